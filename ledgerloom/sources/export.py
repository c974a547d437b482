"""Globally ordered files of bounded size.

Rows are dealt out by ranges of their order columns and sorted inside each range, so that no task sees more than its
share and the files, taken by name, hold all rows in order.  Ranges come from a sample and are only about equal;
``rows_per_file`` bounds every file exactly.  Give order columns that tell all rows apart (a ledger's do):
rows that agree in all of them can't be split and stand in no fixed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER_ORDER = ("txn_ts", "source_file", "row_id")
ROWS_PER_FILE = 1_000_000


def write_ordered(rows: DataFrame, path: str, order: Sequence[str] = LEDGER_ORDER, *, rows_per_file: int = ROWS_PER_FILE,
                  columns: Sequence[str] | None = None, kind: str = "parquet", **options) -> None:
    """Write ``columns`` (default: all) of all rows to an unused ``path``, nulls first.

    The rows are computed three times (counted, sampled, written), the first two without the columns that the order
    doesn't need.  An empty frame gives one empty file.
    """
    ranges = max(1, -(-rows.count() // rows_per_file))
    (rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(*(columns or rows.columns))
     .write.format(kind).options(maxRecordsPerFile=rows_per_file, **options).save(path))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows that :func:`write_ordered` wrote as Parquet, with their ``place`` among all rows, from 1.

    Only one row a file is ever put in order: places are prefix sums over the files' row counts.
    """
    found = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"),
                                            F.col("_metadata.row_index").alias("_at"))
    number = F.regexp_extract("_file", r"part-(\d+)-", 1).cast("int")
    piece = F.regexp_extract("_file", r"-c(\d+)\.", 1).cast("int")
    files = found.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy(number, piece).rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    return (found.join(starts, "_file").withColumn("place", F.col("_start") + F.col("_at") + 1)
            .drop("_file", "_at", "_start"))
