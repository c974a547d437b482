"""What several operators share: reading tables, running over Arrow batches, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WHITE_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the decimal text of an id; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str | StructType, rows: int = 1000) -> DataFrame:
    """Apply a function to slices of at most ``rows`` rows; it returns a batch or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (A-Z lower-cased, between ASCII white space) of all texts side by side, and the number of words of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    # White space at the ends of a text leaves empty words.
    some = pc.binary_length(words).to_numpy() > 0
    if not some.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        words = words.filter(pa.array(some))
    return words.cast(pa.binary()), sizes


def slices_of(batch: pa.RecordBatch | pa.Table, size: int) -> Iterator:
    """Rows of about ``size`` bytes of texts together, or one."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // size
    bounds = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for low, high in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
        yield batch.slice(low, high - low)


def signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed long, the bits unchanged."""
    return np.ascontiguousarray(hashes, np.uint64).view(np.int64)


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start..start+length of every pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def smallest(hashes: DataFrame, size: int) -> list[int]:
    """The ``size`` smallest distinct values of the hash column ``h``, in order.

    A cut-off from an estimate of their number goes first, so that only a few times as many reach the driver.
    """
    distinct = hashes.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    share = min(1.0, 3 * (size + 100) / max(1, distinct))
    cut = min(2**63 - 1, -(2**63) + int(share * 2**64))
    return [r["h"] for r in hashes.where(F.col("h") <= F.lit(cut)).select("h").distinct().orderBy("h").limit(size).collect()]
