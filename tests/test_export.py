"""Ordered exports: bounded files, in order by name, places without gaps."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import export


@pytest.mark.parametrize("hot", [False, True])
def test_files_are_bounded_and_in_order(spark, tmp_path, hot):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select(
        (F.lit(7) if hot else F.col("id") * 7919 % 101).alias("day"), (F.col("id") * 31 % 1000).alias("row"),
        F.concat(F.lit("t"), "id").alias("text"))
    export.write_ordered(rows.repartition(5), path, ["day", "row"], rows_per_file=90)
    files = sorted(Path(path).glob("part-*"))
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    assert sum(sizes) == 1000 and max(sizes) <= 90
    found = [(r.place, r.day, r.row, r.text) for r in export.read_ordered(spark, path).orderBy("place").collect()]
    assert found == [(i + 1, *r) for i, r in enumerate(sorted(tuple(r) for r in rows.collect()))]


def test_csv_files_read_one_after_the_other(spark, tmp_path, make_ledger):
    path = str(tmp_path / "out")
    ledger = make_ledger([(f"2026-01-{1 + i * 7 % 28:02}", f"n{i}", i) for i in range(100)])
    export.write_ordered(ledger, path, rows_per_file=30, kind="csv", columns=["txn_ts", "description"])
    lines = [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()]
    wanted = sorted((r.txn_ts, r.row_id, r.description) for r in ledger.collect())
    assert [line.split(",")[1] for line in lines] == [w[2] for w in wanted]


def test_nulls_come_first_and_empty_frames_stay_empty(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (1, "a")], "k int, place_name string")
    export.write_ordered(rows, str(tmp_path / "few"), ["k", "place_name"], rows_per_file=1)
    found = export.read_ordered(spark, str(tmp_path / "few")).orderBy("place").collect()
    assert [(r.place, r.k) for r in found] == [(1, None), (2, 1), (3, 1), (4, 2)]
    export.write_ordered(rows.where("k > 9"), str(tmp_path / "none"), ["k"])
    assert export.read_ordered(spark, str(tmp_path / "none")).collect() == []
