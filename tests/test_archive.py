import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.classify import classify
from ledgerloom.operators import dedup
from ledgerloom.operators.edits import override_categories
from ledgerloom.sources import archive
from ledgerloom.streaming.accumulate import accumulate


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "archives")


def test_save_list_load_delete(spark, root, make_ledger):
    ledger = classify(make_ledger([("2026-01-02T10:30:00", "gift", 10, "A"),
                                   ("2026-01-20", "rent", -4, "B"),
                                   ("2026-01-21", "transfer to x", -1, "B")]))
    assert archive.list_archives(spark, root).count() == 0
    one = archive.save(ledger, root, "Jan/2026", organization="Org", notes="n",
                       created_at=dt.datetime(2026, 2, 1, 9, 8, 7))
    assert one == "Jan_2026_20260201_090807"
    two = archive.save(ledger.where("account = 'A'"), root, "Only A",
                       created_at=dt.datetime(2026, 3, 1))
    assert [r.id for r in archive.list_archives(spark, root).collect()] == [two, one]
    assert archive.list_archives(spark, root, limit=1).count() == 1
    rows, meta = archive.load(spark, root, one)
    assert (meta.transaction_count, meta.account_count, meta.label) == (3, 2, "Jan/2026")
    assert (float(meta.total_revenue), float(meta.total_expenses)) == (10, 5)
    assert meta.date_range_start == dt.datetime(2026, 1, 2)
    assert rows.where("description = 'gift'").first().txn_ts == dt.datetime(2026, 1, 2)
    assert sorted(r.account for r in archive.account_names(spark, root, [one]).collect()) == ["A", "B"]
    with open(f"{root}/meta/archive_id={two}/bad.json", "w") as f:
        f.write("{broken")
    assert archive.list_archives(spark, root).count() == 2
    assert archive.selected(archive.metadata(spark, root), [two]).count() == 1
    span = archive.date_range(archive.metadata(spark, root)).first()
    assert list(span) == ["2026-01-02T00:00:00", "2026-01-21T00:00:00"]
    assert archive.delete(spark, root, one) and not archive.delete(spark, root, one)
    with pytest.raises(FileNotFoundError):
        archive.load(spark, root, one)
    assert [r.id for r in archive.list_archives(spark, root).collect()] == [two]


def test_no_archives(spark, root):
    assert list(archive.date_range(archive.metadata(spark, root)).first()) == ["N/A", "N/A"]
    assert archive.load_many(spark, root, []).isEmpty()


def test_first_archive_wins(spark, root, make_ledger):
    rows = [("2026-01-01", "a", 1), ("2026-01-01", "a", 1), ("2026-01-02", "b", 2)]
    first = make_ledger(rows).withColumn("category", F.lit("first"))
    second = make_ledger(rows[2:] + [("2026-01-03", "c", 3)]).withColumn("category", F.lit("second"))
    ids = [archive.save(df, root, name, created_at=dt.datetime(2026, 1, day))
           for day, (name, df) in enumerate((("z", first), ("a", second)), start=1)]
    found = [(r.description, r.category) for r in archive.load_many(spark, root, ids).collect()]
    assert found == [("a", "first"), ("b", "first"), ("c", "second")]
    turned = archive.load_many(spark, root, ids[::-1])
    assert [(r.description, r.category) for r in turned.collect()] == [
        ("a", "first"), ("b", "second"), ("c", "second")]
    again = dedup.combine_ledgers(turned, ["source_file", "row_id"])
    assert again.count() == turned.count() == 3


def test_other_account_is_another_transaction(make_ledger):
    both = make_ledger([("2026-01-01", "a", 1, "A"), ("2026-01-01", "a", 1, "B")])
    assert dedup.combine_ledgers(both, ["row_id"]).count() == 2
    assert dedup.combine_ledgers(both.drop("account"), ["row_id"]).count() == 1


def test_hot_duplicate_is_reduced_before_the_shuffle(spark):
    rows = spark.range(3000).select(
        F.lit("2026-01-01").cast("timestamp_ntz").alias("txn_ts"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("description"),
        F.lit(1).cast("decimal(28,4)").alias("amount"), F.col("id").alias("row_id"))
    kept = dedup.combine_ledgers(rows, ["row_id"])
    assert kept.count() == 2001 and kept.where("description = 'same'").first().row_id == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_without_accounts(spark, root, make_ledger):
    ledger = make_ledger([("2026-01-01", "a", 1)]).drop("account")
    saved = archive.save(ledger, root, "x")
    assert archive.load(spark, root, saved)[1].account_count == 0
    assert archive.load_many(spark, root, [saved]).count() == 1


def test_stream(spark, root, make_ledger, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    make_ledger([("2026-01-01", "gift", 1), ("2026-01-02", "rent", -1)]).write.parquet(landing)
    accumulate(spark, landing, root, checkpoint).awaitTermination()
    make_ledger([("2026-01-02", "rent", -1), ("2026-02-01", "gift", 5)]).write.mode("append").parquet(
        landing)
    accumulate(spark, landing, root, checkpoint).awaitTermination()
    accumulate(spark, landing, root, checkpoint).awaitTermination()  # nothing new
    ids = [r.id for r in archive.list_archives(spark, root).orderBy("id").collect()]
    assert len(ids) == 2
    combined = archive.load_many(spark, root, ids)
    assert [(r.description, r.category) for r in combined.collect()] == [
        ("gift", "Donations & Contributions"), ("rent", "Facilities & Occupancy"),
        ("gift", "Donations & Contributions")]


def test_stream_keeps_first_sightings(spark, root, make_ledger, tmp_path):
    """Overlapping deliveries, a restart and a batch that runs twice: every transaction is stored once."""
    landing, checkpoint = str(tmp_path / "landing"), tmp_path / "checkpoint"
    days = [("2026-01-01", "gift", 1), ("2026-01-02T08:30:00", "rent", -1), ("2026-01-02", "rent", -1), ("2026-01-03", None, 4)]

    def deliver(rows):
        make_ledger(rows).coalesce(1).write.mode("append").parquet(landing)
        accumulate(spark, landing, root, str(checkpoint), once=True).awaitTermination()

    deliver(days[:3])
    deliver(days[1:] + [("2026-02-01", "gift", 5)])
    for commit in (checkpoint / "commits").glob("*1*"):  # the second batch didn't get to its commit
        commit.unlink()
    deliver(days + [("2026-02-01", "gift", 5)] * 3 + [("2026-02-02", "fee", -2)])
    ids = [r.id for r in archive.list_archives(spark, root).orderBy("id").collect()]
    stored = [[(r.txn_ts.isoformat()[:10], r.description, r.row_id) for r in archive.load(spark, root, i)[0].orderBy("txn_ts").collect()]
              for i in ids]
    assert stored == [[("2026-01-01", "gift", 0), ("2026-01-02", "rent", 1)], [("2026-01-03", None, 2), ("2026-02-01", "gift", 3)],
                      [("2026-02-02", "fee", 7)]]


def test_ids_that_look_like_numbers(spark, root, make_ledger):
    for name, category in (("0007", "a"), ("0003", "b")):
        archive.save(make_ledger([("2026-01-01", "x", 1)]).withColumn("category", F.lit(category)), root, "l", archive=name)
    for ids in (["0007", "0003"], ["0003", "0007"]):
        assert archive.load_many(spark, root, ids).first().category == {"0007": "a", "0003": "b"}[ids[0]]


def test_edit_in_place_and_same_second(spark, root, make_ledger):
    moment = dt.datetime(2026, 1, 1, 10)
    first = archive.save(make_ledger([("2026-01-01", "x", 1)]), root, "same", created_at=moment)
    second = archive.save(make_ledger([("2026-01-01", "y", 2)]), root, "same", created_at=moment)
    assert first != second and archive.metadata(spark, root).count() == 2
    edited = archive.load(spark, root, first)[0].withColumn("amount", F.col("amount") + 1)
    archive.save(edited, root, "same", archive=first)
    assert archive.load(spark, root, first)[0].first().amount == 2
    assert archive.load(spark, root, second)[0].first().amount == 2


def test_one_edit_of_a_row_counts(spark, make_ledger):
    ledger = make_ledger([("2026-01-01", "x", 1), ("2026-01-01", "y", 1)]).withColumn("category", F.lit("old"))
    edits = spark.createDataFrame([("test", 0, "b", 2), ("test", 0, "z", 1)], "source_file string, row_id long, category string, edited_at int")
    assert sorted((r.row_id, r.category) for r in override_categories(ledger, edits).collect()) == [(0, "b"), (1, "old")]


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["describe", "_commit", "_put"])
def test_a_save_that_stops_leaves_the_old_archive(spark, root, make_ledger, monkeypatch, step):
    saved = archive.save(make_ledger([("2026-01-01", "old", 1)]), root, "x")

    def stop(*_):
        raise Stop
    with monkeypatch.context() as patch:
        patch.setattr(archive, step, stop)
        with pytest.raises(Stop):
            archive.save(make_ledger([("2026-01-01", "new", 2)]), root, "x", archive=saved)
        if step != "describe":
            with pytest.raises(Stop):
                archive.delete(spark, root, saved)
    rows, meta = archive.load(spark, root, saved)
    assert [r.description for r in rows.collect()] == ["old"] and meta.total_revenue == 1
    with open(archive._manifest_path(root, saved, 2), "w") as f:  # a manifest of which only a part was written
        f.write('{"id": "' + saved)
    assert archive.load(spark, root, saved)[0].count() == 1
    archive.save(make_ledger([("2026-01-01", "new", 2)]), root, "x", archive=saved)
    assert [r.description for r in archive.load(spark, root, saved)[0].collect()] == ["new"]
    assert archive.vacuum(spark, root) == 0 and archive.vacuum(spark, root, hours=-1) >= 2
    assert archive.load_many(spark, root, [saved]).count() == 1


def test_two_saves_at_once(spark, root, make_ledger, monkeypatch):
    saved = archive.save(make_ledger([("2026-01-01", "old", 1)]), root, "x")
    first = archive._last_number(spark, root, saved)
    archive.save(make_ledger([("2026-01-01", "other", 1)]), root, "x", archive=saved)
    monkeypatch.setattr(archive, "_last_number", lambda *_: first)  # as seen before the other save
    with pytest.raises(FileExistsError):
        archive.save(make_ledger([("2026-01-01", "late", 1)]), root, "x", archive=saved)
    assert archive.load(spark, root, saved)[0].first().description == "other"
    moment = dt.datetime(2026, 1, 1)
    monkeypatch.setattr(archive, "_new_id", lambda *_: "same")
    ids = {archive.save(make_ledger([("2026-01-01", n, 1)]), root, "y", created_at=moment) for n in "ab"}
    assert len(ids) == 2 and archive.load_many(spark, root, sorted(ids)).count() == 2


def test_other_archives_are_pruned(spark, root, make_ledger):
    ids = [archive.save(make_ledger([("2026-01-01", n, 1)]), root, n) for n in "abc"]
    plan = archive.load_many(spark, root, ids[:1], ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "archive_version" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(FileNotFoundError, match="nothing"):
        archive.load_many(spark, root, [ids[0], "nothing"])
