"""Period archives: ledgers partitioned by archive, small manifests beside them.

``<root>/data/archive_id=…/archive_version=…``      ledger rows, Parquet
``<root>/accounts/archive_id=…/archive_version=…``  account names, Parquet
``<root>/meta/archive_id=…/<number>.json``          manifests, one JSON object each

Data folders are written once and never changed.  A manifest names the version that counts from then on; it is written last, with
a create that fails if the file is there.  The manifest with the highest number holds, so a save or delete that stops anywhere
leaves the archive as it was, and of two that meet at one number one fails.  Readers filter and join the data on its
partition columns by the manifests.  (The create must be atomic: it is on HDFS and on stores with conditional writes.)
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
import re
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.money import report_money
from ledgerloom.functions.text import archive_id as archive_id_text
from ledgerloom.operators.dedup import combine_ledgers, in_date_order
from ledgerloom.operators.totals import sum_when

META_SCHEMA = (
    "id string, label string, organization string, notes string, created_at timestamp, "
    "date_range_start timestamp_ntz, date_range_end timestamp_ntz, transaction_count bigint, "
    "account_count bigint, total_revenue decimal(28,2), total_expenses decimal(28,2)"
)

_MANIFEST = f"{META_SCHEMA}, number bigint, version string, deleted boolean"


def describe(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Date range, row count, account count and money totals (transfers counted)."""
    totals = ledger.groupBy(*keys, "account").agg(
        F.min("txn_ts").alias("first_ts"), F.max("txn_ts").alias("last_ts"),
        F.count("*").alias("n"),
        sum_when(F.col("amount") > 0, F.col("amount")).alias("money_in"),
        sum_when(F.col("amount") < 0, -F.col("amount")).alias("money_out"))
    return totals.groupBy(*keys).agg(
        F.min("first_ts").alias("date_range_start"), F.max("last_ts").alias("date_range_end"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("transaction_count"),
        F.count("*").alias("account_count"),
        report_money(F.coalesce(F.sum("money_in"), F.lit(0))).alias("total_revenue"),
        report_money(F.coalesce(F.sum("money_out"), F.lit(0))).alias("total_expenses"))


def _new_id(spark: SparkSession, label: str, created_at: dt.datetime) -> str:
    moment = F.lit(created_at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return spark.range(1).select(archive_id_text(F.lit(label), moment)).first()[0]


def save(ledger: DataFrame, root: str, label: str, *, organization: str = "", notes: str = "",
         created_at: dt.datetime | None = None, archive: str | None = None) -> str:
    """Archive a ledger and return the archive id.  Times of day are cut to the day.

    A new id is one that no archive has or had.  A given ``archive`` id gets a new version, which makes retries
    harmless and lets an edited version of an archive be saved under its own id.  Metadata and account names are
    read back from the stored rows, so the ledger itself is computed once.  ``FileExistsError``: another save or delete of this
    archive came between.
    """
    spark = ledger.sparkSession
    created_at = created_at or dt.datetime.now()
    archive = archive or _claimed(spark, root, _new_id(spark, label, created_at))
    number, version = _last_number(spark, root, archive) + 1, uuid.uuid4().hex
    ledger.withColumn("txn_ts", F.date_trunc("day", "txn_ts").cast("timestamp_ntz")).write.parquet(
        _folder(root, "data", archive, version))
    stored = spark.read.parquet(_folder(root, "data", archive, version))
    has_account = "account" in stored.columns
    if has_account:
        stored.select("account").distinct().write.parquet(_folder(root, "accounts", archive, version))
    else:
        stored = stored.withColumn("account", F.lit(None).cast("string"))
    created = F.lit(created_at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    meta = describe(stored).select(
        F.lit(archive).alias("id"), F.lit(label).alias("label"),
        F.lit(organization).alias("organization"), F.lit(notes).alias("notes"),
        created.alias("created_at"), "date_range_start", "date_range_end", "transaction_count",
        F.when(F.lit(has_account) & (F.col("transaction_count") > 0), F.col("account_count")).otherwise(0)
        .alias("account_count"), "total_revenue", "total_expenses",
        F.lit(number).alias("number"), F.lit(version).alias("version"), F.lit(False).alias("deleted"))
    _commit(spark, root, archive, number, meta.select(F.to_json(F.struct("*"))).first()[0])
    return archive


def _folder(root: str, kind: str, archive: str, version: str) -> str:
    return f"{root}/{kind}/archive_id={archive}/archive_version={version}"


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, path)
    return files.exists(target)


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file; False if it is there already."""
    target, files = _files(spark, path)
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(target):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _manifest_path(root: str, archive: str, number: int) -> str:
    return f"{root}/meta/archive_id={archive}/{number:010d}.json"


def _commit(spark: SparkSession, root: str, archive: str, number: int, text: str) -> None:
    if not _put(spark, _manifest_path(root, archive, number), text):
        raise FileExistsError(f"archive {archive!r} was changed at the same time")


def _last_number(spark: SparkSession, root: str, archive: str) -> int:
    folder, files = _files(spark, f"{root}/meta/archive_id={archive}")
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)


def _claimed(spark: SparkSession, root: str, archive: str) -> str:
    """The id itself, or with the first number that makes it new; taken by a manifest of nothing."""
    names = (archive if n == 1 else f"{archive}-{n}" for n in itertools.count(1))
    return next(n for n in names if _put(spark, _manifest_path(root, n, 0), json.dumps({"id": n, "number": 0, "deleted": True})))


def _current(spark: SparkSession, root: str) -> DataFrame:
    """The manifest that holds of every archive there is; unreadable files are skipped."""
    if not _exists(spark, f"{root}/meta"):
        return spark.createDataFrame([], _MANIFEST)
    written = (spark.read.schema(_MANIFEST).option("mode", "DROPMALFORMED").json(f"{root}/meta")
               .where(F.col("id").isNotNull() & F.col("number").isNotNull()).drop("archive_id"))
    last = written.groupBy("id").agg(F.max_by(F.struct(*written.columns), "number").alias("m"))
    return last.select("m.*").where(~F.col("deleted"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all archives."""
    return _current(spark, root).drop("number", "version", "deleted")


def newest_first(archives: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest archives first, optionally only the first few."""
    ordered = archives.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def list_archives(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    return newest_first(metadata(spark, root), limit)


def selected(archives: DataFrame, ids: Sequence[str]) -> DataFrame:
    return archives.where(F.col("id").isin(*ids))


def _chosen(spark: SparkSession, root: str, ids: Sequence[str]) -> DataFrame:
    """``archive_id``, ``archive_version`` and ``rank`` (place in ``ids``) as a table; an error for ids that aren't there."""
    asked = spark.createDataFrame([(i, rank) for rank, i in enumerate(dict.fromkeys(ids), 1)], "archive_id string, rank int")
    current = _current(spark, root).select(F.col("id").alias("archive_id"), F.col("version").alias("archive_version"))
    missing = asked.join(current, "archive_id", "left_anti").limit(10).collect()
    if missing:
        raise FileNotFoundError("archive " + ", ".join(repr(r["archive_id"]) for r in missing) + " not found")
    return current.join(F.broadcast(asked), "archive_id")  # as many rows as ids were given


def _versions(spark: SparkSession, root: str, kind: str, ids: Sequence[str], merge_schema: bool = False) -> DataFrame:
    """Rows of the chosen archives with ``archive_id`` and ``rank``; the partitions of others are never read."""
    chosen = _chosen(spark, root, ids)
    listed = chosen.orderBy("rank").collect()  # as many rows as ids were given
    reader = spark.read.option("mergeSchema", merge_schema)
    own = ("archive_id", "archive_version")  # text, also where all of them look like numbers
    folders = [_folder(root, kind, r["archive_id"], r["archive_version"]) for r in (listed if merge_schema else listed[:1])]
    schema = StructType([f for f in reader.parquet(*folders).schema if f.name not in own])
    for name in own:
        schema = schema.add(name, "string")
    rows = reader.schema(schema).parquet(f"{root}/{kind}")
    rows = rows.where(F.col("archive_version").isin([r["archive_version"] for r in listed]))  # old versions may differ in columns
    return rows.join(F.broadcast(chosen), list(own)).drop("archive_version")


def account_names(spark: SparkSession, root: str, ids: Sequence[str]) -> DataFrame:
    """``archive_id, account`` of the given archives."""
    return _versions(spark, root, "accounts", ids).select("archive_id", "account")


def date_range(archives: DataFrame) -> DataFrame:
    """Overall range of archive metadata as text, ``N/A`` where there is none."""
    starts, ends = F.min("date_range_start"), F.max("date_range_end")
    known = starts.isNotNull() & ends.isNotNull()

    def text(value: Column) -> Column:
        return F.when(known, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("N/A")

    return archives.agg(text(starts).alias("date_range_start"), text(ends).alias("date_range_end"))


def load(spark: SparkSession, root: str, archive: str) -> tuple[DataFrame, Row]:
    """Ledger and metadata of one archive.  Only that archive's folder is read."""
    ledger = _versions(spark, root, "data", [archive]).drop("archive_id", "rank")
    return ledger, metadata(spark, root).where(F.col("id") == archive).first()


def load_many(spark: SparkSession, root: str, ids: Sequence[str], *,
              ordered: bool = True, merge_schema: bool = False) -> DataFrame:
    """Union of archives, overlapping transactions once, from the first selected archive.

    ``merge_schema`` reads every file footer; it is only needed when archives differ in
    their columns.
    """
    if not ids:
        return spark.createDataFrame([], "txn_ts timestamp_ntz, description string, "
                                         "amount decimal(28,4), category string")
    ledgers = _versions(spark, root, "data", ids, merge_schema)
    ties = [c for c in ("source_file", "row_id") if c in ledgers.columns]
    combined = combine_ledgers(ledgers, ["rank", *ties]).drop("archive_id", "rank")
    return in_date_order(combined) if ordered else combined


def delete(spark: SparkSession, root: str, archive: str) -> bool:
    """Drop an archive: a manifest says so first, then its folders go.  True if there was one."""
    if _current(spark, root).where(F.col("id") == archive).isEmpty():
        return False
    number = _last_number(spark, root, archive) + 1
    _commit(spark, root, archive, number, json.dumps({"id": archive, "number": number, "deleted": True}))
    for kind in ("accounts", "data"):
        target, files = _files(spark, f"{root}/{kind}/archive_id={archive}")
        files.delete(target, True)
    return True


def vacuum(spark: SparkSession, root: str, hours: float = 24) -> int:
    """Remove versions that no manifest holds and that are older than ``hours``; the number of folders removed.

    Saves that have not come to their manifest yet must be younger.
    """
    held = {(r["id"], r["version"]) for r in _current(spark, root).select("id", "version").toLocalIterator()}
    removed, before = 0, (time.time() - hours * 3600) * 1000
    for kind in ("accounts", "data"):
        pattern, files = _files(spark, f"{root}/{kind}/archive_id=*/archive_version=*")
        for found in files.globStatus(pattern) or ():
            path = found.getPath()
            key = (path.getParent().getName().split("=", 1)[1], path.getName().split("=", 1)[1])
            if key not in held and found.getModificationTime() < before:
                removed += files.delete(path, True)
    return removed
