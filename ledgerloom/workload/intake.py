"""Queries that write statement files from the tables and read them back, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.functions.classify import classify
from ledgerloom.functions.money import LEDGER_MONEY
from ledgerloom.operators import edits
from ledgerloom.operators.dedup import union_ledgers
from ledgerloom.session import scratch_path
from ledgerloom.sources import archive, cells, detect, export, statements
from ledgerloom.streaming.accumulate import DELIVERY_SCHEMA, accumulate
from ledgerloom.workload.ledger import deposits, ledger, ledger_sql, table

Query = Callable[[SparkSession, str], DataFrame]

# Date texts: pieces in braces, the seconds after midnight that they name, and how they are read.
MONTH_FIRST, AS_WRITTEN, NO_DAY, NOTHING = "month first", "as written", "first of the month", "no date"
SHAPES = (
    ("{Y}-{MM}-{DD}", 0, AS_WRITTEN), ("{Y}-{M}-{D}", 0, AS_WRITTEN), ("{Y}/{MM}/{DD}", 0, AS_WRITTEN), ("{Y}.{MM}.{DD}", 0, AS_WRITTEN),
    ("{Y}{MM}{DD}", 0, AS_WRITTEN), ("{Y}-{MM}-{DD}T10:00:00Z", 36000, AS_WRITTEN), ("{Y}/{MM}/{DD} 10:00:00", 36000, AS_WRITTEN),
    ("{Y}-{MM}-{DD} 23:59:59.250", 86399, AS_WRITTEN), ("{Y}-{MM}-{DD}T01:02", 3720, AS_WRITTEN),
    ("{Y}-{MM}-{DD} 10:00:00 +02:00", 36000, AS_WRITTEN), ("{MM}/{DD}/{Y}", 0, AS_WRITTEN), ("{M}/{D}/{YY}", 0, AS_WRITTEN),
    ("{M}/{D}/{YY} 3:04 PM", 54240, AS_WRITTEN), ("{MM}/{DD}/{Y} 12:15:30 am", 930, AS_WRITTEN), ("{MM}-{DD}-{Y}", 0, AS_WRITTEN),
    ("{DD}/{MM}/{Y}", 0, MONTH_FIRST), ("{DD}.{MM}.{YY}", 0, MONTH_FIRST), ("{D}-{M}-{Y} 07:08", 25680, MONTH_FIRST),
    ("{MON} {D}, {Y}", 0, AS_WRITTEN), ("{MON} {D} {Y}", 0, AS_WRITTEN), ("{MON} {D}, {Y} 10:00 AM", 36000, AS_WRITTEN),
    ("{MONTH} {D}, {Y}", 0, AS_WRITTEN), ("{DD} {MONTH}, {Y}", 0, AS_WRITTEN), ("{Y} {MON} {D}", 0, AS_WRITTEN),
    ("{DD}-{MON}-{Y}", 0, AS_WRITTEN), ("{D} {MON}. {Y}", 0, AS_WRITTEN), ("{DD}{MON}{Y}", 0, AS_WRITTEN), ("{D}-{MON}-{YY}", 0, AS_WRITTEN),
    ("Friday, {MONTH} {D}th, {Y} at 4pm", 57600, AS_WRITTEN), ("{MON} {Y}", 0, NO_DAY), ("{MM}/{Y}", 0, NO_DAY),
    ("on {Y}-{MM}-{DD}", 0, NOTHING), ("{M}/{D}", 0, NOTHING), ("{Y}", 0, NOTHING), ("{D}.{MM}", 0, NOTHING), ("{Y}-{MM}-41", 0, NOTHING),
    ("{Y}-{MM}-{DD} 24:10", 0, NOTHING), ("{M}/{D}-{Y}", 0, NOTHING), ("{M} {D} {Y}", 0, NOTHING),
)

# --- fixed values: month names, each in nine places -------------------------------------
_LONG = "January  February March    April    May      June     July     August   SeptemberOctober  November December "
_SHORT = "JanFebMarAprMayJunJulAugSepOctNovDec"
_PIECES = {
    "Y": "CAST(y AS VARCHAR(4))", "YY": "SUBSTR(CAST(y AS VARCHAR(4)), 3, 2)", "M": "CAST(m AS VARCHAR(2))",
    "MM": "LPAD(CAST(m AS VARCHAR(2)), 2, '0')", "D": "CAST(d AS VARCHAR(2))", "DD": "LPAD(CAST(d AS VARCHAR(2)), 2, '0')",
    "MON": f"SUBSTR('{_SHORT}', 3 * m - 2, 3)", "MONTH": f"RTRIM(SUBSTR('{_LONG}', 9 * m - 8, 9))",
}


def _shape_text(shape: str) -> str:
    pieces = [f"'{p}'" if i % 2 == 0 else _PIECES[p] for i, p in enumerate(re.split(r"\{(\w+)\}", shape)) if p]
    return f"CONCAT({', '.join(pieces)})"


def shape_text_sql() -> str:
    """The text of a date in the shape of its order; both engines read it."""
    branches = " ".join(f"WHEN {k} THEN {_shape_text(shape)}" for k, (shape, _, _) in enumerate(SHAPES))
    return f"CASE o_orderkey % {len(SHAPES)} {branches} END"


_DATE_PARTS = ("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS m, "
               "CAST(EXTRACT(DAY FROM o_orderdate) AS INTEGER) AS d FROM orders")


def _shapes_sql() -> str:
    day = {AS_WRITTEN: "make_date(y, m, d)", MONTH_FIRST: "CASE WHEN d <= 12 THEN make_date(y, d, m) ELSE make_date(y, m, d) END",
           NO_DAY: "make_date(y, m, 1)", NOTHING: "NULL"}
    days = " ".join(f"WHEN {k} THEN {day[how]}" for k, (_, _, how) in enumerate(SHAPES))
    seconds = " ".join(f"WHEN {k} THEN {'NULL' if how == NOTHING else s}" for k, (_, s, how) in enumerate(SHAPES))
    return (f"SELECT o_orderkey, {shape_text_sql()} AS text, CASE o_orderkey % {len(SHAPES)} {days} END AS day, "
            f"CAST(CASE o_orderkey % {len(SHAPES)} {seconds} END AS INTEGER) AS seconds FROM ({_DATE_PARTS})")


def parse_date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in many shapes, some of them no dates."""
    parts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "year(o_orderdate) AS y", "month(o_orderdate) AS m", "day(o_orderdate) AS d")
    found = parts.select("o_orderkey", F.expr(shape_text_sql()).alias("text")).withColumn("ts", dates.parse_date("text"))
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return found.select("o_orderkey", "text", F.col("ts").cast("date").alias("day"), seconds.cast("int").alias("seconds"))


def _cell(text):
    """A CSV cell."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _line(*texts):
    return F.concat_ws(",", *texts)


def _write_lines(lines: DataFrame, folder: str) -> None:
    """``f`` (folder), ``place`` (order in its file), ``line``: one CSV file a folder."""
    (lines.repartition("f").sortWithinPartitions("f", "place").select("f", "line")
     .write.partitionBy("f").text(folder))
    _named(lines.sparkSession, folder)


def _named(spark: SparkSession, folder: str) -> None:
    """Files of lines become ``statement.csv`` in their folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(path(f"{folder}/*/part-*.txt")):
        old = found.getPath()
        files.rename(old, path(old.getParent(), "statement.csv"))


def _plain_lines(rows: DataFrame) -> DataFrame:
    return rows.select("account", "row_id", _line(F.date_format("txn_ts", "yyyy-MM-dd"), _cell(F.col("description")), F.col("amount").cast("string")).alias("line"))


def _tops(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "f string, place bigint, line string")


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the files of five folders, one of them with a quote that never ends and one of another kind."""
    folder = scratch_path(spark, "statements")
    rows = deposits(spark, sf_dir)
    day, amount = F.date_format("txn_ts", "MM/dd/yyyy"), F.col("amount").cast("string")
    key = F.col("row_id")
    headed = {
        "good": rows.where("account = 'ACCT-0'").select(day.alias("Date"), F.col("description").alias("Memo"), amount.alias("Amount")),
        "undated": rows.where("account = 'ACCT-1'").select(
            F.when(key % 5 == 0, "pending").otherwise(day).alias("Date"), F.col("description").alias("Memo"), amount.alias("Amount")),
        "unpaid": rows.where("account = 'ACCT-2'").select(
            F.when(key % 11 == 0, "pending").otherwise(day).alias("Date"), F.col("description").alias("Memo"),
            F.when(key % 7 == 0, "see note").otherwise(amount).alias("Amount")),
    }
    for name, layout in headed.items():
        layout.write.option("header", True).csv(f"{folder}/{name}")
    lines = _plain_lines(rows.where("account = 'ACCT-0'"))
    last = lines.agg(F.max("row_id")).first()[0]
    lines = lines.select(F.lit("open").alias("f"), F.col("row_id").alias("place"),
                         F.when(F.col("row_id") == F.lit(last), F.lit('1/2/2026,"never closed,5')).otherwise(F.col("line")).alias("line"))
    _write_lines(lines.unionByName(_tops(spark, [("open", -1, "Date,Memo,Amount")])), f"{folder}/lines")
    rows.select("account", "row_id").write.json(f"{folder}/other")
    found = statements.ingest_report(spark, folder)
    named = F.regexp_extract("file", r"/(?:lines/f=)?(\w+)/[^/]*$", 1)
    return found.groupBy(named.alias("folder")).agg(
        *(F.sum(c).alias(c) for c in ("rows", "kept", "without_date", "without_money")), F.max("skipped").alias("skipped"))


def ingest_header_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files: banner rows above the header, a blank name row above it, and one row of nine cells."""
    folder = scratch_path(spark, "statements")
    rows = deposits(spark, sf_dir)
    lines = _plain_lines(rows)
    first = lines.where("account = 'ACCT-2'").agg(F.min("row_id")).first()[0]
    ragged = (F.col("account") == "ACCT-2") & (F.col("row_id") == F.lit(first))
    lines = lines.select(F.col("account").alias("f"), F.col("row_id").alias("place"),
                         F.when(ragged, F.concat("line", F.lit(",more,cells,than,the,others,9"))).otherwise(F.col("line")).alias("line"))
    tops = [("ACCT-0", -3, "My Bank"), ("ACCT-0", -2, "Statement"), ("ACCT-0", -1, "Date,Description,Amount"),
            ("ACCT-1", -2, ",,"), ("ACCT-1", -1, "Date,,Amount"), ("ACCT-2", -1, "Date,Description,Amount")]
    _write_lines(lines.unionByName(_tops(spark, tops)), folder)
    return _rows(statements.read_statements(spark, folder))


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("txn_ts").cast("date").alias("txn_date"), "description", F.col("amount").cast("double").alias("amount"))


def ingest_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with two columns of one name: the first holds a balance, the user takes the second, and a note for the text."""
    folder = scratch_path(spark, "statements")
    rows = deposits(spark, sf_dir).where("account <> 'ACCT-0'")
    lines = rows.select(F.col("account").alias("f"), F.col("row_id").alias("place"), _line(
        F.date_format("txn_ts", "MMM d yyyy"), F.lit("transfer"), F.lit("9999.99"), F.col("amount").cast("string"), _cell(F.col("description"))).alias("line"))
    top = "Posting Date,Details,Amount,Amount,Note"
    _write_lines(lines.unionByName(_tops(spark, [("ACCT-1", -1, top), ("ACCT-2", -1, top)])), folder)
    raw = cells.raw_cells(spark, folder)
    mapping = detect.detect_columns(raw)
    chosen = mapping.select("file", F.lit("Amount.1").alias("amount"), F.lit("Note").alias("desc"))
    return _rows(statements.standardize(raw, detect.override_columns(mapping, chosen)))


def overrides_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits made of one file's rows still name them after another file of the same name has come."""
    folder = scratch_path(spark, "statements")
    lines = _plain_lines(deposits(spark, sf_dir)).select(F.col("account").alias("f"), F.col("row_id").alias("place"), "line")
    top = "Date,Description,Amount"
    _write_lines(lines.where("f = 'ACCT-1'").unionByName(_tops(spark, [("ACCT-1", -1, top)])), f"{folder}/first")
    made = statements.read_statements(spark, folder).where("description = 'Gala ticket sale'")
    changes = made.select("source_path", "row_id", F.lit("Supplies & Materials").alias("category"))
    _write_lines(lines.where("f = 'ACCT-0'").unionByName(_tops(spark, [("ACCT-0", -1, top)])), f"{folder}/a second one")
    edited = edits.override_categories(classify(statements.read_statements(spark, folder)), changes)
    return edited.select(
        F.col("txn_ts").cast("date").alias("txn_date"), "description", F.col("amount").cast("double").alias("amount"), "category")


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive a year and account group; one deleted, one saved again, some loaded by their metadata, one alone."""
    root = scratch_path(spark, "archives")
    rows = classify(deposits(spark, sf_dir))
    made = {}
    for year in (1996, 1997, 1998, 1999):
        made[year] = archive.save(rows.where(F.year("txn_ts") == year), root, f"Year {year}", organization="Test League")
    archive.delete(spark, root, made[1997])
    edited = archive.load(spark, root, made[1998])[0]
    archive.save(edited.where("account <> 'ACCT-0'"), root, "Year 1998", archive=made[1998])
    listed = archive.list_archives(spark, root).where("transaction_count > 0 and label <> 'Year 1999'")
    found = archive.load_many(spark, root, [r["id"] for r in listed.select("id").collect()], ordered=False)
    alone, meta = archive.load(spark, root, made[1999])
    alone = alone.where("account = 'ACCT-1'").withColumn("label", F.lit(meta.label))
    whole = found.withColumn("label", F.concat(F.lit("Year "), F.year("txn_ts").cast("string"))).unionByName(alone)
    names = archive.account_names(spark, root, [made[1998], made[1999]]).select("account").distinct()
    return whole.join(names, "account", "left_semi").select(
        "label", F.col("txn_ts").cast("date").alias("txn_date"), "description", F.col("amount").cast("double").alias("amount"), "category")


def ingest_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names give no roles: columns without names for date and text, none for money, and a date named value."""
    folder = scratch_path(spark, "statements")
    rows = deposits(spark, sf_dir)
    day, amount, key = F.date_format("txn_ts", "yyyy-MM-dd"), F.col("amount").cast("string"), F.col("row_id")
    account = F.col("account")
    lines = rows.select(account.alias("f"), key.alias("place"), F.when(account == "ACCT-0", _line(
        # a column that is filled late and seldom, and a code too short for a text, come before the text
        F.when(key % 97 == 0, "mark").otherwise(""), F.concat(F.lit("r"), (key % 100).cast("string")), day, amount, _cell(F.col("description"))))
        .when(account == "ACCT-1", _line(day, F.lit("none"), _cell(F.col("description")), amount))
        .otherwise(_line(day, _cell(F.col("description")), amount)).alias("line"))
    tops = [("ACCT-0", -1, "A,B,When,Amount,What"), ("ACCT-1", -1, "Booked on date,Kind,Payee,Paid"),
            ("ACCT-2", -1, "Value Date,Narrative,Amount")]
    _write_lines(lines.unionByName(_tops(spark, tops)), folder)
    found = statements.read_statements(spark, folder)
    return found.groupBy(F.regexp_extract("source_path", "f=([^/]*)/", 1).alias("folder"), "description").agg(
        F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"),
        F.min("txn_ts").cast("date").alias("first_day"), F.max("txn_ts").cast("date").alias("last_day"))


#: The derived row ids occur more than once, so what a row says settles ties; rows equal in all of it are the same.
EXPORT_ORDER = (*export.LEDGER_ORDER, "account", "description", "amount")


def ordered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole classified ledger as files in date order, read back with every row's place."""
    path = scratch_path(spark, "export")
    export.write_ordered(classify(ledger(spark, sf_dir)), path, EXPORT_ORDER, rows_per_file=20_000,
                         columns=["txn_ts", "account", "description", "amount", "category", "functional"])
    return export.read_ordered(spark, path).select(
        "place", F.col("txn_ts").cast("date").alias("txn_date"), "account", "description",
        F.col("amount").cast("double").alias("amount"), "category")


def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries that overlap by half, the last after a restart; what the archives hold isn't combined any more."""
    landing, root, checkpoint = (scratch_path(spark, name) for name in ("landing", "archives", "stream"))
    fields = [f.split()[0] for f in DELIVERY_SCHEMA.split(", ")]
    rows = ledger(spark, sf_dir).withColumn("amount", F.col("amount").cast(LEDGER_MONEY)).select(*fields)
    for number in range(3):
        rows.where((F.col("row_id") % 4).isin(number, number + 1)).write.mode("append").parquet(landing)
        if number:
            accumulate(spark, landing, root, checkpoint, once=True).awaitTermination()
    ids = [r["id"] for r in archive.list_archives(spark, root).select("id").collect()]  # two
    stored = [archive.load(spark, root, i)[0] for i in ids]
    return union_ledgers(*stored).groupBy("account", "category").agg(
        F.count("*").alias("n"), F.sum("amount").cast("double").alias("net"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (ingest_fallbacks, ordered_export, stream_first_sightings, archive_roundtrip, parse_date_shapes, ingest_report, ingest_header_recovery, ingest_overrides, overrides_ingested)}


def oracle_sql(classified: str) -> dict[str, str]:
    """``classified``: SQL of the ledger with its categories, see ``oracle``."""
    day = "CAST(txn_ts AS DATE) AS txn_date, description, CAST(amount AS DOUBLE) AS amount"
    rows = f"WITH ledger AS ({ledger_sql()}) SELECT {day} FROM ledger WHERE source_file = 'orders'"

    def folder(name: str, account: str, undated: str, unpaid: str) -> str:
        return (f"SELECT '{name}' AS folder, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (NOT ({undated})) AS BIGINT) AS kept, "
                f"CAST(count(*) FILTER ({undated}) AS BIGINT) AS without_date, CAST(count(*) FILTER (NOT ({undated}) AND ({unpaid})) AS BIGINT) "
                f"AS without_money, NULL AS skipped FROM ledger WHERE source_file = 'orders' AND account = '{account}'")

    def skipped(name: str, reason: str) -> str:
        return f"SELECT '{name}', 0, 0, 0, 0, '{reason}'"

    return {
        "parse_date_shapes": _shapes_sql(),
        "ingest_report": f"WITH ledger AS ({ledger_sql()}) " + " UNION ALL ".join((
            folder("good", "ACCT-0", "false", "false"), folder("undated", "ACCT-1", "row_id % 5 = 0", "false"),
            folder("unpaid", "ACCT-2", "row_id % 11 = 0", "row_id % 7 = 0"),
            skipped("open", cells.UNCLOSED), skipped("other", cells.OTHER_KIND))),
        "ingest_header_recovery": rows,
        "ingest_fallbacks": f"WITH ledger AS ({ledger_sql()}) SELECT account AS folder, description, count(*) AS n, "
                            "CAST(sum(CASE WHEN account = 'ACCT-2' THEN 0 ELSE amount END) AS DOUBLE) AS amount, "
                            "CAST(min(txn_ts) AS DATE) AS first_day, CAST(max(txn_ts) AS DATE) AS last_day "
                            "FROM ledger WHERE source_file = 'orders' GROUP BY account, description",
        "ordered_export": f"{classified} SELECT row_number() OVER (ORDER BY {', '.join(EXPORT_ORDER)}) AS place, CAST(txn_ts AS DATE) AS txn_date, "
                          "account, description, CAST(amount AS DOUBLE) AS amount, category FROM classified",
        "stream_first_sightings": f"{classified}, once AS (SELECT DISTINCT account, txn_ts, description, amount, category FROM classified) "
                                  "SELECT account, category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS net FROM once GROUP BY account, category",
        "ingest_overrides": f"{rows} AND account <> 'ACCT-0'",
        "archive_roundtrip": f"{classified}, once AS (SELECT DISTINCT account, txn_ts, description, amount, category FROM classified "
                             "WHERE source_file = 'orders' AND (year(txn_ts) = 1996 OR (year(txn_ts) = 1998 AND account <> 'ACCT-0'))), "
                             "alone AS (SELECT account, txn_ts, description, amount, category FROM classified WHERE source_file = 'orders' "
                             "AND year(txn_ts) = 1999 AND account = 'ACCT-1') SELECT CONCAT('Year ', CAST(year(txn_ts) AS VARCHAR)) AS label, "
                             f"{day}, category FROM (SELECT * FROM once UNION ALL SELECT * FROM alone)",
        "overrides_ingested": f"{classified} SELECT {day}, CASE WHEN account = 'ACCT-1' AND description = 'Gala ticket sale' "
                              "THEN 'Supplies & Materials' ELSE category END AS category FROM classified "
                              "WHERE source_file = 'orders' AND account <> 'ACCT-2'",
    }
