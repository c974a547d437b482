"""From a folder of bank statements to one typed ledger.

``account, txn_ts, description, amount, source_file, row_id, source_path``

``source_path`` and ``row_id`` name a row for good: the whole path of its file, and its place among the file's rows
that aren't blank.  Nothing vanishes unseen: :func:`ingest_report` counts per file what was read, kept and left out and
why, :func:`quarantine` has the rows that were left out, and an ``Observation`` gives the totals of the very scan that
makes the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import one_each, parse_dates
from ledgerloom.functions.money import LEDGER_MONEY, or_zero, read_amount
from ledgerloom.functions.text import account_from_file, strip
from ledgerloom.sources.cells import NULL_TEXTS, null_texts_to_null, raw_cells, scan, utf8_text
from ledgerloom.sources.detect import data_rows, decoded, detect_columns, fill_amounts, override_columns

NO_DATE = "no date"


def _cell(position: Column) -> Column:
    cell = F.get("cells", position)
    return F.when(F.col("utf8"), utf8_text(cell)).otherwise(cell)


def _readable(column: str) -> Column:
    return F.when(~F.col(column).isin(*NULL_TEXTS), F.col(column))


def _signed_amount() -> Column:
    """One money column, or separate debit and credit columns, or the first money found."""
    has_debit, has_credit = F.col("debit_pos").isNotNull(), F.col("credit_pos").isNotNull()
    return (
        F.when(F.col("amount_pos").isNotNull() | ~(has_debit | has_credit), or_zero(F.col("_amount")))
        .when(has_debit & has_credit, or_zero(F.col("_credit")) - or_zero(F.col("_debit")))
        .when(has_debit, -F.abs(or_zero(F.col("_debit"))))
        .otherwise(F.abs(or_zero(F.col("_credit"))))
    ).cast(LEDGER_MONEY)


def _parsed(raw: DataFrame, mapping: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Every row below its file's header: ``_days`` (empty without a date), ``_no_money``, and the parsed cells."""
    if "value_pos" not in mapping.columns:
        mapping = fill_amounts(raw, mapping)
    mapping = mapping.drop("names").withColumns({
        "account": account_from_file(F.col("file_name")),
        # the single money column, or the first one found; null next to debit and credit
        "money_pos": F.coalesce("amount_pos", "value_pos"),
    })
    if accounts is not None:
        named = accounts.select("file_name", F.col("account").alias("_account"))
        mapping = (
            mapping.join(named, "file_name", "left")
            .withColumn("account", F.coalesce("_account", "account")).drop("_account"))
    # one column per step: each text is decoded, checked and parsed once
    texts = data_rows(raw, mapping).withColumns({
        f"_{role}": _cell(F.col(f"{role}_pos"))
        for role in ("date", "desc", "money", "debit", "credit")})
    parsed = texts.withColumns({
        "_date": _readable("_date"), "_desc": _readable("_desc"),
        "_amount": read_amount(F.col("_money")), "_debit": read_amount(F.col("_debit")),
        "_credit": read_amount(F.col("_credit"))})
    return parsed.withColumns({
        "_days": parse_dates("_date"),
        "_no_money": F.coalesce("_amount", "_debit", "_credit").isNull()})


def _figures() -> list[Column]:
    """What became of rows; those without readable money are kept with an amount of 0."""
    dated = F.size("_days") > 0
    return [F.count("*").alias("rows"), F.count_if(dated).alias("kept"), F.count_if(~dated).alias("without_date"),
            F.count_if(dated & F.col("_no_money")).alias("without_money")]


def standardize(raw: DataFrame, mapping: DataFrame, accounts: DataFrame | None = None,
                observation: Observation | None = None) -> DataFrame:
    """Typed rows of all files; rows without a readable date are dropped.

    ``accounts`` (``file_name``, ``account``) names accounts; others are named by their file.  ``observation`` is filled with
    ``rows``, ``kept``, ``without_date`` and ``without_money`` by the first action on the result.
    """
    parsed = _parsed(raw, mapping, accounts)
    if observation is not None:
        parsed = parsed.observe(observation, *_figures())
    return parsed.select(
        "account",
        one_each(F.col("_days")).alias("txn_ts"),
        F.coalesce(strip(F.col("_desc")), F.lit("")).alias("description"),
        _signed_amount().alias("amount"),
        F.col("file_name").alias("source_file"),
        "row_id",
        F.col("file").alias("source_path"),
    )


def _mapped(raw: DataFrame, overrides: DataFrame | None) -> DataFrame:
    mapping = detect_columns(raw)
    return mapping if overrides is None else override_columns(mapping, overrides)


def read_statements(spark: SparkSession, path: str, *, overrides: DataFrame | None = None,
                    accounts: DataFrame | None = None, observation: Observation | None = None) -> DataFrame:
    """Read every statement below ``path`` into one ledger."""
    raw = raw_cells(spark, path)
    return standardize(raw, _mapped(raw, overrides), accounts, observation)


def quarantine(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows that don't become transactions: ``file, file_name, row_id, reason, cells``."""
    return _parsed(raw, mapping).where(F.size("_days") == 0).select(
        "file", "file_name", "row_id", F.lit(NO_DATE).alias("reason"), null_texts_to_null(decoded(F.col("cells"), F.col("utf8"))).alias("cells"))


def ingest_report(spark: SparkSession, path: str, *, overrides: DataFrame | None = None) -> DataFrame:
    """One row a file: ``rows`` below the header, ``kept``, ``without_date``, ``without_money``, or why it was ``skipped``."""
    found = scan(spark, path)
    mapping = _mapped(found.cells, overrides)
    counted = _parsed(found.cells, mapping).groupBy("file").agg(*_figures())
    names = [c for c in counted.columns if c != "file"]
    read = mapping.select("file", "file_name").join(counted, "file", "left").na.fill(0, names)
    skipped = found.skipped.select("file", "file_name", *(F.lit(0).cast("bigint").alias(c) for c in names), F.col("reason").alias("skipped"))
    return read.withColumn("skipped", F.lit(None).cast("string")).unionByName(skipped)
