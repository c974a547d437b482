"""One query per operator group, each over the whole derived ledger."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerloom.functions import classify, dates, money, text
from ledgerloom.operators import edits, filters
from ledgerloom.operators.totals import category_totals
from ledgerloom.plans import dashboard, form990, reports, statements
from ledgerloom.session import scratch_path
from ledgerloom.sources import archive
from ledgerloom.sources.statements import read_statements
from ledgerloom.streaming.accumulate import DELIVERY_SCHEMA, accumulate
from ledgerloom.workload import intake
from ledgerloom.workload.ledger import deposits, ledger, table, withdrawals

Query = Callable[[SparkSession, str], DataFrame]

BALANCES = {"beginning_cash": 10_000, "other_assets": 2_500, "liabilities": 1_200}
NET_ASSETS = 5_000


def plain(df: DataFrame) -> DataFrame:
    """Money as double, timestamps as date, the types both engines compare alike."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _rows(df: DataFrame) -> DataFrame:
    return plain(df.select("account", F.col("txn_ts").cast("date").alias("txn_date"),
                           "description", "amount"))


def _on_ledger(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(report(ledger(spark, sf_dir)))


def categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify.classify(ledger(spark, sf_dir))
    return plain(classified.select(
        "account", F.col("txn_ts").cast("date").alias("txn_date"), "description", "amount",
        "category", "functional", "category_type"))


def categorize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = category_totals(ledger(spark, sf_dir))
    return plain(totals.select(
        "category", classify.functional_class().alias("functional"), "n",
        money.report_money(F.col("money_in") - F.col("money_out")).alias("net")))


def category_type_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        category_totals(ledger(spark, sf_dir))
        .groupBy(classify.parent_category().alias("parent"),
                 classify.category_type().alias("category_type"))
        .agg(F.sum("n").alias("n"))
    )


def activities_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = statements.activities(ledger(spark, sf_dir), ["account"])
    return plain(lines.where(~F.col("section").isin("revenue", "expenses")
                             | F.col("is_total")).select("account", "line_key", "amount"))


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large deposits relabelled as supplies: a positive amount in an expense category."""
    classified = classify.classify(ledger(spark, sf_dir))
    corrections = (
        deposits(spark, sf_dir).where(F.col("amount") > 400_000)
        .select("source_file", "row_id", F.lit("Supplies & Materials").alias("category")))
    return edits.override_categories(classified, corrections)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(statements.activities(_overridden(spark, sf_dir)).select(
        "section", "label", "amount"))


def filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.search(
        classify.with_category(ledger(spark, sf_dir)), text="ROAD|fee",
        categories=("Program Services: Travel Tournament", "Management & General"),
        accounts=("ACCT-0", "ACCT-2"))
    return plain(found.select(
        "account", F.col("txn_ts").cast("date").alias("txn_date"), "description", "amount",
        "category"))


def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.counts(ledger(spark, sf_dir), F.year("txn_ts") == 1997)


def transaction_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify.classify(ledger(spark, sf_dir))
    detail = reports.transaction_detail(classified)
    return plain(detail.withColumn("amount_text", money.currency_text(F.col("amount"))))


def displayed_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports.displayed(statements.activities(ledger(spark, sf_dir)))
    return lines.select("label", "display", "indented", "amount_text", "is_total")


def displayed_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = form990.worksheet(
        ledger(spark, sf_dir), beginning_net_assets=NET_ASSETS, **BALANCES)
    return plain(reports.displayed_worksheet(lines).select(
        "part", "section", "line_key", "line_number", "amount", "amount_text"))


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.headings(ledger(spark, sf_dir), "Test League", ["account"])


def archive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger in three archives, two overlapping, one holding an account's rows twice."""
    root = scratch_path(spark, "archives")
    rows = ledger(spark, sf_dir)
    first = filters.between(rows, dt.date(1900, 1, 1), dt.date(1996, 6, 30))
    second = filters.between(rows, dt.date(1996, 4, 1), dt.date(1996, 12, 31))
    third = filters.between(rows, dt.date(1997, 1, 1), dt.date(2100, 1, 1))
    doubled = first.unionByName(filters.account(first, "ACCT-1"))
    restated = F.lit("Supplies & Materials")
    saved = [
        archive.save(ledger_part, root, label, organization="Test League",
                     created_at=dt.datetime(2002, 1, day))
        for day, (label, ledger_part) in enumerate((
            ("until June 1996", classify.classify(doubled)),
            ("Apr-Dec 1996", classify.with_dimensions(second.withColumn("category", restated))),
            ("from 1997", classify.classify(third))), start=1)
    ]
    combined = archive.load_many(spark, root, saved, ordered=False)
    return plain(combined.select(
        "account", F.col("txn_ts").cast("date").alias("txn_date"), "description", "amount",
        "category"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as if every year were one archive."""
    labelled = ledger(spark, sf_dir).withColumn("label", F.date_format("txn_ts", "yyyy"))
    described = archive.describe(labelled, ["label"])
    return described.withColumns({
        "id": F.col("label"), "created_at": F.col("date_range_end").cast("timestamp")})


def archive_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_yearly(spark, sf_dir).select(
        "label", F.col("date_range_start").cast("date").alias("date_range_start"),
        F.col("date_range_end").cast("date").alias("date_range_end"),
        dates.range_label(F.col("date_range_start"), F.col("date_range_end")).alias("default_label"),
        "transaction_count", "account_count", "total_revenue", "total_expenses"))


def archive_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.newest_first(_yearly(spark, sf_dir), 5).select("label", "transaction_count")


def archive_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.date_range(_yearly(spark, sf_dir))


AMOUNT_TEXT = {
    1: "CAST(amount AS VARCHAR(30))",
    2: "CONCAT('$', CAST(amount AS VARCHAR(30)))",
    3: "CONCAT('(', CAST(amount AS VARCHAR(30)), ')')",
    4: "CONCAT(' $1,', CAST(l_linenumber AS VARCHAR(3)), '00.25 ')",
    5: "CONCAT('-(', CAST(amount AS VARCHAR(30)), ')')",
    6: "CONCAT(CAST(amount AS VARCHAR(30)), '-')",
    7: "CONCAT(CAST(l_linenumber AS VARCHAR(3)), 'e2')",
}


def amount_text_sql() -> str:
    branches = " ".join(f"WHEN {k} THEN {v}" for k, v in AMOUNT_TEXT.items())
    return f"CASE l_linenumber {branches} END"


def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_extendedprice AS DECIMAL(18,2)) AS amount"
    ).selectExpr("l_orderkey", "l_linenumber", f"{amount_text_sql()} AS text")
    return texts.withColumn("parsed", money.parse_amount(F.col("text")).cast("double"))


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in one shape per order priority, one of them unreadable."""
    d = F.col("o_orderdate")
    shapes = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "MMM d, yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, "yyyyMMdd"))
        .otherwise(F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"))))
    texts = table(spark, sf_dir, "orders").select("o_orderkey", shapes.alias("text"))
    return texts.withColumn("parsed", dates.parse_date("text").cast("date"))


def ingest_csv_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in three layouts, written from the tables and read back as one ledger."""
    folder = scratch_path(spark, "statements")
    deposited, withdrawn = deposits(spark, sf_dir), withdrawals(spark, sf_dir)
    day = F.col("txn_ts")
    amount = F.col("amount")
    layouts = {
        "single": deposited.where(F.col("account") == "ACCT-0").select(
            F.date_format(day, "yyyy-MM-dd").alias("Date"), F.col("description").alias("Description"),
            F.concat(F.lit("$"), F.format_number(amount, 2)).alias("Amount")),
        "credit": deposited.where(F.col("account") != "ACCT-0").select(
            F.date_format(day, "MM/dd/yyyy").alias("Trans Date"),
            F.col("description").alias("Details"), amount.alias("Deposit")),
        "debit_credit": withdrawn.select(
            F.date_format(day, "MMM d, yyyy").alias("Posting Date"),
            F.col("description").alias("Memo"), (-amount).alias("Debit"),
            F.lit(None).cast("string").alias("Credit")),
    }
    for name, layout in layouts.items():
        layout.write.option("header", True).csv(f"{folder}/{name}")
    found = read_statements(spark, folder)
    return plain(found.select(
        F.col("txn_ts").cast("date").alias("txn_date"), "description",
        F.col("amount").cast("decimal(18,2)").alias("amount")))


def default_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-name, label and line-number text helpers over generated names."""
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("AccountHistory "), F.col("c_name"), F.lit(".v1.csv")).alias("file"))
    return named.select(
        "c_custkey", text.account_from_file(F.col("file")).alias("account"),
        text.safe_name(F.col("file")).alias("safe"))


def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliver the ledger as files, archive it by stream, combine the archives."""
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "archives")
    fields = [f.split()[0] for f in DELIVERY_SCHEMA.split(", ")]
    delivered = ledger(spark, sf_dir).withColumn("amount", F.col("amount").cast(money.LEDGER_MONEY))
    delivered.select(*fields).write.parquet(landing)
    accumulate(spark, landing, root, scratch_path(spark, "stream")).awaitTermination()
    ids = [r.id for r in archive.list_archives(spark, root).select("id").collect()]
    combined = archive.load_many(spark, root, ids, ordered=False)
    return plain(combined.groupBy("account", "category").agg(
        F.count("*").alias("n"), money.report_money(F.sum("amount")).alias("net")))


def queries() -> dict[str, Query]:
    return {
        "categorize": categorize,
        "categorize_counts": categorize_counts,
        "category_type_parent": category_type_parent,
        "activities": _on_ledger(lambda l: statements.activities(l).drop("statement")),
        "activities_totals": activities_totals,
        "financial_position": _on_ledger(
            lambda l: statements.financial_position(l, **BALANCES).select("section", "label", "amount")),
        "functional_expenses": _on_ledger(statements.functional_expenses),
        "cash_flows": _on_ledger(lambda l: statements.cash_flows(
            l, beginning_cash=BALANCES["beginning_cash"]).select("section", "ord", "label", "amount")),
        "all_statements": _on_ledger(lambda l: statements.all_statements(
            l, **BALANCES).groupBy("statement", "section").agg(
                F.count("*").alias("n"), F.sum("amount").alias("amount"))),
        "period_labels": period_labels,
        "filter_month": lambda s, d: _rows(filters.period(ledger(s, d), "January 1997")),
        "filter_quarter": lambda s, d: _rows(filters.period(ledger(s, d), "Q3 1996")),
        "filter_ytd": lambda s, d: _rows(filters.period(ledger(s, d), "YTD 2001 (through November)")),
        "filter_year": lambda s, d: _rows(filters.period(ledger(s, d), "Full Year 1998")),
        "filter_range": lambda s, d: _rows(filters.period(
            filters.account(ledger(s, d), "ACCT-1"), "Custom Range",
            dt.date(1996, 2, 10), dt.date(1996, 8, 20))),
        "filter_search": filter_search,
        "filter_counts": filter_counts,
        "period_options": _on_ledger(lambda l: dashboard.period_options(l).select("heading", "label")),
        "kpis": _on_ledger(dashboard.headline),
        "account_summary": _on_ledger(dashboard.account_summary),
        "account_counts": _on_ledger(dashboard.account_counts),
        "revenue_by_category": _on_ledger(dashboard.revenue_by_category),
        "expense_by_category": _on_ledger(dashboard.expense_by_category),
        "monthly_cash_flow": _on_ledger(dashboard.monthly_cash_flow),
        "functional_allocation": _on_ledger(dashboard.functional_allocation),
        "program_ratio": _on_ledger(dashboard.program_ratio),
        "p990_part1": _on_ledger(lambda l: form990.part1_summary(
            l, beginning_net_assets=NET_ASSETS).select("line_key", "amount")),
        "p990_part8": _on_ledger(lambda l: form990.part8_revenue(l).select("line_key", "amount")),
        "p990_program_by_desc": _on_ledger(form990.program_revenue_by_description),
        "p990_part9": _on_ledger(form990.part9_expenses),
        "p990_part10": _on_ledger(lambda l: form990.part10_balance_sheet(
            l, beginning_net_assets=NET_ASSETS, **BALANCES).select("section", "line_key", "amount")),
        "p990_schedule_a": _on_ledger(form990.schedule_a_support),
        "p990_receipts_tier": _on_ledger(lambda l: form990.receipts_tier(l, keys=["account"])),
        "p990_header": _on_ledger(lambda l: form990.header(l, organization="Test League")),
        "displayed_worksheet": displayed_worksheet,
        "displayed_activities": displayed_activities,
        "overrides": overrides,
        "archive_dedup": archive_dedup,
        "archive_meta": archive_meta,
        "archive_top5": archive_top5,
        "archive_range": archive_range,
        "parse_amount": parse_amount,
        "parse_date": parse_date,
        "transaction_detail": transaction_detail,
        "default_accounts": default_accounts,
        "ingest_csv_mixed": ingest_csv_mixed,
        "stream_accumulate": stream_accumulate,
    } | intake.queries()
