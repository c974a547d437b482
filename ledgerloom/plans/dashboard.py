"""Dashboard tables: headline figures, breakdowns, months, period choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.classify import functional_class
from ledgerloom.functions.dates import month_of
from ledgerloom.functions.money import report_money
from ledgerloom.operators.filters import ALL_DATES, CUSTOM_RANGE
from ledgerloom.operators.periods import KINDS, YEAR_TO_DATE
from ledgerloom.operators.totals import category_totals, sum_when


def _not_transfer() -> Column:
    return ~F.col("category").eqNullSafe(dims.TRANSFER)


# Conditions on the category are written into the amounts and rows are dropped by amount.
# A filter on the category itself would be pushed below the aggregation, where Spark would
# evaluate all text rules once more per row.


def headline(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue, expenses and net without transfers; the count has every row."""
    totals = category_totals(ledger, keys).groupBy(*keys).agg(
        sum_when(_not_transfer(), F.col("money_in")).alias("revenue"),
        sum_when(_not_transfer(), F.col("money_out")).alias("expenses"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"))
    return totals.select(
        *keys, "transactions", report_money(F.col("revenue")).alias("revenue"),
        report_money(F.col("expenses")).alias("expenses"),
        report_money(F.col("revenue") - F.col("expenses")).alias("net"))


def account_summary(ledger: DataFrame) -> DataFrame:
    """Headline figures per account."""
    return headline(ledger, ["account"])


def account_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account").agg(F.count("*").alias("transactions"))


def revenue_by_category(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    received = F.when(_not_transfer(), F.col("money_in"))
    return (category_totals(ledger, keys).select(*keys, "category", received.alias("amount"))
            .where(F.col("amount") > 0)
            .withColumn("amount", report_money(F.col("amount"))))


def expense_by_category(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    spent = F.when(_not_transfer(), F.col("money_out"))
    return (category_totals(ledger, keys).select(*keys, "category", spent.alias("amount"))
            .where(F.col("amount") > 0)
            .withColumn("amount", report_money(F.col("amount"))))


def monthly_cash_flow(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Money in and out per month, transfers included; no category is needed."""
    months = ledger.groupBy(*keys, month_of(F.col("txn_ts")).alias("month")).agg(
        sum_when(F.col("amount") > 0, F.col("amount")).alias("revenue"),
        sum_when(F.col("amount") < 0, -F.col("amount")).alias("expenses"))
    return (
        months.where((F.col("revenue") > 0) | (F.col("expenses") > 0))
        .select(*keys, "month", F.date_format("month", "MMM yyyy").alias("label"),
                report_money(F.col("revenue")).alias("revenue"),
                report_money(F.col("expenses")).alias("expenses"))
    )


def functional_allocation(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outflows per function with their share in percent; ``N/A`` is left out."""
    function = functional_class()
    counted = F.when(function != dims.NOT_APPLICABLE, F.col("money_out"))
    spent = (
        category_totals(ledger, keys).groupBy(*keys, function.alias("functional"))
        .agg(F.sum(counted).alias("spent")).where(F.col("spent") > 0)
    )
    # at most three rows per group reach this window
    everything = F.sum("spent").over(Window.partitionBy(*keys))
    share = F.col("spent").cast("double") / everything.cast("double") * 100
    return spent.select(*keys, "functional", report_money(F.col("spent")).alias("amount"),
                        F.round(share, 1).alias("percent"))


def program_ratio(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Program share of functional expenses and its tier; no row without expenses."""
    function = functional_class()
    totals = category_totals(ledger, keys).groupBy(*keys).agg(
        sum_when(function == "Program Services", F.col("money_out")).alias("program"),
        sum_when(function != dims.NOT_APPLICABLE, F.col("money_out")).alias("spent"),
    ).where(F.col("spent") > 0)
    ratio = F.col("program").cast("double") / F.col("spent").cast("double") * 100
    # --- fixed values: tier limits in percent ---------------------------------------------
    tier = (F.when(F.col("ratio") >= 75, "Excellent").when(F.col("ratio") >= 65, "Good")
            .otherwise("Below recommended"))
    return totals.withColumn("ratio", ratio).select(
        *keys, F.round("ratio", 1).alias("program_percent"), tier.alias("tier"))


def period_options(ledger: DataFrame) -> DataFrame:
    """Choices for the period filter in display order: ``ord``, ``heading``, ``label``.

    All choices follow from the distinct months, so the ledger is reduced to those first.
    """
    months = ledger.select(month_of(F.col("txn_ts")).alias("month")).distinct()
    always = F.lit("0001-01-01").cast("date")
    starts = [*(F.trunc("month", kind.unit) for kind in KINDS), always]
    choices = months.select("month", F.inline(F.array(*(
        F.struct(F.lit(i).alias("kind"), start.alias("start")) for i, start in enumerate(starts, start=1)))))
    listed = choices.groupBy("kind", "start").agg(F.max("month").alias("last"))
    label, heading = F.lit(CUSTOM_RANGE), F.lit("")
    for i, kind in enumerate(KINDS, start=1):
        label = F.when(F.col("kind") == i, kind.write(F.col("start"), F.col("last"))).otherwise(label)
        heading = F.when(F.col("kind") == i, kind.heading).otherwise(heading)
    to_date = KINDS.index(YEAR_TO_DATE) + 1
    found = (
        listed.where((F.col("kind") != to_date) | (F.month("last") > 1))
        .select("kind", "start", heading.alias("heading"), label.alias("label"))
    )
    first = ledger.sparkSession.range(1).select(
        F.lit(0).alias("kind"), always.alias("start"), F.lit("").alias("heading"),
        F.lit(ALL_DATES).alias("label"))
    return found.unionByName(first).select(
        (F.col("kind") * 100_000_000 + F.date_format("start", "yyyyMMdd").cast("long")).alias("ord"),
        "heading", "label")


def accounts(ledger: DataFrame) -> DataFrame:
    """Sorted account names."""
    return ledger.select("account").distinct().orderBy("account")
