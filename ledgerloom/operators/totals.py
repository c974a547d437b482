"""The one aggregate every report is built on.

A report needs, per category, the sum of money coming in and the sum going out.  Whatever
the ledger's size, that is a few dozen rows per group, so each report is one map-side
combined aggregation over the scan followed by work on report-sized data.

A ledger without ``category`` is first reduced to its distinct (description, direction)
pairs and only those are classified: summing commutes with classification, and the rules
are by far the most expensive part of the scan.  A description holding a large share of all
rows collapses inside each task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import sqltext as sql
from ledgerloom.functions.classify import functional_class, is_inflow, with_category

Keys = Sequence[str]


def _zero() -> Column:
    return F.lit(Decimal(0)).cast("decimal(28,4)")


def _is_classified(ledger: DataFrame) -> bool:
    return "category" in ledger.columns


def direction_totals(ledger: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, category, inflow, amount, n, first_ts, last_ts`` at category level or finer."""
    detail = "category" if _is_classified(ledger) else "description"
    totals = (
        ledger.groupBy(*keys, detail, is_inflow(F.col("amount")).alias("inflow"))
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("n"),
             F.min("txn_ts").alias("first_ts"), F.max("txn_ts").alias("last_ts"))
    )
    return totals if _is_classified(ledger) else with_category(totals)


def sum_when(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), _zero())


def category_totals(ledger: DataFrame, keys: Keys = ()) -> DataFrame:
    """``keys, category, money_in, money_out, n``; both sums are positive."""
    totals = direction_totals(ledger, keys)
    return totals.groupBy(*keys, "category").agg(
        sum_when(F.col("inflow"), F.col("amount")).alias("money_in"),
        sum_when(~F.col("inflow"), -F.col("amount")).alias("money_out"),
        F.sum("n").alias("n"),
    )


def summary(ledger: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per group with everything the statements and worksheets read.

    ``ins``, ``outs`` and ``nets`` are arrays with one amount per known category, in
    dimension order (see :func:`money`); the remaining columns are sums over all rows, over
    non-transfers, and over non-transfer outflows per function.
    Without ``keys`` an empty ledger still gives one row of zeros.
    """
    per_category = (
        direction_totals(ledger, keys).groupBy(*keys, "category")
        .agg(sum_when(F.col("inflow"), F.col("amount")).alias("money_in"),
             sum_when(~F.col("inflow"), -F.col("amount")).alias("money_out"),
             F.sum("n").alias("n"),
             F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    )
    known = F.col("category").isin(*dims.REVENUE_CATEGORIES, *dims.EXPENSE_CATEGORIES)
    sums = F.struct("money_in", "money_out")
    moved = F.coalesce(F.col("category") == dims.TRANSFER, F.lit(False))
    function = functional_class()

    def total(condition: Column, column: str) -> Column:
        return sum_when(condition, F.col(column))

    row = per_category.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(known, F.struct("category", sums))))
        .alias("by_category"),
        total(F.lit(True), "money_in").alias("all_in"),
        total(F.lit(True), "money_out").alias("all_out"),
        total(~moved, "money_in").alias("earned"),
        total(~moved, "money_out").alias("spent"),
        *(total(~moved & (function == f), "money_out").alias(f"spent_{i}")
          for i, f in enumerate(dims.FUNCTIONS)),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
    return row.withColumns({
        name: F.expr(f"transform(array({sql.texts(_CATEGORIES)}), c -> "
                     f"coalesce(try_element_at(by_category, c).{column}, 0BD))")
        for name, column in (("ins", "money_in"), ("outs", "money_out"))
    }).withColumn("nets", F.zip_with("ins", "outs", lambda a, b: a - b)).drop("by_category")


_CATEGORIES = dims.REVENUE_CATEGORIES + dims.EXPENSE_CATEGORIES


def is_summary(df: DataFrame) -> bool:
    return "nets" in df.columns


def money(category: str, column: str) -> str:
    """SQL: ``money_in`` or ``money_out`` of a category on a :func:`summary` row."""
    array = {"money_in": "ins", "money_out": "outs"}[column]
    return f"{array}[{_CATEGORIES.index(category)}]"


def net(category: str) -> str:
    return f"nets[{_CATEGORIES.index(category)}]"


def money_of(categories: Sequence[str], column: str) -> str:
    return "(" + " + ".join(money(c, column) for c in categories) + ")"
