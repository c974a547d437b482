"""Union of overlapping ledgers, each transaction kept once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: columns naming a transaction (account only where present) -------------
IDENTITY = ("txn_ts", "description", "amount")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    Spark limits each key to one row inside every task before the shuffle (group-limited
    window), so a key repeated in a third of all rows costs its tasks one row each.
    ``dropDuplicates`` would not say which copy survives.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def combine_ledgers(ledgers: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """De-duplicate on date, description, amount and, where present, account."""
    keys = [*IDENTITY, *(["account"] if "account" in ledgers.columns else [])]
    return keep_first(ledgers, keys, order)


def union_ledgers(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def in_date_order(ledger: DataFrame) -> DataFrame:
    """Output order; ties are settled by file and row."""
    ties = [c for c in ("source_file", "row_id") if c in ledger.columns]
    return ledger.orderBy("txn_ts", *ties)
