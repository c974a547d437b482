"""A bank ledger derived from the order tables: orders are deposits, line items withdrawals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Both engines read these texts.  ``source`` columns differ per engine only in the FROM.
_DEPOSIT_TEXT = """CASE o_orderkey % 12
    WHEN 0 THEN 'Annual donation drive'
    WHEN 1 THEN 'State grant award'
    WHEN 2 THEN CONCAT('Zelle payment from member, spring season instalment plan no ',
                       CAST(o_custkey % 5 AS VARCHAR(2)))
    WHEN 3 THEN 'Interest income'
    WHEN 4 THEN 'Gala ticket sale'
    WHEN 5 THEN 'Event sponsor banner'
    WHEN 6 THEN 'Benevity match'
    WHEN 7 THEN 'Dirty bird tournament entry'
    WHEN 8 THEN 'Transfer from savings'
    WHEN 9 THEN 'Misc credit'
    WHEN 10 THEN 'Skills class revenue'
    ELSE '' END"""

_WITHDRAWAL_TEXT = """CASE l_partkey % 18
    WHEN 0 THEN 'Gusto payroll'
    WHEN 1 THEN 'Ice rink rental'
    WHEN 2 THEN 'Office Depot supplies'
    WHEN 3 THEN 'Hockey Monkey jerseys'
    WHEN 4 THEN 'Uber trip'
    WHEN 5 THEN 'CPA audit'
    WHEN 6 THEN 'Liability insurance'
    WHEN 7 THEN 'Campaign mailing'
    WHEN 8 THEN 'Bank fee'
    WHEN 9 THEN 'Referee fees'
    WHEN 10 THEN 'Dirty Birds tourn fee'
    WHEN 11 THEN 'Road tournament entry'
    WHEN 12 THEN 'Drills session'
    WHEN 13 THEN 'Scholarship payout'
    WHEN 14 THEN 'Transfer to checking'
    WHEN 15 THEN 'Venmo team payment'
    WHEN 16 THEN 'Misc debit'
    ELSE 'Donation refund' END"""

DEPOSITS = {
    "account": "CONCAT('ACCT-', CAST(o_custkey % 3 AS VARCHAR(2)))",
    "txn_ts": "o_orderdate",
    "description": _DEPOSIT_TEXT,
    "amount": "CAST(o_totalprice AS DECIMAL(18,2))",
    "source_file": "'orders'",
    "row_id": "o_orderkey",
}

WITHDRAWALS = {
    "account": "CONCAT('ACCT-', CAST(l_suppkey % 3 AS VARCHAR(2)))",
    "txn_ts": "l_shipdate",
    "description": _WITHDRAWAL_TEXT,
    "amount": "-CAST(l_extendedprice AS DECIMAL(18,2))",
    "source_file": "'lineitem'",
    "row_id": "l_orderkey * 8 + l_linenumber",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    typed = {**columns, "amount": f"CAST({columns['amount']} AS DECIMAL(18,2))"}
    return df.selectExpr(*(f"{text} AS {name}" for name, text in typed.items()))


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), DEPOSITS)


def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), WITHDRAWALS)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deposits(spark, sf_dir).unionByName(withdrawals(spark, sf_dir))


def ledger_sql() -> str:
    """The same ledger for the SQL side."""
    def select(columns: dict[str, str], source: str) -> str:
        listed = ",\n  ".join(f"{text} AS {name}" for name, text in columns.items())
        return f"SELECT {listed}\nFROM {source}"

    return f"{select(DEPOSITS, 'orders')}\nUNION ALL\n{select(WITHDRAWALS, 'lineitem')}"
