"""The four financial statements.

Every function takes a ledger, or the summary of one (so that several statements share one
pass), and optional group ``keys`` for one statement per account or organisation.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import sqltext as sql
from ledgerloom.functions.dates import as_of_text, period_text
from ledgerloom.operators.totals import is_summary, money, net, sum_when, summary
from ledgerloom.plans.lines import Line, explode_lines, report_lines

Money = float | int | Decimal

SPENDING_CATEGORIES = tuple(c for c in dims.EXPENSE_CATEGORIES if c != dims.TRANSFER)
NATURAL_CATEGORIES = tuple(c for c in SPENDING_CATEGORIES if c not in dims.FUNCTIONS)
FUNCTION_COLUMNS = ("program_services", "management_general", "fundraising")


def _prepared(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary row plus the totals several lines refer to."""
    base = ledger if is_summary(ledger) else summary(ledger, keys)
    operating = [f"greatest({net(c)}, 0BD)" for c in dims.REVENUE_CATEGORIES]
    return base.withColumns({
        "total_revenue": F.expr(sql.cents_sum(net(c) for c in dims.REVENUE_CATEGORIES)),
        "total_expenses": F.expr(sql.cents_sum(f"abs({net(c)})" for c in SPENDING_CATEGORIES)),
        "transfers": F.expr(sql.cents(net(dims.TRANSFER))),
        "received": F.expr(sql.cents_sum(operating)),
        **{f"functional_{i}": F.expr(sql.cents_sum(
            money(c, "money_out") for c in SPENDING_CATEGORIES if dims.function_of(c) == f))
           for i, f in enumerate(dims.FUNCTIONS)},
    })


def _activities_lines() -> str:
    return report_lines("activities", [
        *(Line("revenue", c, c, net(c), f"{net(c)} <> 0") for c in dims.REVENUE_CATEGORIES),
        Line("revenue", "total_revenue", "Total Revenue and Support", "total_revenue"),
        *(Line("expenses", c, c, f"abs({net(c)})", f"{net(c)} <> 0") for c in SPENDING_CATEGORIES),
        Line("expenses", "total_expenses", "Total Expenses", "total_expenses"),
        Line("transfers", "net_transfers", "Net Transfers", "transfers"),
        Line("change", "change_in_net_assets", "Change in Net Assets",
             "total_revenue - total_expenses + transfers"),
    ])


def activities(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue net of refunds, expenses as absolute net, transfers, change in net assets."""
    return explode_lines(_prepared(ledger, keys), keys, _activities_lines())


def _position_lines(beginning_cash: Money, other_assets: Money, liabilities: Money) -> str:
    other, owed = sql.number(other_assets), sql.number(liabilities)
    cash = sql.cents(f"{sql.number(beginning_cash)} + {sql.cents('all_in - all_out')}")
    assets = sql.cents(f"{cash} + {other}")
    net_assets = sql.cents(f"{assets} - {owed}")
    return report_lines("position", [
        Line("assets", "cash", "Cash and Cash Equivalents", cash),
        Line("assets", "other_assets", "Other Assets", other),
        Line("assets", "total_assets", "Total Assets", assets),
        Line("liabilities", "total_liabilities", "Total Liabilities", owed),
        Line("net_assets", "without_restrictions", "Without Donor Restrictions", net_assets),
        Line("net_assets", "with_restrictions", "With Donor Restrictions", "0BD"),
        Line("net_assets", "total_net_assets", "Total Net Assets", net_assets),
        Line("total", "total_liabilities_and_net_assets", "Total Liabilities and Net Assets",
             f"{owed} + {net_assets}"),
    ])


def financial_position(ledger: DataFrame, *, beginning_cash: Money = 0, other_assets: Money = 0,
                       liabilities: Money = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Opening cash plus all activity (transfers included), other assets, liabilities."""
    if "all_in" not in ledger.columns:
        # needs no category: nothing is classified
        ledger = ledger.groupBy(*keys).agg(
            sum_when(F.col("amount") > 0, F.col("amount")).alias("all_in"),
            sum_when(F.col("amount") < 0, -F.col("amount")).alias("all_out"))
    return explode_lines(ledger, keys, _position_lines(beginning_cash, other_assets, liabilities))


def _functional_rows() -> list[tuple[str, list[str], str]]:
    """Label, amount per function, keep test.  A category has exactly one function."""
    rows = []
    for category in NATURAL_CATEGORIES + dims.FUNCTIONS:
        spent = money(category, "money_out")
        cells = [sql.cents(spent) if f == dims.function_of(category) else sql.cents("0BD")
                 for f in dims.FUNCTIONS]
        direct = category in dims.FUNCTIONS
        rows.append((f"{category} (Direct)" if direct else category, cells,
                     f"{spent if direct else sql.cents(spent)} > 0"))
    rows.append(("Total Expenses", [f"functional_{i}" for i in range(3)], "true"))
    return rows


def functional_expenses(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Natural category by function, wide; only outflows count and refunds do not net.

    The functions' own categories appear as "(Direct)" rows after the natural ones.
    """
    structs = []
    for i, (label, cells, keep) in enumerate(_functional_rows()):
        named = ", ".join(f"'{n}', {sql.cents(c)}" for n, c in zip(FUNCTION_COLUMNS, cells))
        structs.append(f"named_struct('ord', {i}, 'label', {sql.text(label)}, {named}, "
                       f"'total', {sql.cents(' + '.join(cells))}, 'keep', {keep})")
    kept = f"filter(array({', '.join(structs)}), entry -> entry.keep)"
    return _prepared(ledger, keys).select(*keys, F.expr(f"inline({kept})")).drop("keep")


def _functional_lines() -> str:
    lines = []
    for label, cells, keep in _functional_rows():
        lines += [Line(n, label, label, c, keep) for n, c in zip(FUNCTION_COLUMNS, cells)]
        lines.append(Line("total", label, label, " + ".join(cells), keep))
    return report_lines("functional_expenses", lines)


def _cash_flow_lines(beginning_cash: Money) -> str:
    opening, operating = sql.cents(sql.number(beginning_cash)), "received - total_expenses"
    return report_lines("cash_flows", [
        *(Line("operating", c, f"Cash received from {c.lower()}", net(c), f"{net(c)} > 0")
          for c in dims.REVENUE_CATEGORIES),
        *(Line("operating", c, f"Cash paid for {c.lower()}", f"-abs({net(c)})", f"{net(c)} <> 0")
          for c in SPENDING_CATEGORIES),
        Line("operating", "net_operating", "Net Cash from Operating Activities", operating),
        Line("investing", "net_investing", "Net Cash from Investing Activities", "0BD"),
        Line("financing", "net_financing", "Net Cash from Financing Activities", "0BD"),
        Line("cash", "net_change_in_cash", "Net Change in Cash", operating),
        Line("cash", "beginning_cash", "Beginning Cash Balance", opening),
        Line("cash", "ending_cash", "Ending Cash Balance", f"{opening} + {operating}"),
    ])


def cash_flows(ledger: DataFrame, *, beginning_cash: Money = 0,
               keys: Sequence[str] = ()) -> DataFrame:
    """Direct method: operating only, transfers excluded."""
    return explode_lines(_prepared(ledger, keys), keys, _cash_flow_lines(beginning_cash))


def headings(ledger: DataFrame, organization: str = "Organization",
             keys: Sequence[str] = ()) -> DataFrame:
    """Title, organisation and period text of each statement; ``N/A`` dates when empty."""
    period = period_text(F.col("first_ts"), F.col("last_ts"))
    entries = [
        ("activities", "Statement of Activities", period),
        ("position", "Statement of Financial Position", as_of_text(F.col("last_ts"))),
        ("functional_expenses", "Statement of Functional Expenses", period),
        ("cash_flows", "Statement of Cash Flows", period),
    ]
    dates = ledger if "first_ts" in ledger.columns else ledger.groupBy(*keys).agg(
        F.min("txn_ts").alias("first_ts"), F.max("txn_ts").alias("last_ts"))
    return dates.select(*keys, F.inline(F.array(*(
        F.struct(F.lit(s).alias("statement"), F.lit(t).alias("title"),
                 F.lit(organization).alias("organization"), p.alias("period"))
        for s, t, p in entries))))


def all_statements(ledger: DataFrame, *, beginning_cash: Money = 0, other_assets: Money = 0,
                   liabilities: Money = 0, keys: Sequence[str] = ()) -> DataFrame:
    """All four statements as lines, from one pass over the ledger."""
    return explode_lines(
        _prepared(ledger, keys), keys,
        _activities_lines(), _position_lines(beginning_cash, other_assets, liabilities),
        _functional_lines(), _cash_flow_lines(beginning_cash))
