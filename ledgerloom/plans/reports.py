"""Report output: transaction detail, displayed worksheet lines, chart tables, writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import currency_text
from ledgerloom.functions.text import is_subcategory, line_number, short_label
from ledgerloom.plans import dashboard, form990, statements

# --- fixed values: column order of the transaction detail --------------------------------
DETAIL_COLUMNS = ("date", "account", "description", "amount", "category", "functional")
REVIEW_COLUMNS = ("date", "account", "description", "amount", "category")

# --- fixed values: worksheet lines that are shown --------------------------------------------
SHOWN_LINES = {
    "part1": ("line_1", "line_2", "line_3", "line_4", "line_12", "line_13", "line_15", "line_18",
              "line_19", "line_20", "line_22"),
    "part8": ("1e_govt_grants", "1f_all_other_contributions", "1h_total_contributions",
              "2a_program_services", "2a_total", "3_investment_income",
              "8a_fundraising_events_gross", "8b_fundraising_expenses", "8c_fundraising_net",
              "11_other_revenue", "12_total_revenue"),
    "part9": ("5_compensation_current_officers", "7_other_salaries", "11a_management_fees",
              "13_office_expenses", "14_information_technology", "16_occupancy", "17_travel",
              "19_other_expenses_a", "19_other_expenses_b", "19_other_expenses_c",
              "19_other_expenses_d", "25_total"),
    "part10": ("1_cash", "2_savings", "3_pledges_receivable", "4_accounts_receivable",
               "12_investments_other", "15_other_assets", "16_total_assets",
               "17_accounts_payable", "25_other_liabilities", "26_total_liabilities",
               "27_unrestricted", "28_temporarily_restricted", "29_permanently_restricted",
               "33_total_net_assets", "34_total_liabilities_and_net_assets"),
}
# shown even at zero; the rest of parts IX and X only when filled
ALWAYS_SHOWN = ("25_total", "16_total_assets", "26_total_liabilities", "33_total_net_assets",
                "34_total_liabilities_and_net_assets")
EVENT_LINES = ("8a_fundraising_events_gross", "8b_fundraising_expenses", "8c_fundraising_net")


def _dated(ledger: DataFrame) -> DataFrame:
    if "txn_ts" not in ledger.columns:
        return ledger
    return ledger.withColumn("date", F.date_format("txn_ts", "MM/dd/yyyy"))


def transaction_detail(ledger: DataFrame) -> DataFrame:
    """The detail columns the ledger has, in order, dates as ``MM/dd/yyyy``."""
    dated = _dated(ledger)
    return dated.select(*(c for c in DETAIL_COLUMNS if c in dated.columns))


def review(ledger: DataFrame, *, show_account: bool) -> DataFrame:
    """Columns for reviewing categories; the account only when there is more than one."""
    dated = _dated(ledger)
    return dated.select(*(c for c in REVIEW_COLUMNS if c != "account" or show_account))


def displayed(statement_lines: DataFrame) -> DataFrame:
    """Statement lines with display label, indent flag and currency text."""
    return statement_lines.withColumns({
        "display": short_label(F.col("label")),
        "indented": is_subcategory(F.col("label")),
        "amount_text": currency_text(F.col("amount")),
    })


def _shown(part: str) -> Column:
    key = F.col("line_key")
    listed = (F.col("part") == part) & key.isin(*SHOWN_LINES[part])
    if part in ("part9", "part10"):
        return listed & (F.col("filled") | key.isin(*ALWAYS_SHOWN))
    if part == "part8":
        return listed & (F.col("events") | ~key.isin(*EVENT_LINES))
    return listed


def displayed_worksheet(worksheet: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worksheet lines that are shown, with line number and currency text.

    A Part IX line is shown when its total is not zero, fundraising event lines when there
    was event income.  Both flags are group-wide over the fixed lines; program descriptions, of which
    there may be many, need neither and are spread by their text.
    """
    apart = F.when(F.col("line_key") == "2a_program_services", F.xxhash64("label"))
    of_line = Window.partitionBy(*keys, "part", "line_key", apart)
    of_part = Window.partitionBy(*keys, "part", apart)
    flagged = worksheet.withColumns({
        "filled": F.max((F.col("amount") != 0)).over(of_line),
        "events": F.max((F.col("line_key") == EVENT_LINES[0]) & (F.col("amount") > 0)).over(of_part),
    })
    keep = F.col("part") == "schedule_a"
    for part in SHOWN_LINES:
        keep = keep | _shown(part)
    return flagged.where(keep).drop("filled", "events").withColumns({
        "line_number": F.when(F.col("line_key") == "2a_total", "2f")
        .when(F.col("part") == "part1", F.regexp_replace("line_key", "^line_", ""))
        .when(F.col("part") == "schedule_a", "")
        .otherwise(line_number(F.col("line_key"))),
        "amount_text": currency_text(F.col("amount")),
    })


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """Write each table below ``path`` in its own folder, in any Spark file format."""
    for name, table in tables.items():
        writer = table.write.mode(mode).format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{path}/{name}")


def statement_tables(ledger: DataFrame, **balances) -> dict[str, DataFrame]:
    """Everything a statement document shows: lines, detail and chart tables.

    Nothing for a ledger without rows.
    """
    if ledger.isEmpty():
        return {}
    return {
        "statement_lines": displayed(statements.all_statements(ledger, **balances)),
        "functional_expenses": statements.functional_expenses(ledger),
        "transaction_detail": transaction_detail(ledger),
        "revenue_by_category": dashboard.revenue_by_category(ledger),
        "expense_by_category": dashboard.expense_by_category(ledger),
        "monthly_cash_flow": dashboard.monthly_cash_flow(ledger),
    }


def worksheet_tables(ledger: DataFrame, **balances) -> dict[str, DataFrame]:
    """Everything a worksheet document shows; nothing for a ledger without rows."""
    if ledger.isEmpty():
        return {}
    return {"worksheet": displayed_worksheet(form990.worksheet(ledger, **balances)),
            "header": form990.header(ledger)}
