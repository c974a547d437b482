"""Annual information return worksheet: Parts I, VIII, IX, X and Schedule A.

Parts I and VIII and Schedule A fold sub-categories into their parents and count only one
direction of money; Part IX matches exact category names.  Part X takes transfers into cash
but not into net assets.  Lines the worksheet never fills are constant zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import sqltext as sql
from ledgerloom.functions.classify import is_inflow, with_category
from ledgerloom.functions.money import report_money
from ledgerloom.operators.totals import is_summary, money, money_of, sum_when, summary
from ledgerloom.plans.lines import Line, explode_lines, report_lines

Money = float | int | Decimal

PROGRAM_REVENUE = "Program Service Revenue"
LABEL_LENGTH = 50


def _summary_of(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ledger if is_summary(ledger) else summary(ledger, keys)


def _received(*names: str) -> str:
    return sql.cents(money_of(dims.with_subcategories(*names), "money_in"))


def _spent(*names: str) -> str:
    return sql.cents(money_of(dims.with_subcategories(*names), "money_out"))


def _prepared(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary row plus the amounts several lines refer to."""
    amounts = {
        "contributions": _received("Donations & Contributions", "Grants"),
        "gifts": _received("Donations & Contributions"),
        "grants": _received("Grants"),
        "program": _received(PROGRAM_REVENUE),
        "investment": _received("Investment Income"),
        "events": _received("Fundraising Event Revenue"),
        "others": _received(dims.OTHER_REVENUE),
        "events_and_others": _received("Fundraising Event Revenue", dims.OTHER_REVENUE),
        "salaries": _spent("Salaries & Benefits"),
        "event_costs": _spent("Fundraising"),
        "expenses": sql.cents("spent_0 + spent_1 + spent_2"),
    }
    totals = {
        "revenue": "contributions + program + investment + events_and_others",
        "support": "gifts + grants + program + investment + events + others",
        "public": "gifts + grants + program + events",
    }
    return (
        _summary_of(ledger, keys)
        .withColumns({name: F.expr(text) for name, text in amounts.items()})
        .withColumns({name: F.expr(sql.cents(text)) for name, text in totals.items()})
        .withColumn("share", F.expr(
            "CASE WHEN support > 0 THEN round(cast(public as double) / cast(support as double) "
            "* 100, 1) ELSE 0D END"))
    )


def _part1_lines(beginning_net_assets: Money) -> str:
    opening = sql.cents(sql.number(beginning_net_assets))
    # --- fixed values: Part I line keys and labels ---------------------------------------
    return report_lines("part1", [
        Line("revenue", "line_1", "Contributions, gifts, grants", "contributions"),
        Line("revenue", "line_2", "Program service revenue", "program"),
        Line("revenue", "line_3", "Investment income", "investment"),
        Line("revenue", "line_4", "Other revenue", "events_and_others"),
        Line("revenue", "line_5_to_9", "Other gains", "0BD"),
        Line("revenue", "line_12", "Total revenue", "revenue"),
        Line("expenses", "line_13", "Grants and similar amounts paid", "0BD"),
        Line("expenses", "line_14", "Benefits paid to members", "0BD"),
        Line("expenses", "line_15", "Salaries, other compensation, employee benefits",
             "salaries"),
        Line("expenses", "line_16a", "Professional fundraising fees", "0BD"),
        Line("expenses", "line_16b", "Fundraising expenses", "0BD"),
        Line("expenses", "line_17", "Other expenses", "expenses"),
        Line("expenses", "line_18", "Total expenses", "expenses"),
        Line("net_assets", "line_19", "Revenue less expenses", "revenue - expenses"),
        Line("net_assets", "line_20", "Net assets at beginning of year", opening),
        Line("net_assets", "line_21", "Other changes", "0BD"),
        Line("net_assets", "line_22", "Net assets at end of year",
             f"{opening} + revenue - expenses"),
    ], column="part")


def part1_summary(ledger: DataFrame, *, beginning_net_assets: Money = 0,
                  keys: Sequence[str] = ()) -> DataFrame:
    return explode_lines(_prepared(ledger, keys), keys, _part1_lines(beginning_net_assets))


def _described(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, category, description, inflow, amount``; description only for program revenue.

    Only program revenue is reported by description, so a ledger that already has its
    categories shuffles the texts of those rows alone.
    """
    if "category" in ledger.columns:
        keep = (F.col("category") == PROGRAM_REVENUE) & is_inflow(F.col("amount"))
        text = F.when(keep, F.coalesce("description", F.lit("")))
        return ledger.groupBy(*keys, "category", text.alias("description"),
                              is_inflow(F.col("amount")).alias("inflow")).agg(
            F.sum("amount").alias("amount"))
    return with_category(
        ledger.groupBy(*keys, F.coalesce("description", F.lit("")).alias("description"),
                       is_inflow(F.col("amount")).alias("inflow"))
        .agg(F.sum("amount").alias("amount")))


def _by_label(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per category and program label: both sums, and the amount reported for the label.

    Descriptions sharing their first 50 characters share a label, which reports all their money.
    """
    is_program = (F.col("category") == PROGRAM_REVENUE) & F.col("inflow")
    label = F.when(is_program, F.substring("description", 1, LABEL_LENGTH))
    return (
        _described(ledger, keys).groupBy(*keys, "category", label.alias("label"))
        .agg(sum_when(F.col("inflow"), F.col("amount")).alias("money_in"),
             sum_when(~F.col("inflow"), -F.col("amount")).alias("money_out"),
             F.sum(F.when(is_program, F.col("amount"))).alias("reported"))
    )


def program_revenue_by_description(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``description`` (first 50 characters) and ``amount`` of program revenue received."""
    # filter on the aggregate, not on the label: that one would be pushed below the text rules
    return _by_label(ledger, keys).where(F.col("reported").isNotNull()).select(
        *keys, F.col("label").alias("description"), report_money(F.col("reported")).alias("amount"))


def _part8_lines() -> str:
    # --- fixed values: Part VIII line keys ------------------------------------------------
    return report_lines("part8", [
        Line("contributions", "1a_federated_campaigns", "Federated campaigns", "0BD"),
        Line("contributions", "1b_membership_dues", "Membership dues", "0BD"),
        Line("contributions", "1c_fundraising_events", "Fundraising events", "0BD"),
        Line("contributions", "1d_related_organizations", "Related organizations", "0BD"),
        Line("contributions", "1e_govt_grants", "Government grants (contributions)", "grants"),
        Line("contributions", "1f_all_other_contributions", "All other contributions", "gifts"),
        Line("contributions", "1h_total_contributions", "Total contributions", "gifts + grants"),
        Line("program", "2a_total", "Total program service revenue", "reported"),
        Line("other", "3_investment_income", "Investment income", "investment"),
        Line("other", "4_income_from_investment_of_tax_exempt_bonds",
             "Income from tax-exempt bond proceeds", "0BD"),
        Line("other", "5_royalties", "Royalties", "0BD"),
        Line("other", "6a_gross_rents", "Gross rents", "0BD"),
        Line("other", "7a_gross_from_sales", "Gross amount from sales of assets", "0BD"),
        Line("other", "8a_fundraising_events_gross", "Fundraising events (gross)", "events"),
        Line("other", "8b_fundraising_expenses", "Less: direct expenses", "event_costs"),
        Line("other", "8c_fundraising_net", "Net income from fundraising", "events - event_costs"),
        Line("other", "9a_gaming_gross", "Gross income from gaming", "0BD"),
        Line("other", "10a_gross_sales_of_inventory", "Gross sales of inventory", "0BD"),
        Line("other", "11_other_revenue", "Other revenue", "others"),
        Line("total", "12_total_revenue", "Total revenue",
             "gifts + grants + reported + investment + events - event_costs + others"),
    ], column="part")


def part8_revenue(ledger: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed lines of Part VIII; program revenue is the total of its reported labels."""
    def flow(column: str, *names: str) -> Column:
        wanted = F.col("category").isin(dims.with_subcategories(*names))
        return report_money(sum_when(wanted, F.col(column)))

    totals = _by_label(ledger, keys).groupBy(*keys).agg(
        flow("money_in", "Donations & Contributions").alias("gifts"),
        flow("money_in", "Grants").alias("grants"),
        F.coalesce(F.sum(report_money(F.col("reported"))), F.lit(Decimal(0))).alias("reported"),
        flow("money_in", "Investment Income").alias("investment"),
        flow("money_in", "Fundraising Event Revenue").alias("events"),
        flow("money_out", "Fundraising").alias("event_costs"),
        flow("money_in", dims.OTHER_REVENUE).alias("others"),
    )
    return explode_lines(totals, keys, _part8_lines())


def _part9_rows() -> list[tuple[str, list[str]]]:
    rows, columns = [], {f: [] for f in dims.FUNCTIONS}
    for key, categories in dims.EXPENSE_LINES:
        cells = []
        for function in dims.FUNCTIONS:
            amounts = [money(c, "money_out") for c in categories
                       if dims.function_of(c) == function]
            cells.append(sql.cents_sum(amounts or ["0BD"]))
            columns[function] += amounts
        rows.append((key, cells))
    rows.append(("25_total", [sql.cents_sum(columns[f]) for f in dims.FUNCTIONS]))
    return rows


def part9_expenses(ledger: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Part IX, wide: line by function.  Lines without a category stay at zero."""
    structs = ", ".join(
        f"named_struct('ord', {i}, 'line_key', {sql.text(key)}, "
        f"'total', {sql.cents(' + '.join(cells))}, 'program_services', {sql.cents(cells[0])}, "
        f"'management_general', {sql.cents(cells[1])}, 'fundraising', {sql.cents(cells[2])})"
        for i, (key, cells) in enumerate(_part9_rows()))
    return _summary_of(ledger, keys).select(*keys, F.expr(f"inline(array({structs}))"))


def _part9_lines() -> str:
    lines = []
    for key, cells in _part9_rows():
        label = "Total functional expenses" if key == "25_total" else key
        amounts = [("total", " + ".join(cells)), ("program_services", cells[0]),
                   ("management_general", cells[1]), ("fundraising", cells[2])]
        lines += [Line(section, key, label, amount) for section, amount in amounts]
    return report_lines("part9", lines, column="part")


def _part10_lines(beginning_cash: Money, other_assets: Money, liabilities: Money,
                  beginning_net_assets: Money) -> str:
    other, owed = sql.number(other_assets), sql.number(liabilities)
    cash = f"{sql.number(beginning_cash)} + {sql.cents('all_in - all_out')}"
    net_assets = f"{sql.number(beginning_net_assets)} + {sql.cents('earned - spent')}"
    # --- fixed values: Part X line keys and labels ----------------------------------------
    return report_lines("part10", [
        Line("assets", "1_cash", "Cash, non-interest-bearing", cash),
        Line("assets", "2_savings", "Savings and temporary cash investments", "0BD"),
        Line("assets", "3_pledges_receivable", "Pledges and grants receivable", "0BD"),
        Line("assets", "4_accounts_receivable", "Accounts receivable", "0BD"),
        Line("assets", "5_loans_receivable", "Loans receivable", "0BD"),
        Line("assets", "6_loans_receivable_other", "Other loans receivable", "0BD"),
        Line("assets", "7_inventories", "Inventories", "0BD"),
        Line("assets", "8_prepaid_expenses", "Prepaid expenses", "0BD"),
        Line("assets", "10a_land_buildings", "Land, buildings and equipment", "0BD"),
        Line("assets", "10b_less_depreciation", "Less accumulated depreciation", "0BD"),
        Line("assets", "10c_net_land_buildings", "Net land, buildings and equipment", "0BD"),
        Line("assets", "11_investments_public", "Investments, public securities", "0BD"),
        Line("assets", "12_investments_other", "Investments, other securities", other),
        Line("assets", "13_program_related_investments", "Program-related investments", "0BD"),
        Line("assets", "14_intangible_assets", "Intangible assets", "0BD"),
        Line("assets", "15_other_assets", "Other assets", "0BD"),
        Line("assets", "16_total_assets", "Total assets", f"{cash} + {other}"),
        Line("liabilities", "17_accounts_payable", "Accounts payable and accrued expenses", "0BD"),
        Line("liabilities", "18_grants_payable", "Grants payable", "0BD"),
        Line("liabilities", "19_deferred_revenue", "Deferred revenue", "0BD"),
        Line("liabilities", "20_tax_exempt_bond_liabilities", "Tax-exempt bond liabilities", "0BD"),
        Line("liabilities", "21_escrow_account", "Escrow account", "0BD"),
        Line("liabilities", "22_loans_from_officers", "Loans from officers", "0BD"),
        Line("liabilities", "23_secured_mortgages", "Secured mortgages", "0BD"),
        Line("liabilities", "24_unsecured_notes", "Unsecured notes", "0BD"),
        Line("liabilities", "25_other_liabilities", "Other liabilities", owed),
        Line("liabilities", "26_total_liabilities", "Total liabilities", owed),
        Line("net_assets", "27_unrestricted", "Unrestricted net assets", net_assets),
        Line("net_assets", "28_temporarily_restricted", "Temporarily restricted net assets", "0BD"),
        Line("net_assets", "29_permanently_restricted", "Permanently restricted net assets", "0BD"),
        Line("net_assets", "30_capital_stock", "Capital stock", "0BD"),
        Line("net_assets", "31_paid_in_capital", "Paid-in capital", "0BD"),
        Line("net_assets", "32_retained_earnings", "Retained earnings", "0BD"),
        Line("net_assets", "33_total_net_assets", "Total net assets or fund balances", net_assets),
        Line("net_assets", "34_total_liabilities_and_net_assets",
             "Total liabilities and net assets", f"{owed} + {net_assets}"),
    ], column="part")


def part10_balance_sheet(ledger: DataFrame, *, beginning_cash: Money = 0, other_assets: Money = 0,
                         liabilities: Money = 0, beginning_net_assets: Money = 0,
                         keys: Sequence[str] = ()) -> DataFrame:
    """Line 34 is liabilities plus net assets; nothing forces it to equal line 16."""
    return explode_lines(_summary_of(ledger, keys), keys, _part10_lines(
        beginning_cash, other_assets, liabilities, beginning_net_assets))


# --- fixed values: Schedule A line keys, labels, amounts -----------------------------------
_SUPPORT = (
    ("gifts_grants_contributions", "Gifts, grants, contributions", "gifts"),
    ("government_grants", "Government grants", "grants"),
    ("program_service_revenue", "Program service revenue", "program"),
    ("investment_income", "Investment income", "investment"),
    ("fundraising_revenue", "Fundraising event revenue", "events"),
    ("other_revenue", "Other revenue", "others"),
)


def schedule_a_support(ledger: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """One wide row: support by source, public share, and the 33 1/3 % test."""
    return _prepared(ledger, keys).select(
        *keys, *(F.col(amount).alias(key) for key, _, amount in _SUPPORT),
        F.col("support").alias("total_support"), F.col("public").alias("public_support"),
        F.col("share").alias("public_support_percentage"),
        (F.col("share") >= 33.33).alias("meets_33_percent_test"))


def _schedule_a_lines() -> str:
    return report_lines("schedule_a", [
        *(Line("support", key, label, amount) for key, label, amount in _SUPPORT),
        Line("support", "total_support", "Total support", "support"),
        Line("test", "public_support", "Public support", "public"),
        Line("test", "public_support_percentage", "Public support percentage",
             "cast(share as decimal(28,2))"),
        Line("test", "meets_33_percent_test", "33-1/3% public support test (1 = passes)",
             "CASE WHEN share >= 33.33D THEN 1BD ELSE 0BD END"),
    ], column="part")


def receipts_tier(ledger: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Form to file by gross receipts, transfers counted."""
    receipts = sum_when(F.col("amount") > 0, F.col("amount"))
    return ledger.groupBy(*keys).agg(receipts.alias("gross")).select(
        *keys, report_money(F.col("gross")).alias("gross_receipts"),
        F.when(F.col("gross") <= 50_000, "990-N").when(F.col("gross") < 200_000, "990-EZ")
        .otherwise("990").alias("form"))


def header(ledger: DataFrame, *, organization: str = "Organization", ein: str = "",
           fiscal_year_start: str = "", fiscal_year_end: str = "",
           keys: Sequence[str] = ()) -> DataFrame:
    """Worksheet header; the fiscal year defaults to the range of the data."""
    def day(given: str, found: Column) -> Column:
        return F.coalesce(F.nullif(F.lit(given), F.lit("")),
                          F.date_format(found, "MM/dd/yyyy"), F.lit("N/A"))

    dates = ledger.groupBy(*keys).agg(F.min("txn_ts").alias("first_ts"),
                                      F.max("txn_ts").alias("last_ts"))
    return dates.select(
        *keys, F.lit(organization).alias("organization_name"), F.lit(ein).alias("ein"),
        day(fiscal_year_start, F.col("first_ts")).alias("fiscal_year_start"),
        day(fiscal_year_end, F.col("last_ts")).alias("fiscal_year_end"),
        F.lit("990").alias("form_type"))


def worksheet(ledger: DataFrame, *, beginning_cash: Money = 0, other_assets: Money = 0,
              liabilities: Money = 0, beginning_net_assets: Money = 0,
              keys: Sequence[str] = ()) -> DataFrame:
    """All parts as lines.  Part VIII also lists program revenue by description.

    Two passes over the ledger: one for the summary, one for the descriptions, whose
    shuffle serves both their list and their total.
    """
    described = program_revenue_by_description(ledger, keys)
    reported = described.groupBy(*keys).agg(
        F.coalesce(F.sum("amount"), F.lit(Decimal(0))).alias("reported"))
    # one row per group on both sides; without keys the constant is the whole join key
    on = [*keys, "_all"]
    rows = (
        _prepared(ledger, keys).withColumn("_all", F.lit(0))
        .join(reported.withColumn("_all", F.lit(0)), on, "left")
        .withColumn("reported", F.coalesce("reported", F.lit(Decimal(0))))
    )
    lines = explode_lines(
        rows, keys, _part1_lines(beginning_net_assets), _part8_lines(), _part9_lines(),
        _part10_lines(beginning_cash, other_assets, liabilities, beginning_net_assets),
        _schedule_a_lines())
    return lines.unionByName(described.select(
        *keys, F.lit("part8").alias("part"), F.lit("program").alias("section"),
        F.lit(7).alias("ord"), F.lit("2a_program_services").alias("line_key"),
        F.col("description").alias("label"), "amount", F.lit(False).alias("is_total")))
