import pytest
from conftest import amounts
from pyspark.sql import functions as F

from ledgerloom.functions.classify import classify
from ledgerloom.operators import edits
from ledgerloom.operators.totals import category_totals
from ledgerloom.plans import dashboard, reports, statements

ROWS = [
    ("2026-01-05", "Donation", 1000), ("2026-01-09", "Event sponsor", 250.5),
    ("2026-02-01", "State grant", 400), ("2026-02-02", "Gusto payroll", -300.25),
    ("2026-02-03", "Office rent", -200), ("2026-02-04", "Referee", -50),
    ("2026-02-05", "Bank fee", -10), ("2026-02-06", "Campaign", -20),
    ("2026-02-07", "Transfer to savings", -100), ("2026-02-08", "Transfer from savings", 40),
    ("2026-03-01", "Donation refund", -30), ("2026-03-02", "mystery", 5), ("2026-03-02", "zero", 0),
]


@pytest.fixture
def ledger(make_ledger):
    return make_ledger(ROWS)


def test_activities(ledger):
    lines = amounts(statements.activities(ledger))
    assert lines["Donations & Contributions"] == 1000
    assert lines["Donations & Contributions: Tournament Sponsor"] == 250.5
    assert lines["total_revenue"] == 1655.5
    assert lines["Other Expenses"] == 30
    assert lines["total_expenses"] == 610.25
    assert lines["net_transfers"] == -60
    assert lines["change_in_net_assets"] == 985.25
    assert "Insurance" not in lines and "Internal Account Transfer" not in lines


def test_order_of_lines(ledger):
    labels = [r.label for r in statements.activities(ledger).orderBy("ord").collect()]
    assert labels.index("Grants") < labels.index("Total Revenue and Support") < labels.index(
        "Program Services") < labels.index("Facilities & Occupancy") < labels.index("Total Expenses")
    assert labels[-1] == "Change in Net Assets"


def test_refund_nets_against_its_category(make_ledger):
    classified = classify(make_ledger([("2026-01-01", "gift", 100), ("2026-01-02", "x", 7)]))
    refund = make_ledger([("2026-01-03", "back", -40)])
    both = classified.unionByName(classify(refund).withColumn(
        "category", F.lit("Donations & Contributions")))
    assert amounts(statements.activities(both))["Donations & Contributions"] == 60
    flows = amounts(statements.cash_flows(both), "label")
    assert flows["Cash received from donations & contributions"] == 60
    # a revenue category that nets below zero shows in activities, not in cash flows
    negative = both.where("description = 'back'")
    assert amounts(statements.activities(negative))["total_revenue"] == -40
    assert amounts(statements.cash_flows(negative))["net_operating"] == 0


def test_position(ledger):
    lines = amounts(statements.financial_position(
        ledger, beginning_cash=100.10, other_assets=50, liabilities=25))
    assert lines["cash"] == 1085.35 and lines["total_assets"] == 1135.35
    assert lines["total_net_assets"] == 1110.35
    assert lines["total_liabilities_and_net_assets"] == 1135.35


def test_functional(ledger):
    rows = {r.label: r for r in statements.functional_expenses(ledger).collect()}
    assert float(rows["Salaries & Benefits"].program_services) == 300.25
    assert float(rows["Facilities & Occupancy"].management_general) == 200
    assert float(rows["Program Services (Direct)"].program_services) == 50
    assert float(rows["Management & General (Direct)"].total) == 10
    total = rows["Total Expenses"]
    assert [float(total[c]) for c in (*statements.FUNCTION_COLUMNS, "total")] == [
        350.25, 240, 20, 610.25]
    assert "Insurance" not in rows and "Internal Account Transfer" not in rows


def test_cash_flows(ledger):
    lines = amounts(statements.cash_flows(ledger, beginning_cash=10))
    assert lines["net_operating"] == 1045.25 and lines["ending_cash"] == 1055.25
    assert lines["Salaries & Benefits"] == -300.25 and lines["net_investing"] == 0


def test_all_statements_equal_single_ones(ledger):
    every = statements.all_statements(ledger, beginning_cash=10, other_assets=5, liabilities=1)
    for name, single in (
            ("activities", statements.activities(ledger)),
            ("position", statements.financial_position(
                ledger, beginning_cash=10, other_assets=5, liabilities=1)),
            ("cash_flows", statements.cash_flows(ledger, beginning_cash=10))):
        part = every.where(F.col("statement") == name)
        assert sorted(part.collect()) == sorted(single.select(*part.columns).collect())
    wide = statements.functional_expenses(ledger).agg(F.sum("total")).first()[0]
    long = every.where("statement = 'functional_expenses' AND section = 'total'")
    assert long.agg(F.sum("amount")).first()[0] == wide


def test_empty_ledger(ledger):
    empty = ledger.where("false")
    lines = amounts(statements.activities(empty))
    assert set(lines.values()) == {0.0} and "total_revenue" in lines
    periods = {r.statement: r.period for r in statements.headings(empty).collect()}
    assert periods["activities"] == "For the Period N/A to N/A"
    assert periods["position"] == "As of N/A"
    assert dashboard.headline(empty).first().transactions == 0
    assert dashboard.monthly_cash_flow(empty).count() == 0
    assert dashboard.program_ratio(empty).count() == 0


def test_one_statement_per_group(make_ledger):
    rows = [(d, t, a, acct) for acct in ("A", "B") for d, t, a in ROWS]
    both = make_ledger(rows + [("2026-01-01", "gift", 1, "B")])
    for report in (statements.activities, statements.functional_expenses, statements.cash_flows,
                   statements.all_statements, statements.financial_position):
        grouped = report(both, keys=["account"])
        for acct in ("A", "B"):
            alone = report(both.where(F.col("account") == acct))
            assert sorted(grouped.where(F.col("account") == acct).drop("account").collect()) == \
                sorted(alone.collect())


def test_classified_and_raw_ledgers_agree(ledger):
    for report in (statements.all_statements, category_totals, dashboard.headline,
                   dashboard.functional_allocation, dashboard.revenue_by_category,
                   dashboard.expense_by_category, dashboard.program_ratio):
        assert sorted(report(ledger).collect()) == sorted(report(classify(ledger)).collect())


def test_sums_are_whole(ledger):
    total = category_totals(ledger).agg(F.sum(F.col("money_in") - F.col("money_out"))).first()[0]
    assert total == ledger.agg(F.sum("amount")).first()[0]


def test_dashboard(ledger):
    head = dashboard.headline(ledger).first()
    assert [float(head[c]) for c in ("transactions", "revenue", "expenses", "net")] == [
        13, 1655.5, 610.25, 1045.25]
    months = {r.label: (float(r.revenue), float(r.expenses))
              for r in dashboard.monthly_cash_flow(ledger).collect()}
    assert months == {"Jan 2026": (1250.5, 0), "Feb 2026": (440, 680.25), "Mar 2026": (5, 30)}
    shares = {r.functional: r.percent for r in dashboard.functional_allocation(ledger).collect()}
    assert shares == {"Program Services": 57.4, "Management & General": 39.3, "Fundraising": 3.3}
    ratio = dashboard.program_ratio(ledger).first()
    assert (ratio.program_percent, ratio.tier) == (57.4, "Below recommended")


@pytest.mark.parametrize("program, tier", [(75, "Excellent"), (65, "Good"), (64, "Below recommended")])
def test_ratio_tiers(make_ledger, program, tier):
    ledger = make_ledger([("2026-01-01", "payroll", -program), ("2026-01-01", "rent", program - 100)])
    assert dashboard.program_ratio(ledger).first().tier == tier


def test_overrides(spark, ledger):
    classified = classify(ledger)
    changes = spark.createDataFrame([("test", 0, "Supplies & Materials"), ("test", 99, "Grants")],
                                    "source_file string, row_id bigint, category string")
    edited = edits.override_categories(classified, changes)
    assert edited.columns == classified.columns and edited.count() == len(ROWS)
    row = edited.where("row_id = 0").first()
    assert (row.category, row.functional) == ("Supplies & Materials", "Program Services")
    lines = amounts(statements.activities(edited))
    assert lines["Supplies & Materials"] == 1000 and "Donations & Contributions" not in lines
    # a positive amount is no functional expense
    assert "Supplies & Materials" not in {
        r.label for r in statements.functional_expenses(edited).collect()}


def test_report_tables(spark, ledger, tmp_path):
    tables = reports.statement_tables(classify(ledger), beginning_cash=1)
    reports.write_tables(tables, str(tmp_path / "p"))
    reports.write_tables({"detail": tables["transaction_detail"]}, str(tmp_path / "c"), fmt="csv")
    detail = spark.read.option("header", True).csv(str(tmp_path / "c" / "detail"))
    assert detail.columns == ["date", "account", "description", "amount", "category", "functional"]
    assert detail.count() == len(ROWS) and detail.where("date = '01/05/2026'").count() == 1
    stored = spark.read.parquet(str(tmp_path / "p" / "statement_lines"))
    assert stored.where("label LIKE '%: Tournament Sponsor' AND statement = 'activities'").first(
    ).display == "Tournament Sponsor"
    assert reports.transaction_detail(ledger.drop("account")).columns == [
        "date", "description", "amount"]
    assert reports.review(classify(ledger), show_account=False).columns == [
        "date", "description", "amount", "category"]
