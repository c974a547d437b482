import pytest
from conftest import amounts
from pyspark.sql import functions as F

from ledgerloom.functions.classify import classify
from ledgerloom.plans import form990, reports

LONG = "Zelle payment from member, spring season instalment plan no "


@pytest.fixture
def ledger(make_ledger):
    return make_ledger([
        ("2026-01-01", "Donation", 500), ("2026-01-01", "Event sponsor", 100),
        ("2026-01-02", "State grant", 300), ("2026-01-03", LONG + "1", 10),
        ("2026-01-03", LONG + "1", 5), ("2026-01-03", LONG + "2", 7), ("2026-01-03", "Tuition", 20),
        ("2026-01-03", "Skills class revenue", 9), ("2026-01-04", "Dividend", 4),
        ("2026-01-05", "Gala", 60), ("2026-01-06", "odd", 3), ("2026-01-07", "Campaign", -25),
        ("2026-01-08", "Payroll", -80), ("2026-01-09", "Scholar aid", -11),
        ("2026-01-10", "Road tournament", -6), ("2026-01-11", "Transfer to x", -50),
        ("2026-01-12", "Transfer from y", 70)])


def test_part1(ledger):
    lines = amounts(form990.part1_summary(ledger, beginning_net_assets=1000))
    assert lines["line_1"] == 900 and lines["line_2"] == 51 and lines["line_3"] == 4
    assert lines["line_4"] == 63 and lines["line_12"] == 1018 and lines["line_15"] == 80
    assert lines["line_17"] == lines["line_18"] == 122
    assert lines["line_19"] == 896 and lines["line_22"] == 1896 and len(lines) == 17


def test_part8_and_label_clash(ledger):
    labels = amounts(form990.program_revenue_by_description(ledger), "description")
    # both instalment texts share 50 characters: one label with all their money
    assert labels == {LONG[:50]: 22.0, "Tuition": 20.0}
    lines = amounts(form990.part8_revenue(ledger))
    assert lines["2a_total"] == 42 and lines["1h_total_contributions"] == 900
    assert lines["8c_fundraising_net"] == 35
    assert lines["12_total_revenue"] == 900 + 42 + 4 + 35 + 3 and len(lines) == 20
    assert amounts(form990.part8_revenue(classify(ledger))) == lines


def test_part9(ledger):
    rows = {r.line_key: r for r in form990.part9_expenses(ledger).collect()}
    assert float(rows["5_compensation_current_officers"].program_services) == 80
    assert float(rows["19_other_expenses_b"].fundraising) == 25
    # sub-categories and scholarships are on no line
    assert float(rows["25_total"].total) == 105 and len(rows) == 29
    assert float(rows["25_total"].total) <= amounts(form990.part1_summary(ledger))["line_18"]


def test_part10(ledger):
    lines = amounts(form990.part10_balance_sheet(
        ledger, beginning_cash=10, other_assets=20, liabilities=5, beginning_net_assets=100))
    assert lines["1_cash"] == 10 + 1018 - 122 + 20 and lines["16_total_assets"] == lines["1_cash"] + 20
    assert lines["27_unrestricted"] == 996 and lines["34_total_liabilities_and_net_assets"] == 1001
    assert len(lines) == 35


def test_schedule_a(ledger, make_ledger):
    row = form990.schedule_a_support(ledger).first()
    assert float(row.total_support) == 1018 and float(row.public_support) == 1011
    assert row.public_support_percentage == 99.3 and row.meets_33_percent_test
    poor = form990.schedule_a_support(make_ledger([("2026-01-01", "Dividend", 10)])).first()
    assert poor.public_support_percentage == 0 and not poor.meets_33_percent_test
    nothing = form990.schedule_a_support(make_ledger([("2026-01-01", "rent", -10)])).first()
    assert nothing.public_support_percentage == 0


@pytest.mark.parametrize("received, form", [
    (50_000, "990-N"), (50_000.01, "990-EZ"), (199_999.99, "990-EZ"), (200_000, "990")])
def test_receipts_tier(make_ledger, received, form):
    ledger = make_ledger([("2026-01-01", "Transfer from savings", received)])
    assert form990.receipts_tier(ledger).first().form == form


def test_header(ledger):
    row = form990.header(ledger, fiscal_year_start="07/01/2025").first()
    assert (row.fiscal_year_start, row.fiscal_year_end) == ("07/01/2025", "01/12/2026")
    assert form990.header(ledger.where("false")).first().fiscal_year_end == "N/A"


def test_worksheet_and_display(ledger):
    sheet = form990.worksheet(ledger, beginning_cash=10)
    assert {r.part for r in sheet.select("part").distinct().collect()} == {
        "part1", "part8", "part9", "part10", "schedule_a"}
    shown = reports.displayed_worksheet(sheet)
    keys = {r.line_key for r in shown.collect()}
    assert "12_advertising" not in keys and "2_savings" not in keys
    assert {"25_total", "26_total_liabilities", "8a_fundraising_events_gross"} <= keys
    programs = shown.where("line_key = '2a_program_services'").collect()
    assert {r.label for r in programs} == {LONG[:50], "Tuition"}
    quiet = reports.displayed_worksheet(form990.worksheet(ledger.where("description <> 'Gala'")))
    assert "8a_fundraising_events_gross" not in {r.line_key for r in quiet.collect()}


def test_groups(make_ledger, ledger):
    both = ledger.unionByName(ledger.withColumns(
        {"account": F.lit("B"), "amount": (F.col("amount") * 2).cast("decimal(28,4)")}))
    for report in (form990.part1_summary, form990.part8_revenue, form990.part10_balance_sheet,
                   form990.part9_expenses, form990.schedule_a_support, form990.worksheet):
        grouped = report(both, keys=["account"]).where("account = 'B'").drop("account")
        alone = report(both.where("account = 'B'"))
        assert sorted(grouped.collect()) == sorted(alone.collect())
