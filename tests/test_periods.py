import datetime as dt

import pytest

from ledgerloom.operators import filters, periods
from ledgerloom.plans import dashboard


@pytest.fixture
def ledger(make_ledger):
    return make_ledger([
        ("2025-12-31", "a", 1), ("2026-01-01", "b", 1), ("2026-01-31", "c", 1),
        ("2026-01-31T14:00:00", "d", 1), ("2026-02-01", "e", 1), ("2026-03-31", "f", 1),
        ("2026-03-31T09:00:00", "g", -1), ("2026-12-31T23:00:00", "h", -1), ("2027-01-05", "i", -1)])


@pytest.mark.parametrize("label, kept", [
    ("January 2026", "bc"), ("Jan 2026", "bc"), ("Q1 2026", "bcdef"), ("Q4 2026", ""),
    ("YTD 2026 (through December)", "bcdefgh"), ("Full Year 2026", "bcdefgh"),
    ("Full Year 1999", ""), ("All Dates", "abcdefghi"), ("---Months---", "abcdefghi"), ("2026-01", "bc"), ("2026-01-15", "bc"), ("1/15/2026", "bc"), ("january 2026", "bc"), ("YTD 2026", "bcdefgh"),
    ("2026-13", "abcdefghi"), ("2026", "abcdefghi"), ("Mayor 2026", "abcdefghi"), ("", "abcdefghi"),
    ("whatever", "abcdefghi"), (None, "abcdefghi"), ("Custom Range", "abcdefghi")])
def test_periods(ledger, label, kept):
    found = filters.period(ledger, label)
    assert "".join(sorted(r.description for r in found.collect())) == kept


def test_custom_range(ledger):
    both = filters.period(ledger, "Custom Range", dt.date(2026, 1, 31), dt.date(2026, 3, 31))
    assert "".join(sorted(r.description for r in both.collect())) == "cdef"
    assert filters.between(ledger, end=dt.date(2026, 1, 1)).count() == 2


def test_bad_quarter(ledger):
    with pytest.raises(ValueError):
        filters.period(ledger, "Q5 2026")


def test_search(make_ledger):
    from ledgerloom.functions.classify import classify
    ledger = classify(make_ledger([("2026-01-01", "Gift ONE", 1, "A"), ("2026-01-01", "gift two", 1, "B"),
                                   ("2026-01-01", "rent", -1, "A")]))
    assert filters.search(ledger, text="gift (one|two)").count() == 2
    assert filters.search(ledger, text="GIFT", accounts=("B",)).count() == 1
    assert filters.search(ledger, categories=("Facilities & Occupancy",)).count() == 1
    assert filters.search(ledger).count() == 3
    assert filters.account(ledger, "All Accounts").count() == 3
    assert filters.account(ledger, "B").count() == 1
    assert filters.inflows(ledger).count() == 2 and filters.outflows(ledger).count() == 1
    assert filters.without_transfers(ledger).count() == 3


def test_options(spark, ledger, make_ledger):
    labels = [r.label for r in dashboard.period_options(ledger).orderBy("ord").collect()]
    assert labels == [
        "All Dates", "December 2025", "January 2026", "February 2026", "March 2026",
        "December 2026", "January 2027", "Q4 2025", "Q1 2026", "Q4 2026", "Q1 2027",
        "YTD 2025 (through December)", "YTD 2026 (through December)", "Full Year 2025",
        "Full Year 2026", "Full Year 2027", "Custom Range"]
    empty = ledger.where("false")
    assert [r.label for r in dashboard.period_options(empty).collect()] == ["All Dates"]


def test_labels_are_read_as_they_are_written(ledger):
    """A label of the list names the period that it was written for."""
    listed = dashboard.period_options(ledger).where("heading <> ''").collect()
    heads = [(kind.heading, start) for kind, start in (periods.named(o.label) for o in listed)]
    assert heads == [(o.heading, dt.date(o.ord // 10_000 % 10_000, o.ord // 100 % 100, 1)) for o in listed]


def test_every_option_filters(ledger):
    everything = {r.description for r in ledger.collect()}
    for kind in ("---Full Year---", "---Year to Date---"):
        options = dashboard.period_options(ledger).where(f"heading = '{kind}'").collect()
        seen = [r.description for o in options for r in filters.period(ledger, o.label).collect()]
        assert len(seen) == len(set(seen)) and set(seen) <= everything
