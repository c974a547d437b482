import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


AMOUNTS = {
    "1,234.50": 1234.5, "$5": 5, "(5.00)": -5, "-(5)": 0, "100-": 0, "": 0, "abc": 0, "1e5": 100000,
    " $ 1 000.25 ": 1000.25, " 7": 7, "--5": 0, ".5": .5, "5.": 5, "+5": 5, "-$12.30": -12.3,
    "inf": 0, "nan": 0, None: 0, "(1,000)": -1000, "1.23456": 1.2346,
}


def test_amounts(spark):
    found = column(spark, list(AMOUNTS), money.parse_amount(F.col("t")))
    assert [float(v) for v in found] == list(map(float, AMOUNTS.values()))


def test_amounts_are_what_a_decimal_is_read_from(spark):
    """The test before the cast lets everything through that the cast can read."""
    texts = ["1", "１２", "1e2", "1E+2", "1e-2", "e5", "1e", ".", "1.2.3", "+-1", "+.5", "\x011\x02", "0x1", "1d", "1f", "٣", "", "\x0b", "-", "1-", "12 pending"]
    plain = column(spark, texts, F.translate(F.col("t"), "(,$)" + text.WHITESPACE, "-").try_cast(money.LEDGER_MONEY))
    assert column(spark, texts, money.read_amount(F.col("t"))) == plain and None in plain


D = dt.datetime
DATES = {
    "2026-01-02": D(2026, 1, 2), "01/02/2026": D(2026, 1, 2), "1/2/26": D(2026, 1, 2),
    "Jan 2, 2026": D(2026, 1, 2), "2 Jan 2026": D(2026, 1, 2), "20260102": D(2026, 1, 2),
    "13/02/2026": D(2026, 2, 13), "junk": None, "": None, None: None, "January 2026": D(2026, 1, 1),
    "January 2, 2026": D(2026, 1, 2), "2026-01-02 14:30:15": D(2026, 1, 2, 14, 30, 15),
    "2026-01-02T14:30:15": D(2026, 1, 2, 14, 30, 15), "1/2/2026 2:05 PM": D(2026, 1, 2, 14, 5),
    "02-Jan-2026": D(2026, 1, 2), " 2026-01-02 ": D(2026, 1, 2), "JAN 2, 2026": D(2026, 1, 2),
    "1/2/95": D(1995, 1, 2), "2026-13-45": None, "12345": None, "2026/01/02": D(2026, 1, 2),
    "2-Jan-26": D(2026, 1, 2), "Jan-02-2026": D(2026, 1, 2), "01.02.2026": D(2026, 1, 2),
    "13.02.2026": D(2026, 2, 13), "2026.01.02": D(2026, 1, 2), "2026-01": D(2026, 1, 1),
    "2026-01-02 3:04 PM": D(2026, 1, 2, 15, 4), "02/2026": D(2026, 2, 1), "1.25": None,
    "1/2/70": D(2070, 1, 2), "Jan 2 2026": D(2026, 1, 2), "1/2/2026 14:05": D(2026, 1, 2, 14, 5),
    "2026-01-02 14:30:15.250": D(2026, 1, 2, 14, 30, 15, 250000),
}


def test_dates(spark):
    found = column(spark, list(DATES), dates.parse_date("t"))
    assert dict(zip(DATES, found)) == DATES


@pytest.mark.parametrize("value, shown", [
    ("1234.5", "$1,234.50"), ("-1234.5", "($1,234.50)"), ("0", "$0.00"), ("-0.01", "($0.01)")])
def test_currency(spark, value, shown):
    assert column(spark, [value], money.currency_text(F.col("t").cast("decimal(18,2)"))) == [shown]


def test_labels(spark):
    labels = ["Grants", "Program Services: Skills & Drills", "Total Revenue", "Ending Cash Balance",
              "Net Change in Cash"]
    assert column(spark, labels, text.short_label(F.col("t")))[:2] == ["Grants", "Skills & Drills"]
    assert column(spark, labels, text.is_total_label(F.col("t"))) == [False, False, True, True, True]
    assert column(spark, ["19_other_a", "5_x"], text.line_number(F.col("t"))) == ["19", "5"]
    files = ["AccountHistory 1.csv", "a.b.xlsx", "plain", " Checking .csv"]
    assert column(spark, files, text.account_from_file(F.col("t"))) == [
        "Account 1", "a.b", "plain", "Checking"]
    stamp = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    assert column(spark, ["Q1/2026: é_x"], text.archive_id(F.col("t"), stamp)) == [
        "Q1_2026_ é_x_20260102_030405"]


def test_period_text(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-05' a, timestamp_ntz'2026-03-31' b, "
                   "cast(null as timestamp_ntz) n")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    row = df.select(dates.period_text(a, b), dates.as_of_text(n), dates.range_label(a, a),
                    dates.range_label(a, b)).first()
    assert list(row) == ["For the Period January 05, 2026 to March 31, 2026", "As of N/A",
                         "Jan 2026", "Jan 2026 - Mar 2026"]
