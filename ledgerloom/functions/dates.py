"""Date columns: parsing mixed statement formats, report period text."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import sqltext as sql
from ledgerloom.functions.text import WHITESPACE

# --- fixed values: month, weekday and zone names -----------------------------------------
_MONTH = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
          "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY = "(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?"
_ZONE = r"z|utc|gmt|[ecmp][sd]t|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?"

# A date is two or three parts, each a number or a month's name, or eight digits; a clock may follow it.
_PART = rf"(?:({_MONTH})\.?|(\d{{1,4}})(?:st|nd|rd|th)?)"
_BETWEEN = r"(\s*[-/.]\s*|,\s*|\s+|(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z]))"
_CLOCK = rf"(\d{{1,2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)?)?(?:\s*([ap])\.?m\.?)?(?:\s*(?:{_ZONE}))?"
_TEXT = (rf"(?i)^(?:{_WEEKDAY}\.?,?\s+)?(?:(\d{{4}})(\d{{2}})(\d{{2}})|{_PART}{_BETWEEN}{_PART}(?:{_BETWEEN}{_PART})?)"
         rf"(?:(?:t|\s+at\s+|,?\s+){_CLOCK})?$")
_GROUPS = ("y8 m8 d8 name1 number1 between1 name2 number2 between2 name3 number3 hour minute second fraction half").split()
_SPLIT = "#;" + ";".join(f"${i}" for i in range(1, len(_GROUPS) + 1))

FIRST_YEAR, LAST_YEAR = 1678, 2261


def _group(name: str) -> str:
    return f"g[{_GROUPS.index(name) + 1}]"


def _number(name: str, missing: str = "null") -> str:
    """Digits of a group as a number.  Groups are digits or nothing, and a ``try_cast`` of nothing costs an exception."""
    return f"if({_group(name)} = '', {missing}, cast({_group(name)} as int))"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _kind(i: int) -> str:
    """m: a month's name, y: four digits, d: one or two digits, x: three digits, nothing: no such part."""
    digits = f"length({_group(f'number{i}')})"
    return (f"CASE WHEN {_group(f'name{i}')} <> '' THEN 'm' WHEN {digits} = 0 THEN '' WHEN {digits} = 4 THEN 'y' "
            f"WHEN {digits} <= 2 THEN 'd' ELSE 'x' END")


def _value(i: int) -> str:
    name = _group(f"name{i}")
    return (f"if({name} <> '', cast((locate(lower(left({name}, 3)), '{_MONTHS}') + 2) / 3 as int), "
            f"{_number(f'number{i}')})")


def _parts() -> str:
    """Which part is year, month and day, by the kinds of the parts."""
    def ymd(y: str, m: str, d: str) -> str:
        return f"named_struct('y', {y}, 'm', {m}, 'd', {d})"

    def either(y: str, a: str, b: str) -> str:  # month first, unless it can't be one
        return f"if({a} <= 12, {ymd(y, a, b)}, {ymd(y, b, a)})"

    def near(v: str) -> str:  # a two-digit year is read within 50 years of today
        return f"{v} + if({v} + 2000 >= year(current_date()) + 50, 1900, 2000)"

    a, b, c = "v[0]", "v[1]", "v[2]"
    one, two = f"trim({_group('between1')})", f"trim({_group('between2')})"
    numbers = f"{one} IN ('-', '/', '.') AND {one} = {two}"
    short = f"{one} IN ('-', '/')"
    rules = {
        "mdy": ymd(c, a, b), "dmy": ymd(c, b, a), "ymd": ymd(a, b, c), "ydm": ymd(a, c, b), "myd": ymd(b, a, c),
        "mdd": ymd(near(c), a, b),
        "dmd": f"if({a} > 31, {ymd(near(a), b, c)}, {ymd(near(c), b, a)})",
        "ydd": f"if({numbers}, {either(a, b, c)}, null)",
        "ddy": f"if({numbers}, {either(c, a, b)}, null)",
        "ddd": f"if({numbers}, if({a} > 31, {either(near(a), b, c)}, {either(near(c), a, b)}), null)",
        "my": ymd(b, a, "1"), "ym": ymd(a, b, "1"),
        "yd": f"if({short}, {ymd(a, b, '1')}, null)", "dy": f"if({short}, {ymd(b, a, '1')}, null)",
    }
    return "CASE k " + " ".join(f"WHEN '{kinds}' THEN {rule}" for kinds, rule in rules.items()) + " END"


def _clock() -> str:
    """``h``, ``mi``, ``s``; null hour where the clock has neither minutes nor a half of the day, or no such hour."""
    hour, half = _number("hour"), f"lower({_group('half')})"
    twelve = f"if({hour} BETWEEN 1 AND 12, {hour} % 12 + if({half} = 'p', 12, 0), null)"
    h = (f"CASE WHEN {_group('hour')} = '' THEN 0 WHEN {half} <> '' THEN {twelve} "
         f"WHEN {_group('minute')} <> '' AND {hour} < 24 THEN {hour} END")
    second = f"try_cast(concat('0', {_group('second')}, '.', left({_group('fraction')}, 6), '0') as decimal(16,6))"
    return (f"named_struct('h', {h}, 'mi', {_number('minute', '0')}, "
            f"'s', if({second} < 60, {second}, null))")


@cache
def _parse_sql() -> str:
    """The text ``t`` is split once into its parts; everything after works on these."""
    stamp = (f"if(p.y BETWEEN {FIRST_YEAR} AND {LAST_YEAR}, "
             "try_make_timestamp_ntz(p.y, p.m, p.d, c.h, c.mi, c.s), null)")
    values = ", ".join(_value(i) for i in (1, 2, 3))
    kinds = ", ".join(_kind(i) for i in (1, 2, 3))
    digits = ", ".join(f"'{n}', {_number(n + '8')}" for n in ("y", "m", "d"))
    parts = (f"if({_group('y8')} <> '', named_struct({digits}), "
             + _bind(f"concat({kinds})", "k", _bind(f"array({values})", "v", _parts())) + ")")
    whole = _bind(parts, "p", _bind(_clock(), "c", stamp))
    split = f"split(regexp_replace(t, {sql.pattern(_TEXT)}, '{_SPLIT}'), ';', -1)"
    return _bind(split, "g", f"if(g[0] = '#' AND size(g) = {len(_GROUPS) + 1}, {whole}, null)")


def parse_dates(column: str) -> Column:
    """Array holding the parsed TIMESTAMP_NTZ, empty where the text is no date.

    One regular expression splits the text into numbers, a month's name and a clock; their kinds decide
    what they are: four digits are a year, of two numbers the first is the month unless it is above 12, a number
    above 31 in front is a year.  Weekdays, ordinal endings and time zones are read over: the time stays as written.
    A date needs a year; without a day it is the first of the month.  The one-element
    array binds the text, so that it is computed once.  ``one_each`` drops unreadable rows without parsing a second time.
    """
    bound = f"array(btrim({column}, {sql.text(WHITESPACE)}))"
    return F.expr(f"filter(transform({bound}, t -> {_parse_sql()}), d -> d IS NOT NULL)")


def one_each(days: Column) -> Column:
    """A row for each date of a ``parse_dates`` column.

    Of a bare column that is exploded Spark infers a filter on its size, which it pushes below the parsing and so parses twice;
    of an expression it infers none.
    """
    return F.explode(F.slice(days, 1, 1))


def parse_date(column: str) -> Column:
    """Statement date text to TIMESTAMP_NTZ, null where no accepted shape matches."""
    return F.get(parse_dates(column), F.lit(0))


def month_of(ts: Column) -> Column:
    """First day of the month."""
    return F.trunc(ts.cast("date"), "month")


def long_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMMM dd, yyyy"), F.lit("N/A"))


def period_text(first: Column, last: Column) -> Column:
    return F.concat(F.lit("For the Period "), long_date(first), F.lit(" to "), long_date(last))


def as_of_text(last: Column) -> Column:
    return F.concat(F.lit("As of "), long_date(last))


def range_label(first: Column, last: Column) -> Column:
    """``Jan 2026`` for one month, ``Jan 2026 - Mar 2026`` otherwise."""
    start = F.coalesce(F.date_format(first, "MMM yyyy"), F.lit(""))
    end = F.coalesce(F.date_format(last, "MMM yyyy"), F.lit(""))
    return F.when(start == end, start).otherwise(F.concat_ws(" - ", start, end))
