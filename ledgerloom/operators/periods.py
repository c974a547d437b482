"""Kinds of periods.  One definition per kind writes its labels, reads them back and gives its days."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")
_MONTHS = {name.lower(): number for names in (calendar.month_name, calendar.month_abbr) for number, name in enumerate(names) if name}
#: What a field looks like in a label.
_READ = {"month": "|".join(sorted(_MONTHS, key=len, reverse=True)), "quarter": r"\d", "year": r"\d{4}"}
#: Texts of a day or month that name its month too.
_DAYS = (re.compile(r"(?P<year>\d{4})-(?P<month>\d\d?)(-(?P<day>\d\d?))?"), re.compile(r"(?P<month>\d\d?)/(?P<day>\d\d?)/(?P<year>\d{4})"))


@dataclass(frozen=True)
class Kind:
    heading: str
    #: As Spark truncates a day to the start of its period.
    unit: str
    months: int
    #: Fields ``month quarter year`` of the start and ``last`` (month with data); what follows `` (`` isn't needed to read it.
    label: str
    #: The last day counts as a whole, not up to its midnight.
    whole_days: bool = False

    def write(self, start: Column, last: Column) -> Column:
        """Label of the period from ``start`` with its ``last`` month."""
        fields = {"month": F.date_format(start, "MMMM"), "quarter": F.quarter(start).cast("string"),
                  "year": F.year(start).cast("string"), "last": F.date_format(last, "MMMM")}
        return F.concat(*(fields[part] if i % 2 else F.lit(part) for i, part in enumerate(_FIELD.split(self.label)) if part))

    def read(self, text: str) -> dt.date | None:
        """First day of the period that a label names, None for labels of other kinds; ``ValueError`` if there is no such period."""
        needed = self.label.split(" (")[0]
        pattern = "".join(f"(?P<{part}>{_READ[part]})" if i % 2 else re.escape(part).replace(r"\ ", r"\s+")
                          for i, part in enumerate(_FIELD.split(needed)))
        found = re.match(pattern + r"(?!\w)", text, re.IGNORECASE if "{month}" in needed else 0)
        if not found:
            return None
        own = found.groupdict()
        return self.start(int(own["year"]), int(own["quarter"]) if "quarter" in own else _MONTHS[own["month"].lower()] if "month" in own else 1)

    def start(self, year: int, number: int = 1) -> dt.date:
        """First day of a year's period of that number, from 1."""
        return dt.date(year, (number - 1) * self.months + 1, 1)

    def holds(self, moment: Column, start: dt.date) -> Column:
        """Constant range of the period that begins at ``start``."""
        months = start.year * 12 + start.month - 1 + self.months
        after = dt.date(months // 12, months % 12 + 1, 1)
        first = moment >= midnight(start)
        return first & (moment < midnight(after) if self.whole_days else moment <= midnight(after - dt.timedelta(days=1)))


def midnight(moment: dt.date | dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ") if isinstance(moment, dt.datetime) else moment.isoformat()).cast("timestamp_ntz")


# --- fixed values: headings and labels of the choices ------------------------------------
MONTH = Kind("---Months---", "month", 1, "{month} {year}")
QUARTER = Kind("---Quarters---", "quarter", 3, "Q{quarter} {year}")
YEAR_TO_DATE = Kind("---Year to Date---", "year", 12, "YTD {year} (through {last})", whole_days=True)
FULL_YEAR = Kind("---Full Year---", "year", 12, "Full Year {year}", whole_days=True)
#: In display order.
KINDS = (MONTH, QUARTER, YEAR_TO_DATE, FULL_YEAR)


def named(label: str) -> tuple[Kind, dt.date] | None:
    """Kind and first day of the period that a label names; a day names its month."""
    text = label.strip()
    for shape in _DAYS:
        if found := shape.fullmatch(text):
            own = found.groupdict()
            try:
                return MONTH, dt.date(int(own["year"]), int(own["month"]), int(own["day"] or 1)).replace(day=1)
            except ValueError:
                return None
    return next(((kind, start) for kind in KINDS if (start := kind.read(text))), None)
