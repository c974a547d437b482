"""Report lines: SQL text of structs over a one-row-per-group summary."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import sqltext as sql
from ledgerloom.functions.text import TOTAL_WORDS


class Line(NamedTuple):
    section: str
    line_key: str
    label: str
    amount: str
    keep: str = "true"


def report_lines(report: str, lines: Sequence[Line], column: str = "statement") -> str:
    """SQL array of the kept lines of one report; ``ord`` is the place in the full report."""
    structs = [
        f"named_struct('{column}', {sql.text(report)}, 'section', {sql.text(entry.section)}, "
        f"'ord', {i}, 'line_key', {sql.text(entry.line_key)}, 'label', {sql.text(entry.label)}, "
        f"'amount', {sql.cents(entry.amount)}, "
        f"'is_total', {str(bool(re.search(TOTAL_WORDS, entry.label))).lower()}, "
        f"'keep', {entry.keep})"
        for i, entry in enumerate(lines)
    ]
    return f"filter(array({', '.join(structs)}), entry -> entry.keep)"


def explode_lines(summary: DataFrame, keys: Sequence[str], *reports: str) -> DataFrame:
    """Lines of any number of reports as rows; all read the same summary row."""
    return summary.select(*keys, F.expr(f"inline(concat({', '.join(reports)}))")).drop("keep")
