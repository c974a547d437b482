"""Money columns: parsing statement text and formatting report text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import WHITESPACE

LEDGER_MONEY = "decimal(28,4)"
REPORT_MONEY = "decimal(28,2)"

#: What a decimal can be read from, and little else: any other text, an empty one too, would cost an exception a cell.
_NUMERIC = r"^[\x00-\x20]*[+-]?[\p{Nd}.]+(?:[eE][+-]?\p{Nd}+)?[\x00-\x20]*$"


def read_amount(text: Column) -> Column:
    """Money text to DECIMAL(28,4), 24 digits before the point; null where it is unreadable.

    ``(`` is read as a minus sign, so ``(5.00)`` is -5 and ``-(5)`` is unreadable.
    """
    bare = F.translate(text, "(,$)" + WHITESPACE, "-")
    return F.when(bare.rlike(_NUMERIC), bare.try_cast(LEDGER_MONEY))


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(Decimal(0)).cast(LEDGER_MONEY))


def parse_amount(text: Column) -> Column:
    """Money text to DECIMAL(28,4); anything unreadable, and null, is 0."""
    return or_zero(read_amount(text))


def report_money(value: Column | float | int | Decimal) -> Column:
    """A report amount: rounded half up to cents."""
    if not isinstance(value, Column):
        value = F.lit(Decimal(str(value)))
    return F.round(value, 2).cast(REPORT_MONEY)


def currency_text(value: Column) -> Column:
    """``$1,234.50``, negatives as ``($1,234.50)``."""
    digits = F.concat(F.lit("$"), F.format_number(F.abs(value), 2))
    return F.when(value < 0, F.concat(F.lit("("), digits, F.lit(")"))).otherwise(digits)
