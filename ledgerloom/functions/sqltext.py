"""Pieces of SQL expression text.

Rule sets and report lines are long expressions built from data.  As SQL text they reach
the JVM in one call; built from Column objects, each node is a separate round trip and
composing a report takes longer than running it.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(value: str) -> str:
    """Raw string literal for regular expressions and date formats."""
    return f'r"{value}"'


def texts(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def number(value: float | int | Decimal) -> str:
    """Exact decimal literal of a plain number."""
    return f"{Decimal(str(value)):f}BD"


def cents(expression: str) -> str:
    """A report amount: rounded half up to cents."""
    return f"cast(round({expression}, 2) as decimal(28,2))"


def cents_sum(expressions: Iterable[str]) -> str:
    """Sum of amounts that are each rounded first."""
    return "(" + " + ".join(cents(e) for e in expressions) + ")"
