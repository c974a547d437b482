"""Text columns used by ingest and report output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words marking a total line ---------------------------------------------
TOTAL_WORDS = r"(?i)total|change in|ending|net change"

# --- fixed values: Unicode whitespace -----------------------------------------------------
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends (``trim`` only drops U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def account_from_file(file_name: Column) -> Column:
    """Default account name of a statement file: its name without extension."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return strip(F.replace(stem, F.lit("AccountHistory"), F.lit("Account")))


def is_subcategory(label: Column) -> Column:
    return F.contains(label, F.lit(": "))


def short_label(label: Column) -> Column:
    """Display label: sub-categories show only the text after ``": "``."""
    return F.when(is_subcategory(label), F.regexp_replace(label, r"^.*?: ", "")).otherwise(label)


def is_total_label(label: Column) -> Column:
    return label.rlike(TOTAL_WORDS)


def line_number(line_key: Column) -> Column:
    """Worksheet line number: the key's text before the first underscore."""
    return F.split_part(line_key, F.lit("_"), F.lit(1))


def safe_name(label: Column) -> Column:
    """Label usable in a path: letters, digits, blank, ``_`` and ``-`` stay."""
    return strip(F.regexp_replace(label, r"[^\p{L}\p{N} _-]", "_"))


def archive_id(label: Column, created_at: Column) -> Column:
    return F.concat_ws("_", safe_name(label), F.date_format(created_at, "yyyyMMdd_HHmmss"))
