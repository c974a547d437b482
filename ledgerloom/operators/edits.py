"""Category corrections by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import with_dimensions


def override_categories(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace ``category`` where ``overrides`` has a row of the same key.

    The key is ``source_path, row_id`` for an ingested ledger, whose files may share their names, and
    ``source_file, row_id`` for a ledger without paths.  Functional class and type follow the new category; other columns
    never change.  The join keys are unique row ids, so they spread evenly however the edits are distributed.  Of several edits
    of a row the one with the latest ``edited_at`` counts; without that column two different edits of a row are an error.
    """
    source = "source_path" if "source_path" in ledger.columns else "source_file"
    if source not in overrides.columns:
        raise ValueError(f"edits of this ledger need the column {source}")
    if "edited_at" in overrides.columns:
        last = F.max_by("category", F.struct("edited_at", "category"))
    else:
        last = F.when(F.min("category") == F.max("category"), F.max("category")).otherwise(F.raise_error(
            F.concat(F.lit("two edits without edited_at of row "), F.first("row_id").cast("string"), F.lit(" of "), F.first(source))))
    edits = overrides.groupBy(source, "row_id").agg(last.alias("_category"))
    joined = ledger.join(edits, [source, "row_id"], "left")
    edited = joined.withColumn("category", F.coalesce("_category", "category"))
    return with_dimensions(edited.drop("_category")).select(
        *ledger.columns, *(c for c in ("functional", "category_type") if c not in ledger.columns))
