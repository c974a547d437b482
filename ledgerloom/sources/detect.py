"""Find header row and column roles of every statement file, as data.

The result has one row per file: ``file``, ``file_name``, ``utf8``, ``names``,
``header_block``, ``header_row`` and 0-based ``date_pos``, ``desc_pos``, ``amount_pos``,
``debit_pos``, ``credit_pos``.  No step gathers a file's rows in one place: the first rows
are those with the lowest row ids, everything else comes from map-side combined aggregates.

A file is as wide as most of its rows, so single rows with more or fewer cells don't move its header.  A name that
occurs again is numbered: ``Amount``, ``Amount.1``, ``Amount.2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import parse_amount
from ledgerloom.functions.text import strip
from ledgerloom.session import materialize
from ledgerloom.sources.cells import is_utf8, null_texts_to_null, utf8_text

# --- fixed values: column name patterns per role ----------------------------------------
ROLE_PATTERNS = {
    "date": r"date|trans.*date|post.*date|effective.*date|settlement.*date|value.*date",
    "desc": r"desc|memo|narrat|detail|particular|reference|payee|transaction.*type|remark",
    "amount": r"amount|value|sum|total",
    "debit": r"debit|withdrawal|charge",
    "credit": r"credit|deposit|receipt",
}

HEADER_SEARCH_ROWS = 5
SAMPLE_ROWS = 10
#: Rows whose filled cells are counted together.
RUN_ROWS = 1024
NO_COLUMN = "(none)"

_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def decoded(cells: Column, utf8: Column) -> Column:
    return F.transform(cells, lambda c: F.when(utf8, utf8_text(c)).otherwise(c))


def _first(items: Column, condition) -> Column:
    return F.get(F.filter(items, condition), F.lit(0))


def _filled(cells: Column) -> Column:
    return F.size(F.filter(null_texts_to_null(cells), lambda c: c.isNotNull()))


def _names(header: Column, columns: Column) -> Column:
    recovered = header["rn"] > 1
    cells = F.when(recovered, null_texts_to_null(header["cells"])).otherwise(header["cells"])

    def name(i: Column) -> Column:
        cell = F.get(cells, i)
        blank = F.concat(F.when(recovered, F.lit("Column_")).otherwise(F.lit("Unnamed: ")),
                         i.cast("string"))
        named = strip(F.regexp_replace(cell, "^﻿", ""))
        return F.when(cell.isNull() | (cell == ""), blank).otherwise(named)

    named = F.when(columns > 0, F.transform(F.sequence(F.lit(0), columns - 1), name)).otherwise(
        F.array().cast("array<string>"))
    # bound by a lambda, so that the names are made once
    return F.get(F.transform(F.array(named), _told_apart), F.lit(0))


def _told_apart(names: Column) -> Column:
    """Names that stand further to the left already get the number of times they do."""
    def numbered(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda n: n == name))
        return F.when(before > 0, F.concat(name, F.lit("."), before.cast("string"))).otherwise(name)
    return F.transform(names, numbered)


def _role_position(names: Column, pattern: str) -> Column:
    return F.array_min(F.transform(
        names, lambda n, i: F.when(F.lower(n).rlike(pattern), i)))


def header_rows(raw: DataFrame) -> DataFrame:
    """Header row, column names and encoding per file."""
    widths = raw.groupBy("file", "file_name", F.size("cells").alias("width")).agg(
        F.count("*").alias("n"), F.bool_and(is_utf8(F.concat_ws("", "cells"))).alias("utf8"))
    stats = widths.groupBy("file", "file_name").agg(
        F.max_by("width", F.struct("n", "width")).alias("columns"), F.bool_and("utf8").alias("utf8"))
    first_rows = (
        raw.where(F.col("row_id") <= HEADER_SEARCH_ROWS)
        .select("file", "block", "row_id", "cells", (F.col("row_id") + 1).cast("int").alias("rn"))
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "block", "row_id", "cells"))).alias("rows"))
    )
    rows = F.transform("rows", lambda r: F.struct(
        r["rn"].alias("rn"), r["block"].alias("block"), r["row_id"].alias("row_id"),
        decoded(r["cells"], F.col("utf8")).alias("cells")))
    per_file = stats.join(first_rows, "file").withColumn("rows", rows)

    top, second = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    first_name = F.get(top["cells"], F.lit(0))
    nameless = first_name.isNull() | (first_name == "") | F.startswith(
        strip(first_name), F.lit("Unnamed"))
    mostly_empty = F.coalesce(
        F.col("columns") - _filled(second["cells"]) > F.floor(F.col("columns") / 2), F.lit(False))
    recovered = _first(F.col("rows"), lambda r: (r["rn"] > 1) & (_filled(r["cells"]) >= 2))
    header = F.when(nameless | mostly_empty, F.coalesce(recovered, top)).otherwise(top)
    return (
        per_file.withColumn("header", header)
        .select("file", "file_name", "utf8",
                F.col("header.block").alias("header_block"),
                F.col("header.row_id").alias("header_row"),
                _names(F.col("header"), F.greatest("columns", F.size("header.cells"))).alias("names"))
    )


def data_rows(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows below each file's header, with that file's mapping columns."""
    joined = raw.drop("file_name").join(mapping, "file")
    return joined.where(F.col("row_id") > F.col("header_row"))


def _filled_cells(rows: DataFrame) -> DataFrame:
    """Non-null cells of rows: ``file, row_id, pos, cell``."""
    return rows.select(
        "file", "row_id",
        F.posexplode(null_texts_to_null(decoded(F.col("cells"), F.col("utf8")))).alias("pos", "cell"),
    ).where(F.col("cell").isNotNull())


def _column_kinds(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per file and column: ``textual`` (any cell is no number), ``dates`` and ``mean_length`` of the first filled cells.

    One pass counts the filled cells of every run of rows, combined inside its tasks.  The counts tell in which run a column's
    last sample cell lies, so that a second pass takes rows up to there only and a column hands on no more cells than the
    sample and one run have, however many rows its file has and however late its cells begin.
    """
    rows = data_rows(raw, mapping.drop("names"))
    run = F.floor(F.col("row_id") / RUN_ROWS)
    runs = materialize(_filled_cells(rows).groupBy("file", "pos", run.alias("run")).agg(
        F.count("*").alias("n"), F.bool_or(~F.col("cell").rlike(_NUMBER)).alias("textual")), "runs")
    in_column = Window.partitionBy("file", "pos").orderBy("run")
    # a column's sample lies in its first SAMPLE_ROWS runs, so tasks keep that many of each before they are put in order
    first_runs = runs.withColumn("rn", F.row_number().over(in_column)).where(F.col("rn") <= SAMPLE_ROWS)
    before = F.sum("n").over(in_column.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    last_runs = first_runs.withColumn("before", before).where(F.col("before") < SAMPLE_ROWS).groupBy("file", "pos").agg(
        F.max("run").alias("last_run"))
    last_rows = last_runs.groupBy("file").agg(F.max("last_run").alias("stop"))
    near = rows.join(last_rows, "file").where(run <= F.col("stop"))
    cells = _filled_cells(near).join(last_runs, ["file", "pos"]).where(run <= F.col("last_run"))
    first_cells = cells.groupBy("file", "pos").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("row_id", "cell"))), 1, SAMPLE_ROWS).alias("sample"))
    sample = first_cells.select("file", "pos", F.explode("sample.cell").alias("cell")).groupBy("file", "pos").agg(
        F.bool_and(parse_date("cell").isNotNull()).alias("dates"), F.avg(F.length("cell")).alias("mean_length"))
    return sample.join(runs.groupBy("file", "pos").agg(F.bool_or("textual").alias("textual")), ["file", "pos"])


def _fill_date_and_description(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fallbacks from the data of files whose column names did not give both roles."""
    missing = mapping.where(F.col("date_pos").isNull() | F.col("desc_pos").isNull())
    per_file = (
        _column_kinds(raw, missing).groupBy("file")
        .agg(F.collect_set(F.when(~F.col("dates"), F.col("pos"))).alias("not_dates"),
             F.collect_set(F.when(F.col("textual") & (F.col("mean_length") > 5), F.col("pos")))
             .alias("texts"))
    )
    none = F.array().cast("array<int>")
    not_dates, texts = F.coalesce("not_dates", none), F.coalesce("texts", none)
    positions = F.transform("names", lambda n, i: i)
    date_pos = F.coalesce("date_pos", _first(positions, lambda p: ~F.array_contains(not_dates, p)))
    filled = mapping.join(per_file, "file", "left").withColumn(
        "date_pos", date_pos)
    other = F.filter(texts, lambda p: ~p.eqNullSafe(F.col("date_pos")))
    return filled.withColumn("desc_pos", F.coalesce("desc_pos", F.array_min(other))).drop(
        "not_dates", "texts")


def detect_columns(raw: DataFrame) -> DataFrame:
    """Header and column roles per file.  ``raw`` must be stored, see ``materialize``."""
    roles = {f"{role}_pos": _role_position(F.col("names"), pattern)
             for role, pattern in ROLE_PATTERNS.items()}
    mapping = materialize(header_rows(raw).withColumns(roles), "mapping")
    if mapping.where(F.col("date_pos").isNull() | F.col("desc_pos").isNull()).isEmpty():
        return mapping
    return materialize(_fill_date_and_description(raw, mapping), "mapping")


def override_columns(mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply user choices: ``file`` (the whole path) or ``file_name``, plus column names per role.

    ``overrides`` has any of the columns ``date desc amount debit credit``; null keeps the
    detected column, ``(none)`` unmaps the role.  A name that the file doesn't have is an error.
    """
    roles = [r for r in ROLE_PATTERNS if r in overrides.columns]
    key = "file" if "file" in overrides.columns else "file_name"
    chosen = overrides.select(key, *(F.col(r).alias(f"_{r}") for r in roles))
    joined = mapping.join(chosen, key, "left")
    wanted = F.array_compact(F.array(*(F.col(f"_{r}") for r in roles), F.lit(None).cast("string")))
    unknown = F.filter(wanted, lambda n: (n != NO_COLUMN) & ~F.array_contains("names", n))
    wrong = joined.where(F.size(unknown) > 0).select("file", unknown.alias("n"), "names").limit(10).collect()  # one row a file
    if wrong:
        raise ValueError("; ".join(f"no column {', '.join(r.n)} in {r.file}, only {', '.join(r.names)}" for r in wrong))
    for role in roles:
        wanted = F.col(f"_{role}")
        position = F.array_position("names", wanted).cast("int")
        joined = joined.withColumn(
            f"{role}_pos",
            F.when(wanted.isNull(), F.col(f"{role}_pos"))
            .when((wanted != NO_COLUMN) & (position > 0), position - 1))
    return joined.select(*mapping.columns)


def fill_amounts(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``value_pos``: the first column holding any money, for files without a money role."""
    without = mapping.where(
        F.col("amount_pos").isNull() & F.col("debit_pos").isNull() & F.col("credit_pos").isNull())
    if without.isEmpty():
        return mapping.withColumn("value_pos", F.lit(None).cast("int"))
    found = (
        _filled_cells(data_rows(raw, without.drop("names"))).groupBy("file", "pos")
        .agg(F.sum(F.abs(parse_amount(F.col("cell")))).alias("total"))
        .where(F.col("total") > 0)
        .groupBy("file").agg(F.min("pos").alias("value_pos"))
    )
    return materialize(mapping.join(found, "file", "left"), "mapping")
