"""Scan statement files of any layout into one stored relation.

``raw_cells``: ``file``, ``file_name``, ``block``, ``row_id``, ``cells ARRAY<STRING>``.  ``row_id`` counts the rows of a
file that aren't blank from 0, so it depends on the file alone: not on how it is split, nor on other files.
A file that can't be read is left out and listed with the reason, see :func:`scan`.

CSV files are read as lines, in splits, so a huge export is spread over many tasks and rows
may have any number of columns.  Only files with line breaks inside quoted cells are read
again, to join the lines of such records.  Lines are taken as ISO-8859-1, which keeps every byte and splits exactly
like UTF-8 because delimiters and quotes are ASCII.  Whether a file really is UTF-8 is
decided later per file (:func:`utf8_text`, :func:`is_utf8`), so both encodings cost one scan.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip
from ledgerloom.session import materialize
from ledgerloom.sources import workbook

RAW_SCHEMA = ("file string, file_name string, block bigint, row_id bigint, "
              "cells array<string>")

# --- fixed values: cell texts that mean "missing" ---------------------------------------
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

UNCLOSED, NO_WORKBOOK, OTHER_KIND = "quoted cell never closed", "no readable workbook", "neither csv nor xlsx"
#: Splits up to this number, at 32 bytes each, are sent to every task to number rows; more are joined by shuffle.
SENT_SPLITS = 1_000_000

_CSV_FILES = "*.[cC][sS][vV]"
_EXCEL_FILES = "*.[xX][lL][sS][xX]"

# a cell: quoted (doubled quotes inside, text after the closing quote kept) or not quoted
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_CELL = rf',({_QUOTED}|[^,]*+)'
_COMPLETE = rf'^(?:,(?:{_QUOTED}|(?!")[^,]*+))*+$'


@dataclass(frozen=True)
class Scan:
    """``cells`` of the files that could be read; ``file, file_name, reason`` of those that couldn't."""

    cells: DataFrame
    skipped: DataFrame


def utf8_text(latin: Column) -> Column:
    """The same bytes read as UTF-8."""
    return F.encode(latin, "ISO-8859-1").cast("string")


def is_utf8(latin: Column) -> Column:
    return F.is_valid_utf8(utf8_text(latin))


def null_texts_to_null(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.when(~c.isin(*NULL_TEXTS), c))


def _split_line(line: Column) -> Column:
    """Cells of a line; lines without quotes, the usual case, take a plain split."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    unquoted = F.transform(quoted, lambda c: F.when(
        c.startswith('"'),
        F.replace(F.regexp_replace(c, r'^"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"')),
    ).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.split(line, ",", -1))


def _is_open(line: Column) -> Column:
    """A quoted cell starts on this line and does not end on it."""
    return F.contains(line, F.lit('"')) & ~F.concat(F.lit(","), line).rlike(_COMPLETE)


def _file_columns() -> list[Column]:
    name = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return [
        F.col("_metadata.file_path").alias("file"),
        F.url_decode(name).alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    ]


def _lines(spark: SparkSession, paths: str | list[str], blank: bool) -> DataFrame:
    """Lines as they come, numbered through the whole scan; blank ones are left out before that or stay."""
    text = (spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", _CSV_FILES).text(paths))
    line = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    if not blank:
        text = text.where(strip(line) != "")
    return text.select(*_file_columns(), line.alias("line"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Row ids that count the rows of a file, for rows of a stored scan.

    The rows of a split are numbered without gaps, so a row's place is its distance to the split's first row
    plus the rows of the file's splits before; only one row a split is aggregated and joined.
    """
    splits = lines.groupBy("file", "block").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    shifts = materialize(splits.select(F.xxhash64("file").alias("_file"), F.col("block").alias("_block"),
                                       (before - F.col("first")).alias("_shift")), "split-rows")
    if shifts.count() <= SENT_SPLITS:
        shifts = F.broadcast(shifts)
    same = (F.xxhash64("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    return lines.join(shifts, same).withColumn("row_id", F.col("row_id") + F.col("_shift")).drop("_file", "_block", "_shift")


def _split_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        "file", "file_name", "block", "row_id", _split_line(F.col("line")).alias("cells"),
        _is_open(F.col("line")).alias("open"))


def _odd(count: Column) -> Column:
    return count % 2 == 1


def _join_open_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join lines that belong to one record because a quoted cell spans them; and the files that end inside one.

    Whether a line starts inside a quoted cell depends on everything before it in the file.
    A line either forces the state after it, or keeps it, or flips it, and so does a whole
    split; the state at the start of each split therefore follows from one row per split,
    and no task ever needs more of a file than one split.
    """
    from_outside = _is_open(F.col("line"))
    from_inside = _is_open(F.concat(F.lit('"'), F.col("line")))
    in_split = Window.partitionBy("file", "block").orderBy("row_id")
    in_file = Window.partitionBy("file").orderBy("block")

    def last_forced(forced: str, flips: str, window: Window) -> Column:
        known = F.when(F.col(forced).isNotNull(), F.struct(
            F.col(forced).alias("state"), F.col(flips).alias("flips")))
        return F.last(known, ignorenulls=True).over(window)

    def since(last: str, flips: str, initial: Column) -> Column:
        known = F.col(last)
        return F.when(known.isNull(), initial != _odd(F.col(flips))).otherwise(
            known["state"] != _odd(F.col(flips) - known["flips"]))

    marked = lines.select(
        "*", F.when(from_outside == from_inside, from_outside).alias("forced"),
        (from_outside & ~from_inside).cast("int").alias("flip"),
    ).withColumn("flips", F.sum("flip").over(in_split)).withColumn(
        "last", last_forced("forced", "flips", in_split))

    outside = F.lit(False)
    splits = (
        marked.groupBy("file", "block").agg(F.max_by(F.struct("flips", "last"), "row_id").alias("end"))
        .select("file", "block", F.col("end.flips").alias("flips"), F.col("end.last").alias("last"))
        .select("file", "block", F.when(F.col("last").isNotNull(), since("last", "flips", outside))
                .alias("forced"), _odd(F.col("flips")).cast("int").alias("flip"))
        .withColumn("flips", F.sum("flip").over(in_file))
        .withColumn("last", last_forced("forced", "flips", in_file))
        .withColumn("after", since("last", "flips", outside))
        .select("file", "block", "after", F.lag("after", 1, False).over(in_file).alias("initial"))
    )
    splits = materialize(splits, "splits")
    ends = splits.groupBy("file").agg(F.max_by("after", "block").alias("inside"))
    unclosed = ends.where("inside").select("file")
    splits = splits.drop("after").join(unclosed, "file", "left_anti")
    states = (
        marked.join(splits, ["file", "block"])
        .withColumn("after", since("last", "flips", F.col("initial")))
        .withColumn("inside", F.coalesce(F.lag("after").over(in_split), "initial"))
        .select("file", "file_name", "block", "row_id", "line", "inside")
    )
    stored = materialize(states, "states")
    starts = stored.withColumn(
        "start", F.last(F.when(~F.col("inside"), F.col("row_id")), ignorenulls=True).over(in_split))
    # a record reaching into a split began at the last start before that split
    carried = (
        stored.groupBy("file", "block")
        .agg(F.max(F.when(~F.col("inside"), F.struct("block", "row_id"))).alias("last_start"))
        .select("file", "block", F.last("last_start", ignorenulls=True).over(
            in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    begins = F.when(F.col("start").isNotNull(), F.struct("block", F.col("start").alias("row_id"))
                    ).otherwise(F.col("carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row_id", "line")))
    records = (
        starts.join(carried, ["file", "block"])
        .groupBy("file", "file_name", begins.alias("begins"))
        .agg(F.concat_ws("\n", F.transform(parts, lambda p: p["line"])).alias("line"))
        .where(strip(F.col("line")) != "")
        .select("file", "file_name", "begins.block", "begins.row_id", "line")
    )
    own = records.groupBy("file", "block").agg(F.count("*").alias("n")).select(
        "file", "block", (F.sum("n").over(in_file) - F.col("n")).alias("_before"))
    placed = records.withColumn("row_id", F.row_number().over(in_split) - 1).join(own, ["file", "block"])
    return placed.withColumn("row_id", F.col("row_id") + F.col("_before")).drop("_before"), unclosed


def csv_cells(spark: SparkSession, path: str) -> Scan:
    """Cells of all ``*.csv`` files below ``path``, stored in the scratch folder."""
    lines = _numbered(materialize(_split_lines(_lines(spark, path, blank=False)), "lines"))
    broken = materialize(lines.where("open").select("file", "file_name").distinct(), "broken")
    if broken.isEmpty():
        return Scan(lines.drop("open"), broken.withColumn("reason", F.lit(UNCLOSED)))
    again = materialize(_lines(spark, path, blank=True).join(broken, "file", "left_semi"), "reread")
    joined, unclosed = _join_open_lines(again)
    records = materialize(_split_lines(joined).drop("open"), "records")
    intact = lines.drop("open").join(broken, "file", "left_anti")
    bad = materialize(broken.join(unclosed, "file", "left_semi").withColumn("reason", F.lit(UNCLOSED)), "unclosed")
    return Scan(intact.unionByName(records), bad)


def _sheet_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, name, content in zip(batch["path"], batch["name"], batch["content"]):
            own = {"file": path, "file_name": name, "block": 0}
            try:
                for start, rows in workbook.first_sheet_batches(content):
                    yield pd.DataFrame({**own, "row_id": range(start, start + len(rows)), "cells": rows})
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError):
                yield pd.DataFrame({**own, "row_id": [-1], "cells": [None]})


def excel_cells(spark: SparkSession, path: str) -> Scan | None:
    """Cells of the first sheet of all ``*.xlsx`` files, stored; None without such files.

    A sheet holds at most 1,048,576 rows, which bounds the work per file.  ``row_id`` is the
    row position in the file.  Text is kept the way CSV bytes are, see :func:`utf8_text`.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", _EXCEL_FILES).load(path))
    if files.select("path").isEmpty():
        return None
    named = files.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "content")
    as_bytes = F.transform("cells", lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))
    sheets = named.mapInPandas(_sheet_batches, RAW_SCHEMA).withColumn("cells", as_bytes)
    stored = materialize(sheets, "sheets")
    bad = stored.where("row_id < 0").select("file", "file_name", F.lit(NO_WORKBOOK).alias("reason"))
    return Scan(stored.join(bad, "file", "left_anti"), bad)


def _other_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of other kinds; only their names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    other = files.where(~F.lower(name).rlike(r"\.(csv|xlsx)$"))
    return other.select(F.col("path").alias("file"), name.alias("file_name"), F.lit(OTHER_KIND).alias("reason"))


def scan(spark: SparkSession, path: str) -> Scan:
    """All statement files below ``path``, CSV and Excel, as one stored relation, and the files left out.

    Stored, because text is then parsed only once.  A file that can't be read doesn't hold up the others.
    """
    found = [s for s in (csv_cells(spark, path), excel_cells(spark, path)) if s is not None]
    cells, skipped = found[0].cells, found[0].skipped
    for more in found[1:]:
        cells, skipped = cells.unionByName(more.cells), skipped.unionByName(more.skipped)
    return Scan(cells, skipped.unionByName(_other_files(spark, path)))


def raw_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a scan; an error if there are statement files and none can be read."""
    found = scan(spark, path)
    if found.cells.isEmpty():
        bad = found.skipped.where(F.col("reason") != OTHER_KIND).limit(10).collect()
        if bad:
            raise ValueError("; ".join(f"{r.reason}: {r.file}" for r in bad))
    return found.cells


def preview(raw: DataFrame, rows: int = 15) -> DataFrame:
    """First rows of a scan, as read."""
    return raw.select("file_name", "cells").limit(rows)
