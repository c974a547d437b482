"""Rows of the first sheet of an .xlsx file (a zip of XML parts), in batches."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}
_EPOCH = dt.datetime(1899, 12, 30)


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _name(t) == "t")


def _children(book: zipfile.ZipFile, part: str, tag: str) -> list:
    if part not in book.namelist():
        return []
    return [e for e in ElementTree.fromstring(book.read(part)).iter() if _name(e) == tag]


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = _children(book, "xl/workbook.xml", "sheet")[0]
    rel_id = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    for rel in _children(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        if rel.get("Id") == rel_id:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    raise ValueError("workbook without a first sheet")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    custom = {
        int(f.get("numFmtId")) for f in _children(book, "xl/styles.xml", "numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))
    }
    styles = set()
    for block in _children(book, "xl/styles.xml", "cellXfs"):
        for i, xf in enumerate(block):
            if int(xf.get("numFmtId", 0)) in _DATE_FORMAT_IDS | custom:
                styles.add(i)
    return styles


def _column(reference: str) -> int:
    position = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        position = position * 26 + ord(letter) - ord("A") + 1
    return position - 1


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    raw = next((e.text for e in cell if _name(e) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind != "n":
        return raw
    number = float(raw)
    if int(cell.get("s", -1)) in dates:
        moment = _EPOCH + dt.timedelta(seconds=round(number * 86400))
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(number)) if number.is_integer() else repr(number)


def first_sheet_batches(content: bytes, size: int = 10_000) -> Iterator[tuple[int, list]]:
    """``(index of first row, rows)`` batches; a row is a list of texts or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(e) for e in _children(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        start, rows = 0, []
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if _name(element) != "row":
                    continue
                row: list[str | None] = []
                for i, cell in enumerate(e for e in element if _name(e) == "c"):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _value(cell, shared, dates)
                rows.append(row)
                element.clear()
                if len(rows) == size:
                    yield start, rows
                    start, rows = start + size, []
        if rows:
            yield start, rows
