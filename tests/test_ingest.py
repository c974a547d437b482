import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import cells, detect, statements


def write(folder, name, content, encoding="utf-8"):
    (folder / name).write_bytes(content.encode(encoding))


def rows(ledger, name=None):
    kept = ledger if name is None else ledger.where(F.col("source_file") == name)
    return [(r.txn_ts.date().isoformat(), r.description, float(r.amount))
            for r in kept.orderBy("source_file", "row_id").collect()]


DAY = "2026-01-02"
FILES = {
    "AccountHistory single.csv": (
        "Date,Description,Amount\n2026-01-02,  Gift  ,\"1,234.50\"\n01/02/2026,b,$5\n"
        "1/2/26,c,(5.00)\n\"Jan 2, 2026\",d,-(5)\n\n13/02/2026,g,abc\njunk,h,1\n,i,2\n",
        [(DAY, "Gift", 1234.5), (DAY, "b", 5), (DAY, "c", -5), (DAY, "d", 0),
         ("2026-02-13", "g", 0)]),
    "debit_credit.csv": ("Posting Date,Memo,Debit,Credit\n2026-01-02,a,5,\n2026-01-02,b,,7.25\n",
                         [(DAY, "a", -5), (DAY, "b", 7.25)]),
    "debit_only.csv": ("Date,Details,Withdrawal\n2026-01-02,a,-5\n", [(DAY, "a", -5)]),
    "credit_only.csv": ("Date,Details,Deposit\n2026-01-02,a,-5\n", [(DAY, "a", 5)]),
    "no_amount.csv": ("Date,Payee,Col3\n2026-01-02,a,5\n2026-01-02,b,9\n",
                      [(DAY, "a", 5), (DAY, "b", 9)]),
    "value_date.csv": ("Value Date,Narrative,Amount\n2026-01-02,a,5\n", [(DAY, "a", 0)]),
    "no_names.csv": ("A,B,C\n2026-01-02,long text here,5\n2026-01-03,other text,6\n",
                     [(DAY, "long text here", 5), ("2026-01-03", "other text", 6)]),
    "banner.csv": ("My Bank,,\nStatement,,\nDate,Description,Amount\n2026-01-02,a,5\n",
                   [(DAY, "a", 5)]),
    "unnamed.csv": (",,\nDate,,Amount\n2026-01-02,some longer text,5\n",
                    [(DAY, "some longer text", 5)]),
    "quoted.csv": ("Date,Description,Amount\n2026-01-02,\"x, \"\"y\"\"\",5\n",
                   [(DAY, 'x, "y"', 5)]),
    "line_break.csv": ("Date,Description,Amount\n2026-01-02,\"x, y\nz, \"\"q\"\"\",5\n"
                       "2026-01-03,w,6\n",
                       [(DAY, 'x, y\nz, "q"', 5), ("2026-01-03", "w", 6)]),
    "line_breaks.csv": ("Date,Description,Amount\n2026-01-02,\"a\n\n\"\"b\"\"\n2026-01-09,c,1\n\",5\n"
                        "2026-01-03,\"\n\",6\n\n2026-01-04,\"5\"\" x\",7\n2026-01-05,5\" y,8\n",
                        [(DAY, 'a\n\n"b"\n2026-01-09,c,1', 5), ("2026-01-03", "", 6),
                         ("2026-01-04", '5" x', 7), ("2026-01-05", '5" y', 8)]),
    "stray_quote.csv": ("Date,Description,Amount\n2026-01-02,5\" pipe,5\n", [(DAY, '5" pipe', 5)]),
    "nulls.csv": ("Date,Description,Amount\n2026-01-02,nan,5\n2026-01-02,N/A,NULL\n",
                  [(DAY, "", 5), (DAY, "", 0)]),
    # a mostly empty first data row makes the next filled row the header
    "sparse.csv": ("Date,Description,Amount\n2026-01-02,,\nTrans Date,Memo,Value\n"
                   "2026-01-03,b,6\n", [("2026-01-03", "b", 6)]),
    "bom.csv": ("﻿Date,Description,Amount\n2026-01-02,é,5\n", [(DAY, "é", 5)]),
    "empty.csv": ("Date,Description,Amount\n", []),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("statements")
    (made / "sub").mkdir()
    for i, (name, (content, _)) in enumerate(FILES.items()):
        write(made / "sub" if i % 2 else made, name, content)
    write(made, "latin.CSV", "Date,Description,Amount\n2026-01-02,caf\xe9,5\n", "latin-1")
    return made


@pytest.fixture(scope="module")
def ledger(spark, folder):
    return statements.read_statements(spark, str(folder)).cache()


@pytest.mark.parametrize("name", FILES)
def test_layouts(ledger, name):
    assert rows(ledger, name) == [(d, t, float(a)) for d, t, a in FILES[name][1]]


def test_encoding_fallback(ledger):
    assert rows(ledger, "latin.CSV") == [(DAY, "café", 5.0)]


def test_accounts_and_schema(ledger):
    named = {r.source_file: r.account for r in ledger.collect()}
    assert named["AccountHistory single.csv"] == "Account single"
    assert dict(ledger.dtypes)["amount"] == "decimal(28,4)"
    assert dict(ledger.dtypes)["txn_ts"] == "timestamp_ntz"


def test_splits_keep_file_order(spark, tmp_path):
    """A file read in several splits gives the rows of the file, in its order."""
    lines = [f"2026-01-02,row {i},{i}" for i in range(3000)]
    write(tmp_path, "big.csv", "\n".join(["Date,Description,Amount", *lines]))
    write(tmp_path, "breaks.csv", "Date,Description,Amount\n" + "\n".join(
        f'2026-01-02,"row\n{i}",{i}' for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = cells.raw_cells(spark, str(tmp_path))
        assert raw.where("file_name = 'big.csv'").select("block").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = statements.standardize(raw, detect.detect_columns(raw))
    assert [r[2] for r in rows(found, "big.csv")] == list(range(3000))
    assert [r[1] for r in rows(found, "breaks.csv")] == [f"row\n{i}" for i in range(1000)]


def test_records_over_several_splits(spark, tmp_path):
    """Records much longer than a split, and splits starting anywhere in them."""
    texts = ["\n".join(f"{i} part {k}" for k in range(length))
             for i, length in enumerate([1, 3, 400, 2, 1, 900, 1, 50, 5])]
    write(tmp_path, "long.csv", "Date,Description,Amount\n" + "".join(
        f'2026-01-02,"{t}, ""x""",{i}\n' for i, t in enumerate(texts)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = cells.raw_cells(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = statements.standardize(raw, detect.detect_columns(raw))
    assert [(r[1], r[2]) for r in rows(found)] == [
        (f'{t}, "x"', float(i)) for i, t in enumerate(texts)]


def test_overrides_and_account_names(spark, tmp_path):
    write(tmp_path, "v.csv", "Value Date,Narrative,Amount,Note\n2026-01-02,a,5,hello\n")
    write(tmp_path, "w.csv", "Date,Memo,Amount\n2026-01-02,a,5\n")
    overrides = spark.createDataFrame(
        [("v.csv", "Amount", "Note"), ("w.csv", None, "(none)")],
        "file_name string, amount string, desc string")
    names = spark.createDataFrame([("v.csv", "Savings")], "file_name string, account string")
    found = statements.read_statements(spark, str(tmp_path), overrides=overrides, accounts=names)
    assert rows(found) == [(DAY, "hello", 5.0), (DAY, "", 5.0)]
    assert [r.account for r in found.orderBy("source_file").collect()] == ["Savings", "w"]


def test_many_columns_and_preview(spark, tmp_path):
    header = ["Date", "Description", *(f"x{i}" for i in range(200)), "Amount"]
    write(tmp_path, "wide.csv", ",".join(header) + "\n2026-01-02,a," + "v," * 200 + "9\n")
    assert rows(statements.read_statements(spark, str(tmp_path))) == [(DAY, "a", 9.0)]
    raw = cells.raw_cells(spark, str(tmp_path))
    assert cells.preview(raw).count() == 2
    mapping = detect.detect_columns(raw).first()
    assert (mapping.date_pos, mapping.desc_pos, mapping.amount_pos) == (0, 1, 202)


def _workbook() -> bytes:
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
      <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Memo</t></is></c>
        <c r="C1" t="str"><v>Amount</v></c></row>
      <row r="2"><c r="A2" s="1"><v>46024</v></c><c r="B2" t="s"><v>1</v></c><c r="C2"><v>12.5</v></c></row>
      <row r="3"><c r="A3" s="1"><v>46025.5</v></c><c r="C3"><v>-3</v></c></row>
    </sheetData></worksheet>"""
    parts = {
        "xl/workbook.xml": """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
          xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
          <sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>""",
        "xl/_rels/workbook.xml.rels": """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
          <Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>""",
        "xl/sharedStrings.xml": """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
          <si><t>Trans Date</t></si><si><r><t>Ice </t></r><r><t>rink é</t></r></si></sst>""",
        "xl/styles.xml": """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
          <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>""",
        "xl/worksheets/sheet1.xml": sheet,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(_workbook())
    write(tmp_path, "c.csv", "Date,Memo,Amount\n2026-01-02,a,5\n")
    found = statements.read_statements(spark, str(tmp_path))
    assert rows(found) == [("2026-01-02", "Ice rink é", 12.5), ("2026-01-03", "", -3.0),
                           ("2026-01-02", "a", 5.0)]
    noon = found.where("amount = -3").first().txn_ts
    assert noon == dt.datetime(2026, 1, 3, 12)


def test_open_quotes_in_files_named_like_globs(spark, tmp_path):
    for i, name in enumerate(("stmt [2026].csv", "a{b,c}?*.csv", "plain.csv")):
        write(tmp_path, name, f'Date,Description,Amount\n2026-01-02,"x\ny",{i}\n')
    found = statements.read_statements(spark, str(tmp_path))
    for i, name in enumerate(("stmt [2026].csv", "a{b,c}?*.csv", "plain.csv")):
        assert rows(found, name) == [(DAY, "x\ny", i)]


def test_unclosed_quote_is_an_error(spark, tmp_path):
    write(tmp_path, "bad.csv", 'Date,Description,Amount\n2026-01-02,"a,5\n2026-01-03,b,6\n')
    with pytest.raises(ValueError, match="bad.csv"):
        statements.read_statements(spark, str(tmp_path))


def test_dates_are_parsed_once_a_row(spark, folder):
    """A filter inferred from exploding the dates, below their parsing, would parse them a second time."""
    plan = statements.read_statements(spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("make_timestamp_ntz(") == 1, plan
