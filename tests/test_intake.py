"""Files that are odd: what is left out is counted, and rows keep their names."""

import pytest
from pyspark.sql import Observation
from test_ingest import DAY, rows, write

from ledgerloom.functions.classify import classify
from ledgerloom.functions.dates import parse_date
from ledgerloom.operators.edits import override_categories
from ledgerloom.sources import cells, detect, statements

HEAD = "Date,Description,Amount\n"
READ = {
    "2026-01-02T10:00:00Z": "2026-01-02 10:00:00", "2026/01/02 10:00:00": "2026-01-02 10:00:00", "Sept 5 2026": "2026-09-05 00:00:00",
    "1/2/26 3:04 PM": "2026-01-02 15:04:00", "Jan 2, 2026 10:00 AM": "2026-01-02 10:00:00", "02 January, 2026": "2026-01-02 00:00:00",
    "2026 Jan 2": "2026-01-02 00:00:00", "02.01.26": "2026-02-01 00:00:00", "Fri, 02 Jan 2026 10:00:00 +0200": "2026-01-02 10:00:00",
    "2026-13-02": "2026-02-13 00:00:00", "45-01-02": "2045-01-02 00:00:00", "1/2/76": "1976-01-02 00:00:00", "1/2/2026 12:15 am": "2026-01-02 00:15:00",
    "Friday, January 2nd, 2026": "2026-01-02 00:00:00", "2026-01-02 10:11:12.123456789": "2026-01-02 10:11:12.123456",
}
UNREAD = ["12.50", "1,234", "12.2026", "1 2 3", "5", "2026", "junk", "2026-02-30", "1/2/2026 25:00", "1/2/2026 13:00 PM", "Sepember 5 2026",
          ";" * 16, "#;1;2;3;4;5;6;7;8;9;0;1;2;3;4;5;6", "Jan 2", "1/2-2026", "0026-01-02", "", "2026-01-02 10:00:60"]


def test_dates_by_their_parts(spark):
    frame = spark.createDataFrame([(t,) for t in [*READ, *UNREAD]] + [(None,)], "t string")
    found = {r.t: r.d and str(r.d) for r in frame.select("t", parse_date("t").alias("d")).collect()}
    assert found == {**READ, **dict.fromkeys(UNREAD), None: None}


def test_a_text_is_parsed_once_a_row(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + f"{DAY},a,5\n")
    plan = statements.read_statements(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t") + plan.count("try_make_timestamp_ntz") <= 4


def test_an_unclosed_quote_leaves_other_files_whole(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + f'{DAY},"x\ny",5\n')
    write(tmp_path, "b.csv", HEAD + f'{DAY},"never,5\n{DAY},b,6\n')
    write(tmp_path, "c.csv", HEAD + f"{DAY},c,7\n")
    write(tmp_path, "d.xlsx", "no workbook")
    write(tmp_path, "notes.txt", "nothing")
    found = statements.read_statements(spark, str(tmp_path))
    assert rows(found) == [(DAY, "x\ny", 5.0), (DAY, "c", 7.0)]
    report = {r.file_name: r for r in statements.ingest_report(spark, str(tmp_path)).collect()}
    assert {n: r.skipped for n, r in report.items()} == {
        "a.csv": None, "b.csv": cells.UNCLOSED, "c.csv": None, "d.xlsx": cells.NO_WORKBOOK, "notes.txt": cells.OTHER_KIND}
    assert report["a.csv"].rows == report["a.csv"].kept == 1 and report["b.csv"].rows == 0


def test_what_is_dropped_is_counted(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + f"{DAY},a,5\nsoon,b,6\n,c,7\n{DAY},d,-(5)\n{DAY},e,\n")
    write(tmp_path, "b.csv", f"Date,Memo,Debit,Credit\n{DAY},a,5,\n{DAY},b,,\n")
    write(tmp_path, "empty.csv", HEAD)
    report = {r.file_name: (r.rows, r.kept, r.without_date, r.without_money) for r in statements.ingest_report(spark, str(tmp_path)).collect()}
    assert report == {"a.csv": (5, 3, 2, 2), "b.csv": (2, 2, 0, 1), "empty.csv": (0, 0, 0, 0)}
    seen = Observation("ingest")
    ledger = statements.read_statements(spark, str(tmp_path), observation=seen)
    assert len(ledger.collect()) == 5
    assert seen.get == {"rows": 7, "kept": 5, "without_date": 2, "without_money": 3}
    raw = cells.raw_cells(spark, str(tmp_path))
    left = statements.quarantine(raw, detect.detect_columns(raw)).orderBy("row_id").collect()
    assert [(r.file_name, r.row_id, r.reason, r.cells) for r in left] == [
        ("a.csv", 2, statements.NO_DATE, ["soon", "b", "6"]), ("a.csv", 3, statements.NO_DATE, [None, "c", "7"])]


def test_single_rows_do_not_move_the_header(spark, tmp_path):
    write(tmp_path, "wide.csv", HEAD + f"{DAY},rent,5\n{DAY},more,6,1,2,3,4,5,6\n{DAY},last,7\n")
    write(tmp_path, "banner.csv", f"My Bank\nStatement\n{HEAD}{DAY},a,5\n{DAY},b,6\n")
    write(tmp_path, "blank.csv", f",,\nDate,,Amount\n{DAY},some longer text,5\n")
    write(tmp_path, "short.csv", f"Date,Description,Amount,Note\n{DAY},a,5\n{DAY},b,6\n")
    found = statements.read_statements(spark, str(tmp_path))
    assert rows(found, "wide.csv") == [(DAY, "rent", 5.0), (DAY, "more", 6.0), (DAY, "last", 7.0)]
    assert rows(found, "banner.csv") == rows(found, "short.csv") == [(DAY, "a", 5.0), (DAY, "b", 6.0)]
    assert rows(found, "blank.csv") == [(DAY, "some longer text", 5.0)]


def test_names_that_occur_again(spark, tmp_path):
    write(tmp_path, "a.csv", f"Date,Memo,Amount,Amount,Memo,Amount\n{DAY},a,1,2,b,3\n")
    raw = cells.raw_cells(spark, str(tmp_path))
    mapping = detect.detect_columns(raw)
    assert mapping.first().names == ["Date", "Memo", "Amount", "Amount.1", "Memo.1", "Amount.2"]
    chosen = spark.createDataFrame([("a.csv", "Amount.2", "Memo.1")], "file_name string, amount string, desc string")
    assert rows(statements.standardize(raw, detect.override_columns(mapping, chosen))) == [(DAY, "b", 3.0)]
    wrong = spark.createDataFrame([("a.csv", "Total", None)], "file_name string, amount string, desc string")
    with pytest.raises(ValueError, match="no column Total"):
        detect.override_columns(mapping, wrong)


def test_rows_keep_their_names(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    lines = "".join(f"{DAY},row {i},{i + 1}\n{chr(10) if i % 3 else ''}" for i in range(300))
    write(tmp_path / "two", "s.csv", HEAD + lines)
    write(tmp_path / "two", "t.csv", HEAD + lines.replace("row 7,", '"row\n\n7",'))

    def names():
        found = statements.read_statements(spark, str(tmp_path)).where("source_path like '%/two/%'")
        return {(r.source_path, r.row_id): r.description for r in found.collect()}
    before = names()
    assert sorted(i for p, i in before if p.endswith("s.csv")) == list(range(1, 301))
    assert sorted(i for p, i in before if p.endswith("t.csv")) == list(range(1, 301))
    write(tmp_path / "one", "s.csv", HEAD + f"{DAY},other,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert names() == before
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    ledger = classify(statements.read_statements(spark, str(tmp_path)))
    path = next(p for p, _ in before if p.endswith("s.csv"))
    edit = spark.createDataFrame([(path, 1, "Grants")], "source_path string, row_id bigint, category string")
    changed = override_categories(ledger, edit).where("category = 'Grants'").collect()
    assert [(r.source_path, r.description) for r in changed] == [(path, "row 0")]
    with pytest.raises(ValueError, match="source_path"):
        override_categories(ledger, edit.withColumnRenamed("source_path", "source_file"))
    two = spark.createDataFrame([(path, 1, "Grants"), (path, 1, "Travel")], "source_path string, row_id bigint, category string")
    with pytest.raises(Exception, match="two edits"):
        override_categories(ledger, two).collect()


def test_samples_of_late_and_rare_columns(spark, tmp_path, monkeypatch):
    """A column's sample is its first ten filled cells, wherever they lie and however rows are counted together."""
    lines = ["A,B,C,D,E"]
    for i in range(200):
        late = f"2026-03-{1 + i % 28:02}" if i >= 150 else ""
        rare = ("no day" if i == 190 else "2026-01-05") if i % 19 == 0 else ""
        lines.append(f"x{i},{rare},{late},words of row {i},{i}")
    write(tmp_path, "a.csv", "\n".join(lines) + "\n")
    raw = cells.raw_cells(spark, str(tmp_path))
    for run_rows in (1, 3, 64, 1024):
        monkeypatch.setattr(detect, "RUN_ROWS", run_rows)
        found = {r.pos: (r.dates, r.textual, r.mean_length) for r in detect._column_kinds(raw, detect.header_rows(raw)).collect()}
        assert found == {0: (False, True, 2.0), 1: (True, True, 10.0), 2: (True, True, 10.0), 3: (False, True, 14.0), 4: (False, False, 1.0)}
        mapping = detect.detect_columns(raw).first()
        assert (mapping.date_pos, mapping.desc_pos) == (1, 2)


def test_no_cells_are_sorted_for_samples(spark, tmp_path):
    write(tmp_path, "a.csv", f"A,B,C\n{DAY},words and words,5\n")
    raw = cells.raw_cells(spark, str(tmp_path))
    plan = detect._column_kinds(raw, detect.header_rows(raw))._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line or "Window [" in line]
    assert all("cell" not in line for line in sorts)
