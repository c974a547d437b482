import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as registered
import corpus_pipeline
from ledgerloom.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.queries()[name], oracle.oracle_sql()[name]) is None


def test_all_registered():
    assert {*queries.queries(), "pipeline"} <= set(registered.queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_native_plans(spark):
    for name in ("op6_chat_windows", "op9_line_quality"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def without_repeats(texts):
    """Texts without strings of 400 bytes and runs of 51 words that start at several places, by trying all of them."""
    places, cut = {}, {d: bytearray(b"\1" * len(t)) for d, t in texts.items()}
    for d, t in texts.items():
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", t)]
        for i in range(len(t) - 399):
            places.setdefault(t[i:i + 400], []).append((d, i, i + 400))
        for i in range(len(words) - 50):
            run = tuple(t[a:b] for a, b in words[i:i + 51])
            places.setdefault(run, []).append((d, words[i][0], words[i + 50][1]))
    for found in places.values():
        if len(found) > 1:
            for d, a, b in found:
                cut[d][a:b] = bytes(b - a)
    return {d: bytes(c for c, kept in zip(t, cut[d], strict=True) if kept).decode("utf-8", "ignore") for d, t in texts.items()}


def test_pipeline_stages_hold_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        results[name] = docs
        assert name == "pack" or docs.columns == columns
    first = queries.quality.verdicts(before).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in results["quality_rules"].collect()} == {r.doc_id for r in first}
    texts = {r.doc_id: r.text for r in results["quality_rules"].collect()}

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    sets = {d: shingles(t) for d, t in texts.items()}
    left = sorted(r.doc_id for r in results["near_duplicates"].collect())
    for i, a in enumerate(left):
        for b in left[:i]:
            both = len(sets[a] & sets[b])
            assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    whole = {r.doc_id: r.text.encode() for r in results["near_duplicates"].collect()}
    assert {r.doc_id: r.text for r in results["repeated_passages"].collect()} == without_repeats(whole)
    hit = queries.decontaminate.verdicts(results["repeated_passages"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    clean = {r.doc_id for r in hit.where("not contaminated").collect()}
    assert {r.doc_id for r in results["benchmark_decontamination"].collect()} == clean
    assert {r.doc_id for r in results["pack"].collect()} == clean
