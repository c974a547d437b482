"""Small cases of every operator: brute force, round trips, and rows that are null, empty, repeated or odd."""

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import (
    chat, decontaminate, jaccard, langid, lm, packing, quality, rans, suffix_dedup, token_files, tokens, toxicity,
)
from ledgerloom.llm.attention import Attention
from ledgerloom.llm.induced import suffix_order
from ledgerloom.llm.tokens import ByteTokens, WordTokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, key string, words int"
ODD = [None, "", " ", "\n\n", "a", "A b", "%%% ***", "é à ü", "x" * 5000, "one two three four five six seven eight nine ten " * 30]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, two of them twice, a repeated row, null ids, and columns named like inner ones."""
    rows = [(i, t, "en", "s", 0, 1, "k", 2) for i, t in enumerate(ODD)]
    rows += [(100, ODD[-1], None, None, 0, 1, "k", 2), (5, "A b", "en", "s", 0, 1, "k", 2), (None, "no id at all", "en", "s", 0, 1, "k", 2)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def encoded(path, text, end):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_give_the_tokenizers_ids():
    rng = random.Random(5)
    parts = ["a", "the", "Erly", "é", "ß", " ", "  ", "\n", ",", ".", "...", "!!", "'s", "’", "1", "\t", "<|endoftext|>", "İ", "\x1c", "\x00", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for tokens in (ByteTokens(BYTE), WordTokens(WORD)):
        want = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert tokens.encode([t.encode() for t in texts]) == want


@pytest.mark.parametrize("kind, path", [(ByteTokens, BYTE), (WordTokens, WORD)])
@pytest.mark.parametrize("joined", [1, 2, 64])
def test_pieces_joined_by_what_they_may_hold(monkeypatch, kind, path, joined):
    """Texts that hold the separators themselves, or white space beside them, get the tokenizer's ids, in any grouping."""
    monkeypatch.setattr("ledgerloom.llm.tokens.JOINED", joined)
    rng = random.Random(11)
    parts = ["a", "Erly", "é", " ", "\n", "|", " | ", "||", "a|b", "\t", ",", "\x0b", "7", "'s"]
    texts = ["", "|", " ", "\n", "word ", " word", "x\t", "\ty", "a\n"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    tokens = kind(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert tokens.encode([t.encode() for t in texts]) == want
    assert tokens.separator_id is not None


def test_packing_covers_every_id_once(odd, none):
    rows = packing.pack_documents(odd, BYTE, with_ids=True).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    for doc, text in enumerate(ODD):
        ids = encoded(BYTE, text, 0)
        copies = 2 if doc == 5 else 1
        own = sorted(found[doc], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids) and all(r.doc_tokens == len(ids) for r in own)
        for r in own:
            part = ids[r.start:r.start + r.length].tobytes()
            assert r.ids == part and r.ids_crc32 == zlib.crc32(part)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack_documents(none, BYTE).count() == 0


def test_instruction_data_keeps_all_limits(spark):
    """Examples with a loss mask of their own: each id lies in one piece, and the limit of loss-bearing tokens binds."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50_000) for _ in range(rng.randrange(40))]) for i in range(150)]
    rows = [(i, ids, [rng.random() < 0.7 for _ in ids]) for i, ids in rows] + [(900, None, None), (901, [5, 6, 7], [True]), (902, [8], None)]
    examples = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, loss array<boolean>").repartition(3)
    limits = packing.Limits(tokens=64, segments=4, loss=20)
    found = packing.pack_tokens(examples, limits, pool=40).collect()
    pieces, bins = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, ids, loss in rows:
        own = sorted(pieces.get(i, []), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids or [], "<u4").tobytes()
        assert sum(r.loss_tokens for r in own) == sum(loss or [])
    assert max(sum(r.loss_tokens for r in b) for b in bins.values()) == 20
    assert all(sum(r.length for r in b) <= 64 and len(b) <= 4 and sum(r.loss_tokens for r in b) <= 20 for b in bins.values())


@pytest.mark.parametrize("cut", [True, False])
def test_bins_keep_all_limits(cut):
    rng = np.random.default_rng(2)
    examples = [packing.Example(i, np.arange(n, dtype="<u4").tobytes(), rng.random(n) < 0.4)
                for i, n in enumerate(rng.integers(0, 90, 400))]
    limits = packing.Limits(tokens=64, segments=3, loss=20, cut=cut)
    bins = list(packing.pack(iter(examples), limits, pool=50))
    assert sum(len(e) for b in bins for e in b) == sum(len(e) for e in examples)
    for b in bins:
        single = not cut and len(b) == 1
        assert sum(len(e) for e in b) <= 64 or single
        assert len(b) <= 3 and (sum(int(e.loss.sum()) for e in b) <= 20 or single)


def test_rans_round_trip_parts_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1023, 1024, 5000, 300_000):
        ids = rng.zipf(1.3, n).clip(max=49_000).astype(np.uint32)
        table = rans.Frequencies.from_counts(np.bincount(ids, minlength=49_001))
        block = rans.encode(ids, table, lanes=256, every=16)
        assert (rans.decode(block, table) == ids).all()
        if n == 5000:
            parts = [rans.decode_part(block, table, k) for k in range(rans.checkpoints(block, table))]
            assert len(parts) > 1 and (np.concatenate(parts[::-1][::-1]) == ids).all()
            damaged = bytearray(block)
            damaged[-3] ^= 1
            with pytest.raises(rans.Corrupt):
                rans.decode(bytes(damaged), table)
            assert len(block) < 2 * n


def test_token_files_read_back_in_order(spark, odd, none, tmp_path):
    token_files.write(odd, str(tmp_path / "a"), WORD, files=3, block_ids=50)
    rows = token_files.read(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 100]
    at = 0
    for r in rows:
        text = ODD[-1] if r.doc_id == 100 else "no id at all" if r.doc_id is None else ODD[r.doc_id]
        ids = encoded(WORD, text, 1)
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    token_files.write(none, str(tmp_path / "b"), WORD)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize(("memory", "in_memory", "chunk"), [(5, 3, 4), (1000, 3, 1 << 18), (1000, 10**6, 1 << 18)])
def test_suffix_order_equals_sorting(tmp_path, monkeypatch, memory, in_memory, chunk):
    monkeypatch.setattr("ledgerloom.llm.induced.CHUNK", chunk)
    monkeypatch.setattr("ledgerloom.llm.induced.HELD", chunk)
    rng = np.random.default_rng(3)
    for case in range(60):
        limit = int(rng.integers(2, 40))
        core = rng.integers(1, 30, 30)
        text = np.concatenate([rng.integers(1, 1 + int(rng.integers(1, 30)), int(rng.integers(1, 60))), core,
                               np.tile(core[:3], case % 7), core, [0]])
        found = list(suffix_order(text, str(tmp_path), limit, memory, in_memory))
        order, common = (np.concatenate(c).tolist() for c in zip(*found, strict=True))
        cut = [tuple(text[i:i + limit].tolist()) for i in order]
        assert sorted(order) == list(range(len(text))) and cut == sorted(cut)
        for i in range(1, len(cut)):
            same = next((k for k, (a, b) in enumerate(zip(cut[i - 1], cut[i], strict=False)) if a != b), min(len(cut[i - 1]), len(cut[i])))
            assert common[i] == same


def test_repeated_strings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 105, 300).astype(np.uint8)).decode()
    texts = [base, base[:120] + "#" + base[121:], base[50:110] + base[50:110], None, "", "é" * 60, base[200:] + "x" + base[:40], base]
    rows = spark.createDataFrame([*enumerate(texts), (7, base)], "doc_id long, text string")
    length, gram = 20, 6
    raw = [(t or "").encode() for t in [*texts, base]]
    seen = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i:i + length], []).append((d, i))
    cut = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cut[d][i:i + length] = True
    want = sorted((min(d, 7), len(t), int(c.sum()), int(c[:1].sum()) + int((c[1:] & ~c[:-1]).sum()),
                   hashlib.sha256(rest := np.frombuffer(t, np.uint8)[~c].tobytes()).hexdigest(), rest.decode("utf-8", "ignore")) for d, (t, c) in enumerate(zip(raw, cut, strict=True)))
    assert sorted(tuple(r) for r in suffix_dedup.remove(rows, length, gram).collect()) == want
    left = {r.doc_id: r.text for r in suffix_dedup.rewrite(rows.where("doc_id < 7"), length, gram).collect()}
    assert left[3] is None and left[4] == "" and len(left[2].encode()) < 120


def test_repeated_passages_of_over_50_words(spark):
    rng = random.Random(9)

    def some(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(n)]
    texts, want = [], []
    for n in (50, 51, 52, 57, 64):
        passage, second = some(n), some(20)
        for apart in (" ", "\n"):
            before, after = some(30), some(30)
            texts.append(" ".join(before) + " " + apart.join(passage) + " " + " ".join(after))
            want.append(before + (passage if n == 50 else []) + after)
            assert len(" ".join(passage)) < 400
        texts.append(" ".join(second * 4 + some(5)))  # 51 words and more that start twice in one text
        want.append(texts[-1].split()[80:])
    texts += ["", " \n", "a b c", None]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, 1, "k", 2) for i, t in enumerate(texts)], DOCUMENTS)
    left = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, frame, "").collect()}
    assert [left[i].text.split() for i in range(len(want))] == want
    assert [left[i].text for i in range(len(want), len(texts))] == texts[len(want):]
    # Places beyond 2^20 words in one batch, and a text that repeats one word.
    found = suffix_dedup.word_runs([b"x " * (1 << 20) + b"y " * 60, b"y " * 51], 51, 8)
    assert len(found[0]) == (1 << 20) + 60 - 50 + 1 and found[2][-1] == found[2][-2]


def test_suffix_dedup_odd_rows(odd, none):
    assert suffix_dedup.remove(odd).count() == 13 and suffix_dedup.remove(none).count() == 0
    assert suffix_dedup.rewrite(odd).columns == odd.columns


def test_chat_round_trip_and_budget(spark):
    text = r"\### Assistant: </turn> ok \<text> <turn>"
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"{text} {t} " + "w " * (t * 7 % 90)) for t in range(60)]
    rows += [(2, 0, None, None), (2, 0, "assistant", "\\"), (2, None, "assistant", "\n</turn>\n"), (None, 1, "user", "x")]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 300, 60)
    back = chat.read_back(made).orderBy("conv_id", "window").collect()
    own = [r for r in back if r.conv_id == 1]
    assert [(t.role, t.text) for r in own for t in r.turns] == [(r[2], r[3]) for r in rows[:60]]
    assert [x for r in own for x in r.loss_texts] == [r[3] for r in rows[:60] if r[2] == "assistant"]
    assert len(own) > 3 and all(r.tokens <= 300 for r in made.collect())
    later = made.where("conv_id = 1 and window > 0").collect()
    assert all(r.formatted.startswith("<turn>system") and r.n_repeated >= 1 for r in later)
    two = [(t.role, t.text) for r in back if r.conv_id == 2 for t in r.turns]
    assert two == [("assistant", "\n</turn>\n"), ("", ""), ("assistant", "\\")]
    assert chat.digests(made).count() == 3
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_language_held_out(spark):
    words = {"en": "the and of with that this from", "de": "der die und nicht mit das ein", "fr": "le les des avec une pour dans"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "e"]) for _ in range(30)), lang)
            for i, lang in enumerate(["en", "de", "fr"] * 40)]
    frame = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(frame.where("doc_id % 4 <> 0")))
    found = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == "und" for i in (900, 901, 902))
    nothing = langid.predict(frame, langid.fit(langid.sample(frame.where("doc_id < 0"))))
    assert nothing.where("lang_pred <> 'und'").count() == 0


def test_decontamination_spans_and_blocks(spark, odd):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:12])), (2, "short One"), (2, "short One"), (3, None), (4, "..."), (5, " ".join(words[20:30]))],
                                  "item_id long, text string")
    text = "É—W0, w1; " + " ".join(words[2:11]) + " x short. ONE y " + " ".join(words[20:29])
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "w0 w1 short two")], "doc_id long, text string")
    for block in (1 << 20, 1):
        found = {r.doc_id: r for r in decontaminate.find(rows, items, block_bytes=block).collect()}
        assert (found[1].n_hit, found[1].items) == (10 + 2, ["1", "2"]) or (found[1].n_hit, found[1].items) == (13, ["1", "2"])
        assert [text[s.start:s.start + s.length].lower().split()[-1] for s in found[1].spans][-1] == "one"
        assert found[2].n_words == found[3].n_words == found[4].n_hit == 0
    assert decontaminate.remove(rows, items).count() == 3
    unnamed = spark.createDataFrame([(None, text), (None, "clean"), (None, None), (1, "clean")], "doc_id long, text string")
    assert {r.text for r in decontaminate.remove(unnamed, items).collect()} == {"clean", None}
    assert decontaminate.verdicts(odd, items.limit(0)).where("contaminated").count() == 0


def test_quality_limits_count_distinct_texts(spark):
    def some(i):
        return " ".join(f"w{i}x{j}" for j in range(3))
    line = "one line of this host that many of its documents have got in common"
    own = [(i, f"{line}\n{some(i)}" if i < 40 else " ".join(some(100 * i + j) for j in range(5)), "src") for i in range(400)]
    copies = [(1000 + i, own[-1][1], "src") for i in range(1000)]  # with them 5 % of the rows are 70
    for rows in (own, own + copies):
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        kept = {r.doc_id for r in quality.verdicts(frame).where("kept and doc_id < 1000").collect()}
        assert kept == set(range(40, 400))


def test_quality_cuts_common_lines(spark):
    line, own = "The  same footer\tin all of them ", " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{own} {i}\n\n{line if i % 2 else line.lower()}\n tail {i}", None if i < 30 else "h", -1) for i in range(60)]
    rows += [(i, f"{own} {i}\n{line}\nb", "rare", -1) for i in range(60, 70)] + [(70, f"{own} alone", "h", -1)]
    frame = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, n_chars int")
    kept = quality.keep(frame)
    assert kept.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    found = sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect())
    cut = [(i, f"{own} {i}\n\n tail {i}") for i in range(60)]
    assert found == sorted([(i, t, len(t)) for i, t in cut + cut[:2]] + [r[:2] + (-1,) for r in rows[60:]])


def test_quality_rejects_depleted_documents(spark, odd, none):
    line = "this very line stands in almost all documents of the host here"
    own = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{line}\n{own} {i}" if i < 40 else f"{line}\nonly {i}", "src") for i in range(60)]
    rows += [(100 + i, line + "\nand " + own, "other") for i in range(50)]  # copies are one document
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep(frame).collect()}
    assert kept == {*range(40), *range(100, 150)}
    assert {r.doc_id for r in quality.verdicts(frame).where("kept").collect()} == kept
    judged = quality.verdicts(odd)
    assert judged.count() == 13 and judged.where("kept").count() == 0 and quality.verdicts(none).count() == 0
    assert quality.keep(odd).columns == odd.columns
    own = frame.withColumn("n_words", F.lit(777)).withColumn("base_failed", F.lit("mine"))
    assert {(r.n_words, r.base_failed) for r in quality.keep(own).collect()} == {(777, "mine")}


def test_quality_tells_null_and_empty_hosts_apart(spark):
    line = "one line that many of the documents of both these hosts have got in common"
    rows = [(i, f"{line}\nw{i} x{i}", None if i % 2 else "") for i in range(24)]  # 12 a host: below the limit of 20
    rows += [(100 + i, " ".join(f"y{i}z{j}" for j in range(12)), None) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.verdicts(frame).where("kept").count() == 29


def test_jaccard_equals_brute_force(spark, odd, none):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(4, 60))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            other = list(words)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = f"u{rng.randint(0, 9)}"
            texts.append(" ".join(other).upper())
    texts += ["", "one", "ONE", "one two", None]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for k, percent in ((3, 90), (2, 70)):
        sets = []
        for t in texts:
            w = (t or "").lower().split()
            sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
        root = list(range(len(texts)))
        changed = True
        while changed:
            changed = False
            for a in range(len(texts)):
                for b in range(a):
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
                        changed = True
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(frame, k, percent).collect()}
        assert found == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.groups(odd).count() == 13 and jaccard.groups(none).count() == 0
    assert {r.doc_id for r in jaccard.keep_one(odd).collect()} == {None, *range(10)}


def test_linked_sets_in_blocks(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1:]])) for i in range(20)]
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    assert {r.component_id for r in found.collect()} == {0}


def test_language_model_chunks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    rows = [(i, "w" * 99 + str(i % 10)) for i in range(400)] + [(1000 + i, "x" * (2001 + i)) for i in range(3)]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for times in (1, 5):
        more = functools.reduce(lambda a, b: a.union(b), [source.withColumn("doc_id", source.doc_id + 10000 * k) for k in range(times)])
        found = lm.chunked(more).selectExpr("chunk", "length(text) AS n").groupBy("chunk").agg({"n": "sum", "*": "count"}).collect()
        assert sum(r["count(1)"] for r in found) == 403 * times
        assert [r["count(1)"] for r in found if r.chunk < 0] == [1] * 3 * times
        assert max(r["sum(n)"] for r in found if r.chunk >= 0) <= 3 * 2000


def test_lm_texts_are_dealt_out_once(spark, monkeypatch):
    """Both sides of a chunk, the words it asks for and the texts it scores, read one shuffle of the texts."""
    monkeypatch.setattr(lm, "learn", functools.partial(lm.learn, steps=2))
    frame = spark.createDataFrame([(i, f"word{i % 7} and {i}") for i in range(60)], "doc_id long, text string")
    counts = lm.materialize(lm.token_counts(frame), "counts")
    found = lm.scores(frame, counts, lm.fit(frame, counts, BYTE, size=4), BYTE, (F.col("doc_id") % 2 == 0).alias("mark"))
    assert len(found.collect()) == 60
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_two_workers_leave_an_executor_room():
    """Workers keep their pieces between steps, beside steps that need the executor's 3000 MB."""
    assert 2 * 250 * tokens.MAX_PIECES <= 0.1 * 3000e6


def test_lm_workers_keep_few_words(monkeypatch):
    """Words are encoded in bounded portions, and a worker that learns or scores keeps few of them."""
    monkeypatch.setattr(lm, "ENCODED", 50)
    words = [b"w%dx" % i for i in range(200)] + [lm.END] + [b"q%dz" % i for i in range(200)]
    whole = ByteTokens(BYTE)
    ids, sizes = whole.ids_of(whole.numbers([b" " + w for w in words if w != lm.END]))
    subwords = lm.Subwords(BYTE)
    for kept in (120, 0):
        found = subwords.of(words, kept)
        assert found[0].tolist() == ids.tolist() and found[1].tolist() == np.insert(sizes, 200, 0).tolist()
        assert len(subwords.tokens.index) <= kept + 50
    assert 2 * 250 * (lm.KEPT + 16_384) <= 0.05 * 3000e6


def test_lm_spelling_holds_seen_rows_only():
    rng = np.random.default_rng(3)
    spelling = lm.Spelling(np.zeros(0, np.int64), np.zeros(0), 40, 30)
    totals = np.zeros((lm.LEADS + 1, 71, 31), np.int64)
    lead, symbol = rng.integers(0, lm.LEADS + 1, 200), rng.integers(0, 71, 200)
    totals[lead, symbol, rng.integers(0, 31, 200)] = rng.integers(1, 99, 200)
    spelling.learn(totals.ravel())
    by_id = totals.sum(axis=0).astype(float)
    usual = by_id.sum(axis=0) + 0.5
    by_id += usual / usual.sum()
    by_id /= by_id.sum(axis=1, keepdims=True)
    share = totals + 3 * by_id
    assert np.allclose(spelling.after[spelling.row], np.log10(share / share.sum(axis=2, keepdims=True)), atol=1e-6)
    assert len(spelling.after) <= 71 + 200


def test_lm_is_a_distribution_and_beats_counts(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "learn", functools.partial(lm.learn, steps=120))
    rng = random.Random(2)
    words = {"a": [f"qa{c}" for c in "bcdfgh"], "b": [f"zo{c}t" for c in "klmnpr"]}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(40))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score_documents(frame, frame["doc_id"] % 5 != 0, BYTE).where("doc_id % 5 = 0").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found) and all(r.n_tokens == 41 for r in found)
    counts = lm.token_counts(frame)
    model = lm.fit(frame, counts, BYTE, size=40)
    every, at, ends = lm.streams([rows[0][1].encode()])
    every = [w for w in every if w != lm.END] + [w for own in words.values() for w in own if w.encode() not in every] + [lm.END]
    every = [w if isinstance(w, bytes) else w.encode() for w in every]
    three, chance = model.spelling.words(*lm.Subwords(BYTE).of(every))
    total = sum(10 ** model.spelled(three, chance, np.array([0, 1, i]), np.array([3]))[-1] for i in range(len(every)))
    assert 0.2 < total <= 1 + 1e-6
    scored = lm.score_documents(odd, odd["n"] == 1, BYTE).collect()
    assert len(scored) == 13 and all(r.score < 0 and r.n_tokens >= 1 for r in scored)
    assert lm.score_documents(none, none["n"] == 1, BYTE).count() == 0


def test_lm_learns_from_all_training_texts(spark):
    """Longer texts than those the network begins with, and texts beyond their number, change its chances and weights."""
    rng = random.Random(4)
    few = [(i, " ".join(rng.choice(["qab", "zot"]) for _ in range(60))) for i in range(8)]
    long = [(100 + i, "qab zot " * (lm.LONGEST // 2)) for i in range(12)]  # one always after the other
    model = {}
    for name, rows in (("few", few), ("all", few + long)):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        model[name] = lm.fit(frame, lm.token_counts(frame), BYTE, size=4)
        assert [len(t) for t in lm.sample(frame, 4)] == [239] * 4
        words, at, ends = lm.streams([b"qab zot " * 20])
        three, chance = model[name].spelling.words(*lm.Subwords(BYTE).of(words))
        model[name, "score"] = model[name].spelled(three, chance, at, ends)[5:35].mean()
    assert model["all", "score"] > model["few", "score"] + 0.1  # the rest of the texts counts
    assert not np.allclose(model["all"].shares, model["few"].shares)


def test_attention_gradients_are_differences():
    rng = np.random.default_rng(1)
    network = Attention.new(30, 37)
    network.flat = network.flat.astype(np.float64)
    own, first = rng.integers(0, 30, (6, 16, 3)), np.array([1, 0, 0, 1, 0], bool)
    target = rng.integers(-1, 37, (5, 16))
    found, gradient = network.gradients(own, first, target)
    every = network.chances(network.vectors(own), first, np.maximum(target.ravel(), 0))
    assert np.allclose(every[target.ravel() >= 0], found, atol=1e-4)
    for i in np.argsort(-np.abs(gradient))[:40:4]:
        loss = []
        for step in (1e-3, -2e-3):
            network.flat[i] += step
            loss.append(-network.gradients(own, first, target)[0].mean())
        network.flat[i] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - gradient[i]) < 1e-3 + 0.02 * abs(gradient[i])


def test_toxicity_learns_words_and_parts(spark, odd):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    def text(bad):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 90))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grobble", "fleck" + rng.choice(plain)])
        return " ".join(words).encode()
    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    network = toxicity.fit(rows, steps=300)
    test = [(text(i % 2), i % 2) for i in range(100)]
    scores = toxicity.Reader(network).scores([t for t, _ in test])
    right = np.mean([(s >= 0.7) == bool(label) for s, (_, label) in zip(scores, test, strict=True)])
    assert right > 0.85
    found = toxicity.score(odd, network).collect()
    assert len(found) == 13 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.fit(rows[1:2]) is None and toxicity.score(odd, None).where("score <> 0").count() == 0
