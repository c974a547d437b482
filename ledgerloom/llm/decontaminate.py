"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of ASCII letters and digits and of all bytes above 0x7F, lower-cased A-Z.  Items
(questions and answers alike) are cut into windows of ``window`` consecutive words; a shorter item
is one window.  All windows become patterns of one automaton, a document's words joined by single
spaces are scanned once, and matches are mapped back through the word positions to character
offsets of the original text.

The items are the only thing sent to every task, in blocks of at most ``block_bytes`` of item text,
so an automaton never outgrows a worker.  A larger benchmark becomes several automata that the
same task runs one after the other over its documents; no text is shuffled.

Null or empty texts have no words and no hits.  Items without words match nothing.  Repeated items,
items with equal ids and equal windows of several items each keep their own id.  Extra columns are
ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, texts_of

WINDOW = 10
BLOCK_BYTES = 8 << 20

#: Lower case for A-Z, words kept, everything else a space: one byte stays one byte.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))

FOUND = ("doc_id bigint, n_words bigint, n_hit bigint, items array<string>, "
         "spans array<struct<start:bigint,length:bigint>>")
BETWEEN = "doc_id bigint, text string, items array<string>, hit binary"

_TEXT_LIST = pa.list_(pa.string())
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _patterns(items: tuple[tuple[str, bytes], ...], window: int) -> dict[str, set[str]]:
    """Windows as `` w1 w2 ... `` with the ids of the items that have them."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        own = [w.decode("latin-1") for w in text.translate(FOLD).split()]
        for at in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(f" {' '.join(own[at:at + window])} ", set()).add(item)
    return found


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str, bytes], ...], window: int):
    """Built once a worker and block, not once a task."""
    automaton = ahocorasick.Automaton()
    for pattern, owners in _patterns(items, window).items():
        automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, tuple(owners)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def scan(words: list[bytes], automaton) -> tuple[np.ndarray, set[str]]:
    """Flags of the words inside a window, and the items whose windows occur."""
    found = []
    if words and len(automaton):
        found = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not found:
        return np.zeros(len(words), bool), set()
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))  # of each word's space
    change, items = np.zeros(len(words) + 1, np.int64), set()
    for end, (size, count, owners) in found:
        first = int(np.searchsorted(starts, end + 1 - size))
        change[first] += 1
        change[first + count] -= 1
        items.update(owners)
    return np.cumsum(change[:-1]) > 0, items


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one index of each run of true flags."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans_of(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Character spans of the original from the first to the last word of each run of hit words."""
    if not hit.any():
        return []
    first, last = _edges(np.frombuffer(text.translate(FOLD), np.uint8) != 0x20)
    return [{"start": len(text[:first[a]].decode()), "length": len(text[first[a]:last[b - 1]].decode())}
            for a, b in zip(*_edges(hit), strict=True)]


def _scanner(items: tuple[tuple[str, bytes], ...], window: int, last: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, texts = _automaton(items, window), texts_of(batch.column("text"))
        found, flags, counts = [], [], []
        for text, before, hit in zip(texts, batch.column("items").to_pylist(),
                                     batch.column("hit").to_pylist(), strict=True):
            words = text.translate(FOLD).split()
            now, owners = scan(words, automaton)
            flags.append(now | np.frombuffer(hit, bool) if hit else now)
            found.append(sorted(owners.union(before or ())))
            counts.append(len(words))
        names = pa.array(found, _TEXT_LIST)
        if not last:
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text").cast(pa.string()), names,
                 pa.array([f.tobytes() for f in flags], pa.binary())],
                names=["doc_id", "text", "items", "hit"])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()),
             pa.array([int(f.sum()) for f in flags], pa.int64()), names,
             pa.array([spans_of(t, f) for t, f in zip(texts, flags, strict=True)], _SPANS)],
            names=["doc_id", "n_words", "n_hit", "items", "spans"])
    return run


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """Items in blocks of at most ``block_bytes`` of text (one item at least), read one by one."""
    block, size = [], 0
    rows = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
            .where(F.col("text").isNotNull()).toLocalIterator())
    for row in rows:
        text = row["text"].encode()
        if block and size + len(text) > block_bytes:
            yield tuple(block)
            block, size = [], 0
        block.append((row["item_id"] or "", text))
        size += len(text)
    yield tuple(block)


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: number of words, hit words, items found, hit character spans of the text."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                            F.lit(None).cast("array<string>").alias("items"),
                            F.lit(None).cast("binary").alias("hit"))
    blocks = list(item_blocks(benchmark, block_bytes))
    for at, items in enumerate(blocks, 1):
        last = at == len(blocks)
        rows = map_batches(rows, _scanner(items, window, last), FOUND if last else BETWEEN, rows=500)
    return rows


def verdicts(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: word counts, a digest of the items found, and whether any was."""
    return find(documents, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


def remove(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a window of an item, told apart by id and text, so null and repeated ids do no harm."""
    key = F.xxhash64("doc_id", "text")
    hit = find(documents.select(key.alias("doc_id"), "text"), benchmark, window).where("n_hit > 0")
    keyed = documents.withColumn("_d_key", key)
    return keyed.join(hit.select(F.col("doc_id").alias("_d_hit")), F.col("_d_key") == F.col("_d_hit"), "left_anti").select(*documents.columns)
