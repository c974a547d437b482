"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that starts elsewhere too.

1. Anchors: of the hashes of all ``gram``-byte strings inside one ``length``-byte string the smallest one, the
   leftmost of equals, is that string's anchor.  Equal strings have equal anchors at equal places, so a
   string whose anchor occurs once is not repeated, and most of the text is left here.  All strings of an
   anchor form its context: their starts are neighbours, and every start lies in exactly one context.
2. Equal contexts become one class, so copies are counted, not sorted: all of a context that occurs twice
   is repeated.
3. The contexts of anchors with several classes are dealt out by anchor into shards.  A task takes whole
   anchor groups of ``SHARD_BYTES`` together (or one group, however large).  Strings whose distance to the anchor
   lies in the same range of ``CELL`` share all but ``CELL`` - 1 bytes; where that core is unique in the group the
   cell can't match and goes, and equal cells become one.  The suffixes of the rest are sorted by external
   induced sorting (``induced``), spilling to Spark's local folder of the task, and strings whose common
   prefix with a neighbour that starts elsewhere reaches ``length`` are marked.
4. Marked strings and repeated contexts become byte intervals per document, and the covered bytes go.

All equal strings meet under their anchor, so the result is exact; rows are told apart by a 64-bit hash of
id and text, classes by two 64-bit hashes.  Strings are bytes of UTF-8, judged on the input and never
across documents.  Null texts are empty; shorter texts than ``length`` have no strings; repeated rows are
repeats of each other.  Extra columns are ignored by ``remove`` and kept by ``rewrite``.

``rewrite`` can also cut passages of a number of words, whatever their bytes: every run of ``words`` words that
starts elsewhere too, white space between words aside.  Anchors, here of ``WORD_GRAM`` words, leave out most
of the text again; the hashes of all runs of the other anchors are counted with their anchor.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import WHITE_SPACE, map_batches, ragged_ranges, signed, texts_of
from ledgerloom.llm.induced import suffix_order
from ledgerloom.session import materialize

LENGTH = 400
GRAM = 48
SEGMENT = 1 << 19
SHARD_BYTES = 1_000_000
CELL = 64
WORD_GRAM = 8
#: Suffix tuples a task's queue holds before it writes, and longest reduced text sorted in memory.
QUEUE_TUPLES = 400_000
IN_MEMORY_NAMES = 2_000_000
_PLACE = np.uint64((1 << 20) - 1)

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_BLANK = np.isin(np.arange(256), list(WHITE_SPACE.encode()))

ANCHORS = "key bigint, anchor bigint, context bigint, start bigint, size int, lead int"


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = 2 * SEGMENT
    up, down = np.full(size, _FACTOR, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every full window, from running minima to both sides of block borders."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, 2**64 - 1, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash of every anchor of a text, and hash, start, size and anchor's offset of its context."""
    n, width = len(text), length - gram + 1
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    up, down = _powers()
    out = []
    for low in range(0, n - length + 1, SEGMENT):
        high = min(n, low + SEGMENT + length - 1)
        own = np.frombuffer(text, np.uint8, high - low, low)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[own] * up[:high - low], dtype=np.uint64)))
        at = np.arange(high - low - gram + 1)
        h = _mix((total[gram:] - total[:-gram]) * down[at])
        # Ranked by 44 bits of the hash, then by place: the order depends on the string alone.
        best = (_sliding_min((h & ~_PLACE) | at.astype(np.uint64), width) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        stop = np.append(first[1:], len(best)) + length - 1
        where, lead = best[first], best[first] - first
        context = _mix((total[stop] - total[first]) * down[first] + _mix(((stop - first) * 65536 + lead).astype(np.uint64)))
        out.append((h[where], context, first + low, stop - first, lead))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.xxhash64("doc_id", text).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
                            text.alias("text"))


def _anchor_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [anchors(t, length, gram) for t in texts_of(batch.column("text"))]
        keys = np.repeat(batch.column("key").to_numpy(), [len(f[0]) for f in found])
        h, context, start, size, lead = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(signed(h)), pa.array(signed(context)), pa.array(start),
             pa.array(size.astype(np.int32)), pa.array(lead.astype(np.int32))],
            names=[c.split()[0] for c in ANCHORS.split(", ")])
    return map_batches(_keyed(documents).select("key", "text"), run, ANCHORS, rows=200)


def _contexts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts.  ``doc_id`` goes along so that the texts' shuffle is the one that
    ``_with_intervals`` needs too, and Spark runs it once."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, text, own in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")),
                                  batch.column("own").to_pylist(), strict=True):
            rows.extend((key, o["anchor"], o["start"], o["lead"], text[o["start"]:o["start"] + o["size"]]) for o in own)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["key", "anchor", "start", "lead", "context"])
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "size", "lead")).alias("own"))
    once = keyed.join(per_text, "key")
    return map_batches(once, run, "key bigint, anchor bigint, start bigint, lead int, context binary", rows=50)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and the number of each row's group in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        sorted_ = c[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    return order, np.cumsum(new)


def repeated_in_group(anchor: np.ndarray, keys: np.ndarray, starts: np.ndarray, leads: np.ndarray, contexts: list[bytes],
                      length: int, folder: str, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """Key's row number and start (in its text) of every repeated string of some anchor groups."""
    cell = max(1, min(cell, length // 4))
    sizes = np.array([len(c) for c in contexts], np.int64)
    first = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    up, down = _powers()
    local = ragged_ranges(np.zeros(len(sizes), np.int64), sizes)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * up[local], dtype=np.uint64)))
    # Cells: starts whose distance to the anchor lies in [cell * q, cell * q + cell).
    near = np.maximum(leads - (sizes - length), 0) // cell
    count = leads // cell - near + 1
    own = np.repeat(np.arange(len(sizes)), count)
    q = ragged_ranges(near, count)
    begin = np.maximum(leads[own] - (q * cell + cell - 1), 0)
    last = np.minimum(leads[own] - q * cell, (sizes - length)[own])

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((total[first[own] + b] - total[first[own] + a]) * down[a])

    core = leads[own] - q * cell
    shared = hashed(core, core - cell + 1 + length)
    order, group = _groups(anchor[own], q, shared)
    kept = order[np.bincount(group)[group] > 1] if len(order) else order
    own, q, begin, last = own[kept], q[kept], begin[kept], last[kept]
    if not len(own):
        return own, own
    whole = hashed(begin, last + length)
    order, group = _groups(anchor[own], q, leads[own] - begin, leads[own] - last, whole)
    own, begin, last = own[order], begin[order], last[order]
    place = starts[own] + begin
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    # Equal cells of different places are repeated whole; one of them is sorted with the rest.
    several = np.zeros(len(head), bool)
    for values in (keys[own], place):
        several |= np.minimum.reduceat(values, head) != np.maximum.reduceat(values, head)
    equal = np.flatnonzero(several[group])
    rows = [np.repeat(own[equal], (last - begin + 1)[equal])]
    found = [ragged_ranges(place[equal], (last - begin + 1)[equal])]
    cells = [contexts[o][a:b + length] for o, a, b in zip(own[head], begin[head], last[head], strict=True)]
    number, offset = repeated_starts(keys[own[head]], place[head], cells, length, folder)
    return (np.concatenate([*rows, own[head][number]]), np.concatenate([*found, place[head][number] + offset]))


def repeated_starts(keys: np.ndarray, starts: np.ndarray, contexts: list[bytes], length: int,
                    folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Context number and start of its strings that also start at another place, by suffix sorting."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.ones(int(first[-1]) + 1, np.uint16)
    text[ragged_ranges(first[:-1], sizes)] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 2
    text[-1] = 0
    number = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    found: list[np.ndarray] = []
    run = np.zeros(0, np.int64)

    def ended(positions: np.ndarray, bounds: np.ndarray) -> None:
        """Runs of suffixes with a common prefix of ``length``; bounds: where each begins."""
        if not len(positions):
            return
        own = np.searchsorted(first, positions, side="right") - 1
        offset = positions - first[own]
        good = offset + length <= np.append(sizes, 0)[own]
        own = np.minimum(own, len(sizes) - 1)
        place = (number[own] << 40) + starts[own] + offset
        least, most = np.minimum.reduceat(place, bounds), np.maximum.reduceat(place, bounds)
        several = np.repeat(least != most, np.diff(np.append(bounds, len(positions))))
        found.append(positions[several & good])

    for positions, common in suffix_order(text, folder, length, QUEUE_TUPLES, IN_MEMORY_NAMES):
        new = common < length
        positions = np.concatenate((run, positions))
        new = np.concatenate((np.arange(len(run)) == 0, new)) if len(run) else new
        bounds = np.flatnonzero(new)
        ended(positions[:bounds[-1]] if len(bounds) else positions[:0], bounds[:-1])
        run = positions[bounds[-1]:] if len(bounds) else positions
    ended(run, np.zeros(1, np.int64))
    where = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    own = np.searchsorted(first, where, side="right") - 1
    return own, where - first[own]


def local_folder() -> str:
    """Spark's folder for what a task spills; it goes with the executor."""
    return os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]


def _sorted_shards(contexts: DataFrame, length: int) -> DataFrame:
    """``key``, ``start`` and ``size`` of the intervals that suffix sorting finds."""
    def shard(rows: list[tuple]) -> pa.RecordBatch | None:
        unique = list({r[:3]: r for r in rows}.values())  # equal rows of documents share their key
        anchor, keys, starts, leads = (np.array(c, np.int64) for c in list(zip(*unique, strict=True))[:4])
        with tempfile.TemporaryDirectory(dir=local_folder()) as folder:
            own, begin = repeated_in_group(anchor, keys, starts, leads, [r[4] for r in unique], length, folder)
        if not len(own):
            return None
        key = keys[own]
        order = np.lexsort((begin, key))
        key, begin = key[order], begin[order]
        head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (begin[1:] > begin[:-1] + length))))
        end = np.append(head[1:], len(key)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(key[head]), pa.array(begin[head]), pa.array(begin[end] + length - begin[head])],
            names=["key", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, now = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "start", "lead", "context")), strict=True):
                if row[0] != now:
                    if size >= SHARD_BYTES:
                        if (out := shard(rows)) is not None:
                            yield out
                        rows, size = [], 0
                    now = row[0]
                rows.append(row)
                size += len(row[4])
        if rows and (out := shard(rows)) is not None:
            yield out

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "key bigint, start bigint, size bigint")


def _intervals(documents: DataFrame, keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """``key`` of a document and ``start``, ``size`` of byte intervals to remove; they may overlap."""
    rows = _anchor_rows(documents, length, gram)
    several = rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    rows = materialize(rows.join(several, "anchor"), "anchors")
    classes = materialize(
        rows.groupBy("anchor", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("key", "start", "size", "lead")).alias("origin")), "contexts")
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor")
    wanted = classes.join(mixed, "anchor").select("anchor", "origin.*")
    copies = rows.join(classes.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    return _sorted_shards(_contexts(keyed, wanted), length).unionByName(
        copies.select("key", "start", F.col("size").cast("bigint").alias("size")))


def _runs(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values."""
    n = len(x) - size + 1
    out = x[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_FACTOR)
        out += x[k:k + n]
    return _mix(out)


def word_runs(texts: list[bytes], words: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every run of ``words`` words inside a text: number of the text, anchor, hash, start and size in bytes,
    and whether its anchor stands at another place than that of the run before."""
    flat = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    inside = ~_BLANK[flat]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    first, stop = edges[::2], edges[1::2]
    n, width = len(first) - words + 1, words - gram + 1
    if n < 1:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    up = _powers()[0]
    place = ragged_ranges(np.zeros(len(first), np.int64), stop - first) % len(up)
    word = _mix(np.add.reduceat(_BYTES[flat[inside]] * up[place], np.cumsum(stop - first) - (stop - first)))
    grams = _runs(word, gram)
    at = np.arange(len(grams), dtype=np.uint64) & _PLACE
    best = _sliding_min((grams & ~_PLACE) | at, width)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, first, side="right")
    whole = text[:n] == text[words - 1:]
    # Where places begin again at 0 inside a run of words, the leftmost isn't known: each run stands for itself.
    new = at[:n] > at[width - 1:]
    new[0] = True
    new[1:] |= (best[1:] != best[:-1]) | ~whole[:-1]
    start = first[:n] - np.concatenate(([0], ends))[text[:n]]
    return tuple(c[whole] for c in (text[:n], best & ~_PLACE, _runs(word, words), start, stop[words - 1:] - first[:n], new))


def _word_intervals(keyed: DataFrame, words: int, gram: int) -> DataFrame:
    """``key``, ``start`` and ``size`` of all runs of ``words`` words that start elsewhere too."""
    def anchored(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, anchor, *_, new = word_runs(texts_of(batch.column("text")), words, gram)
        return pa.RecordBatch.from_arrays(
            [pa.array(batch.column("key").to_numpy()[text[new]]), pa.array(signed(anchor[new]))], names=["key", "anchor"])

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, anchor, run, start, size, _ = word_runs(texts_of(batch.column("text")), words, gram)
        anchor, own, key = signed(anchor), batch.column("own").to_pylist(), batch.column("key").to_numpy()
        borders = np.searchsorted(text, np.arange(len(own) + 1))
        kept = np.concatenate([np.isin(anchor[a:b], o) for a, b, o in zip(borders[:-1], borders[1:], own, strict=True)])
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (key[text[kept]], anchor[kept], signed(run[kept]), start[kept], size[kept])],
            names=["key", "anchor", "run", "start", "size"])

    rows = materialize(map_batches(keyed.select("key", "text"), anchored, "key bigint, anchor bigint", rows=200), "word-anchors")
    several = rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    wanted = rows.join(several, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("own"))
    found = materialize(map_batches(keyed.select("key", "text").join(wanted, "key"), runs,
                                    "key bigint, anchor bigint, run bigint, start bigint, size bigint", rows=200), "word-runs")
    twice = found.groupBy("anchor", "run").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "run")
    return found.join(twice, ["anchor", "run"]).select("key", "start", "size")


def _cut(text: bytes, own: Iterable[dict[str, int]] | None) -> np.ndarray:
    """True for the bytes to remove."""
    change = np.zeros(len(text) + 1, np.int32)
    for o in () if own is None else own:
        change[o["start"]] += 1
        change[o["start"] + o["size"]] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_intervals(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """``key``, ``doc_id``, ``text`` (null as empty) of every row and ``own``, its intervals or null."""
    keyed = _keyed(documents)
    found = _intervals(documents, keyed, length, gram).groupBy("key").agg(
        F.collect_set(F.struct("start", "size")).alias("own"))
    return keyed.join(found, "key", "left")


def remove(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, SHA-256 of the rest, and the rest as text.

    A character that is cut in two is missing in the text, not in the bytes that the digest is of.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, own in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")),
                                  batch.column("own").to_pylist(), strict=True):
            if own:
                cut = _cut(text, own)
                rest = np.frombuffer(text, np.uint8)[~cut].tobytes()
                runs = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
            else:
                rest, runs = text, 0
            rows.append((doc, len(text), len(text) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
    return map_batches(_with_intervals(documents, length, gram), run,
                       "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string", rows=200)


def rewrite(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """The documents with their texts cut; a character that is cut in two goes whole.  A null stays null.

    With ``words``, repeated runs of so many words go too.
    """
    columns = documents.columns

    @F.pandas_udf("string")
    def rest(text: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, o in zip(text, own, strict=True):
            raw = (t or "").encode()
            out.append(np.frombuffer(raw, np.uint8)[~_cut(raw, o)].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    keyed = _keyed(documents)
    intervals = _intervals(documents, keyed, length, gram)
    if words:
        intervals = intervals.unionByName(_word_intervals(keyed, words, min(WORD_GRAM, words)))
    found = intervals.groupBy(F.col("key").alias("_s_key")).agg(
        F.collect_set(F.struct("start", "size")).alias("_s_own"))
    key = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    cut = documents.withColumn("_s_at", key).join(found, F.col("_s_at") == F.col("_s_key"), "left")
    return cut.withColumn("text", F.when(F.col("_s_own").isNull(), F.col("text")).otherwise(
        rest("text", "_s_own"))).select(*columns)
