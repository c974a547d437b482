"""N-gram Jaccard join: documents whose word shingles overlap by a given percentage, and their groups.

Words are split at ASCII white space and lower-cased A-Z; a document's set is its distinct shingles of
``k`` consecutive words, a shorter text is one shingle of all its words.  Two documents link when
100 * intersection >= percent * union.

1. Words are counted over all documents; the ``FREQUENT`` most frequent ones with their counts go to
   every task (a fixed size) and order shingles by the estimated frequency of their words: rare first.
2. Documents with equal sets become one class (a 128-bit hash), so copies never meet as pairs.
3. Of n shingles the first n - ceil(n * t) + 1 in that order are a class's prefix.  Prefix entries, which
   a task has packed and freed of copies, meet by hash range.  Classes that link share a prefix shingle
   (prefix filter), have sizes in the same or neighbouring bands of ratio 1/t (length filter), and the smaller
   one has its first shared shingle in its shorter index prefix (positional filter).
4. The classes of a prefix shingle and band are gathered under the smallest of them.  Distinct pairs of
   leader and member, usually one or two per class, say which texts are compared with each other: a
   group is dealt out to a task in blocks of bounded size, and pairs of blocks where it has several.
5. A task keeps each set as its difference from the group's first set, bounds distances from below by
   the sets' histograms over 64 hash ranges (suffix filter), and verifies what passes exactly, once a
   pair and only while its two classes are not yet connected.  It gives spanning links: at most as many
   as it has classes, never all pairs of a group.  Links are exact; all connections are found.
6. Components of the links give each document the smallest id it is connected with.

Texts without words have an empty set and link with nothing.  Repeated rows are copies.  Rows with a
null id take part like others; the smallest id of a group leaves nulls out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ragged_ranges, signed, slices_of, texts_of, words_in
from ledgerloom.llm.components import components
from ledgerloom.session import materialize

SHINGLE = 5
PERCENT = 80
FREQUENT = 65_536
#: Bytes of texts whose words are counted together.
SLICE_BYTES = 4_000_000
BLOCK_CLASSES = 2048
BLOCK_SHINGLES = 2_000_000
BUCKETS = 64
MAX_WORDS = 700_000
#: Prefix entries a task holds before it passes them on.
FLUSH = 1_000_000

_ODD = [np.uint64(0x9E3779B97F4A7C15 ^ (0xD1B54A32D192ED03 * i & 0xFFFFFFFFFFFFFFFE)) for i in range(16)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to index into arrays of its 64-bit hash and of the logarithm of its count."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray) -> None:
        super().__init__()
        self.frequent = dict(zip(hashes.tolist(), logs.tolist(), strict=True))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hash, self.log, self.new = np.zeros(1024, np.uint64), np.zeros(1024, np.float32), []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > MAX_WORDS:
            self.reset()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            start, stop = len(self) - len(self.new), len(self)
            while stop > len(self.hash):
                self.hash, self.log = np.pad(self.hash, (0, len(self.hash))), np.pad(self.log, (0, len(self.log)))
            hashes = [xxhash.xxh3_64_intdigest(w) for w in self.new]
            self.hash[start:stop] = hashes
            look = self.frequent.get
            self.log[start:stop] = [look(h, 0.0) for h in hashes]
            self.new = []
        return self.hash[at], self.log[at]


@lru_cache(maxsize=1)
def _words(hashes: bytes, logs: bytes) -> _Words:
    return _Words(np.frombuffer(hashes, np.uint64), np.frombuffer(logs, np.float32))


def word_counts(documents: DataFrame, most: int = FREQUENT) -> tuple[bytes, bytes]:
    """Hashes and log counts of the most frequent words; all words of all documents are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices_of(batch, SLICE_BYTES):
                found = words_in(part.column("text"))[0].value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                size += len(found)
                if size > 3 * MAX_WORDS:
                    held = [summed(held)]
                    size = held[0].num_rows
                    if size > MAX_WORDS:
                        yield given(held[0])
                        held, size = [], 0
        if size:
            yield given(summed(held))

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])

    def given(counts: pa.Table) -> pa.RecordBatch:
        hashes = [xxhash.xxh3_64_intdigest(w) for w in counts.column("word").to_numpy().tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.array(hashes, np.uint64))), counts.column("n_sum").combine_chunks()], names=["h", "n"])

    counted = materialize(documents.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h")
                          .agg(F.sum("n").alias("n")).where("n > 1"), "word-counts")
    # The words from a count upwards, the lowest for which they are few enough: a sort would bring as many
    # words from every task to the driver.
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # 16 a doubling
    lowest, held = 2**31 - 1, 0
    for row in sizes:
        held += row["count"]
        if held > most:
            break
        lowest = row["step"]
    rows = counted.where(step >= lowest).collect()
    hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    return hashes.tobytes(), np.log2(1 + np.array([r["n"] for r in rows], np.float64)).astype(np.float32).tobytes()


def shingles(texts: list[bytes], k: int, words: _Words) -> list[np.ndarray]:
    """Sorted distinct keys of each text's shingles: 8 bits of rank, rare first, above 56 of hash."""
    flat, sizes = words_in(pa.array(texts, pa.binary()))
    coded = flat.dictionary_encode()
    h, log = (x[coded.indices.to_numpy()] for x in words.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
    total = len(h)
    if total >= k:
        x, rank = np.zeros(total - k + 1, np.uint64), np.zeros(total - k + 1, np.float32)
        for i in range(k):
            x += h[i:total - k + 1 + i] * _ODD[i]
            rank += log[i:total - k + 1 + i]
        x = _mix(x)
        keys = (np.minimum(rank * (8 / k), 255).astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
    out, at = [], 0
    for size, own in zip(sizes.tolist(), texts, strict=True):
        if size >= k:
            found = np.sort(keys[at:at + size - k + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            out.append(found)
        elif size:
            whole = xxhash.xxh3_64_intdigest(b" ".join(own.lower().split()), seed=size)
            out.append(np.array([whole >> 8], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def _short(digests: list[bytes]) -> np.ndarray:
    """First 64 bits of class digests: enough to bring candidates together, never to tell classes apart."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


_ENTRY = np.dtype([("s", "<u8"), ("c", "<u8"), ("n", "<i8")])


def _pack(rows: np.ndarray) -> bytes:
    """Entries sorted by shingle as byte planes of differences, which the shuffle's codec shrinks."""
    s = np.diff(rows["s"], prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T for x in (s, rows["c"], rows["n"])]
    return b"".join(p.tobytes() for p in planes)


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 24
    s, c, size = (np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T).view("<u8").ravel()
                  for i in range(3))
    out = np.empty(n, _ENTRY)
    out["s"], out["c"], out["n"] = np.cumsum(s, dtype=np.uint64), c, size.view("<i8")
    return out


def _postings(documents: DataFrame, k: int, percent: int, frequent: tuple[bytes, bytes], parts: int) -> DataFrame:
    """Size and class (hash of the set, and its first 64 bits) of every document, and prefix entries (shingle, class, twice
    the size plus whether in the index prefix) in packed runs; both from one making of the shingles.

    A task drops entries it has already and packs what goes to the same of ``parts`` hash ranges; documents go around.
    """
    def flush(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        part = _mix(rows["s"]) % np.uint64(parts)
        order = np.lexsort((rows["c"], rows["s"], part))
        rows, part = rows[order], part[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["s"][1:] != rows["s"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
        rows, part = rows[new], part[new]
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        packed = [_pack(rows[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        none = [pa.nulls(len(packed), kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]].astype(np.int32)), pa.array(packed, pa.binary()), *none], names=names)

    names = ["part", "entries", "doc_id", "n", "class", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found, held, given = _words(*frequent), [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                every = shingles(texts_of(own.column("text")), k, words)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in every]
                short = _short(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((given + np.arange(len(every))) % parts).astype(np.int32)), pa.nulls(len(every), pa.binary()), own.column("doc_id"),
                     pa.array([len(s) for s in every], pa.int64()), pa.array(digests, pa.binary()), pa.array(signed(short))], names=names)
                given += len(every)
                some = [i for i, s in enumerate(every) if len(s)]
                sets = [every[i] for i in some]
                lengths = [prefix_length(len(s), percent) for s in sets]
                rows = np.empty(sum(lengths), _ENTRY)
                if not len(rows):
                    continue
                rows["s"] = np.concatenate([s[:p] for s, p in zip(sets, lengths, strict=True)])
                rows["c"] = np.repeat(short[some], lengths)
                size, place = np.repeat([len(s) for s in sets], lengths), ragged_ranges(np.zeros(len(sets), np.int64), np.array(lengths))
                # The smaller of two that link has its first shared shingle among n * (1 - t) / (1 + t).
                rows["n"] = 2 * size + (place * (100 + percent) <= size * (100 - percent))
                found.append(rows)
                held += len(rows)
                if held > FLUSH:
                    yield flush(found)
                    found, held = [], 0
        if found:
            yield flush(found)

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(run, "part int, entries binary, doc_id bigint, n bigint, class binary, short bigint")


def gathered(rows: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of leader and member (their first 64 bits) of all shingles and size bands with several classes."""
    rows = rows[np.lexsort((rows["c"], rows["s"]))]
    if not len(rows):
        return np.zeros((0, 2), np.uint64)
    new = np.ones(len(rows), bool)
    new[1:] = (rows["s"][1:] != rows["s"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    rows = rows[new]
    start = np.ones(len(rows), bool)
    start[1:] = rows["s"][1:] != rows["s"][:-1]
    group = np.cumsum(start) - 1
    rows = rows[np.bincount(group)[group] > 1]
    # Sizes that can link lie in the same or neighbouring bands; the ratio is a little wider against rounding.
    band = np.floor(np.log(rows["n"] >> 1) / np.log(100 / percent * 1.001)).astype(np.int64)
    rows, band = np.concatenate([rows, rows]), np.concatenate([band, band + 1])
    order = np.lexsort((rows["c"], band, rows["s"]))
    rows, band = rows[order], band[order]
    if not len(rows):
        return np.zeros((0, 2), np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (rows["s"][1:] != rows["s"][:-1]) | (band[1:] != band[:-1]))))
    size = np.diff(np.append(first, len(rows)))
    good = np.repeat((size > 1) & (np.maximum.reduceat(rows["n"] & 1, first) > 0), size)
    return np.unique(np.stack([np.repeat(rows["c"][first], size)[good], rows["c"][good]], axis=1), axis=0)


def signatures(documents: DataFrame, k: int, percent: int, frequent: tuple[bytes, bytes]) -> DataFrame:
    """``doc_id``, size ``n`` and class of every document, and, in rows with a ``leader``, ``short`` of the classes that are
    compared with each other."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            documents = batch.filter(pc.is_null(batch.column("entries")))
            if documents.num_rows:
                own = [documents.column(c) for c in ("doc_id", "n", "class", "short")]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(documents.num_rows, pa.int64())], names=names)
            packed = batch.filter(pc.is_valid(batch.column("entries")))
            for part, entries in zip(packed.column("part").to_pylist(), packed.column("entries").to_pylist(), strict=True):
                if part != now:
                    if found:
                        yield pairs(found)
                    now, found = part, []
                found.append(_unpack(entries))
        if found:
            yield pairs(found)

    names = ["doc_id", "n", "class", "short", "leader"]

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        out = gathered(np.concatenate(found), percent)
        none = [pa.nulls(len(out), kind) for kind in kinds[:3]]
        return pa.RecordBatch.from_arrays([*none, pa.array(signed(out[:, 1])), pa.array(signed(out[:, 0]))], names=names)

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = _postings(documents, k, percent, frequent, 4 * n)
    return (packed.repartition("part").sortWithinPartitions("part")
            .mapInArrow(run, "doc_id bigint, n bigint, class binary, short bigint, leader bigint"))


def _dealt(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of each group with the block pairs they are compared in."""
    members = materialize(candidates.join(classes, "short").select("leader", "class", "n", "rep"), "members")
    sizes = members.groupBy("leader").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1").select(
        "leader", F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return (members.join(sizes, "leader").select("leader", "class", "rep", "blocks", own.alias("own"))
            .select("leader", "class", "rep", "own", other.alias("other"))
            .select("leader", "class", "rep", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))


def _linked(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Spanning links among a group's sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    pivot = sets[order[0]]
    rest = [np.setxor1d(sets[i], pivot, assume_unique=True) for i in order]
    shift = np.uint64(56 - 6)
    counts = np.stack([np.bincount(((sets[i] >> shift) & np.uint64(BUCKETS - 1)).astype(np.int64),
                                   minlength=BUCKETS) for i in order]).astype(np.int32)
    group = np.arange(len(order))
    for i in range(len(order) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        later = np.flatnonzero(group[i + 1:stop] != group[i]) + i + 1
        if not len(later):
            continue
        most = (sizes[later] + sizes[i]) * (100 - percent) // (100 + percent)
        far = np.abs(counts[later] - counts[i]).sum(axis=1)
        for j in later[far <= most]:
            if group[j] == group[i]:
                continue
            both = len(np.intersect1d(rest[i], rest[j], assume_unique=True))
            apart = len(rest[i]) + len(rest[j]) - 2 * both
            total = int(sizes[i] + sizes[j])
            if 100 * (total - apart) >= percent * (total + apart):
                group[group == group[j]] = group[i]
                yield int(order[i]), int(order[j])


def links(documents: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int,
          frequent: tuple[bytes, bytes]) -> DataFrame:
    """Links between classes that connect all that link: ``a`` and ``b``; ``members``: which classes are compared."""
    dealt = _dealt(members, classes)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = (dealt.join(source, F.col("rep").eqNullSafe(F.col("doc_id")))
            .select("leader", "low", "high", "class", "text")
            .repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high", "class"))

    def compare(keys: list[bytes], sets: list[np.ndarray], out: list[tuple[bytes, bytes]]) -> None:
        if len(keys) > 1:
            out.extend((keys[i], keys[j]) for i, j in _linked(sets, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now = _words(*frequent), None
        keys: list[bytes] = []
        sets: list[np.ndarray] = []
        out: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                group = zip(*(part.column(c).to_pylist() for c in ("leader", "low", "high")), strict=True)
                own = part.column("class").to_pylist()
                for at, key, found in zip(group, own, shingles(texts_of(part.column("text")), k, words), strict=True):
                    if at != now:
                        compare(keys, sets, out)
                        now, keys, sets = at, [], []
                    # Rows with equal ids and other texts aren't of this class; copies come once.
                    if xxhash.xxh3_128_digest(found.tobytes()) == key and (not keys or keys[-1] != key):
                        keys.append(key)
                        sets.append(found)
            if out:
                yield _pairs(out)
                out = []
        compare(keys, sets, out)
        if out:
            yield _pairs(out)

    return rows.mapInArrow(run, "a binary, b binary")


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def groups(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest connected id) of every row."""
    frequent = word_counts(documents)
    both = materialize(signatures(documents, k, percent, frequent), "signatures")
    every = both.where("leader IS NULL").drop("leader")
    members = both.where("leader IS NOT NULL").select("leader", "short").distinct()
    classes = materialize(every.where("n > 0").groupBy("class", "short", "n").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(materialize(links(documents, classes, members, k, percent, frequent), "links"), "a", "b")
    rooted = (classes.select("class", "rep").join(found, F.col("class") == F.col("node"), "left")
              .select("class", "rep", F.coalesce("root", "class").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = rooted.join(least, "root").select("class", "component_id")
    return (every.join(by_class, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id; rows that repeat it stay with it."""
    rest = (groups(documents, k, percent).where("doc_id <> component_id")
            .select(F.col("doc_id").alias("gone")).distinct())
    return documents.join(rest, documents["doc_id"] == rest["gone"], "left_anti")
