"""Nearest neighbours by inner product with balanced posting lists.

An index has three parts.  *Lists*: balanced k-means splits a bounded sample again and again until a leaf holds
its share; each leaf's mean is the centroid of one posting list.  *Postings*: every vector goes to its nearest list
and, near a border, to up to ``REPLICAS`` lists whose centroids are at most ``1 + BORDER`` times as far and not closer
to a centroid already taken than to the vector.  *Graph*: centroids are linked with near ones of different
directions; both vectors and queries find centroids by a best-first walk over this graph, which every task holds.
A query visits all lists whose centroid is at most ``1 + ratio`` times as far as the nearest one; ``ratio`` is
measured on the sample, so that ``COVER`` of the sample's true neighbours lie in visited lists.

Inner products become distances by one more coordinate: vectors are lifted to the table's largest norm, queries scaled to it
(largest inner product then means smallest distance).  Scores are inner products of the original vectors in double precision.

At scale: equal vectors are one class, of which the ``k + 1`` smallest ids can be in a result, and queries with equal
vectors are searched once.  The lists, one after the other, are cut into shelves of equal size, ``SHELVES`` of them, or more of at most
``SHELF_ROWS`` rows, so a list that holds a third of all rows is spread over a third of the shelves.  A query goes once to each shelf
with lists that it visits; the queries of a shelf are cut into blocks of at most ``BLOCK_BYTES``, which a task holds while the
shelf's rows stream by, and of which it keeps the best ``k + 1`` a query.  What every task holds besides are the centroids, at most
``SAMPLE_BYTES / LEAF_SAMPLE`` bytes, whatever the size of the table.

The sample is bounded: at most ``SAMPLE_BYTES`` of vectors, those with the smallest hashes of their id and values; all rows
are indexed.  Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows without id and
vectors of another length than the most frequent one (of equally frequent ones the shortest).  Rows with equal id count
once, with the smallest of their vectors.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ragged_ranges
from ledgerloom.session import materialize

LIST_ROWS = 1024
SAMPLE_BYTES = 16 << 20
LEAF_SAMPLE = 16
REPLICAS = 4
BORDER = 0.02
COVER = 0.98
BLOCK_BYTES = 16 << 20
PENDING = 1 << 19
SHELVES = 32
SHELF_ROWS = 1 << 18
BRANCHES = 8
DEGREE = 16
WIDTH = 32

FOUND = "query_id bigint, rank int, vec_id bigint, score double"
_POSTED = "list int, c bigint, v array<double>"
_PROBES = "shelf int, qc bigint, v array<double>, lists array<int>"
_BEST = "qc bigint, c bigint, score double"


@dataclass(frozen=True)
class Index:
    """Centroids in lifted space, their graph (rows of neighbours, padded with -1), and the measured ratio."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float

    def lift(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Scaled to the largest norm 1; vectors get the missing length as a further coordinate, queries are scaled."""
        scaled = vectors / self.norm
        length = np.linalg.norm(scaled, axis=1)
        if queries:
            scaled, rest = scaled / length[:, None], np.zeros(len(scaled))
        else:
            rest = np.sqrt(np.maximum(0, 1 - length * length))
        return np.hstack([scaled, rest[:, None]]).astype(np.float32)

    def walk(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists and distances of the ``width`` nearest centroids found, nearest first; missing ones are infinitely far."""
        n, k = len(points), len(self.centroids)
        width = min(width, k)
        rows = np.arange(n)
        at = np.zeros((n, width), np.int64)
        far = np.full((n, width), np.inf, np.float32)
        seen, done = np.zeros((n, k), bool), np.ones((n, width), bool)
        for slot, entry in enumerate(range(0, k, max(1, k // min(4, width)))[:width]):
            at[:, slot], done[:, slot], seen[:, entry] = entry, False, True
            far[:, slot] = ((points - self.centroids[entry]) ** 2).sum(1)
        while True:
            waiting = np.where(done[rows], np.inf, far[rows])
            best = waiting.argmin(1)
            going = np.isfinite(waiting[np.arange(len(rows)), best])
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            done[rows, best] = True
            near = self.graph[at[rows, best]]
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            seen[rows[:, None], np.where(near >= 0, near, at[rows, best][:, None])] = True
            gap = ((points[rows][:, None, :] - self.centroids[near]) ** 2).sum(2)
            all_at = np.hstack([at[rows], near])
            all_far = np.hstack([far[rows], np.where(fresh, gap, np.inf)])
            all_done = np.hstack([done[rows], ~fresh])
            keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            at[rows], far[rows], done[rows] = (np.take_along_axis(a, keep, 1) for a in (all_at, all_far, all_done))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(at, order, 1), np.sqrt(np.take_along_axis(far, order, 1))

    def homes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists: the nearest list of each vector, and those across its borders."""
        lists, far = self.walk(points, WIDTH)
        taken = np.zeros(lists.shape, bool)
        taken[:, 0] = True
        for j in range(1, min(REPLICAS, lists.shape[1])):
            fits = np.isfinite(far[:, j]) & (far[:, j] <= (1 + BORDER) * far[:, 0])
            for i in range(j):
                apart = np.linalg.norm(self.centroids[lists[:, i]] - self.centroids[lists[:, j]], axis=1)
                fits &= ~taken[:, i] | (apart >= far[:, j])
            taken[:, j] = fits
        rows, place = np.nonzero(taken)
        return rows, lists[rows, place]

    def visits(self, points: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists within the ratio, or until lists of ``least`` rows; the walk is widened until it reaches beyond."""
        found_rows, found_lists = [], []
        rows, width = np.arange(len(points)), WIDTH
        while len(rows):
            lists, far = self.walk(points[rows], width)
            rows_before = np.cumsum(sizes[lists], axis=1) - sizes[lists]
            inside = np.isfinite(far) & ((far <= (1 + self.ratio) * far[:, :1] + 1e-6) | (rows_before < least))
            whole = ~inside[:, -1] if width < len(self.centroids) else np.ones(len(rows), bool)
            own, place = np.nonzero(inside & whole[:, None])
            found_rows.append(rows[own])
            found_lists.append(lists[own, place])
            rows, width = rows[~whole], 4 * width
        return np.concatenate(found_rows or [rows]), np.concatenate(found_lists or [rows])


def _split(points: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """Balanced k-means: full clusters become dearer until they hold about their share."""
    centres = points[random.choice(len(points), parts, replace=False)]
    price = np.zeros(parts, np.float32)
    scale = float(points.var(0).sum()) + 1e-12
    for turn in range(16):
        owner = ((centres * centres).sum(1) - 2 * points @ centres.T + price).argmin(1)
        size = np.bincount(owner, minlength=parts)
        centres = np.stack([points[owner == j].mean(0) if size[j] else points[random.integers(len(points))]
                            for j in range(parts)])
        price = price + np.float32(scale / (turn + 4)) * (size * parts / len(points) - 1).astype(np.float32)
    return owner


def _leaves(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of about ``lists`` parts of equal size."""
    random, todo, means = np.random.default_rng(seed), [(points, lists)], []
    while todo:
        own, n = todo.pop()
        parts = min(BRANCHES, n, len(own))
        owner = _split(own, parts, random) if parts > 1 and (own != own[0]).any() else np.zeros(len(own), int)
        groups = [g for g in (own[owner == j] for j in range(max(parts, 1))) if len(g)]
        if len(groups) < 2:
            means.append((len(own), own.mean(0)))
        else:
            todo.extend((g, max(1, round(n * len(g) / len(own)))) for g in groups)
    whole = [m for size, m in means if size >= LEAF_SAMPLE // 4] or [m for _, m in means]  # a stray point is no list
    return np.stack(whole).astype(np.float32)


def _linked(centroids: np.ndarray) -> np.ndarray:
    """Near centroids that aren't closer to one another than to the node, plus a ring that keeps the graph in one piece."""
    k = len(centroids)
    graph = np.full((k, DEGREE), -1, np.int64)
    squares = (centroids * centroids).sum(1)
    for at in range(0, k, 512):
        far = squares - 2 * centroids[at:at + 512] @ centroids.T
        near = np.argsort(far, axis=1)[:, :4 * DEGREE + 1]
        for node, others in enumerate(near, at):
            kept = sorted({(node + 1) % k, (node - 1) % k} - {node})
            ring = len(kept)
            for other in others:
                gap = ((centroids[other] - centroids[node]) ** 2).sum()
                if other not in (node, *kept) and all(((centroids[other] - centroids[o]) ** 2).sum() >= gap for o in kept[ring:]):
                    kept.append(other)
            filler = [o for o in others if o not in (node, *kept)]
            kept = (kept + filler)[:DEGREE]
            graph[node, :len(kept)] = kept
    return graph


def fit(sample: np.ndarray, rows: int, norm: float, k: int, list_rows: int = LIST_ROWS) -> Index:
    """Index for a table of ``rows`` vectors from its sample; ``norm`` is the table's largest norm."""
    plain = Index(np.zeros((1, sample.shape[1] + 1), np.float32), np.full((1, 1), -1), norm, 0.0)
    points = plain.lift(sample, queries=False)
    lists = max(1, min(math.ceil(rows / list_rows), len(points) // LEAF_SAMPLE))
    centroids = _leaves(points, lists)
    index = Index(centroids, _linked(centroids), norm, 0.0)
    member = np.zeros((len(points), len(centroids)), bool)
    for at in range(0, len(points), 512):
        own, homes = index.homes(points[at:at + 512])
        member[at + own, homes] = True
    needed = []
    for asked in np.random.default_rng(11).choice(len(points), min(256, len(points)), replace=False):
        query = index.lift(sample[asked:asked + 1], queries=True)
        score = points @ query[0]
        score[asked] = -np.inf
        most = min(k, len(points) - 1)
        nearest = np.argpartition(-score, most)[:most]
        far = np.linalg.norm(centroids - query, axis=1)
        needed.append(np.where(member[nearest], far / max(far.min(), 1e-9), np.inf).min(1))
    found = np.concatenate(needed)
    ratio = float(np.quantile(found, COVER)) - 1 if len(found) else 0.0
    return Index(centroids, index.graph, norm, max(0.0, ratio))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _posted(frame: DataFrame, index: Index) -> DataFrame:
    """One row for every list of a vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, lists = index.homes(index.lift(_matrix(part.column("v")), queries=False))
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column("c").take(own), part.column("v").take(own)],
                                                 names=["list", "c", "v"])
    return frame.select("c", "v").mapInArrow(run, _POSTED)


@dataclass(frozen=True)
class Shelves:
    """Where the rows of each list stand when all lists follow one another on shelves of ``size`` rows."""

    before: np.ndarray
    held: np.ndarray
    size: int

    @classmethod
    def of(cls, held: np.ndarray, count: int) -> Shelves:
        return cls(np.cumsum(held) - held, held, max(1, math.ceil(int(held.sum()) / count)))

    def of_lists(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last shelf of lists; none where a list is empty."""
        return self.before[lists] // self.size, (self.before[lists] + self.held[lists] - 1) // self.size

    def of_rows(self) -> Column:
        """A row's shelf, from its list's ``before`` and ``held``."""
        return F.floor((F.col("before") + F.pmod(F.xxhash64("c"), "held")) / F.lit(self.size)).cast("int")


def _probing(frame: DataFrame, index: Index, shelves: Shelves, least: int) -> DataFrame:
    """One row for every shelf of a query, with the lists that it visits there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, lists = index.visits(index.lift(_matrix(part.column("v")), queries=True), shelves.held, least)
                first, last = shelves.of_lists(lists)
                times = np.maximum(0, last - first + 1)
                rows, lists, shelf = np.repeat(rows, times), np.repeat(lists, times), ragged_ranges(first, times)
                order = np.lexsort((lists, shelf, rows))
                rows, lists, shelf = rows[order], lists[order], shelf[order]
                new = np.flatnonzero(np.diff(rows, prepend=-1) | np.diff(shelf, prepend=-1))
                own = pa.array(rows[new])
                ends = pa.array(np.append(new, len(rows)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shelf[new], pa.int32()), part.column("qc").take(own), part.column("v").take(own),
                     pa.ListArray.from_arrays(ends, pa.array(lists, pa.int32()))], names=["shelf", "qc", "v", "lists"])
    return frame.select("qc", "v").mapInArrow(run, _PROBES)


def best_of(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query rows, ids and scores of the ``keep`` best of each query, ties to smaller ids.

    A matrix product finds all that could be among the best; these are scored again one by one, so that a pair's score
    doesn't depend on the block it is computed in.
    """
    slack = 1e-12 * vectors.shape[1] * max(1e-300, np.abs(vectors).max() * np.abs(queries).max())
    step = max(1, min(256, (1 << 22) // len(vectors)))
    for at in range(0, len(queries), step):
        score = queries[at:at + step] @ vectors.T
        top = min(keep, len(ids)) - 1
        least = -np.partition(-score, top, axis=1)[:, top]
        rows, cols = np.nonzero(score >= (least - slack)[:, None])
        exact = np.concatenate([(queries[at + rows[i:i + 65536]] * vectors[cols[i:i + 65536]]).sum(1)
                                for i in range(0, len(rows), 65536)])
        order = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        chosen = place < keep
        yield at + rows[chosen], ids[cols[chosen]], exact[chosen]


class _Block:
    """The queries of a shelf that a task holds, and the best that it has found for them."""

    def __init__(self, keep: int):
        self.keep = keep
        self.parts: list[pa.RecordBatch] = []
        self.asking: dict[int, np.ndarray] | None = None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def meet(self, number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of one list go past the queries that visit it."""
        if self.asking is None:
            lists = [p.column("lists") for p in self.parts]
            owner = np.repeat(np.arange(sum(map(len, lists))), [len(own) for part in lists for own in part.to_pylist()])
            flat = np.concatenate([part.flatten().to_numpy() for part in lists] or [owner])
            order = np.argsort(flat, kind="stable")
            names, starts = np.unique(flat[order], return_index=True)
            self.asking = dict(zip(names.tolist(), np.split(owner[order], starts[1:]), strict=True)) if len(names) else {}
            self.vectors = np.concatenate([_matrix(p.column("v")) for p in self.parts] or [vectors[:0]])
            self.ids = np.concatenate([p.column("id").to_numpy() for p in self.parts] or [ids[:0]])
            self.parts = []
        rows = self.asking.get(number)
        if rows is not None:
            for q, c, score in best_of(ids, vectors, self.vectors[rows], self.keep):
                self.found.append((rows[q], c, score))
                self.pending += len(q)
                if self.pending > PENDING + len(self.ids) * self.keep:
                    self.found = [self.best()]
                    self.pending = len(self.found[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's best so far, each vector once."""
        q, c, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        once = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))
        q, c, score = q[once], c[once], score[once]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.keep
        return q[kept], c[kept], score[kept]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            q, c, score = self.best()
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(c), pa.array(score)], names=["qc", "c", "score"])


def _searched(both: DataFrame, keep: int) -> DataFrame:
    """Best of each shelf and query; rows come by shelf and block, queries first, then the lists one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = _Block(keep), None
        for batch in batches:
            shelf, turn, number = (batch.column(c).to_numpy() for c in ("shelf", "turn", "list"))
            edges = np.flatnonzero(np.diff(shelf) | np.diff(turn) | np.diff(number)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(shelf)), strict=True):
                part = batch.slice(a, b - a)
                if at != (shelf[a], turn[a]):
                    yield from block.rows()
                    block, at = _Block(keep), (shelf[a], turn[a])
                if number[a] < 0:
                    block.parts.append(part)
                else:
                    block.meet(int(number[a]), part.column("id").to_numpy(), _matrix(part.column("v")))
        yield from block.rows()
    return both.mapInArrow(run, _BEST)


def usable(frame: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part, each once, with a hash ``h`` of the vector."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = (frame.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (length[0]["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))


def _sample(rows: DataFrame, count: int) -> np.ndarray:
    """At most ``SAMPLE_BYTES`` of vectors, by the smallest hashes; a cut-off keeps about as many before the sort."""
    size = len(rows.first()["v"])
    most = max(LEAF_SAMPLE, SAMPLE_BYTES // (8 * size))
    cut = min(2**63 - 1, -(2**63) + int(min(1.0, 1.2 * (most + 100) / count) * 2**64))
    picked = (rows.select("v", F.xxhash64("vec_id", "h").alias("r")).where(F.col("r") <= F.lit(cut))
              .orderBy("r").limit(most).select("v").toArrow())
    return _matrix(picked.column("v"))


def search(frame: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           list_rows: int = LIST_ROWS) -> DataFrame:
    """``k`` nearest rows found for each row where ``is_query`` (a condition on ``vec_id``): see ``FOUND``."""
    spark = frame.sparkSession
    rows = materialize(usable(frame, key, vector), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("norm")).first()
    if not total["n"]:
        return spark.createDataFrame([], FOUND)
    index = fit(_sample(rows, total["n"]), total["n"], total["norm"], k, list_rows)

    alike = Window.partitionBy("h", "v").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)
    members = members.withColumn("c", F.first("vec_id").over(alike))
    members = materialize(members.select("c", "vec_id", F.expr("if(place = 1, v, null)").alias("v")), "vector-classes")
    asked = rows.where(is_query)
    asking = asked.groupBy("h", "v").agg(F.min("vec_id").alias("qc"))
    asking = materialize(asking, "query-classes")

    postings = materialize(_posted(members.where("v is not null"), index), "postings")
    held = np.zeros(len(index.centroids), np.int64)
    for row in postings.groupBy("list").count().collect():  # one row a list
        held[row["list"]] = row["count"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shelves = Shelves.of(held, max(SHELVES, math.ceil(int(held.sum()) / SHELF_ROWS)))
    probes = materialize(_probing(asking, index, shelves, REPLICAS * (k + 1)), "probes")
    most = max(256, BLOCK_BYTES // (8 * len(index.centroids[0])))
    turns = probes.groupBy("shelf").agg(F.ceil(F.count("*") / most).cast("int").alias("turns"))
    turns = F.broadcast(materialize(turns, "turns"))  # one row a shelf
    places = F.broadcast(spark.createDataFrame(
        [(i, int(b), int(h)) for i, (b, h) in enumerate(zip(shelves.before, held, strict=True))], "list int, before bigint, held bigint"))
    shelved = postings.join(places, "list").withColumn("shelf", shelves.of_rows()).join(turns, "shelf")
    left = shelved.select("shelf", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", F.col("c").alias("id"), "v",
                          F.lit(None).cast("array<int>").alias("lists"))
    right = probes.join(turns, "shelf").select("shelf", F.pmod(F.xxhash64("qc"), "turns").cast("int").alias("turn"),
                                               F.lit(-1).alias("list"), F.col("qc").alias("id"), "v", "lists")
    both = left.unionByName(right).repartition(parts, "shelf", "turn").sortWithinPartitions("shelf", "turn", "list")
    best = _searched(both, k + 1)

    once = best.groupBy("qc", "c").agg(F.max("score").alias("score"))  # a class in several lists
    first = Window.partitionBy("qc").orderBy(F.desc("score"), "c")
    classes = once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    near = classes.join(members.select("c", "vec_id"), "c")
    order = Window.partitionBy("qc").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    found = near.groupBy("qc").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    queries = asked.join(asking, ["h", "v"]).select("qc", F.col("vec_id").alias("query_id"))
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return (queries.join(found, "qc").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"))
