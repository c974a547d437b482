"""Ranked lexical search with a document FP-tree.

A document is reduced to its *restricted term vector*: the terms that items ask for, with their counts, the most frequent
term (by documents) first.  Vectors of a block of documents, sorted, share the paths of a trie; a path without a fork is one
edge, equal vectors of equal length are one leaf.  Every node knows, for each term, the largest count below it, and
the smallest length norm ``m``.  A term's part of a score grows with its count and falls with ``m``, so these give an upper bound of
every score below a node.  Each item walks the tree depth first, the best bound first, and leaves out what can't enter
its ``k`` best, ties by smaller id included; these bounds carry on from block to block of a task.

The work in Spark: one pass over all texts writes the restricted vectors (no text is shuffled); their totals and document
counts are aggregates; a second pass, over the vectors, searches the blocks of each task and keeps ``k`` documents an item;
a group-limited window picks the best over all tasks.  Items are taken in blocks of at most ``TERMS`` distinct terms (an item
with more is a block of its own), one block at a time on the driver and in the tasks; each block is a search over all documents.
A task's tree holds at most ``BLOCK_CELLS`` counts, so memory depends neither on the number of documents nor of items.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.  Null or empty texts have no
term and are not counted; an item without terms, or whose terms occur nowhere, has no row.  Equal rows are documents (and items)
of their own.  A document without id ranks behind equal scores with ids; an item without id keeps its null.  Other columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, texts_of
from ledgerloom.session import materialize

TERMS = 8192
BLOCK_CELLS = 1 << 23
BLOCK_DOCS = 4096
#: A node with at most so many leaves is not walked further; they are all scored at once.
FEW_LEAVES = 96

#: Lower case for A-Z, terms kept, everything else a space: one byte stays one byte.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

FOUND = "item_id bigint, rank int, doc_id bigint, score bigint"
_VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
_LAST = np.iinfo(np.int64).max

Item = tuple[int | None, dict[bytes, int]]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_blocks(items: DataFrame, most: int = TERMS) -> Iterator[list[Item]]:
    """Items with the counts of their terms, in blocks of a bounded number of distinct terms."""
    block: list[Item] = []
    held: set[bytes] = set()
    for row in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        own = Counter(terms_of((row["text"] or "").encode()))
        if own and block and len(held | own.keys()) > most:
            yield block
            block, held = [], set()
        if own:
            block.append((row["item_id"], dict(own)))
            held |= own.keys()
    if block:
        yield block


def vectors(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``n``: terms with repeats; ``terms``, ``counts``: those that ``numbers`` has.  Only documents with a term."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, terms, counts = [], [], [], []
        for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            own = terms_of(text)
            if own:
                held = Counter(own)
                kept = [t for t in held if t in numbers]
                keys.append(key)
                sizes.append(len(own))
                terms.append([numbers[t] for t in kept])
                counts.append([held[t] for t in kept])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((keys, sizes, terms, counts), kinds, strict=True)],
                                          names=["doc_id", "n", "terms", "counts"])
    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, _VECTORS)


class Best:
    """The ``k`` best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> tuple[int, int]:
        """Score and id of the last one; anything below can't enter."""
        return (int(self.scores[-1]), int(self.ids[-1])) if len(self.scores) == self.k else (0, -1)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


class Tree:
    """FP-tree of one block: nodes in arrays, node 0 the root, children and leaves of a node in one range each."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, paths: list[bytes], cells: np.ndarray, width: int):
        """``paths``: the vector's term numbers as big-endian bytes; ``cells``: a row of counts for each document."""
        docs = sorted(range(len(ids)), key=lambda i: (paths[i], m[i], cells[i].tobytes(), ids[i]))
        self.leaf_ids: list[list[int]] = []
        rows: list[int] = []
        for i in docs:
            last = rows[-1] if rows else -1
            if rows and paths[i] == paths[last] and m[i] == m[last] and (cells[i] == cells[last]).all():
                self.leaf_ids[-1].append(int(ids[i]))
            else:
                rows.append(i)
                self.leaf_ids.append([int(ids[i])])
        parents, depth, stack = [-1], [0], [0]
        owner = []
        for place, i in enumerate(rows):
            shared = _common(paths[rows[place - 1]], paths[i]) // 4 if place else 0
            below = -1
            while depth[stack[-1]] > shared:
                below = stack.pop()
            if depth[stack[-1]] < shared:  # a fork on the edge to the node below, or to the leaf before
                node = len(parents)
                parents.append(stack[-1])
                depth.append(shared)
                if below >= 0:
                    parents[below] = node
                else:
                    owner[-1] = node
                stack.append(node)
            owner.append(stack[-1])
        leaves, inner = len(rows), len(parents)
        self.inner = inner
        parent = np.array(parents + owner)
        self.counts = np.zeros((inner + leaves, width), cells.dtype)
        self.m = np.full(inner + leaves, _LAST)
        self.least_id = np.full(inner + leaves, _LAST)
        self.counts[inner:] = cells[rows]
        self.m[inner:] = m[rows]
        self.least_id[inner:] = [own[0] for own in self.leaf_ids]
        self.leaf_first = np.append(np.full(inner, leaves), np.arange(leaves))
        self.leaf_end = np.append(np.zeros(inner, np.int64), np.arange(1, leaves + 1))
        for node in [*range(inner, inner + leaves), *sorted(range(1, inner), key=lambda j: -depth[j])]:
            up = parent[node]
            np.maximum(self.counts[up], self.counts[node], out=self.counts[up])
            self.m[up] = min(self.m[up], self.m[node])
            self.least_id[up] = min(self.least_id[up], self.least_id[node])
            self.leaf_first[up] = min(self.leaf_first[up], self.leaf_first[node])
            self.leaf_end[up] = max(self.leaf_end[up], self.leaf_end[node])
        self.kids = np.argsort(parent, kind="stable")[1:]
        self.first = np.searchsorted(parent[self.kids], np.arange(inner))
        self.end = np.searchsorted(parent[self.kids], np.arange(inner), side="right")

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Depth first, the child with the best bound first."""
        def bounds(nodes: np.ndarray) -> np.ndarray:
            counts = self.counts[nodes[:, None], terms[None, :]].astype(np.int64)
            return (weights * score_part(counts, self.m[nodes][:, None])).sum(1)

        stack = [(_LAST, -1, 0)]
        while stack:
            score, least, node = stack.pop()
            floor, last = best.floor()
            if score < floor or (score == floor and least > last):
                continue
            if self.leaf_end[node] - self.leaf_first[node] <= FEW_LEAVES:
                kids = np.arange(self.inner + self.leaf_first[node], self.inner + self.leaf_end[node])
            else:
                kids = self.kids[self.first[node]:self.end[node]]
            bound = bounds(kids)
            kept = bound >= max(floor, 1)
            kids, bound = kids[kept], bound[kept]
            leaf = kids >= self.inner
            own = [(s, d) for s, j in zip(bound[leaf], kids[leaf], strict=True) for d in self.leaf_ids[j - self.inner][:best.k]]
            if own:
                best.add(np.array([s for s, _ in own]), np.array([d for _, d in own]))
            forks, bound = kids[~leaf], bound[~leaf]
            order = np.lexsort((-self.least_id[forks], bound))
            stack.extend(zip(bound[order].tolist(), self.least_id[forks[order]].tolist(), forks[order].tolist(), strict=True))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    size = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))
    return int(differ[0]) if len(differ) else size


def score_part(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _searched(stored: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], width: int, documents: int, terms: int, k: int) -> DataFrame:
    """``item`` (place in the block), ``doc_id``, ``score``: the best of every task.  Terms are numbered by frequency."""
    rows = max(64, min(BLOCK_DOCS, BLOCK_CELLS // (2 * width)))

    def tree_of(batch: pa.RecordBatch) -> Tree:
        own, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy()
        ends = np.cumsum([0, *(len(v) if v else 0 for v in own.to_pylist())])
        flat = own.flatten().to_numpy()
        cells = np.zeros((batch.num_rows, width), np.int32 if not len(counts) or counts.max() < 1 << 31 else np.int64)
        paths = []
        for i in range(batch.num_rows):
            part = flat[ends[i]:ends[i + 1]]
            cells[i, part] = counts[ends[i]:ends[i + 1]]
            paths.append(np.sort(part).astype(">u4").tobytes())
        ids = np.array([_LAST if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
        m = 75 + (25 * batch.column("n").to_numpy() * documents) // terms
        return Tree(ids, m, paths, cells, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                tree = tree_of(batch.slice(at, rows))
                for (own, weights), found in zip(asked, best, strict=True):
                    tree.search(own, weights, found)
        items = np.repeat(np.arange(len(asked)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _LAST),
             pa.array(np.concatenate([b.scores for b in best] or [ids]), pa.int64())], names=["item", "doc_id", "score"])
    return stored.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _block(documents: DataFrame, block: list[Item], k: int) -> DataFrame:
    spark = documents.sparkSession
    names = sorted({t for _, own in block for t in own})
    stored = materialize(vectors(documents, {t: i for i, t in enumerate(names)}), "term-vectors")
    total = stored.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not total["n"]:
        return spark.createDataFrame([], FOUND)
    found = stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most the block's terms
    frequent = sorted(((r["count"], -r["term"]) for r in found), reverse=True)
    place = {-number: at for at, (_, number) in enumerate(frequent)}
    weight = [math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * df + 1))) for df, _ in frequent]
    numbers = {names[term]: at for term, at in place.items()}
    asked = []
    for _, own in block:
        terms = np.array(sorted(numbers[t] for t in own if t in numbers), np.int64)
        repeats = {numbers[t]: c for t, c in own.items() if t in numbers}
        asked.append((terms, np.array([weight[t] * repeats[t] for t in terms], np.int64)))
    new = np.zeros(len(names), np.int64)
    for term, at in place.items():
        new[term] = at

    def renumber(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("terms")
        return batch.set_column(2, "terms", pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(old).to_numpy())]), pa.int32()),
            pa.array(new[old.flatten().to_numpy()], pa.int32())))

    best = _searched(map_batches(stored, renumber, _VECTORS), asked, max(1, len(place)), total["n"], total["l"], k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = best.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(at, item) for at, (item, _) in enumerate(block)], "item bigint, item_id bigint")
    return ranks.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # one row an item of the block


def search(documents: DataFrame, items: DataFrame, k: int = 20, most_terms: int = TERMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` highest-scoring documents."""
    blocks = list_of_results(documents, items, k, most_terms)
    return reduce(DataFrame.unionByName, blocks) if blocks else documents.sparkSession.createDataFrame([], FOUND)


def list_of_results(documents: DataFrame, items: DataFrame, k: int, most_terms: int) -> list[DataFrame]:
    """A written result for each block of items; a single block's is read as it is computed."""
    found: list[DataFrame] = []
    for block in item_blocks(items, most_terms):
        if found:
            found[-1] = materialize(found[-1], "ranked")
        found.append(_block(documents, block, k))
    return found
