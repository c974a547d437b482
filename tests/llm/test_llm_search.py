"""Nearest neighbours, manifest and lexical search against trying everything, on rows that are null, empty, equal or odd."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical, manifest, nearest

ODD = [None, "", " ", "\n", "A b, a", "É—w0 É—W0", "x" * 5000, "the same words " * 40, "%%% ***", "9 lives"]


def neighbours(rows, k):
    """All rows against all, ties to smaller ids."""
    good = [(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    size = min((-n, length) for length, n in Counter(len(v) for _, v in good).items())[1]
    good = sorted({i: v for i, v in sorted(good, reverse=True) if len(v) == size}.items())
    found = []
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i)
            found += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:k], 1)]
    return found


@pytest.mark.parametrize("list_rows", [8, 10_000])
def test_nearest_equals_trying_all(spark, list_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=8) * 0.2)]) for i in range(240)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies, three of them queries
    rows += [(2000 + i, [float(i == j % 8) for j in range(8)]) for i in range(8)]  # many equal scores
    rows += [(3000, None), (3020, []), (3040, [0.0] * 8), (3060, [1.0] * 7 + [None]), (3080, [float("nan")] * 8),
             (3100, [float("inf")] + [0.0] * 7), (3120, [1.0, 2.0]), (None, [1.0] * 8), (7, rows[7][1]), (20, [5.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("c", F.lit(1))
    found = [tuple(r) for r in nearest.search(frame, F.col("vec_id") % 20 == 0, k=5, list_rows=list_rows).collect()]
    want = neighbours(rows, 5)
    if list_rows == 10_000:  # one list: nothing is left out
        def plain(r):
            return sorted((q, rank, v, round(s, 9)) for q, rank, v, s in r)
        assert plain(found) == plain(want)
    else:
        assert Counter(q for q, *_ in found) == Counter(q for q, *_ in want)
        assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len({(q, v) for q, _, v, _ in want})


def test_nearest_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert nearest.search(spark.createDataFrame([(20, [1.0, 0.0])], kind), F.lit(True)).count() == 0
    two = spark.createDataFrame([(20, [1.0, 0.0]), (21, [-2.0, 1.0])], kind)
    assert [tuple(r) for r in nearest.search(two, F.col("vec_id") == 20).collect()] == [(20, 1, 21, -2.0)]


def test_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(4000, 12))
    index = nearest.fit(sample, 60_000, float(np.linalg.norm(sample, axis=1).max()), 10, list_rows=300)
    points = index.lift(rng.normal(size=(50, 12)), queries=True)
    lists, far = index.walk(points, 32)
    true = np.linalg.norm(points[:, None] - index.centroids[None], axis=2)
    assert len(index.centroids) > 100 and (lists[:, 0] == true.argmin(1)).mean() > 0.95
    assert np.allclose(far, np.take_along_axis(true, lists, 1), atol=1e-5)
    sizes = np.bincount(np.concatenate([index.homes(index.lift(sample, False)[i:i + 500])[1] for i in range(0, 4000, 500)]))
    assert sizes.max() < 8 * np.median(sizes)
    shelves = nearest.Shelves.of(sizes, 7)
    first, last = shelves.of_lists(np.arange(len(sizes)))
    assert first[0] == 0 and last.max() == 6 and (first[1:] >= first[:-1]).all()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(rows):
    """(doc, leaf, subroot, root, proof, folded, verified) by building the whole tree in lists."""
    def own(*values):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def lower(text):
        return re.sub("[A-Z]", lambda m: m[0].lower(), text)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha(*found[-1][i:i + 16]) for i in range(0, len(found[-1]), 16)])
        return found

    def way(found, at):
        steps = []
        for level in found[:-1]:
            run = at // 16 * 16
            steps.append((level[run:at], level[at + 1:run + 16]))
            at //= 16
        return steps
    trees = {}
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(((r[0] is not None, r[0] or 0, own(r[0], r[1], r[2], r[4], r[3]), r) for r in rows if r[1] == source),
                        key=lambda x: x[:3])
        trees[source] = (leaves, levels([x[2] for x in leaves]))
    top = levels([found[-1][0] for _, found in trees.values()])
    for place, (leaves, found) in enumerate(trees.values()):
        for at, (*_, leaf, r) in enumerate(leaves):
            steps = way(found, at) + way(top, place)
            low = r[3] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
            shown = own(r[0], r[1], r[2], r[4], lower(r[3])) if low else leaf
            for left, right in steps:
                shown = sha(*left, shown, *right)
            proof = sha(*(s for left, right in steps for s in left + right))
            yield r[0], leaf, found[-1][0], top[-1][0], proof, shown, shown == top[-1][0]


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1, 40], [300, 2] + [1] * 20])
def test_manifest_equals_lists(spark, sizes):
    rows = [(1000 * s + i, None if s == 1 else f"sé{s}", "en" if i % 3 else None, random.Random(i).choice([*ODD, f"Text {i}"]), i if i % 2 else None)
            for s, n in enumerate(sizes) for i in range(n)]
    rows += rows[:1] + ([(None, "sé0", None, "No Id", None)] if len(sizes) > 2 else [])
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long")
    found = manifest.manifest(frame.withColumn("lo", F.lit("clash")).withColumn("way", F.lit(1)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(tree(rows), key=key)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, text string, n_chars long")).count() == 0


def ranked(documents, items, k):
    """Scores of all documents for all items."""
    def terms(text):
        return [t.lower() for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    held = [(d, Counter(terms(t))) for d, t in documents]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        yield from ((item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1))


@pytest.mark.parametrize("few, cells, most_terms", [(96, 1 << 23, 8192), (1, 4096, 8192), (2, 1 << 23, 30)])
def test_lexical_search_equals_trying_all(spark, monkeypatch, few, cells, most_terms):
    monkeypatch.setattr(lexical, "FEW_LEAVES", few)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", cells)
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    documents = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(400)]
    documents += [(500 + i, documents[3][1]) for i in range(40)] + [*enumerate(ODD, 600), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, documents[5][1])]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(1, "W1 w1; w2!"), (1, "W1 w1; w2!"), (None, "lives"), (13, None), (14, "..."), (15, "nowhere")]
    frame = spark.createDataFrame(documents, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("terms", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in lexical.search(frame, asked, 7, most_terms).collect()]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(found, key=order) == sorted(ranked(documents, items, 7), key=order)


def test_lexical_search_of_nothing(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(documents.limit(0), items).count() == lexical.search(documents, items.limit(0)).count() == 0
    assert lexical.search(documents.withColumn("text", F.lit("")), items).count() == 0
