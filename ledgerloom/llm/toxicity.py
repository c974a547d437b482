"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words.

Words are runs of ASCII letters and digits and of bytes above 0x7F, lower-cased A-Z; words of more than
``CHARACTERS`` bytes are read as several.  A first layer reads a word's bytes and pools them into a vector,
which joins the word's own vector (by hash); a second layer reads windows of ``WINDOW`` words that begin
every ``STRIDE`` words, and a logistic unit scores what it pools.  A document's score is that of its
worst window, so all of a text counts, whatever its length.

Training is multiple-instance learning by Adam on a bounded sample of labelled documents, at most
``POSITIVE`` toxic and ``NEGATIVE`` other ones of at most ``LONGEST`` bytes, distinct texts by smallest hash.
At first a toxic document teaches by the windows with the word or word part that speaks most for toxicity by
its document frequencies in the sample, later by the windows that the network itself finds worst; half of
the other windows are those it finds most toxic so far.  Half of the toxic windows are replaced by their
worst words put into another window, so that the rest of a document isn't learned by heart, and a word's own
vector is left out half of the time, so that spelling has to suffice for unseen words.

Scoring keeps the second layer's input of each distinct word, at most ``MAX_WORDS`` of them, and runs
batches of windows of several documents at once.  Null texts and texts without words score 0, as all do
when no labelled document has words.  Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, smallest, texts_of
from ledgerloom.llm.decontaminate import FOLD
from ledgerloom.llm.recurrent import Arrays, Layer, sigmoid
from ledgerloom.session import materialize

WINDOW = 32
STRIDE = 24
CHARACTERS = 16
POSITIVE = 1000
NEGATIVE = 2000
LONGEST = 20_000
BUCKETS = 4096
STEPS = 700
BATCH = 64
RATE = 5e-3
THRESHOLD = 0.7
MAX_WORDS = 250_000
WINDOWS_AT_ONCE = 1024


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(FOLD).split()
    if max(map(len, words), default=0) <= CHARACTERS:
        return words
    return [w[i:i + CHARACTERS] for w in words for i in range(0, len(w), CHARACTERS)]


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, padded, and the mask."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, int(size.max(initial=1)))), np.uint8)
    mask = np.arange(out.shape[1])[None, :] < size[:, None]
    out[mask] = np.frombuffer(b"".join(words), np.uint8)
    return out, mask


def windows_of(count: int) -> np.ndarray:
    """Where the windows of a text of so many words begin; the last one ends with the text."""
    if count <= WINDOW:
        return np.zeros(min(count, 1), np.int64)
    return np.append(np.arange(0, count - WINDOW, STRIDE), count - WINDOW)


@dataclass
class Network:
    characters: Layer
    words: Layer
    rest: Arrays

    @classmethod
    def new(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        return cls(Layer.new(8, 8, rng), Layer.new(24, 8, rng), {
            "byte": (rng.standard_normal((256, 8)) * 0.5).astype(np.float32),
            "own": np.zeros((BUCKETS, 8), np.float32),
            "out": (rng.standard_normal((16, 1)) * 0.25).astype(np.float32), "bias": np.zeros(1, np.float32)})

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Vectors of distinct words."""
        out = np.empty((len(words), 24), np.float32)
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            code, mask = spelled(part)
            out[at:at + 4096, :16] = self.characters.pooled(self.characters.projected(self.rest["byte"][code]), mask)
            out[at:at + 4096, 16:] = self.rest["own"][[zlib.crc32(w) % BUCKETS for w in part]]
        return out

    def logits(self, given: tuple[np.ndarray, np.ndarray], mask: np.ndarray) -> np.ndarray:
        return (self.words.pooled(given, mask) @ self.rest["out"])[:, 0] + self.rest["bias"]

    def step(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, label: np.ndarray,
             keep_own: np.ndarray) -> tuple[float, np.ndarray, dict[str, Arrays]]:
        """Loss, logits and gradients of windows ``at`` (numbers of distinct ``words``)."""
        code, letters = spelled(words)
        byte = self.rest["byte"][code]
        kept: dict = {}
        pooled = self.characters.pooled(self.characters.projected(byte), letters, kept)
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in words])
        x = np.concatenate([pooled, self.rest["own"][bucket] * keep_own[:, None]], axis=1)[at]
        above: dict = {}
        top = self.words.pooled(self.words.projected(x), mask, above)
        z = (top @ self.rest["out"])[:, 0] + self.rest["bias"]
        p = sigmoid(z)
        loss = float(-np.mean(np.where(label > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
        g = ((p - label) / len(label)).astype(np.float32)
        rest: Arrays = {"out": top.T @ g[:, None], "bias": g.sum(keepdims=True)}
        g_words, g_x = self.words.gradients(g[:, None] * self.rest["out"][:, 0], x, above)
        g_input = np.zeros((len(words), 24), np.float32)
        np.add.at(g_input, at[mask], g_x[mask])
        rest["own"] = np.zeros_like(self.rest["own"])
        np.add.at(rest["own"], bucket, g_input[:, 16:] * keep_own[:, None])
        g_characters, g_byte = self.characters.gradients(g_input[:, :16], byte, kept)
        rest["byte"] = np.zeros_like(self.rest["byte"])
        np.add.at(rest["byte"], code[letters], g_byte[letters])
        return loss, z, {"characters": g_characters, "words": g_words, "rest": rest}

    def groups(self) -> dict[str, Arrays]:
        return {"characters": self.characters.weights, "words": self.words.weights, "rest": self.rest}


@dataclass
class Reader:
    """Scores texts; remembers the second layer's input of the words it has met."""
    network: Network
    index: dict[bytes, int] = field(default_factory=dict)
    given: list[np.ndarray] = field(default_factory=list)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > MAX_WORDS:
            self.index, self.given, new = {}, [], list(set(words))
        if new:
            found = self.network.words.projected(self.network.inputs(new))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            rows = len(self.index) - len(new)
            if not self.given or len(self.index) > len(self.given[0]):
                size = max(4096, 2 * len(self.index))
                self.given = [np.concatenate([g[:rows], np.zeros((size - rows, f.shape[1]), np.float32)])
                              for g, f in zip(self.given or [f[:0] for f in found], found, strict=True)]
            for g, f in zip(self.given, found, strict=True):
                g[rows:len(self.index)] = f
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window of the texts (words), and the number of windows of each."""
        numbers = self._numbers([w for own in texts for w in own])
        first = np.cumsum([0, *map(len, texts)])
        starts = [windows_of(len(own)) for own in texts]
        begin = np.concatenate([s + f for s, f in zip(starts, first, strict=False)] or [np.zeros(0, np.int64)])
        size = np.concatenate([np.minimum(len(own) - s, WINDOW) for own, s in zip(texts, starts, strict=True)]
                              or [np.zeros(0, np.int64)])
        out = np.empty(len(begin), np.float32)
        step = np.arange(WINDOW)
        for at in range(0, len(begin), WINDOWS_AT_ONCE):
            own = size[at:at + WINDOWS_AT_ONCE]
            wide = step[:int(own.max())]
            mask = wide[None, :] < own[:, None]
            place = numbers[np.minimum(begin[at:at + WINDOWS_AT_ONCE, None] + wide, len(numbers) - 1)]
            out[at:at + WINDOWS_AT_ONCE] = self.network.logits((self.given[0][place], self.given[1][place]), mask)
        return out, np.array([len(s) for s in starts], np.int64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of every text: that of its worst window, 0 without words."""
        parted = [words_of(t) for t in texts]
        logits, count = self.logits(parted)
        out = np.zeros(len(texts))
        some = np.flatnonzero(count)
        if len(some):
            out[some] = sigmoid(np.maximum.reduceat(logits, (np.cumsum(count) - count)[some]).astype(np.float64))
        return out


def _parts(word: bytes) -> list[bytes]:
    """A word and its parts of four and five bytes, the first one marked as a beginning."""
    marked = b"^" + word
    return [word, *(marked[i:i + n] for n in (4, 5) for i in range(len(marked) - n + 1))]


def evidence(texts: list[tuple[list[bytes], int]]) -> dict[bytes, float]:
    """What a word says for toxicity: the best of its parts, by smoothed odds over documents."""
    parts: dict[bytes, list[bytes]] = {}
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]
    for words, label in texts:
        totals[label] += 1
        own = set(words)
        for w in own:
            if w not in parts:
                parts[w] = _parts(w)
        counts[label].update({p for w in own for p in parts[w]})
    good, bad = counts
    odds = {p: np.log((n + 0.1) / (totals[1] + 0.1)) - np.log((good[p] + 0.5) / (totals[0] + 0.5))
            + min(0.0, np.log(n / 4)) for p, n in bad.items()}
    return {w: max((odds.get(p, -9.0) for p in own), default=-9.0) for w, own in parts.items()}


def fit(rows: list[tuple[bytes, int]], steps: int = STEPS, seed: int = 4) -> Network | None:
    """Train on (text, label) rows; None if a label is missing altogether."""
    rng, network = np.random.default_rng(seed), Network.new()
    texts = [(words_of(t), label) for t, label in rows]
    texts = [(w, label) for w, label in texts if w]
    if len({label for _, label in texts}) < 2:
        return None
    windows = [(d, int(s)) for d, (w, _) in enumerate(texts) for s in windows_of(len(w))]
    labels = np.array([texts[d][1] for d, _ in windows])
    document = np.array([d for d, _ in windows])
    first = np.flatnonzero(np.diff(document, prepend=-1))
    says = evidence(texts)
    guess = np.array([max(says[w] for w in texts[d][0][s:s + WINDOW]) for d, s in windows])

    def taught(value: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """Toxic documents' worst windows and those that are bad enough, and the hardest other windows."""
        best = np.maximum.reduceat(value, first)[document]
        other = np.flatnonzero(labels == 0)
        hardest = other[np.argsort(-value[other], kind="stable")[:max(BATCH, len(other) // 20)]]
        return np.flatnonzero((labels == 1) & (value >= np.minimum(best, enough))), hardest

    good = np.flatnonzero(labels == 0)
    bad, hard = taught(guess, np.inf)
    mean, square = ({n: {k: np.zeros_like(x) for k, x in g.items()} for n, g in network.groups().items()} for _ in range(2))
    for step in range(steps):
        if step and step % (steps // 5) == 0:
            bad, hard = taught(Reader(network).logits([w for w, _ in texts])[0], 2.0)
        chosen = np.concatenate([rng.choice(bad, BATCH // 2), rng.choice(good, BATCH // 4), rng.choice(hard, BATCH // 4)])
        sequences = [texts[windows[c][0]][0][windows[c][1]:windows[c][1] + WINDOW] for c in chosen]
        for i in range(0, BATCH // 2, 2):
            # Half of the toxic windows keep only their worst words, among those of another window.
            worst = sorted(sequences[i], key=says.__getitem__)[-int(rng.integers(1, 3)):]
            among = [*sequences[BATCH // 2 + int(rng.integers(BATCH // 2))][:WINDOW - len(worst)]]
            for w in worst:
                among.insert(int(rng.integers(len(among) + 1)), w)
            sequences[i] = among
        distinct = list(dict.fromkeys(w for s in sequences for w in s))
        index = dict(zip(distinct, range(len(distinct)), strict=True))
        size = np.array([len(s) for s in sequences])
        mask = np.arange(int(size.max()))[None, :] < size[:, None]
        at = np.zeros(mask.shape, np.int64)
        at[mask] = [index[w] for s in sequences for w in s]
        _, _, found = network.step(distinct, at, mask, labels[chosen].astype(np.float32),
                                   (rng.random(len(distinct)) < 0.5).astype(np.float32))
        rate = RATE * min(1.0, (step + 1) / 30) * (0.1 + 0.9 * (1 - step / steps))
        for name, group in network.groups().items():
            for key, g in found[name].items():
                g = np.clip(g, -1, 1)
                mean[name][key] += 0.1 * (g - mean[name][key])
                square[name][key] += 0.01 * (g * g - square[name][key])
                a, b = mean[name][key] / (1 - 0.9 ** (step + 1)), square[name][key] / (1 - 0.99 ** (step + 1))
                group[key] -= (rate * (a / (np.sqrt(b) + 1e-8) + (0.02 * group[key] if key == "own" else 0))).astype(np.float32)
    # The decision lies half way between the sample's clean documents and its toxic ones.
    best = np.maximum.reduceat(Reader(network).logits([w for w, _ in texts])[0], first)
    own = labels[first]
    middle = (np.quantile(best[own == 0], 0.995) + np.quantile(best[own == 1], 0.05)) / 2
    network.rest["bias"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - middle)
    return network


def sample(documents: DataFrame, labels: DataFrame, learn: Column, positive: int = POSITIVE, negative: int = NEGATIVE,
           longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """A bounded, repeatable choice of labelled texts; texts with both labels are left out.

    Only ids and hashes meet the labels; the texts of the chosen hashes come from one more scan.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("l_doc"), F.col("toxic").cast("int").alias("toxic"))
    rows = (documents.where(learn & F.col("text").isNotNull() & (F.octet_length("text") <= longest))
            .select("doc_id", "text", F.xxhash64("text").alias("h")))
    known = materialize(rows.select("doc_id", "h").join(marked, F.col("doc_id") == F.col("l_doc")).select("h", "toxic"), "labelled")
    keys = known.groupBy("h").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    own = {h: label for label, most in ((1, positive), (0, negative))
           for h in smallest(keys.where(F.col("toxic") == label).select("h"), most)}
    if not own:
        return []
    asked = F.broadcast(documents.sparkSession.createDataFrame([(h,) for h in own], "h bigint"))  # at most positive + negative
    found = rows.join(asked, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).collect()
    return [(r["text"].encode(), own[r["h"]]) for r in sorted(found, key=lambda r: (-own[r["h"]], r["h"]))]


def score(documents: DataFrame, network: Network | None, *carry: Column) -> DataFrame:
    """``doc_id``, ``score`` and the columns to carry along."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    extra = source.columns[2:]
    if network is None:
        return source.select("doc_id", *extra, F.lit(0.0).alias("score"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _reader(network).scores(texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in extra), pa.array(found)],
                                          names=["doc_id", *extra, "score"])

    kinds = dict(source.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *extra]) + ", score double"
    return map_batches(source, run, schema, rows=200)


_READERS: dict[bytes, Reader] = {}


def _reader(network: Network) -> Reader:
    """One reader for each network and worker."""
    key = network.rest["byte"].tobytes() + network.rest["out"].tobytes()
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(network)
    return _READERS[key]
