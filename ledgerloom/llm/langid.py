"""Language identification with a string kernel and kernel ridge regression.

The blended-spectrum presence kernel of two texts counts the byte n-grams of 1 to ``N`` bytes (texts
lower-cased A-Z) that both have, each length weighted, divided by the root of the product of both
texts' own counts.  A bounded sample of labelled texts gives the landmarks, whose n-grams are the
kernel's spectrum; the Nystrom map of the landmarks turns kernel ridge regression, one language
against the rest, into a small linear system solved on the driver.

Scoring is linear in a text's presence vector up to its length, so landmarks, Nystrom map and ridge
weights are multiplied once into a matrix of n-grams by languages, and a batch of texts is one matrix
product.  Every text is read whole.  Only that matrix and the n-gram index go to the tasks; their
size is bounded by ``PER_LANGUAGE`` texts of ``LONGEST`` bytes for each language.

The sample takes for each language the ``PER_LANGUAGE`` distinct texts with the smallest hash, of at
most ``LONGEST`` bytes.  Null texts and texts without a letter are ``und`` with score 0, as is every text when
no label was learned.  Ties go to the language that sorts first.  Repeated rows get equal answers,
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, texts_of

N = 4
PER_LANGUAGE = 400
LANDMARKS = 320
LONGEST = 20_000
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """``lang`` and ``text`` of a bounded, repeatable choice; copies count once."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
                          & (F.octet_length("text") <= longest)).select("lang", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    keys = (rows.select("lang", "h").distinct().withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= per_language).select("lang", "h"))
    chosen = rows.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in chosen.collect())


def _grams(text: bytes, n: int) -> np.ndarray:
    """Keys of all byte n-grams of one length, the length in the top byte."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.zeros(0, np.uint64)
    keys = b[:len(b) - n + 1].copy()
    for k in range(1, n):
        keys <<= np.uint64(8)
        keys |= b[k:len(b) - n + 1 + k]
    return keys


@dataclass
class Spectrum:
    """Index of the landmarks' n-grams: by table for short ones, by a hashed table for long ones."""
    keys: list[np.ndarray]

    BITS = 20

    def __post_init__(self) -> None:
        self.offsets = np.concatenate(([0], np.cumsum([len(k) for k in self.keys]))).astype(np.int64)
        self.size = int(self.offsets[-1])
        self.tables = []
        for n, keys in enumerate(self.keys, 1):
            bits = min(8 * n, self.BITS)
            table = np.full(1 << bits, self.size, np.int32)
            table[self._slot(keys, n)] = np.arange(len(keys)) + self.offsets[n - 1]
            self.tables.append(table)
        self.flat = np.concatenate([*self.keys, np.zeros(1, np.uint64)]) if self.keys else np.zeros(1, np.uint64)

    def _slot(self, keys: np.ndarray, n: int) -> np.ndarray:
        if 8 * n <= self.BITS:
            return keys.astype(np.int64)
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    @classmethod
    def of(cls, texts: list[bytes], n: int = N) -> Spectrum:
        """N-grams that occur in two texts or more; of those that share a slot one stays."""
        keys = []
        for k in range(1, n + 1):
            found, count = np.unique(np.concatenate([np.unique(_grams(t, k)) for t in texts] or
                                                    [np.zeros(0, np.uint64)]), return_counts=True)
            found = found[count >= min(2, len(texts))]
            if 8 * k > cls.BITS:
                slot = ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cls.BITS))
                found = found[np.unique(slot, return_index=True)[1]]
            keys.append(found)
        return cls(keys)

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """One row of 0 and 1 per text."""
        rows = np.zeros((len(texts), self.size + 1), np.float32)
        for row, text in zip(rows, texts, strict=True):
            for n, table in enumerate(self.tables, 1):
                keys = _grams(text, n)
                at = table[self._slot(keys, n)]
                if 8 * n > self.BITS:
                    at = at[self.flat[at] == keys]
                row[at] = 1
        return rows[:, :-1]

    def weights(self) -> np.ndarray:
        """Each length has the same total weight, whatever its number of n-grams."""
        return np.concatenate([np.full(len(k), 1 / max(1, len(k))) for k in self.keys]).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    spectrum: Spectrum
    matrix: np.ndarray
    weight: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Margins of every language, one row per text."""
        x = self.spectrum.presence([t.lower() for t in texts])
        own = np.sqrt(np.maximum(x @ self.weight, 1e-12))
        return (x @ self.matrix) / own[:, None]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, n: int = N) -> Model | None:
    """Nystrom kernel ridge regression on (language, text) rows; None without rows."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    texts = [t.encode().lower() for _, t in rows]
    by_language = [[i for i, r in enumerate(rows) if r[0] == lang] for lang in languages]
    rng = np.random.default_rng(7)
    share = max(1, landmarks // len(languages))
    chosen = [i for own in by_language for i in rng.permutation(own)[:share]]
    spectrum = Spectrum.of([texts[i] for i in chosen], n)
    weight = spectrum.weights()
    x = spectrum.presence(texts)
    x /= np.sqrt(np.maximum(x @ weight, 1e-12))[:, None]
    z = x[chosen] * weight
    kernel = (z @ x.T).astype(np.float64).T  # sample by landmarks
    among = kernel[chosen]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > values.max() * 1e-6
    nystrom = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ nystrom
    target = np.full((len(rows), len(languages)), -1.0)
    target[np.arange(len(rows)), [languages.index(lang) for lang, _ in rows]] = 1
    counts = np.array([len(own) for own in by_language], np.float64)
    balance = np.array([1 / counts[languages.index(lang)] for lang, _ in rows]) * len(rows) / len(languages)
    gram = features.T @ (features * balance[:, None])
    gram += ridge * len(rows) * np.eye(gram.shape[0]) * np.trace(gram) / len(rows) / gram.shape[0]
    solved = np.linalg.solve(gram, features.T @ (target * balance[:, None]))
    return Model(languages, spectrum, (z.T @ (nystrom @ solved)).astype(np.float32), weight)


def predict(documents: DataFrame, model: Model | None, *carry: Column) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and the columns to carry along."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    extra = source.columns[2:]
    if model is None:
        return source.select("doc_id", *extra, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        margins = SHARPNESS * model.score(texts)
        shares = np.exp(margins - margins.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        known = [bool(_LETTER.search(t.decode())) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(batch.column(c) for c in extra),
             pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
             pa.array([float(s[b]) if k else 0.0 for s, b, k in zip(shares, best, known, strict=True)], pa.float64())],
            names=["doc_id", *extra, "lang_pred", "score"])

    kinds = dict(source.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *extra]) + ", lang_pred string, score double"
    return map_batches(source, run, schema, rows=128)
