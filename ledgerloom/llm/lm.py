"""Language-model scores of whole texts.

Texts are streams of tokens: words (runs of non-white-space, A-Z lower-cased) and one end.  The model
of a word given what comes before is a mixture of three distributions:

* its share among all training tokens,
* its share among the text's tokens so far (a copy of an earlier word), and
* the probability of its subword ids: the first one under a causal self-attention model (``attention``)
  that reads the ids of the text so far, the further ones and the word's end each after the id before.

Ids that begin a word and ids that go on with one are different.  The most frequent ``SYMBOLS`` of either kind
are symbols; the rest of a kind shares one symbol, within which an id has its smoothed share among all
training ids.  How words go on is counted over all training words.

The network learns from every word of every training text.  It begins with the ``SAMPLE`` texts of at most
``LONGEST`` bytes with the smallest hash; then each task goes once over all texts of its rows, whatever their
length, and the mean of the tasks' networks, weighted by their words, is the model.  The same pass notes, for every
word, the logarithms of its share and of its copies against its spelling's chance, before the network learned from it;
sums of these notes over all tasks give the mixture weights, one set for each range of places in a text, by
expectation maximisation.  A word's own document is left out of its count there; words that aren't among the
``FREQUENT`` most frequent ones count as the rest does on average.

Over the whole corpus, with Spark: token counts (exact, by word), ids of all distinct words, and for
scoring every chunk of documents asks the table of counts only for its own words: chunks of documents and
their words' counts and spelling meet by chunk.  A chunk has about ``CHUNK_BYTES`` of texts whatever the size of the corpus, and a
longer text is a chunk by itself.  No task and no driver holds the vocabulary.

Null texts are empty: one end.  Without training texts every word is unknown and the network untrained.
Repeated rows each get their score.  Extra columns are carried only if asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.attention import BLOCK, RATE, STEPS, Attention, Learner, blocks_of
from ledgerloom.llm.common import ragged_ranges, slices_of, smallest, words_in
from ledgerloom.llm.tokens import ByteTokens
from ledgerloom.session import materialize

SYMBOLS = 255
LEADS = 63
SAMPLE = 1500
LONGEST = 20_000
MAX_WORDS = 400_000
SCORE_BLOCKS = 512
#: Blocks a task learns from in its first step, and at most.
LEAST_BLOCKS, LEARN_BLOCKS = 32, 512
#: Words whose exact counts go to every task that learns.
FREQUENT = 65_536
#: Bytes of texts whose words are looked at together.
SLICE_BYTES = 1_500_000
#: Words that are encoded together, and encoded words that a worker keeps, about 250 bytes each.
ENCODED, KEPT = 16_384, 150_000
#: Bytes of texts that meet their words' counts at once.
CHUNK_BYTES = 8_000_000
END = b"\n"  # white space, so never a word
SMOOTHING = 0.1
#: Ends of the ranges of places in a text that have mixture weights of their own.
PLACES = (1, 8, 32, 128, 512, 2048)


def token_counts(training: DataFrame) -> DataFrame:
    """Occurrences of every token, the end included; summed up inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices_of(batch, SLICE_BYTES):
                found = words_in(part.column("text"))[0].value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([part.num_rows], pa.int64())}))
                size += len(found)
                if size > 3 * MAX_WORDS:
                    held = [summed(held)]
                    size = held[0].num_rows
                    if size > MAX_WORDS:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed(held).to_batches()
        del held
        pa.default_memory_pool().release_unused()

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
    return (training.select("text").mapInArrow(run, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Subwords:
    """Ids of words, each as it stands after a space; an end has none."""

    def __init__(self, path: str) -> None:
        self.tokens = ByteTokens.shared(path)

    def of(self, words: list[bytes], kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words side by side, and the number of ids of each; ``kept``: words a worker keeps for the next call."""
        found = [self._of(words[at:at + ENCODED], kept) for at in range(0, max(1, len(words)), ENCODED)]
        ids, sizes = map(np.concatenate, zip(*found, strict=True))
        return ids, sizes

    def _of(self, words: list[bytes], kept: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.tokens.ids_of(self.tokens.numbers([b" " + w for w in words], most=kept))
        ends = [i for i, w in enumerate(words) if w == END]
        if ends:
            gone = np.repeat(np.isin(np.arange(len(words)), ends), sizes)
            ids, sizes = ids[~gone], sizes.copy()
            sizes[ends] = 0
        return ids.astype(np.int64), sizes


def begins(path: str) -> np.ndarray:
    """Which ids begin a word: those whose text starts with the sign for a space."""
    tokenizer = ByteTokens.shared(path).tokenizer
    return np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(tokenizer.get_vocab_size())])


def numbered(counts: DataFrame, path: str) -> DataFrame:
    """The counts with the ids (little-endian uint32) of every word, each encoded once and none kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED):
                part = batch.slice(at, ENCODED)
                ids, sizes = subwords.of(part.column("word").to_pylist(), kept=0)
                ends = np.concatenate(([0], np.cumsum(4 * sizes))).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), raw], names=["word", "n", "ids"])
    return counts.select("word", "n").mapInArrow(run, "word binary, n bigint, ids binary")


def _numbered(counts: DataFrame, path: str) -> DataFrame:
    return counts if "ids" in counts.columns else materialize(numbered(counts, path), "token-counts")


def ids_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a numbered table side by side, and the number of ids of each."""
    ids = np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)
    return ids, pc.binary_length(column).to_numpy().astype(np.int64) // 4


def _summed(counts: DataFrame, keys: int, keys_of: Callable) -> np.ndarray:
    """Totals of small numbers over all words of a numbered table; ``keys_of``: their numbers, and the word of each.

    One row for each number comes to the driver: as many as ids, or pairs of symbols.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(keys, np.int64)
        for batch in batches:
            key, word = keys_of(*ids_in(batch.column("ids")))
            np.add.at(total, key, batch.column("n").to_numpy()[word])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["k", "n"])
    found = counts.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(keys, np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


@dataclass
class Spelling:
    """Symbols of ids, and how words go on.

    Symbols: 0 the end of a text (as a beginning) or nothing; then beginnings, the last of them for the rest;
    then continuations, again with one for the rest.  After an id comes a continuation or nothing; its chance
    depends on the id before and, as far as that was seen, on the word's first symbol (``LEADS`` and the rest).
    """
    symbol: np.ndarray  # fewer than 1024
    inside: np.ndarray  # log10 share of an id among those with its symbol
    fronts: int
    backs: int
    row: np.ndarray | None = None  # of ``after``, by first symbol and symbol
    after: np.ndarray | None = None  # log10 chance of the next continuation (0: none)

    @classmethod
    def of(cls, used: np.ndarray, first: np.ndarray, most: int = SYMBOLS) -> Spelling:
        symbol, inside, at = np.zeros(len(used), np.int64), np.zeros(len(used)), 1
        counts = []
        for kind in (np.flatnonzero(first), np.flatnonzero(~first)):
            top = kind[np.argsort(-used[kind], kind="stable")][:most]
            top = top[used[top] > 0]
            symbol[kind] = at + len(top)
            symbol[top] = at + np.arange(len(top))
            rest = kind[symbol[kind] == at + len(top)]
            share = used[rest] + 0.5
            inside[rest] = np.log10(share / share.sum())
            at += len(top) + 1
            counts.append(len(top) + 1)
        return cls(symbol, inside, *counts)

    def steps(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol before and continuation after (0: none) of every id, and the number of its word."""
        own = self.symbol[ids]
        word = np.repeat(np.arange(len(sizes)), sizes)
        following = np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        # A space inside a word can't be, but an id that also begins words may stand there: it counts as rest.
        following[inner] = np.where(own[inner + 1] > self.fronts, own[inner + 1] - self.fronts, self.backs)
        return own, following, word

    def pairs(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, following, word = self.steps(ids, sizes)
        return (self._lead(own, sizes) * (1 + self.fronts + self.backs) + own) * (self.backs + 1) + following, word

    def _lead(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        some = sizes[sizes > 0]
        return np.repeat(np.minimum(own[np.cumsum(some) - some], LEADS), some)

    def pair_keys(self) -> int:
        return (LEADS + 1) * (1 + self.fronts + self.backs) * (self.backs + 1)

    def learn(self, totals: np.ndarray) -> None:
        exact = totals.reshape(LEADS + 1, -1, self.backs + 1)
        by_id = exact.sum(axis=0).astype(np.float64)
        usual = by_id.sum(axis=0) + 0.5
        by_id = by_id + usual / usual.sum()
        by_id /= by_id.sum(axis=1, keepdims=True)
        # First symbols that were never seen with a symbol share its row.
        seen, symbols = exact.any(axis=2), len(by_id)
        self.row = np.tile(np.arange(symbols, dtype=np.int32), (LEADS + 1, 1))
        self.row[seen] = symbols + np.arange(seen.sum())
        found = exact[seen] + 3 * by_id[np.nonzero(seen)[1]]
        found = np.concatenate([3 * by_id, found])
        found /= found.sum(axis=1, keepdims=True)
        self.after = np.log10(found, out=found).astype(np.float32)

    def words(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word three symbols (first, second, last) and log10 chance of all but its first symbol."""
        own, following, word = self.steps(ids, sizes)
        chance = np.bincount(word, self.after[self.row[self._lead(own, sizes), own], following] + self.inside[ids],
                             minlength=len(sizes))
        three = np.zeros((len(sizes), 3), np.int64)
        some = np.flatnonzero(sizes > 0)
        start = (np.cumsum(sizes) - sizes)[some]
        three[some, 0] = np.minimum(own[start], self.fronts)
        three[some, 1] = np.where(sizes[some] > 1, own[np.minimum(start + 1, len(own) - 1)], 0)
        three[some, 2] = own[start + sizes[some] - 1]
        return three, chance


@dataclass
class Model:
    network: Attention
    spelling: Spelling
    tokens: int
    distinct: int
    shares: np.ndarray  # of word counts, copies and spelling in the mixture, by range of places

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTHING) / (self.tokens + SMOOTHING * (self.distinct + 1)))

    def spelled(self, three: np.ndarray, chance: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of every word of several texts: ``at`` its number among the distinct words whose
        symbols and chances are given, ``ends`` the number of words up to each text's end."""
        vectors = np.concatenate([self.network.vectors(three), self.network.vectors(np.zeros((1, 3), np.int64))])
        n, place, first, own = read_blocks(at, ends, len(three))
        target = np.zeros(n * BLOCK, np.int64)
        target[place] = three[at, 0]
        out = np.empty(n * BLOCK, np.float32)
        for low in range(0, n, SCORE_BLOCKS):
            high = min(n, low + SCORE_BLOCKS)
            out[low * BLOCK:high * BLOCK] = self.network.chances(
                vectors[own[low:high + 1]], first[low:high], target[low * BLOCK:high * BLOCK])
        return out[place] / np.log(10) + chance[at]

    def parts(self, count: np.ndarray, spelled: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probability of every word in each part of the mixture; ``before``: its occurrences so far."""
        return np.stack([count / max(1, self.tokens), before / np.maximum(place, 1), np.power(10.0, spelled)], axis=1)

    def mixed(self, parts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of every word."""
        return np.log10((parts * self.shares[np.searchsorted(PLACES, place, side="right")]).sum(axis=1))

    def fit_shares(self, notes: Notes, rounds: int = 100) -> None:
        """Expectation maximisation of the weights of each range of places, from notes of all words."""
        words, copies, n = notes.cells()
        for _ in range(rounds):
            own = np.stack([words, copies, np.ones_like(words)], axis=-1) * self.shares[:, None, None, :]
            own *= (n / np.maximum(own.sum(axis=-1), 1e-300))[..., None]
            # A little of every part, and never none of the spelling, which alone knows new words.
            total = own.sum(axis=(1, 2)) + (1.0, 0.1, 1.0)
            self.shares = total / total.sum(axis=1, keepdims=True)


class Notes:
    """Numbers of words by range of places and by the chances of the other parts of the mixture against the spelling's,
    as logarithms in steps of an eighth: all that its weights depend on."""

    STEP, LEAST, CELLS = 0.125, -5.0, 122  # ratios from 1e-5 to 1e10, and none

    def __init__(self) -> None:
        self.n = np.zeros((len(PLACES) + 1, self.CELLS, self.CELLS), np.int64)

    def add(self, parts: np.ndarray, place: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            ratio = np.log10(parts[:, :2]) - np.log10(np.maximum(parts[:, 2:], 1e-300))
        cell = np.clip((ratio - self.LEAST) / self.STEP, -1, self.CELLS - 2).astype(np.int64) + 1
        cell[~(ratio > self.LEAST)] = 0
        kind = np.searchsorted(PLACES, place, side="right")
        self.n += np.bincount((kind * self.CELLS + cell[:, 0]) * self.CELLS + cell[:, 1], minlength=self.n.size).reshape(self.n.shape)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ratios of words' shares and of copies, and numbers of words, of all cells."""
        value = np.concatenate(([0.0], 10 ** (self.LEAST + self.STEP * (np.arange(self.CELLS - 1) + 0.5))))
        return (np.broadcast_to(value[None, :, None], self.n.shape), np.broadcast_to(value[None, None, :], self.n.shape), self.n)


def read_blocks(at: np.ndarray, ends: np.ndarray, nothing: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts of words given by number: how many, place of every word, which begin a text, and the word read at
    each place, the one before; before the first one an end (``nothing``).  One block to read from goes before them."""
    n, place, first = blocks_of(np.diff(np.concatenate(([0], ends))))
    read = np.empty(len(at), np.int32)
    read[1:] = at[:-1]
    read[np.concatenate(([0], ends[:-1]))] = nothing
    own = np.full((n + 1) * BLOCK, nothing, np.int32)
    own[place + BLOCK] = read
    return n, place, first, own.reshape(n + 1, BLOCK)


def occurrences(word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in its text, earlier occurrences there and all occurrences there of every word given by index."""
    sizes = np.diff(np.concatenate(([0], ends)))
    text = np.repeat(np.arange(len(ends)), sizes)
    place = ragged_ranges(np.zeros(len(ends), np.int64), sizes)
    key = text * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")  # places stay in order
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(head, len(order)))
    before, again = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    before[order] = ragged_ranges(np.zeros(len(head), np.int64), times)
    again[order] = np.repeat(times, times)
    return place, before, again


def sample(training: DataFrame, size: int = SAMPLE, longest: int = LONGEST) -> list[bytes]:
    """A bounded, repeatable choice of training texts; copies count once."""
    rows = training.where(F.octet_length("text") <= longest).select("text", F.xxhash64("text").alias("h"))
    keys = smallest(rows.select("h"), size)
    found = rows.where(F.col("h").isin(keys)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    return [r["text"].encode() for r in found]


def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words and the end, number of every word (an end after each text), number of words up to each end."""
    words, sizes = words_in(column)
    found = words.dictionary_encode()
    ends = np.cumsum(sizes + 1)
    at = np.full(len(words) + len(sizes), len(found.dictionary), np.int32)
    inner = np.ones(len(at), bool)
    inner[ends - 1] = False
    at[inner] = found.indices.to_numpy()
    return pa.concat_arrays([found.dictionary, pa.array([END], pa.binary())]), at, ends


def portions(rows: pa.RecordBatch | pa.Table, stops: np.ndarray) -> Iterator[tuple]:
    """Rows of about ``SLICE_BYTES`` of texts, the number of their words up to each end, and where these lie among all words."""
    row = low = 0
    for part in slices_of(rows, SLICE_BYTES):
        ends = stops[row:row + part.num_rows] - low
        yield part, ends, slice(low, low + int(ends[-1]))
        row, low = row + part.num_rows, low + int(ends[-1])


def streams(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    distinct, at, ends = coded(pa.array(texts, pa.binary()))
    return distinct.to_pylist(), at, ends


def counts_of(words: pa.Array, table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Count of every word in a table of words and counts, -1 for others."""
    found = pc.index_in(words, value_set=_whole(table.column("word")))
    n = np.append(_whole(table.column("n")).to_numpy(), -1)
    return n[pc.fill_null(found, -1).to_numpy()].astype(np.int64)


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[pa.Table, float]:
    """The most frequent words with their counts, and what another occurrence of the rest has on average besides itself."""
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(
        F.count("*").alias("c"), F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("others")).orderBy(F.desc("step")).collect()  # 16 a doubling
    lowest, held, n, others = 2**31 - 1, 0, 0.0, 0.0
    for row in sizes:
        held += row["c"]
        if held <= most:
            lowest = row["step"]
        else:
            n, others = n + row["n"], others + row["others"]
    rows = counts.where(step >= lowest).collect()
    table = pa.table({"word": pa.array([bytes(r["word"]) for r in rows], pa.binary()), "n": pa.array([r["n"] for r in rows], pa.int64())})
    return table, others / max(1.0, n)


def fit(training: DataFrame, counts: DataFrame, path: str, size: int = SAMPLE) -> Model:
    """Symbols, continuations, network and mixture from all training words; ``size``: texts the network begins with."""
    counts = _numbered(counts, path)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    first = begins(path)
    used = _summed(counts, len(first), lambda ids, sizes: (ids, np.repeat(np.arange(len(sizes)), sizes)))
    spelling = Spelling.of(used, first)
    spelling.learn(_summed(counts, spelling.pair_keys(), spelling.pairs))
    network = Attention.new(1 + spelling.fronts + spelling.backs, 1 + spelling.fronts)
    model = Model(network, spelling, int(totals["n"]), int(totals["v"]), np.tile([0.8, 0.1, 0.1], (len(PLACES) + 1, 1)))
    texts = sample(training, size)
    if texts:
        words, at, ends = streams(texts)
        learn(model, spelling.words(*Subwords(path).of(words))[0], at, ends)
    learn_all(training, model, path, *frequent_words(counts))
    return model


def learn_all(training: DataFrame, model: Model, path: str, frequent: pa.Table, rest: float) -> None:
    """The network goes over every training text, in as many copies as there are tasks, whose mean it becomes; then the
    mixture's weights."""
    shape = Notes().n.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, notes, n = Subwords(path), Notes(), 0
        own = Model(Attention(model.network.flat.copy(), model.network.shapes), model.spelling, model.tokens, model.distinct, model.shares)
        learner = Learner(own.network)
        for batch in batches:
            for part in slices_of(batch, CHUNK_BYTES):
                words, every, stops = coded(part.column("text"))
                three, chance = own.spelling.words(*subwords.of(words.to_numpy(zero_copy_only=False).tolist()))
                found, counted = _learned(learner, three, every, stops), counts_of(words, frequent)
                for _, ends, inner in portions(part, stops):
                    at = every[inner]
                    place, before, again = occurrences(at, ends)
                    count = np.where(counted[at] < 0, rest, np.maximum(counted[at] - again, 0))
                    notes.add(own.parts(count, found[inner] / np.log(10) + chance[at], place, before), place)
                n += len(every)
                del words, every, stops, three, chance, found, counted, at, place, before, again, count
        if n:
            yield sums(TaskContext.get().partitionId() % 16, n, own.network.flat * np.float64(n), notes.n)
        pa.default_memory_pool().release_unused()

    def sums(slot: int, n: int, flat: np.ndarray, noted: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([noted.tobytes()], pa.binary())],
            names=["slot", "n", "flat", "notes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat, noted = 0, 0.0, np.zeros(shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                n += row["n"]
                flat = flat + np.frombuffer(row["flat"])
                noted += np.frombuffer(row["notes"], np.int64).reshape(shape)
        if n:
            yield sums(0, n, flat, noted)

    schema = "slot int, n bigint, flat binary, notes binary"
    found = training.select("text").mapInArrow(run, schema).repartition("slot").mapInArrow(add, schema).collect()  # 16 rows at most
    if found:
        model.network.flat = (sum(np.frombuffer(r["flat"]) for r in found) / sum(r["n"] for r in found)).astype(np.float32)
        notes = Notes()
        notes.n = sum(np.frombuffer(r["notes"], np.int64).reshape(shape) for r in found)
        model.fit_shares(notes)


def _learned(learner: Learner, three: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance of every word's first symbol, each before the network learns from it."""
    n, place, first, own = read_blocks(at, ends, len(three))
    symbols = np.concatenate([three, np.zeros((1, 3), np.int64)])
    target = np.full(n * BLOCK, -1, np.int32)
    target[place] = three[at, 0]
    target = target.reshape(n, BLOCK)
    found = np.empty(n * BLOCK, np.float32)
    low = 0
    while low < n:
        high = min(n, low + min(LEARN_BLOCKS, LEAST_BLOCKS + 2 * learner.steps))
        rate = 0.2 * RATE * min(1.0, (learner.steps + 1) / 20) / (1 + learner.steps / 500) ** 0.5
        found[low * BLOCK:high * BLOCK][target[low:high].ravel() >= 0] = learner.step(
            symbols[own[low:high + 1]], first[low:high], target[low:high], rate)
        low = high
    return found[place]


def learn(model: Model, three: np.ndarray, at: np.ndarray, ends: np.ndarray, steps: int = STEPS) -> list[float]:
    """Train the network on texts of words given by number."""
    n, place, first, own = read_blocks(at, ends, len(three))
    target = np.full(n * BLOCK, -1, np.int64)
    target[place] = three[at, 0]
    model.network.set_prior(np.bincount(three[at, 0], minlength=1 + model.spelling.fronts) + 0.5)
    symbols = np.concatenate([three, np.zeros((1, 3), np.int64)])[own[1:]]
    return model.network.train(symbols, first, target.reshape(n, BLOCK), steps)


def chunked(source: DataFrame) -> DataFrame:
    """Rows with ``doc_id`` and ``text`` with the number of their chunk, from the bytes of all texts; those of
    texts too long for a chunk are negative."""
    size = F.octet_length("text").cast("bigint")
    total = source.agg(F.coalesce(F.sum(F.when(size <= CHUNK_BYTES, size)), F.lit(0)).alias("n")).first()["n"]
    h = F.xxhash64("doc_id", "text")
    short = F.pmod(h, F.lit(total // CHUNK_BYTES + 1).cast("bigint"))
    return source.withColumn("chunk", F.when(size <= CHUNK_BYTES, short).otherwise(F.lit(-1) - F.shiftrightunsigned(h, 1)))


def scores(documents: DataFrame, counts: DataFrame, model: Model, path: str, *carry: Column) -> DataFrame:
    """Per document: tokens, known tokens, base score, and the model's log10 probability of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = chunked(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *carry))
    extra = [c for c in source.columns if c not in ("doc_id", "text", "chunk")]
    dealt = source.repartition("chunk").sortWithinPartitions("chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks = batch.column("chunk").to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1]))).tolist()
            for low, high in zip(bounds, [*bounds[1:], len(chunks)], strict=True):
                if now is not None and (chunks[low] != now or size > MAX_WORDS):
                    yield asked(now, found)
                    found, size = [], 0
                now = int(chunks[low])
                for part in slices_of(batch.slice(low, high - low), SLICE_BYTES):
                    found.append(words_in(part.column("text"))[0].unique())
                    size += len(found[-1])
                if size > MAX_WORDS:
                    found = [pa.concat_arrays(found).unique()]
                    size = len(found[0])
        if now is not None:
            yield asked(now, found)

    def asked(chunk: int, found: list[pa.Array]) -> pa.RecordBatch:
        words = pa.concat_arrays([*found, pa.array([END], pa.binary())]).unique()
        return pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), chunk, np.int64))], names=["word", "chunk"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            three, chance = model.spelling.words(*ids_in(batch.column("ids")))
            three = three @ (1 << 20, 1 << 10, 1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(three), pa.array(chance)],
                                             names=["word", "n", "three", "chance"])

    # All columns, though only two are used, so that the texts are dealt out once for both sides.
    known = _numbered(counts, path).mapInArrow(spell, "word binary, n bigint, three bigint, chance double")
    answers = dealt.mapInArrow(ask, "word binary, chunk bigint").join(known, "word").select(
        "chunk", "word", "n", "three", "chance")
    kinds = dict(source.dtypes)
    schema = ("doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
              + "".join(f", {c} {kinds[c]}" for c in extra))

    def score(own: pa.Table, answer: pa.Table) -> pa.Table:
        if not own.num_rows:
            return None
        words, every, stops = coded(_whole(own.column("text")))
        told, three, chance = answered(words, answer)
        counted, parts = np.maximum(told, 0), []
        for part, ends, inner in portions(own, stops):
            at_word = every[inner]
            count = counted[at_word]
            first = np.concatenate(([0], ends[:-1]))
            place, before, _ = occurrences(at_word, ends)
            parts_of = model.parts(count, model.spelled(three, chance, at_word, ends), place, before)
            mixed = np.add.reduceat(model.mixed(parts_of, place), first)
            parts.append([part.column("doc_id").combine_chunks(), pa.array(ends - first),
                          pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                          pa.array(np.add.reduceat(model.base(count), first)), pa.array(mixed),
                          *(part.column(c).combine_chunks() for c in extra)])
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score", *extra]
        return pa.table([pa.chunked_array(c) for c in zip(*parts, strict=True)], names=names)

    def answered(words: pa.Array, answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, three symbols and chance of every word; those that no training text has are encoded here."""
        at = pc.fill_null(pc.index_in(words, value_set=_whole(answer.column("word"))), -1).to_numpy()
        told, packed, chance = (np.append(_whole(answer.column(c)).to_numpy(), -1)[at] for c in ("n", "three", "chance"))
        three = packed[:, None] >> np.array([20, 10, 0]) & 1023
        new = np.flatnonzero(at < 0)
        if len(new):
            three[new], chance[new] = model.spelling.words(*Subwords(path).of(words.take(pa.array(new)).to_pylist()))
        return told, three, chance

    def run(key: tuple, own: pa.Table, answer: pa.Table) -> pa.Table:
        found = score(own, answer)
        return found if found is not None else pa.Table.from_batches([], schema=_schema(own, extra))

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _schema(own: pa.Table, extra: list[str]) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("base_score", pa.float64()), ("score", pa.float64())]
    return pa.schema([*fields, *((c, own.schema.field(c).type) for c in extra)])


def score_documents(documents: DataFrame, training: Column, path: str, *carry: Column) -> DataFrame:
    """Learn from the rows where ``training`` holds and score all rows."""
    own = documents.where(training)
    counts = materialize(numbered(token_counts(own), path), "token-counts")
    model = fit(own, counts, path)
    return scores(documents, counts, model, path, *carry).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
