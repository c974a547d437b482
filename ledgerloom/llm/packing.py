"""Vector bin packing of tokenised examples under simultaneous limits.

A bin (training sequence) is limited in tokens, in segments (pieces of examples) and in tokens that
bear loss.  Each example has a demand in all three.  Bins are filled one after the other: of the
examples in a bounded pool that still fit, the one with the largest dot product of its demand and
the bin's remaining room, both as shares of the limits, goes in.  With ``cut`` an example may be split:
what is as long as a whole bin fills bins of its own, and when nothing fits any more the bin is
topped up with the front of a pooled example.  The last, partly filled bin of a task is then dealt
out into bins whose lengths are powers of two, which need no padding.

Every task packs the examples of its own partition in one pass over bounded pools, without a shuffle;
only its last bin can be short.  Bin ids are the partition number and a counter, so a task that runs
again gives the same ids for the same input.

Empty examples (no tokens) take no place and get no piece.  Null texts are empty texts.  Repeated
rows are packed as often as they come.  An example that exceeds a limit and may not be cut gets a bin
of its own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import texts_of
from ledgerloom.llm.tokens import ByteTokens

BIN = 1024
MAX_SEGMENTS = 64
MAX_LOSS = 1024
POOL = 2048
END_ID = 0

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, loss_tokens bigint, segments int, sequence_length int, "
          "ids binary")


@dataclass
class Limits:
    tokens: int = BIN
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS
    cut: bool = True


@dataclass
class Example:
    """``ids`` little-endian uint32; ``loss`` one flag per id."""
    key: int | None
    ids: bytes
    loss: np.ndarray
    start: int = 0
    total: int = 0
    loss_tokens: int = -1

    def __post_init__(self) -> None:
        self.total = self.total or len(self.loss)
        if self.loss_tokens < 0:
            self.loss_tokens = int(np.count_nonzero(self.loss))

    def __len__(self) -> int:
        return len(self.loss)

    def split(self, at: int) -> tuple[Example, Example]:
        front = Example(self.key, self.ids[:4 * at], self.loss[:at], self.start, self.total)
        return front, Example(self.key, self.ids[4 * at:], self.loss[at:], self.start + at, self.total,
                              self.loss_tokens - front.loss_tokens)


@dataclass
class Packer:
    """Takes examples, gives full bins; ``finish`` gives the rest.

    The pool is kept by falling length, so the examples that fit a bin's tokens are its end, and their
    dot products can only fall along it but for the loss: a search stops where even an example that bears
    loss in all its tokens would score less than the best one so far.
    """
    limits: Limits
    pool_size: int = POOL
    pool: list[tuple[int, int, Example]] = field(default_factory=list)
    _added: int = 0

    def add(self, example: Example) -> Iterator[list[Example]]:
        if self.limits.cut:
            while len(example) >= self.limits.tokens:
                room = self._fits(example, self.limits.tokens, self.limits.loss)
                if room < self.limits.tokens:
                    break
                whole, example = example.split(room)
                yield [whole]
        if len(example):
            self._put(example)
        if len(self.pool) >= self.pool_size:
            yield from self._pack(self.pool_size // 8)

    def finish(self) -> Iterator[list[Example]]:
        yield from self._pack(0)

    def _put(self, example: Example) -> None:
        self._added += 1
        insort(self.pool, (-len(example), self._added, example))

    def _fits(self, example: Example, tokens: int, loss: int) -> int:
        """Longest front of an example within so many tokens and loss-bearing tokens."""
        longest = min(tokens, len(example))
        if longest <= loss:
            return longest
        return int(np.searchsorted(np.cumsum(example.loss[:tokens]), loss, side="right"))

    def _best(self, tokens: int, loss: int) -> int | None:
        """Place in the pool of the example that fits and has the largest dot product, the longest and then
        the earliest of equal ones.  An example is one segment, so that part is the same for all."""
        by_token = tokens * max(self.limits.loss, 1) ** 2
        by_loss = loss * max(self.limits.tokens, 1) ** 2
        best, most = None, -1
        for at in range(bisect_left(self.pool, (-tokens,)), len(self.pool)):
            size, _, example = self.pool[at]
            if by_token * -size + by_loss * min(-size, loss) <= most:
                break
            score = by_token * -size + by_loss * example.loss_tokens
            if example.loss_tokens <= loss and score > most:
                best, most = at, score
        return best

    def _pack(self, leave: int) -> Iterator[list[Example]]:
        limits, pool = self.limits, self.pool
        while len(pool) > leave:
            tokens, segments, loss = limits.tokens, limits.segments, limits.loss
            own: list[Example] = []
            while segments and (at := self._best(tokens, loss)) is not None:
                example = pool.pop(at)[2]
                own.append(example)
                tokens, segments, loss = tokens - len(example), segments - 1, loss - example.loss_tokens
            if limits.cut and tokens and segments and loss and pool:
                example = pool[0][2]
                fit = self._fits(example, tokens, loss)
                if fit:
                    front, rest = example.split(fit)
                    del pool[0]
                    own.append(front)
                    if len(rest):
                        self._put(rest)
            elif not own:  # larger than a bin and not to be cut
                own = [pool.pop(0)[2]]
            yield own


def power_of_two_bins(bin_: list[Example]) -> Iterator[list[Example]]:
    """A short bin as bins whose lengths are the powers of two that add up to its length."""
    total = sum(len(e) for e in bin_)
    queue = list(bin_)
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        own = []
        while size:
            example = queue.pop(0)
            if len(example) > size:
                example, rest = example.split(size)
                queue.insert(0, rest)
            own.append(example)
            size -= len(example)
        yield own


def pack(examples: Iterator[Example], limits: Limits, pool: int = POOL) -> Iterator[list[Example]]:
    """Bins of one stream of examples."""
    packer = Packer(limits, pool)
    for example in examples:
        yield from packer.add(example)
    for bin_ in packer.finish():
        if limits.cut and sum(len(e) for e in bin_) < limits.tokens:
            yield from power_of_two_bins(bin_)
        else:
            yield bin_


def _rows(bins: Iterator[list[Example]], partition: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for number, bin_ in enumerate(bins):
        sequence, offset = (partition << 40) + number, 0
        size = sum(len(e) for e in bin_)
        for e in bin_:
            rows.append((e.key, e.start, len(e), zlib.crc32(e.ids), e.total, sequence, offset,
                         e.loss_tokens, len(bin_), size, e.ids if with_ids else None))
            offset += len(e)
        if len(rows) >= 5000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.int32()] * 2 + [pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack_documents(documents: DataFrame, tokenizer: str, limits: Limits | None = None,
                   pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; every id of a document bears loss but its closing one."""
    chosen = limits or Limits()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        tokens = ByteTokens.shared(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, ids in zip(part.column("doc_id").to_pylist(),
                                    tokens.encode(texts_of(part.column("text"))), strict=True):
                    loss = np.ones(len(ids) // 4 + 1, bool)
                    loss[-1] = False
                    yield Example(key, ids + end, loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = pack(examples(batches), chosen, pool)
        yield from _rows(bins, TaskContext.get().partitionId(), with_ids)
        # The worker waits for its next task beside steps that need the memory.
        pa.default_memory_pool().release_unused()

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    packed = source.mapInArrow(run, PIECES)
    return packed if with_ids else packed.drop("ids")


def pack_tokens(examples: DataFrame, limits: Limits, pool: int = POOL) -> DataFrame:
    """Pack rows of ``doc_id``, ``ids`` (array of int) and ``loss`` (array of boolean), as instruction
    data has them.  A null list is empty; a shorter loss list is filled up with false."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"] or [], "<u4")
                loss = np.zeros(len(ids), bool)
                given = np.array([bool(x) for x in row["loss"] or []][:len(ids)], bool)
                loss[:len(given)] = given
                yield Example(row["doc_id"], ids.tobytes(), loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(pack(read(batches), limits, pool), TaskContext.get().partitionId(), True)

    source = examples.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids", "loss")
    return source.mapInArrow(run, PIECES)
