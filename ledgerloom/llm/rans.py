"""Static range asymmetric numeral system over token ids, many interleaved lanes at once.

A block holds ``n`` ids as ``lanes`` independent streams: id ``i`` belongs to lane ``i % lanes``.  Every
lane has a 64-bit state; a step codes one id of each lane, and lanes whose state would overflow give
32 bits to the shared word stream in lane order.  All blocks share one frequency table, whose sum is
a power of two.  Every ``CHECKPOINT`` steps the lane states and the place in the word stream are
kept, with a checksum of the words in between, so that parts of a block can be decoded apart.

Layout, little-endian: magic ``LLRA``, version, lanes, ids, steps between checkpoints, number of
checkpoints, number of words, crc32 of the frequency table, crc32 of the ids (u32 each); per checkpoint
first word and crc32 of its words (u32 each); the states of each checkpoint (u64); the words (u32).
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

MAGIC = b"LLRA"
VERSION = 1
LANES = 1024
CHECKPOINT = 128
SCALE_BITS = 18
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s8I")


class Corrupt(ValueError):
    """A block whose checksums or layout don't hold."""


@dataclass(frozen=True)
class Frequencies:
    """Share of each id among ``2 ** SCALE_BITS``; 0 for ids that never occur."""
    shares: bytes

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Frequencies:
        """Shares in proportion to the counts, at least 1 for every id that occurs."""
        counts = np.asarray(counts, np.float64)
        total, whole = counts.sum(), 1 << SCALE_BITS
        if not total:
            return cls(np.zeros(len(counts), "<u4").tobytes())
        if (counts > 0).sum() > whole:
            raise ValueError("more ids than shares")
        shares = np.where(counts > 0, np.maximum(1, np.floor(counts * whole / total)), 0).astype(np.int64)
        excess = int(shares.sum()) - whole
        order = np.argsort(-shares, kind="stable")
        while excess > 0:  # taken from the largest, which lose least
            for i in order:
                if not excess:
                    break
                take = min(excess, int(shares[i]) - 1, max(1, int(shares[i]) >> 6))
                shares[i] -= take
                excess -= take
        shares[order[0]] -= excess
        return cls(shares.astype("<u4").tobytes())

    @cached_property
    def share(self) -> np.ndarray:
        return np.frombuffer(self.shares, "<u4").astype(np.uint64)

    @cached_property
    def first(self) -> np.ndarray:
        return np.cumsum(self.share) - self.share

    @cached_property
    def of_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.share), dtype=np.uint32), self.share.astype(np.int64))

    @cached_property
    def crc(self) -> int:
        return zlib.crc32(self.shares)


def encode(ids: np.ndarray, table: Frequencies, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """A block of the given ids, each of which must have a share."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    if n and not (int(ids.max()) < len(table.share) and table.share[ids].all()):
        raise ValueError("an id without a share")
    share, first = table.share[ids], table.first[ids]
    limit = share << np.uint64(63 - SCALE_BITS)
    state = np.full(lanes, _LOW, np.uint64)
    given: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    states: dict[int, np.ndarray] = {}
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[:b - a], share[a:b]
        full = x >= limit[a:b]
        given[step] = x[full].astype(np.uint32)  # the low half
        x = np.where(full, x >> half, x)
        quotient = x // f
        state[:b - a] = (quotient << bits) + (x - quotient * f) + first[a:b]
        if step % every == 0:
            states[step] = state.copy()
    marks = sorted(states)
    places = np.concatenate(([0], np.cumsum([len(w) for w in given]))).astype(np.int64)
    words = np.concatenate(given).astype("<u4") if given else np.zeros(0, "<u4")
    starts = [int(places[m]) for m in marks]
    parts = [words[s:e] for s, e in zip(starts, [*starts, len(words)][1:], strict=True)]
    index = np.array([(s, zlib.crc32(p.tobytes())) for s, p in zip(starts, parts, strict=True)], "<u4").reshape(-1, 2)
    head = _HEAD.pack(MAGIC, VERSION, lanes, n, every, len(marks), len(words), table.crc,
                      zlib.crc32(ids.astype("<u4").tobytes()))
    return b"".join([head, index.tobytes(), *(states[m].astype("<u8").tobytes() for m in marks),
                     words.tobytes()])


def _open(block: bytes, table: Frequencies):
    if len(block) < _HEAD.size:
        raise Corrupt("shorter than its head")
    magic, version, lanes, n, every, marks, words, table_crc, crc = _HEAD.unpack_from(block)
    if (magic, version) != (MAGIC, VERSION) or table_crc != table.crc:
        raise Corrupt("another format or frequency table")
    if len(block) != _HEAD.size + marks * (8 + 8 * lanes) + 4 * words:
        raise Corrupt("wrong length")
    at = _HEAD.size
    index = np.frombuffer(block, "<u4", 2 * marks, at).reshape(marks, 2)
    states = np.frombuffer(block, "<u8", marks * lanes, at + 8 * marks).reshape(marks, lanes)
    stream = np.frombuffer(block, "<u4", words, at + marks * (8 + 8 * lanes))
    return lanes, n, every, index, states, stream, crc


def checkpoints(block: bytes, table: Frequencies) -> int:
    """Number of parts that can be decoded apart."""
    return len(_open(block, table)[3])


def decode_part(block: bytes, table: Frequencies, part: int) -> np.ndarray:
    """Ids between one checkpoint and the next; raises ``Corrupt`` if the words have changed."""
    lanes, n, every, index, states, stream, _ = _open(block, table)
    first = int(index[part, 0])
    words = stream[first:int(index[part + 1, 0]) if part + 1 < len(index) else None]
    if zlib.crc32(words.tobytes()) != int(index[part, 1]):
        raise Corrupt("words changed")
    begin, end = part * every * lanes, min(n, (part + 1) * every * lanes)
    out = np.empty(end - begin, np.uint32)
    state, at = states[part].astype(np.uint64), 0
    share, low, of_slot = table.share, table.first, table.of_slot
    bits, mask, half = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    for a in range(0, end - begin, lanes):
        b = min(end - begin, a + lanes)
        x = state[:b - a]
        slot = x & mask
        ids = of_slot[slot]
        out[a:b] = ids
        x = share[ids] * (x >> bits) + slot - low[ids]
        short = np.flatnonzero(x < _LOW)
        if at + len(short) > len(words):
            raise Corrupt("words missing")
        x[short] = (x[short] << half) | words[at:at + len(short)].astype(np.uint64)
        at += len(short)
        state[:b - a] = x
    return out


def decode(block: bytes, table: Frequencies) -> np.ndarray:
    """All ids of a block, checked."""
    parts = [decode_part(block, table, k) for k in range(checkpoints(block, table))]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != _open(block, table)[6]:
        raise Corrupt("ids changed")
    return ids
