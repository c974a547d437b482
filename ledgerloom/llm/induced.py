"""External induced suffix sorting with common-prefix values.

The suffixes of a text are sorted as in induced sorting: suffixes smaller than the one after them (S) or
larger (L); those S suffixes that follow an L suffix (S*) cut the text into substrings.  Sorting these
substrings by induction gives each a name, the names in text order are a text of at most half the
length, and its suffix order (by recursion) is the order of the S* suffixes, from which one scan up
induces all L and one scan down all S suffixes.

Both scans take suffix tuples (first character, rank of the suffix they were induced from, position, common
prefix with the tuple before) out of a disk-backed priority queue and put the tuples of the suffixes one
position before into it.  The queue is a list of runs sorted by character; within a character tuples keep
the order in which they came, which is that of their source's rank.  Runs beyond ``memory`` tuples are written
to the working folder and read back slice by slice.  Results of the scans are written there too, so
memory holds the text's memory map, one character's tuples in chunks, and the queue's buffer.

The common prefix of two neighbours induced from sources i < j is one more than the smallest common prefix
between neighbours from i to j; it is carried along with the scan.  All values are cut at ``limit``, and
suffixes that agree on ``limit`` characters may come in any order.  A reduced text of at most ``memory``
names is sorted in memory by doubling prefixes; its common prefixes in names become those in characters.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 4_000_000
CHUNK = 1 << 18
#: Rows of a scan's result kept in memory before they are written.
HELD = 400_000
#: Alphabets above this size (reduced texts) get their common prefixes by comparing neighbours.
SMALL_ALPHABET = 4096
_NEVER = -1
_FAR = np.int32(2**30)


class Spool:
    """Rows of equally long integer columns, appended and read back in slices; on disk beyond ``HELD`` rows."""

    def __init__(self, folder: str, columns: int) -> None:
        self.folder, self.columns, self.rows = folder, columns, 0
        self.parts: list[np.ndarray] = []
        self.held, self.written, self.file = 0, 0, None

    def append(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(np.ascontiguousarray(np.stack(columns, axis=1), np.int64))
            self.rows += len(columns[0])
            self.held += len(columns[0])
            if self.held > HELD:
                self.flush()

    def flush(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, os.SEEK_END)
        for part in self.parts:
            self.file.write(part.tobytes())
        self.parts, self.held, self.written = [], 0, self.rows

    def read(self, start: int, stop: int) -> list[np.ndarray]:
        width, found = 8 * self.columns, []
        if start < min(stop, self.written):
            self.file.seek(start * width)
            raw = self.file.read((min(stop, self.written) - start) * width)
            found.append(np.frombuffer(raw, np.int64).reshape(-1, self.columns))
        if stop > self.written and stop > start:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            found.append(self.parts[0][max(0, start - self.written):stop - self.written])
        if not found:
            return [np.zeros(0, np.int64)] * self.columns
        return list((found[0] if len(found) == 1 else np.concatenate(found)).T)

    def close(self) -> None:
        self.parts = []
        if self.file is not None:
            self.file.close()


class Run:
    """Tuples sorted by character, in memory or in a file, taken from the front."""

    def __init__(self, columns: list[np.ndarray], taken: int = 0) -> None:
        self.char, self.rest, self.spool, self.taken = columns[0], columns[1:], None, taken

    def spill(self, folder: str) -> None:
        if self.spool is None:
            self.spool = Spool(folder, len(self.rest))
            self.spool.append(*self.rest)
            self.spool.flush()
            self.rest = []

    def slice(self, start: int, stop: int) -> list[np.ndarray]:
        return self.spool.read(start, stop) if self.spool else [c[start:stop] for c in self.rest]

    def left(self) -> list[np.ndarray]:
        start, self.taken = self.taken, len(self.char)
        return [self.char[start:], *self.slice(start, len(self.char))]


class Queue:
    """Disk-backed priority queue of tuples (character, position, source, prefix).

    Taken by character, ascending or descending; tuples of a character in the order they were put in.
    """

    def __init__(self, folder: str, memory: int, descending: bool) -> None:
        self.folder, self.memory, self.sign = folder, memory, -1 if descending else 1
        self.runs: list[Run] = []

    def put(self, char: np.ndarray, position: np.ndarray, source: np.ndarray, prefix: np.ndarray) -> None:
        if not len(char):
            return
        order = np.argsort(self.sign * char, kind="stable")
        self.runs.append(Run([c[order] for c in (self.sign * char, position, source, prefix)]))
        if len(self.runs) > 48:
            self._merge()
        held = sum(len(r.char) - r.taken for r in self.runs if r.spool is None)
        if held > self.memory:
            for run in self.runs:
                run.spill(self.folder)

    def _merge(self) -> None:
        """The runs in memory, which are the latest, become one."""
        at = max((i + 1 for i, r in enumerate(self.runs) if r.spool is not None), default=0)
        parts = [r.left() for r in self.runs[at:]]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        self.runs = [r for r in self.runs[:at] if r.taken < len(r.char)] + [Run([c[order] for c in columns])]

    def next(self) -> int | None:
        """The character whose turn it is."""
        chars = [int(r.char[r.taken]) for r in self.runs if r.taken < len(r.char)]
        return self.sign * min(chars) if chars else None

    def take(self, char: int) -> Iterator[list[np.ndarray]]:
        """Position, source and prefix of a character's tuples, in chunks.

        They are taken out at once and read as they are asked for, so others may be put in meanwhile.
        """
        slices = []
        for run in self.runs:
            stop = int(np.searchsorted(run.char, self.sign * char, side="right"))
            if run.taken < stop:
                slices.append((run, run.taken, stop))
                run.taken = stop
        self.runs = [r for r in self.runs if r.taken < len(r.char)]
        return self._read(slices)

    @staticmethod
    def _read(slices: list[tuple[Run, int, int]]) -> Iterator[list[np.ndarray]]:
        for run, start, stop in slices:
            for begin in range(start, stop, CHUNK):
                yield run.slice(begin, min(stop, begin + CHUNK))
            if stop == len(run.char) and run.spool:
                run.spool.close()


def _minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest of values[first..last] for every pair, by tables of minima over powers of two."""
    span = (last - first + 1).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int32)
    row = values.astype(np.int32)
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        if len(row) > 1 << k:
            row = np.minimum(row[:-(1 << k)], row[1 << k:])
    return out


class Prefixes:
    """Common prefixes of induced neighbours, from those between the scanned suffixes."""

    def __init__(self, alphabet: int, limit: int) -> None:
        self.limit, self.since = limit, np.full(alphabet, _NEVER, np.int32)

    def scan(self, between: np.ndarray, target: np.ndarray) -> np.ndarray:
        """``between``: of each scanned suffix with the one before; ``target``: character of the suffix it
        induces, or -1.  Gives the prefix of each induced one with the one before it of its character."""
        out = np.zeros(len(target), np.int32)
        at = np.flatnonzero(target >= 0)
        if len(at):
            order = at[np.argsort(target[at], kind="stable")]
            char = target[order]
            new = np.concatenate(([True], char[1:] != char[:-1]))
            first = np.where(new, 0, np.concatenate(([0], order[:-1] + 1)))
            least = _minima(between, first, order)
            before = self.since[char]
            value = np.where(new, np.where(before == _NEVER, 0, np.minimum(before, least) + 1), least + 1)
            out[order] = np.minimum(value, self.limit)
        seen = self.since != _NEVER
        if len(between):
            self.since[seen] = np.minimum(self.since[seen], between.min())
        if len(at):
            last = order[np.concatenate((new[1:], [True]))]
            ends = np.minimum(last + 1, len(between) - 1)
            tail = _minima(between, ends, np.full(len(last), len(between) - 1))
            self.since[target[last]] = np.where(last + 1 < len(between), tail, _FAR)
        return out


def _run_length(text: np.ndarray, at: int, limit: int) -> int:
    own = np.asarray(text[at:at + limit])
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; block by block from the right."""
    n = len(text)
    out = np.empty(n, bool)
    out[n - 1] = True
    stop = n - 1
    while stop > 0:
        start = max(0, stop - CHUNK)
        own, after = np.asarray(text[start:stop]), np.asarray(text[start + 1:stop + 1])
        end = np.flatnonzero(own != after)  # where the next character differs the type is known
        own_type = own[end] < after[end]
        run = np.searchsorted(end, np.arange(stop - start))
        known = np.concatenate((own_type, [out[stop]]))
        out[start:stop] = known[run]
        stop = start
    return out


class Induced:
    """One level: the scans over a text whose last character is its only smallest."""

    def __init__(self, text: np.ndarray, folder: str, memory: int, limit: int, carry: bool) -> None:
        self.text, self.folder, self.memory, self.limit = text, folder, memory, limit
        self.alphabet = int(text.max()) + 1 if len(text) else 1
        self.carry = carry and self.alphabet <= SMALL_ALPHABET
        self.large, self.small = Spool(folder, 3), Spool(folder, 3)
        self.large_at: dict[int, tuple[int, int]] = {}
        self.small_at: dict[int, tuple[int, int]] = {}

    def _before(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position before and its character, -1 at the start of the text."""
        before = position - 1
        char = np.where(before >= 0, np.asarray(self.text[np.maximum(before, 0)]).astype(np.int64), -1)
        return before, char

    def up(self, position: np.ndarray, name: np.ndarray, prefix: np.ndarray) -> None:
        """Scan up from sorted S* suffixes: all L suffixes, with names and common prefixes."""
        queue = Queue(self.folder, self.memory, False)
        prefixes = Prefixes(self.alphabet, self.limit) if self.carry else None
        first = np.asarray(self.text[position]).astype(np.int64)
        names, at = 0, 0
        while True:
            waiting = queue.next()
            seed = int(first[at]) if at < len(first) else None
            if waiting is None and seed is None:
                break
            char = min(c for c in (waiting, seed) if c is not None)
            start, last_source, last_position = self.large.rows, None, -1
            batches: Iterator[list[np.ndarray]] | list = queue.take(char)
            while True:
                same: list[list[np.ndarray]] = []
                for own, source, common in batches:
                    change = np.concatenate(([last_source is None or source[0] != last_source], source[1:] != source[:-1]))
                    own_name = names + np.cumsum(change)
                    names, last_source, last_position = int(own_name[-1]), source[-1], int(own[-1])
                    self.large.append(own, own_name, common)
                    before, target = self._before(own)
                    target = np.where(target >= char, target, -1)
                    value = prefixes.scan(common, target) if prefixes else np.zeros(len(own), np.int64)
                    far = target > char
                    queue.put(target[far], before[far], own_name[far], value[far].astype(np.int64))
                    near = target == char
                    if near.any():
                        same.append([before[near], own_name[near], value[near].astype(np.int64)])
                if not same:
                    break
                batches, last_source = same, None
            if self.large.rows > start:
                self.large_at[char] = (start, self.large.rows)
            stop = int(np.searchsorted(first, char, side="right"))
            while at < stop:
                end = min(stop, at + CHUNK)
                own, source, common = position[at:end], name[at:end], prefix[at:end].copy()
                if at == 0 or first[at - 1] != char:
                    common[0] = self._border(last_position, int(own[0])) if last_position >= 0 else 0
                change = np.concatenate(([at == 0 or source[0] != name[at - 1]], source[1:] != source[:-1]))
                own_name = names + np.cumsum(change)
                names = int(own_name[-1])
                before, target = self._before(own)
                target = np.where(target > char, target, -1)
                value = prefixes.scan(common, target) if prefixes else np.zeros(len(own), np.int64)
                kept = target >= 0
                queue.put(target[kept], before[kept], own_name[kept], value[kept].astype(np.int64))
                at = end

    def _border(self, large: int, small: int) -> int:
        """Common prefix of an L and an S suffix that start with the same character."""
        return min(_run_length(self.text, large, self.limit), _run_length(self.text, small, self.limit))

    def down(self) -> None:
        """Scan down over the L suffixes: all S suffixes but the last character's."""
        queue = Queue(self.folder, self.memory, True)
        prefixes = Prefixes(self.alphabet, self.limit) if self.carry else None
        chars = sorted(self.large_at)
        names = 0
        while True:
            waiting = queue.next()
            if waiting is None and not chars:
                break
            char = max(c for c in (waiting, chars[-1] if chars else None) if c is not None)
            start, last_source, last_position = self.small.rows, None, -1
            batches: Iterator[list[np.ndarray]] | list = queue.take(char)
            while True:
                same: list[list[np.ndarray]] = []
                for own, source, common in batches:
                    change = np.concatenate(([last_source is None or source[0] != last_source], source[1:] != source[:-1]))
                    own_name = names + np.cumsum(change)
                    names, last_source, last_position = int(own_name[-1]), source[-1], int(own[-1])
                    self.small.append(own, own_name, common)
                    before, target = self._before(own)
                    target = np.where((target <= char) & (target >= 0), target, -1)
                    value = prefixes.scan(common, target) if prefixes else np.zeros(len(own), np.int64)
                    far = (target < char) & (target >= 0)
                    queue.put(target[far], before[far], own_name[far], value[far].astype(np.int64))
                    near = target == char
                    if near.any():
                        same.append([before[near], own_name[near], value[near].astype(np.int64)])
                if not same:
                    break
                batches, last_source = same, None
            if self.small.rows > start:
                self.small_at[char] = (start, self.small.rows)
            if chars and chars[-1] == char:
                chars.pop()
                low, high = self.large_at[char]
                above_name, above_common = None, None
                while high > low:
                    begin = max(low, high - CHUNK)
                    own, source, common = (c[::-1] for c in self.large.read(begin, high))
                    between = np.empty(len(own), np.int64)
                    between[1:] = common[:-1]
                    if above_name is None:
                        between[0] = self._border(int(own[0]), last_position) if last_position >= 0 else 0
                    else:
                        between[0] = above_common
                    change = np.concatenate(([above_name is None or source[0] != above_name], source[1:] != source[:-1]))
                    own_name = names + np.cumsum(change)
                    names, above_name, above_common = int(own_name[-1]), source[-1], int(common[-1])
                    before, target = self._before(own)
                    target = np.where((target < char) & (target >= 0), target, -1)
                    value = prefixes.scan(between, target) if prefixes else np.zeros(len(own), np.int64)
                    kept = target >= 0
                    queue.put(target[kept], before[kept], own_name[kept], value[kept].astype(np.int64))
                    high = begin

    def small_up(self, char: int) -> Iterator[list[np.ndarray]]:
        """Position and name of a character's S suffixes, ascending, and prefix with the one below."""
        low, high = self.small_at.get(char, (0, 0))
        while high > low:
            begin = max(low, high - CHUNK)
            own, name, common = self.small.read(begin, high)
            below = np.append(common[1:], self.small.read(high, high + 1)[2] if high < self.small_at[char][1] else [-1])
            yield [own[::-1], -name[::-1], below[::-1]]
            high = begin

    def ordered(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in suffix order with the common prefix of each and the one before."""
        yield np.array([len(self.text) - 1]), np.zeros(1, np.int64)
        for char in sorted(set(self.large_at) | set(self.small_at)):
            low, high = self.large_at.get(char, (0, 0))
            last = -1
            for begin in range(low, high, CHUNK):
                own, _, common = self.large.read(begin, min(high, begin + CHUNK))
                last = int(own[-1])
                yield own, common
            for own, _, common in self.small_up(char):
                if len(common) and common[0] == -1:
                    common = common.copy()
                    common[0] = self._border(last, int(own[0])) if last >= 0 else 0
                yield own, common

    def close(self) -> None:
        self.large.close()
        self.small.close()


def _doubled(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes (in characters of this text) in memory, up to ``limit``."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, length = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank.max() < n - 1 and length < limit:
        after = np.zeros(n, np.int64)
        after[:n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        length *= 2
        levels.append(rank.astype(np.int32))
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((left < n) & (right < n))
        same = inside[levels[level][left[inside]] == levels[level][right[inside]]]
        common[same] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    return order, np.concatenate(([0], common))


def _compared(text: np.ndarray, left: np.ndarray, right: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
    """Common prefix of suffix pairs, character by character, at most ``limit``."""
    out = np.zeros(len(left), np.int64)
    limit = np.broadcast_to(np.asarray(limit), left.shape)
    active = np.flatnonzero(limit > 0)
    n = len(text)
    while len(active):
        a, b = left[active] + out[active], right[active] + out[active]
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = np.asarray(text[a[inside]]) == np.asarray(text[b[inside]])
        active = active[same]
        out[active] += 1
        active = active[out[active] < limit[active]]
    return out


def suffix_order(text: np.ndarray, folder: str, limit: int, memory: int = MEMORY,
                 in_memory: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in order, chunk by chunk: positions, and common prefixes with the suffix before.

    ``text``: integers (an array or a memory map) whose last one is the only smallest.  ``memory``: tuples
    the queue holds before it writes; ``in_memory``: longest reduced text sorted in memory (default ``memory``).
    """
    n, most = len(text), memory if in_memory is None else in_memory
    if n == 0:
        return
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    small = types(text)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_star = np.zeros(n, bool)
    is_star[star] = True
    del small

    # Names of the S* substrings, by inducing from S* suffixes sorted by their first character alone.
    first = np.asarray(text[star]).astype(np.int64)
    seeds = star[np.argsort(first, kind="stable")]
    level = Induced(text, folder, memory, limit, carry=False)
    chars = np.asarray(text[seeds]).astype(np.int64)
    level.up(seeds, chars, np.zeros(len(seeds), np.int64))
    level.down()
    positions, names = [np.array([n - 1])], [np.array([-2**62])]
    for char in sorted(level.small_at):
        for own, name, _ in level.small_up(char):
            kept = is_star[own]
            positions.append(own[kept])
            names.append(name[kept])
    level.close()
    position, name = np.concatenate(positions), np.concatenate(names)
    rank = np.concatenate(([0], np.cumsum(name[1:] != name[:-1])))
    index = np.searchsorted(star, position)
    reduced = np.empty(len(star), np.int64)
    reduced[index] = rank

    # Order and common prefixes of the S* suffixes, from those of the reduced text.
    if rank[-1] + 1 == len(star):
        order, same = index, np.zeros(len(star), np.int64)
    elif len(star) <= most:
        order, same = _doubled(reduced, limit)
    else:
        parts = list(suffix_order(reduced, folder, limit, memory, in_memory))
        order, same = (np.concatenate(c) for c in zip(*parts, strict=True))
    del reduced, index
    sorted_star = star[order]
    ahead = np.minimum(order + same, len(star) - 1)
    equal = star[ahead] - sorted_star
    below = np.concatenate(([0], order[:-1]))
    other = star[np.minimum(below + same, len(star) - 1)]
    room = np.maximum(limit - equal, 0)
    room[0] = 0
    common = np.minimum(equal + _compared(text, star[ahead], other, room), limit)
    common[0] = 0

    level = Induced(text, folder, memory, limit, carry=True)
    level.up(sorted_star, np.arange(len(sorted_star)), common)
    level.down()
    if level.carry:
        yield from level.ordered()
    else:
        last = None
        for own, _ in level.ordered():
            before = np.concatenate(([own[0] if last is None else last], own[:-1]))
            value = _compared(text, before, own, limit)
            if last is None:
                value[0] = 0
            last = own[-1]
            yield own, value
    level.close()
