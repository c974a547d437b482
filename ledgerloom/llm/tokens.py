"""Token ids by the public tokenizers, each distinct piece of text encoded once per worker.

Both tokenizers cut a text into words, runs of other signs and white space before they merge, so ids
of a text are the ids of its pieces side by side wherever the pieces end at such cuts.  Texts are cut
before a space, around a line feed, and before a comma or full stop that follows a letter or digit;
texts where these places are no cuts of the tokenizer (two white-space characters in a row, signs
before a comma) are encoded as they are.  Pieces are numbered by a dictionary; new ones are encoded in one call, a group of
them joined by a separator of one id, which costs less than a call's work for each.  A group whose ids hold another number of
separators than were put in is halved, and encoded piece by piece when it is small.  Pieces of ASCII letters alone need no
separator: their first or last token shows by itself where they begin or end.
Beyond ``MAX_PIECES`` pieces the rare ones go, so memory is bounded.
Special tokens' strings inside a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from ledgerloom.llm.common import ragged_ranges, words_in

#: About 250 bytes each; a worker keeps the most used third when it has more.
MAX_PIECES = 450_000

#: New pieces that are encoded as one text.
JOINED = 256

_MARK = 0
#: White space as a space, letters, digits and all bytes above 0x7F as a letter, other signs as one sign.
_KIND = bytes(
    0x20 if b in (0x20, *range(0x09, 0x0E)) else
    b if b in (0x2C, 0x2E, _MARK) else
    0x61 if chr(b).isalnum() or b >= 0x80 else 0x21
    for b in range(256))
_SIGN_BEFORE_STOP = (b"!,", b"!.", b",,", b",.", b".,", b"..")


class _Index(dict):
    """Piece to its number; a new piece gets the next one and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class _Pieces:
    """Numbers of pieces, and their ids side by side in one array."""

    #: Stands between pieces that are encoded together, and what a joined text may not hold.
    separator = b""
    inseparable: re.Pattern[bytes] | None = None
    #: Stands between pieces of letters alone; the sign, in a token's text, of the edge of a piece.
    glue = b""
    sign = re.compile("")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alone = self._encoded([self.separator])[0]
        self.separator_id = alone[0] if len(alone) == 1 else None
        texts = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.edge = np.array([self.sign.search(t) is not None for t in texts])
        self._reset()

    def _reset(self) -> None:
        self.index, self.used = _Index(), 0
        self.ids, self.start = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.size, self.times = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def split(self, text: bytes) -> list[bytes] | None:
        """Pieces of a text, None where it can't be cut safely."""
        raise NotImplementedError

    def _encoded(self, texts: list[bytes]) -> list[array]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids) for e in found]

    def _joined(self, groups: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each group ids of its pieces side by side, and the number of ids of each."""
        joined = [self.separator.join(own) for own in groups]
        found = self.tokenizer.encode_batch_fast([t.decode() for t in joined], add_special_tokens=False)
        for own, text, encoding in zip(groups, joined, found, strict=True):
            together = np.array(encoding.ids, np.uint32)
            ends = np.append(np.flatnonzero(together == self.separator_id), len(together))
            if len(ends) == len(own) and not (self.inseparable and self.inseparable.search(text)):
                yield np.delete(together, ends[:-1]), np.diff(ends, prepend=-1) - 1
            elif len(own) > 16:
                half = len(own) // 2
                yield from self._joined([own[:half], own[half:]])
            else:
                single = self._encoded(own)
                yield (np.frombuffer(b"".join(s.tobytes() for s in single), np.uint32),
                       np.fromiter(map(len, single), np.int64, len(single)))

    def _glued(self, groups: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``_joined``, for pieces of letters alone, whose borders the tokens show."""
        joined = [self.glue.join(own).decode() for own in groups]
        for own, encoding in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            together = np.array(encoding.ids, np.uint32)
            sizes = self._borders(self.edge[together])
            if len(sizes) == len(own) and sizes.sum() == len(together):
                yield together, sizes
            else:
                yield from self._joined([own])

    def _alone(self, piece: bytes) -> bool:
        """Whether a piece is letters of ASCII only, which the tokenizer never cuts before it merges."""
        raise NotImplementedError

    def _borders(self, edge: np.ndarray) -> np.ndarray:
        """Number of ids of each piece, from the ids that stand at a piece's edge."""
        raise NotImplementedError

    def _learn(self) -> None:
        new = self.index.new
        plain = np.fromiter(map(self._alone, new), bool, len(new))
        order = np.argsort(~plain, kind="stable")
        put = [new[i] for i in order.tolist()]
        border = int(plain.sum())
        groups = [put[at:min(at + JOINED, stop)] for low, stop in ((0, border), (border, len(put))) for at in range(low, stop, JOINED)]
        found = [*self._glued(groups[:-(-border // JOINED)]), *self._joined(groups[-(-border // JOINED):])]
        ids, sizes = map(np.concatenate, zip(*found, strict=True))
        back = np.argsort(order)
        ids, sizes = ids[ragged_ranges((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]
        first, count = len(self.index) - len(sizes), len(self.index)
        while count > len(self.start):
            self.start, self.size, self.times = (np.pad(x, (0, len(x))) for x in (self.start, self.size, self.times))
        total = self.used + len(ids)
        if total > len(self.ids):
            self.ids = np.pad(self.ids, (0, max(len(self.ids), total - len(self.ids))))
        self.ids[self.used:total] = ids
        self.start[first:count] = self.used + np.cumsum(sizes) - sizes
        self.size[first:count] = sizes
        self.used, self.index.new = total, []

    def numbers(self, pieces: list[bytes], times: np.ndarray | None = None, most: int = MAX_PIECES) -> np.ndarray:
        """Number of every piece; numbers hold until the next call.  ``times``: how often each stands here, if not once;
        ``most``: pieces that are kept for the next call."""
        if len(self.index) > most:
            self._keep_frequent(most // 3)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.index.new:
            self._learn()
        self.times[:len(self.index)] += np.bincount(at, times, len(self.index)).astype(np.int32)
        return at

    def _keep_frequent(self, size: int) -> None:
        if not size:
            self._reset()
            return
        pieces, times = list(self.index), self.times[:len(self.index)]
        kept = np.argsort(-times, kind="stable")[:size]
        ids, sizes = self.ids_of(kept)
        times = times[kept] // 2
        self._reset()
        self.index.update((pieces[k], i) for i, k in enumerate(kept.tolist()))
        self.ids, self.used = ids, len(ids)
        self.start, self.size, self.times = np.cumsum(sizes) - sizes, sizes.astype(np.int32), times

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray | list[int], list[int]]:
        """Number of every piece of all texts, the number of pieces of each, and which texts can't be cut."""
        cut = [self.split(t) for t in texts]
        at = self.numbers([p for own in cut if own is not None for p in own])
        return at, [0 if own is None else len(own) for own in cut], [i for i, own in enumerate(cut) if own is None]

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces side by side, and the number of ids of each."""
        sizes = self.size[numbers].astype(np.int64)
        return self.ids[ragged_ranges(self.start[numbers], sizes)], sizes

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text as little-endian uint32."""
        at, pieces, whole = self._numbered(texts)
        ids, sizes = self.ids_of(at)
        total = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.cumsum(pieces)
        bounds = total[np.concatenate(([0], ends))].tolist()
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a:4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, found in zip(whole, self._encoded([texts[i] for i in whole]), strict=True):
            out[i] = found.tobytes()
        return out


def _plain(text: bytes) -> bool:
    """Only letters beyond ASCII, which the cuts take them for, lower-cased too."""
    return text.isascii() or all(c.isalpha() and c.lower().isalpha() for c in set(text.decode()) if c > "\x7f")


class ByteTokens(_Pieces):
    """Byte-level BPE: a space belongs to the word after it, a lone line feed stands alone."""

    separator, inseparable = b"\n", re.compile(rb"\s(\n|\Z)")
    sign = re.compile("^Ġ")

    def _alone(self, piece: bytes) -> bool:
        return piece[:1] == b" " and piece[1:].isalpha()

    def _borders(self, edge: np.ndarray) -> np.ndarray:
        return np.diff(np.append(np.flatnonzero(edge), len(edge)))

    def split(self, text: bytes) -> list[bytes] | None:
        kinds = text.translate(_KIND)
        if b"\0" in kinds or b"  " in kinds or not _plain(text):
            return None
        cut = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")
        if not any(pair in kinds for pair in (*_SIGN_BEFORE_STOP, b" ,", b" .")):
            cut = cut.replace(b",", b"\0,").replace(b".", b"\0.")
        return list(filter(None, cut.split(b"\0")))

    @staticmethod
    @lru_cache(maxsize=1)
    def shared(path: str) -> ByteTokens:
        return ByteTokens(path)


class WordTokens(_Pieces):
    """Lower-casing BPE with word ends: white space only separates, so every word stands alone."""

    separator, glue = b" | ", b" "
    sign = re.compile("</w>$")

    def _alone(self, piece: bytes) -> bool:
        return piece.isalpha()

    def _borders(self, edge: np.ndarray) -> np.ndarray:
        return np.diff(np.flatnonzero(edge), prepend=-1)

    def split(self, text: bytes) -> list[bytes] | None:
        return self._spaced(text).split()

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray | list[int], list[int]]:
        words, sizes = words_in(pa.array([self._spaced(t) for t in texts], pa.binary()))
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        return self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(at, minlength=len(coded.dictionary)))[at], sizes, []

    def _spaced(self, text: bytes) -> bytes:
        """Lower-cased, with a space before commas and full stops where the tokenizer cuts there."""
        text = text.lower()
        kinds = text.translate(_KIND)
        if _plain(text) and not any(
                pair in kinds for pair in (*_SIGN_BEFORE_STOP, b"\0,", b"\0.")):
            text = text.replace(b",", b" ,").replace(b".", b" .")
        return text

    @staticmethod
    @lru_cache(maxsize=1)
    def shared(path: str) -> WordTokens:
        return WordTokens(path)
