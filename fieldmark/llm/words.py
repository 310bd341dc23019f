"""Words of whole Arrow string columns in numpy, without a Python object per word.

A column is taken in blocks of whole texts.  White space is ASCII (x09-x0D, x20).  The
64-bit hash of any byte range of a block comes from one prefix sum of ``code[byte] *
base^position`` (modulo 2^64): the difference of two sums, divided by ``base^start`` and
mixed with the range's length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text taken at once; a longer text is a block of its own.  The arrays over a block's
#: bytes take some 60 times that.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Random code of each byte value, from a fixed seed.
CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
#: The same with A-Z read as a-z.
CODES_LOWER = CODES.copy()
CODES_LOWER[65:91] = CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < max(n, 1):
        size = max(n, BLOCK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Block:
    """Some texts of a column: ``first`` is the row of the first one, ``offsets`` their
    byte ranges in ``data``; word i is ``data[start[i]:end[i]]`` of text ``doc[i]``.

    With ``cuts``, words are cut between a Latin letter or ASCII digit and any of these
    ASCII characters."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    cuts: str = ""

    def __post_init__(self) -> None:
        data, n = self.data, len(self.data)
        inner = ~_SPACE[data]
        begins = np.zeros(n + 1, bool)  # where a text begins or ends
        begins[self.offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inner[:-1]
        cut = self._cut(n)
        self.start = np.flatnonzero(inner & (~before | begins[:-1] | cut[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inner[1:]
        self.end = np.flatnonzero(inner & (~after | begins[1:] | cut[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        #: Words of each text, and the position of each text's first word.
        self.counts = np.bincount(self.doc, minlength=self.texts)
        self.heads = np.cumsum(self.counts) - self.counts

    def _cut(self, n: int) -> np.ndarray:
        """Whether a word is cut before each byte."""
        out = np.zeros(n + 1, bool)
        if not self.cuts or n < 2:
            return out
        at = np.zeros(256, bool)
        at[np.frombuffer(self.cuts.encode(), np.uint8)] = True
        at = np.flatnonzero(at[self.data[1:]]) + 1
        last, lead = self.data[at - 1], self.data[np.maximum(at - 2, 0)]
        latin = (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xC8) & ~(
            (lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        out[at[_ALNUM[last] | latin]] = True
        return out

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def sums(self, codes: np.ndarray = CODES) -> np.ndarray:
        up, _ = _powers(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(codes[self.data] * up[:len(self.data)], out=out[1:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
        """Of the byte ranges, all non-zero."""
        sums, (_, down) = self.sums(codes), _powers(len(self.data) + 1)
        h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
        h = mix(h)
        h[h == 0] = 1
        return h

    def folded_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the byte ranges, A-Z read as a-z in those of ASCII and Latin letters alone."""
        h = self.hashes(start, end, CODES_LOWER)
        wide = self.data >= 0xCA  # what lies beyond the Latin letters begins so
        if wide.any():
            before = np.concatenate(([0], np.cumsum(wide)))
            at = np.flatnonzero(before[end] != before[start])
            h[at] = self.hashes(start[at], end[at])
        return h

    def word_hashes(self, codes: np.ndarray = CODES) -> np.ndarray:
        return self.hashes(self.start, self.end, codes)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the units: each word with the white space before it, and
        white space left at a text's end."""
        start = np.empty_like(self.start)
        start[1:] = self.end[:-1]
        head = self.heads[self.counts > 0]
        start[head] = self.offsets[:-1][self.counts > 0]
        last = np.where(self.counts > 0, self.end[np.maximum(self.heads + self.counts - 1, 0)]
                        if len(self.end) else 0, self.offsets[:-1])
        tail = np.flatnonzero(last < self.offsets[1:])
        if not len(tail):
            return start, self.end, self.doc
        starts = np.concatenate((start, last[tail]))
        ends = np.concatenate((self.end, self.offsets[1:][tail]))
        docs = np.concatenate((self.doc, tail))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], docs[order]

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode()


def blocks(column: pa.Array, cuts: str = "", size: int = BLOCK) -> Iterator[Block]:
    """The column's texts (no nulls) in order."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets, data = _offsets(column), np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for at, to in _parts(offsets, size):
        yield Block(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], cuts)


def parts(batch: pa.RecordBatch, text_col: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts (nulls among them) have at most ``size`` bytes, or of
    one text."""
    if batch.num_rows:
        for at, to in _parts(_offsets(batch.column(text_col).cast(pa.large_string())), size):
            yield batch.slice(at, to - at)


def _offsets(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    return offsets[column.offset:column.offset + len(column) + 1]


def _parts(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def freeing(run: Callable) -> Callable:
    """``run`` (batches to batches) that hands Arrow's free memory back at a task's end:
    Python workers stay for later tasks, beside those at work."""
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return freed


def shingles(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of ``size`` words of one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.flatnonzero(doc[:n] == doc[size - 1:])
    h = np.zeros(len(own), np.uint64)
    for i in range(size):
        h = mix(h + words[own + i] + np.uint64(i)) if i in (0, size - 1) else \
            (h + words[own + i]) * np.uint64(_BASE | 1)
    return own, h


class HashTable:
    """64-bit keys (not 0) to numbers, looked up and added in bulk."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        out = np.full(len(h), -1, np.int64)
        todo, place = np.arange(len(h)), self._place(h)
        while len(todo):
            keys = self.keys[place]
            hit = keys == h[todo]
            out[todo[hit]] = self.values[place[hit]]
            on = np.flatnonzero(~hit & (keys != 0))
            todo, place = todo[on], (place[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old = self.keys != 0
            keys, numbers = self.keys[old], self.values[old]
            while 2 * (self.n + len(h)) > (1 << self.bits):
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.values = np.zeros(1 << self.bits, np.int32)
            self._put(keys, numbers)
        self._put(h, values)
        self.n += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        place = self._place(h)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]
            won = self.keys[place] == h
            self.values[place[won]] = values[won]
            h, values = h[~won], values[~won]
            place = (place[~won] + 1) & ((1 << self.bits) - 1)
