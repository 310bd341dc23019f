"""Ids of distinct units, each encoded once per worker.

A unit is a word, or a part of it (:class:`~fieldmark.llm.words.Block`, ``cuts``), with or
without the white space before it.  For tokenizers whose pieces never reach from one unit
into the next, the ids of a text are those of its units one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from fieldmark.llm.words import PUNCTUATION, Block, HashTable

#: Most units a worker remembers; beyond it its table starts anew (this changes the work,
#: not the results).
MAX_UNITS = 3_000_000

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once per worker."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def cuts_of(tok) -> str:
    """ASCII punctuation before which a word may be cut: all that stands nowhere behind a
    letter or digit inside a special string."""
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    inside = {b for s in special for a, b in zip(s, s[1:]) if a.isalnum()}
    return "".join(c for c in PUNCTUATION if c not in inside)


class UnitTable:
    """Numbers of distinct units and their ids in one flat array."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]],
                 max_units: int = MAX_UNITS):
        self.encode, self.max_units = encode, max_units
        self.clear()

    def clear(self) -> None:
        self.index = HashTable()
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def find(self, block: Block, start: np.ndarray, end: np.ndarray,
             h: np.ndarray) -> np.ndarray:
        """Numbers of the units at the byte ranges with the hashes ``h``, new ones learnt."""
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.index.n and self.index.n + len(new) > self.max_units:
                self.clear()
                missing = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
            first = missing[first]
            data = block.data.tobytes()
            self._learn(new, [data[a:b].decode() for a, b in zip(start[first].tolist(),
                                                                 end[first].tolist())])
            at[missing] = self.index.find(h[missing])
        return at

    def _learn(self, new: np.ndarray, units: list[str]) -> None:
        ids = [np.asarray(x, np.int32) for x in self.encode(units)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = self.index.n, int(sizes.sum())
        while n + len(new) > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
            self.sizes = np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[n:n + len(new)] = sizes
        self.starts[n:n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + total] = np.concatenate(ids)
        self.used += total
        self.index.add(new, np.arange(n, n + len(new), dtype=np.int32))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units one after the other, ids before each unit and in all)."""
        sizes = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], sizes)], ends
