"""Sketches that tell which hashes may occur more than once, built in parts and merged.

A hash has a counter in each of a few rows, all in the slice its upper bits name.  Every
partition counts into a sketch of its own and sends it as the places of its counters; the
sketches are added up slice by slice.  Counters stop at 2: what matters is whether the least
of a hash's counters is below 2, and then the hash occurs once.  Colliding hashes only raise
counters, so none that repeats is missed.

With rows apart this is a count-min sketch, with all rows in one array a counting Bloom
filter.  A slice is a file in the shared folder that workers map into memory: the number of
slices grows with the table, what a task holds does not."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmark.llm.common import save
from fieldmark.llm.files import map_file, write_file
from fieldmark.llm.runs import pack, unpack
from fieldmark.llm.words import mix

#: Counters of a row of a slice.
WIDTH = 1 << 20
RUN = "slice long, n long, counters binary, n_again long, again binary"


@dataclass
class Sketch:
    root: str
    slices: int
    rows: int = 3
    apart: bool = True

    @property
    def size(self) -> int:
        return WIDTH * (self.rows if self.apart else 1)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slice, counters of shape hashes x rows) of 64-bit hashes."""
        h = mix(h.astype(np.uint64))
        part = ((h >> np.uint64(32)) * np.uint64(self.slices) >> np.uint64(32)).astype(np.int64)
        at = np.empty((len(h), self.rows), np.int64)
        for r in range(self.rows):
            at[:, r] = mix(h + np.uint64(r + 1)) % np.uint64(WIDTH)
        return part, at + np.arange(self.rows) * WIDTH if self.apart else at

    def run(self, h: np.ndarray) -> pa.RecordBatch:
        """The sketch of some hashes, to be sent."""
        part, at = self.places(h)
        if not self.apart:  # a hash counts once for each counter
            at = np.sort(at, axis=1)
            new = np.ones(at.shape, bool)
            new[:, 1:] = at[:, 1:] != at[:, :-1]
            flat = (part[:, None] * self.size + at)[new]
        else:
            flat = (part[:, None] * self.size + at).ravel()
        flat.sort()
        heads = np.flatnonzero(np.diff(flat, prepend=-1))
        twice = np.diff(heads, append=len(flat)) > 1
        part, at = np.divmod(flat[heads], self.size)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(part))):
            again = at[a:b][twice[a:b]]
            out.append((int(part[a]), b - a, pack(at[a:b], ascending=True), len(again),
                        pack(again, ascending=True)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        columns = list(zip(*out)) or [()] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            ["slice", "n", "counters", "n_again", "again"])

    def path(self, part: int) -> str:
        return f"{self.root}/{part:07d}.bin"

    def merge(self, runs: DataFrame) -> None:
        """Adds up the partitions' sketches and writes the slices."""
        def add(key: tuple, table: pa.Table) -> pa.Table:
            counters = np.zeros(self.size, np.uint8)
            for n, one, m, two in zip(*(table[c].to_pylist() for c in (
                    "n", "counters", "n_again", "again"))):
                at = unpack(one, n, ascending=True).astype(np.int64)
                counters[at] = np.minimum(counters[at] + 1, 2)
                counters[unpack(two, m, ascending=True).astype(np.int64)] = 2
            write_file(self.path(key[0].as_py()), np.packbits(counters == 2).tobytes())
            return pa.table({"slice": pa.array([key[0].as_py()]),
                             "again": pa.array([int((counters == 2).sum())])})

        save(runs.groupBy("slice").applyInArrow(add, "slice long, again long"), "sketch")

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may occur more than once; false only for those that do not."""
        out = np.zeros(len(h), bool)
        part, at = self.places(h)
        by = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[by], append=-1)) + 1
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
            bits = map_file(self.path(int(part[by[a]])))
            if bits is not None:
                own = at[by[a:b]]
                out[by[a:b]] = ((bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1).all(axis=1)
        return out
