"""Removal of passages that occur before: windows of consecutive words with an equal one
earlier in the corpus.

Prefilter by a count-min sketch.  Every window is represented by a cell: the least of the
hashes of its short word runs.  Equal windows have equal cells at equal places, so the number
of places a cell stands at is at least the count of each of its windows.  Every partition
counts its cells in a sketch, the sketches are added up by slice, and cells whose least
counter is 1 rule all their windows out.  Neighbouring windows mostly share their cell, so
a seventh of the windows is counted.  Collisions overestimate counts, so no repeated window
is lost.

Second pass: only windows of the other cells are grouped, exactly, by their 64-bit hash.
A task first settles what it can alone: of equal windows it met, only the earliest goes
on, so a passage that a third of the corpus shares is one row a task.  All but the
earliest of a group are marked, and the marks meet their texts in one join, by id and
hash of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.common import save
from fieldmark.llm.runs import slices_for
from fieldmark.llm.sketch import RUN as RUN_OF_SKETCH
from fieldmark.llm.sketch import Sketch
from fieldmark.llm.words import Block, blocks, mix
from fieldmark.session import checkpoint_dir, scratch_path

#: Words in the short runs whose least hash is a window's cell.
RUN = 8
#: Values a task holds before it counts or settles them.
FLUSH = 1 << 20


def _chain(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, across text ends as well."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h + words[i:n + i]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def _windows(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, its hash, its cell and the cell's place."""
    words = block.word_hashes()
    n = len(words) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    own = np.flatnonzero(block.doc[:n] == block.doc[size - 1:])
    runs = _chain(words, RUN)
    least = np.lib.stride_tricks.sliding_window_view(runs, size - RUN + 1)
    place = own + least[own].argmin(axis=1)
    return own, _chain(words, size)[own], runs[place], place


def _places(cells: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One entry for each place a cell stands at; places never go back."""
    return cells[np.flatnonzero(np.diff(place, prepend=-1))] if len(place) else cells


def repeated_cells(docs: DataFrame, size: int, slices: int) -> Sketch:
    """The merged count-min sketch of all cells of ``docs(text)``."""
    checkpoint_dir(docs.sparkSession)  # raises when no shared folder is configured
    counts = Sketch(scratch_path(docs.sparkSession, "counts"), slices)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                _, _, cells, place = _windows(block, size)
                held.append(_places(cells, place))
                n += len(held[-1])
                if n >= FLUSH:
                    yield counts.run(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield counts.run(np.concatenate(held))

    counts.merge(docs.select("text").mapInArrow(sketch, RUN_OF_SKETCH))
    return counts


def _marked_starts(docs: DataFrame, size: int, slices: int | None) -> DataFrame:
    """(doc_id, text_hash, starts): first words of all windows with an equal one earlier."""
    counts = repeated_cells(docs, size, slices or slices_for(docs))
    names = ["h", "doc_id", "text_hash", "start", "starts"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            h, doc, text, start = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((text, start, doc, h))
            h, doc, text, start = h[order], doc[order], text[order], start[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            # as early as the first: it goes on, once for each text of that id
            same = (doc == doc[head]) & (start == start[head])
            on = same & (first | np.concatenate(([True], text[1:] != text[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[on].view(np.int64)), pa.array(doc[on]), pa.array(text[on]),
                 pa.array(start[on].astype(np.int32)),
                 pa.nulls(int(on.sum()), pa.list_(pa.int32()))], names)
            doc, text, start = doc[~same], text[~same], start[~same]
            if len(doc):
                order = np.lexsort((start, text, doc))
                doc, text, start = doc[order], text[order], start[order]
                heads = np.flatnonzero(np.concatenate(
                    ([True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(heads, len(doc)).astype(np.int32)),
                    pa.array(start.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(heads), pa.int64()), pa.array(doc[heads]), pa.array(text[heads]),
                     pa.nulls(len(heads), pa.int32()), lists], names)

        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                           for c in ("doc_id", "text_hash"))
            for block in blocks(batch.column("text")):
                own, h, cells, place = _windows(block, size)
                at = np.flatnonzero(np.diff(place, prepend=-1))
                keep = np.repeat(counts.repeated(cells[at]), np.diff(at, append=len(own)))
                own = own[keep]
                doc = block.doc[own]
                parts.append((h[keep], ids[block.first + doc], hashes[block.first + doc],
                              own - block.heads[doc]))
                n += len(own)
                if n >= FLUSH:
                    yield from settled()
                    parts, n = [], 0
        if n:
            yield from settled()

    found = save(docs.select("doc_id", "text_hash", "text").mapInArrow(
        settle, "h long, doc_id long, text_hash long, start int, starts array<int>"), "windows")
    earlier = W.partitionBy("h").orderBy("doc_id", "start")
    by = ("doc_id", "text_hash")
    across = found.where("h is not null").select(
        *by, "start", F.rank().over(earlier).alias("at")).where("at > 1") \
        .groupBy(*by).agg(F.collect_list("start").alias("starts"))
    return across.unionByName(found.where("h is null").select(*by, "starts")) \
        .groupBy(*by).agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _without(block: Block, covered: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(texts of the words not covered, one space between; their number)."""
    kept = np.flatnonzero(~covered)
    left = np.bincount(block.doc[kept], minlength=block.texts)
    size = block.end[kept] - block.start[kept] + 1
    to = np.cumsum(size)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(block.start[kept] - to + size, size)
    out = np.append(block.data, np.uint8(32))[np.minimum(at, len(block.data))]
    out[to - 1] = 32
    # no space behind a text's last word
    ends = np.concatenate(([0], to))[np.cumsum(left)]
    out = np.delete(out, ends[left > 0] - 1)
    offsets = np.concatenate(([0], ends - np.cumsum(left > 0))).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(block.texts, pa.py_buffer(offsets),
                                            pa.py_buffer(out.tobytes()))
    return text.cast(pa.string()), left


def remove_repeats(docs: DataFrame, size: int = 20, slices: int | None = None,
                   keep: tuple[str, ...] = (), keep_untouched: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text, *keep), one row per row of ``docs``.

    Words are runs of anything but ASCII white space.  A word goes if it lies in a window
    of ``size`` words whose word sequence also starts earlier (smaller doc_id, or same
    document, earlier start); windows are judged on the input.  ``text`` is the kept words
    joined by one space.  A null text has no words; a text with fewer words than a window
    keeps them all.  Rows that repeat a doc_id and its text are one document and come out
    alike; with different texts, windows of theirs that start at the same place are neither
    earlier.  A row without doc_id keeps all words and counts nowhere.  An empty table gives
    an empty result.  ``keep`` names further columns to hand through; ``keep_untouched``
    leaves a text from which nothing goes as it is (null as empty).  ``slices`` of the sketch
    are as many as the texts need by default; they steer the work, not the result."""
    if size < RUN:
        raise ValueError(f"a window needs at least {RUN} words")
    rows = docs.select(F.col("doc_id").cast("long"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       *[F.col(c).alias(f"kept_{c}") for c in keep])
    marks = _marked_starts(rows.where("doc_id is not null").select("doc_id", "text_hash", "text"),
                           size, slices)
    joined = rows.join(marks, ["doc_id", "text_hash"], "left")
    others = [f for f in joined.schema.fields if f.name.startswith("kept_")]
    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "text string"] + [
        f"`{f.name[5:]}` {f.dataType.simpleString()}" for f in others])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts")
            for block in blocks(batch.column("text")):
                own = starts.slice(block.first, block.texts)
                lengths = np.array([len(x) if x.is_valid else 0 for x in own], np.int64)
                at = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + \
                    np.repeat(block.heads, lengths)
                n = len(block.start)
                turns = np.bincount(at, minlength=n + size + 1)[:n + 1] - \
                    np.bincount(at + size, minlength=n + size + 1)[:n + 1]
                text, left = _without(block, np.cumsum(turns)[:n] > 0)
                rows = batch.slice(block.first, block.texts)
                if keep_untouched:
                    text = pc.if_else(pa.array(block.counts == left), rows.column("text"), text)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(block.counts),
                     pa.array(block.counts - left), text,
                     *[rows.column(f.name) for f in others]],
                    ["doc_id", "n_words", "n_removed", "text", *[f.name[5:] for f in others]])

    return joined.select("doc_id", "text", "starts", *[f.name for f in others]) \
        .mapInArrow(rebuild, schema)
