"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A piece of length s belongs to reciprocal class k = capacity // s, and a bin of class k
takes exactly k pieces.  Each worker fills the bins of every class by itself; the pieces
of bins it could not fill (fewer than k per class) are filled across groups of workers, then
of groups, class by class; what is then left (under one bin per class, a number bounded by the capacity alone)
goes together by decreasing length.

Documents may be cut: full sequences first, then the rest at halves of the capacity down
to ``least``, because those lengths fill their class's bins with no padding at all."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.common import save, texts
from fieldmark.llm.units import UnitTable, cuts_of, tokenizer
from fieldmark.llm.words import Block, blocks

#: Ids of the sequences that the three steps make do not meet.
ACROSS, LAST = 1 << 60, 1 << 62
#: Tasks, or groups of tasks, whose open bins are filled together.
GROUP = 64


_TABLES: dict[str, UnitTable] = {}


def _table(path: str) -> UnitTable:
    """The worker's table of words; it lasts from task to task."""
    if path not in _TABLES:
        tok = tokenizer(path)
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for piece, i in tok.get_vocab().items() if piece.endswith("</w>")]] = True

        def encode(words: list[str]) -> Iterator[list[int]]:
            # words of one piece chain each are told apart by their last pieces
            plain = [w for w in words if w.isalpha()]
            chunks = [plain[i:i + 256] for i in range(0, len(plain), 256)]
            found = {}
            for chunk, e in zip(chunks, tok.encode_batch_fast(
                    [" ".join(c) for c in chunks], add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                cuts = np.flatnonzero(ends[ids]) + 1
                if len(cuts) == len(chunk):
                    found.update(zip(chunk, np.split(ids, cuts[:-1])))
            rest = [w for w in words if w not in found]
            found.update(zip(rest, (e.ids for e in tok.encode_batch_fast(
                rest, add_special_tokens=False))))
            return map(found.__getitem__, words)

        _TABLES[path] = UnitTable(encode)
    return _TABLES[path]


def _holding(block: Block, special: list[bytes]) -> np.ndarray:
    """The words that hold one of these strings in any case."""
    data, found = block.data.tobytes().lower(), []
    for s in special:
        at = data.find(s)
        while at >= 0:
            found.append(at)
            at = data.find(s, at + 1)
    return np.unique(np.searchsorted(block.start, np.array(found, np.int64), "right") - 1)


def _ids(column: pa.Array, table: UnitTable, cuts: str,
         special: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text; white space has no ids and ASCII letters no case, so lower-
    case words alone are looked up.  Special strings do have a case: words that hold one in
    any case are looked up as they are."""
    for block in blocks(column, cuts):
        h = block.folded_hashes(block.start, block.end)
        at = _holding(block, special)
        h[at] = block.hashes(block.start[at], block.end[at])
        at = table.find(block, block.start, block.end, h)
        ids, before = table.ids(at)
        for i, (a, n) in enumerate(zip(block.heads, block.counts)):
            yield block.first + i, ids[before[a]:before[a + n]]


def cut(total: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids."""
    out = [capacity] * (total // capacity)
    rest, half = total % capacity, capacity // 2
    while half >= least:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * (rest > 0)


def pack(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int | None = 2,
         least: int = 512, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row
    per piece; each id of each document lies in exactly one piece.

    ``ids_crc32`` is of the piece's ids as little-endian unsigned 32-bit; ``keep_ids``
    adds the ids themselves, for :func:`sequences`.  A null or empty text has ``end_id``
    alone; without ``end_id`` it has no piece.  Each repeated row is packed for itself, a
    null doc_id stays null, an empty table gives an empty result.  Cutting does not depend
    on the other documents, and no document is dropped."""
    rows = texts(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if keep_ids else ""
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
              f"k long, seq long, offset long, task long, nth long{extra}")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tok = _table(vocab_path), tokenizer(vocab_path)
        cuts = cuts_of(tok)
        special = [t.content.lower().encode() for t in tok.get_added_tokens_decoder().values()]
        task, made, nth = TaskContext.get().partitionId(), 0, 0
        bins: dict[int, list] = defaultdict(list)  # class -> pieces of its open bin
        names = [f.split()[0] for f in schema.split(", ")]
        doc_type = None

        def rows_of(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * len(names)
            types = [doc_type] + [pa.int64()] * 9 + [pa.list_(pa.int32())] * keep_ids
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            doc_type, out = batch.column("doc_id").type, []
            names_of = batch.column("doc_id").to_pylist()
            for doc, ids in _ids(batch.column("text"), table, cuts, special):
                doc, at = names_of[doc], 0
                if end_id is not None:
                    ids = np.append(ids, np.int32(end_id))
                for n in cut(len(ids), capacity, least):
                    part, k = ids[at:at + n], capacity // n
                    bins[k].append((doc, at, n, zlib.crc32(part.astype("<u4").tobytes()),
                                    len(ids), *([part.tolist()] if keep_ids else ())))
                    at += n
                    if len(bins[k]) == k:
                        offset = 0
                        for p in bins.pop(k):
                            out.append((*p[:5], k, (task << 32) + made, offset, task, 0, *p[5:]))
                            offset += p[2]
                        made += 1
            yield rows_of(out)
        left = []
        for k, pieces in bins.items():
            for p in pieces:
                nth += 1
                left.append((*p[:5], k, None, None, task, nth, *p[5:]))
        if left:
            yield rows_of(left)

    placed = save(rows.mapInArrow(fill, schema), "pieces")
    ids = ["ids"] if keep_ids else []
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids]
    full = placed.where("seq is not null").withColumn("sequence_id", F.col("seq")).select(cols)

    # the workers' open bins, class by class: first those of GROUP tasks, what these leave
    # (under one bin a class and group) with that of GROUP groups, and so on
    tasks = (placed.agg(F.max("task").alias("t")).first()["t"] or 0) + 1
    left, across, level, width = placed.where("seq is null").drop("seq", "offset"), [], 0, 1
    while True:
        level, width = level + 1, width * GROUP
        g = F.expr(f"task div {width}L")
        order = W.partitionBy("k", "g").orderBy("task", "nth")
        rows = left.withColumn("g", g).withColumns({
            "at": F.row_number().over(order) - 1,
            "n": F.count("*").over(W.partitionBy("k", "g"))}).withColumn("bin", F.expr("at div k"))
        rows = save(rows.withColumn("whole", F.expr("(bin + 1) * k <= n")), "left")
        in_bin = W.partitionBy("k", "g", "bin").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        place = F.shiftleft(F.lit(level).cast("long"), 57) + F.shiftleft(F.col("k"), 37) \
            + F.shiftleft(F.col("g"), 7) + F.col("bin")
        across.append(rows.where("whole").withColumns({
            "sequence_id": F.lit(ACROSS) + place,
            "offset": F.coalesce(F.sum("length").over(in_bin), F.lit(0))}).select(cols))
        left = rows.where("not whole").drop("g", "at", "n", "bin", "whole")
        if width >= tasks:
            break

    # under one bin of each class: at most capacity pieces for each of the few classes
    types = {f.name: f.dataType.simpleString() for f in full.schema}
    last_schema = ", ".join(f"`{c}` {types[c]}" for c in cols)

    def decreasing(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "task", "nth"], ascending=[False, True, True])
        room: list[int] = []
        seq, off = [], []
        for n in pdf["length"]:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(capacity)
            seq.append(LAST + at)
            off.append(capacity - room[at])
            room[at] -= n
        return pdf.assign(sequence_id=seq, offset=off)[cols]

    last = left.withColumn("one", F.lit(0)) \
        .groupBy("one").applyInPandas(decreasing, last_schema)
    for some in across:
        full = full.unionByName(some)
    return full.unionByName(last)


def sequences(pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the padded sequences of pieces made with ``keep_ids``.
    A sequence whose length is a power of two is left unpadded."""
    rows = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.col("parts")["ids"])
    power = F.expr("(length & (length - 1)) = 0")
    pad = F.when(power, 0).otherwise(F.lit(capacity) - F.col("length")).cast("int")
    return rows.select("sequence_id", "length",
                       F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
