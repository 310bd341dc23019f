"""Exact deduplication with two-pass Bloom filtering.

Pass 1: every partition puts its rows' hashes into a partitioned counting Bloom filter;
merging the partitions' filters slice by slice marks the bits that were set twice.  Pass 2:
a row is possibly repeated if all its bits are marked; only those rows are shuffled and
grouped, all others pass straight through as their own group.  The slices are files that
workers map, so both passes are the same at every size.  Texts never move: both passes run
on a written table of ids and digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import lower_az, save, sha256_hex, texts
from fieldmark.llm.sketch import RUN, WIDTH, Sketch
from fieldmark.session import checkpoint_dir, scratch_path

#: Bits of the filter for each row; hashes that a task holds before it sends its filter.
BITS_PER_ROW, FLUSH = 16, 1 << 20


def possibly_repeated(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """``rows`` (a written table with a 64-bit hash ``h``) with the column ``maybe``: false
    only where no other row has the same hash."""
    checkpoint_dir(rows.sparkSession)  # raises when no shared folder is configured
    slices = slices or max(1, -(-rows.count() * BITS_PER_ROW // WIDTH))
    bloom = Sketch(scratch_path(rows.sparkSession, "bloom"), slices, apart=False)
    names = rows.columns

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(hashes(batch))
            n += len(batch)
            if n >= FLUSH:
                yield bloom.run(np.concatenate(held))
                held, n = [], 0
        if n:
            yield bloom.run(np.concatenate(held))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bloom.repeated(hashes(batch)))], [*names, "maybe"])

    bloom.merge(rows.select("h").mapInArrow(build, RUN))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(test, f"{schema}, maybe boolean")


def exact_dedup(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, so
    empty and null texts form one group.  The largest doc_id of a group stays.  Rows that
    repeat a doc_id with an equal text are one document; with different texts, a document
    in each group.  A null doc_id stays only if its group has no other id.  An empty
    table gives an empty result.  ``slices`` of the filter are as many as the rows need by
    default; they steer the work, not the result."""
    rows = texts(docs)
    digest = sha256_hex(lower_az(F.col("text")))
    rows = save(rows.select("doc_id", digest.alias("text_sha256"))
                .withColumn("h", F.xxhash64("text_sha256")), "digests")
    rows = possibly_repeated(rows, slices).drop("h")
    alone = rows.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    rest = rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("rows"))
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"),
                                             F.count("*").alias("group_size"))
    shared = rest.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(shared)
