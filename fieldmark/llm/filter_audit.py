"""How text filters act on each other, from a sparse document-term matrix.

Tasks turn blocks of texts into CSR shards over their own words.  The words of all shards
meet by slices of their hash and get global numbers: the rank in the slice after the words
of the slices before.  The numbers go back to the shards, whose columns are then the same
everywhere.  Row sums (words) and nonzero counts (distinct words) decide two filters, the
texts' characters and digests the others.  The audit of all filter orders needs no more
than how many documents of a part fail which set of filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import save, sha256_hex
from fieldmark.llm.runs import pack, slices_for, unpack
from fieldmark.llm.words import Block, blocks

#: Bytes of text in a shard; a longer text is one by itself.
SHARD = 1 << 21
SPECIAL = "#$%&*|"
LETTERS = "ABCDE"

_ROWS = "doc_id array<long>, part array<string>, text_sha256 array<string>, " \
    "capital array<boolean>, special array<boolean>"
_MATRIX = "indptr binary, indices binary, counts binary"


def _flags(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Per text: over 5 % capitals A-Z among its code points; holds a special character."""
    def per_text(mask: np.ndarray) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(mask)))
        return before[block.offsets[1:]] - before[block.offsets[:-1]]

    data = block.data
    odd = np.zeros(256, bool)
    odd[np.frombuffer(SPECIAL.encode(), np.uint8)] = True
    points = per_text((data & 0xC0) != 0x80)
    return 100 * per_text((data >= 65) & (data <= 90)) > 5 * points, per_text(odd[data]) > 0


def _local_shards(rows: DataFrame, slices: int) -> DataFrame:
    """Shards over their own words, and those words (hashes) as one run a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch.column("text"), size=SHARD):
                words, column = np.unique(block.word_hashes(), return_inverse=True)
                cells = np.sort(block.doc * max(1, len(words)) + column)
                heads = np.flatnonzero(np.diff(cells, prepend=-1))
                doc, index = np.divmod(cells[heads], max(1, len(words)))
                indptr = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=block.texts))))
                capital, special = _flags(block)
                home = _slice_of(words, slices)
                cuts = np.flatnonzero(np.diff(home, prepend=-1, append=slices))
                runs = [{"slice": int(home[a]), "n": int(b - a),
                         "run": pack(words[a:b], ascending=True)} for a, b in zip(cuts, cuts[1:])]

                def one(values: pa.Array) -> pa.Array:
                    return pa.ListArray.from_arrays([0, len(values)], values)

                own = batch.slice(block.first, block.texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([made]), pa.array([len(words)]),
                    *[one(own.column(c)) for c in ("doc_id", "part", "text_sha256")],
                    one(pa.array(capital)), one(pa.array(special)),
                    pa.array([indptr.astype("<i8").tobytes()]),
                    pa.array([pack(index)]), pa.array([pack(np.diff(heads, append=len(cells)))]),
                    pa.array([runs], pa.list_(pa.struct(
                        [("slice", pa.int64()), ("n", pa.int64()), ("run", pa.binary())])))],
                    ["shard", "n", "doc_id", "part", "text_sha256", "capital", "special",
                     "indptr", "indices", "counts", "runs"])
                made += 1

    return rows.mapInArrow(run, f"shard long, n long, {_ROWS}, {_MATRIX}, "
                           "runs array<struct<slice: long, n: long, run: binary>>")


def _slice_of(words: np.ndarray, slices: int) -> np.ndarray:
    """Slices are ranges of the hash, so a shard's words in order go through them in order."""
    return ((words >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _ranks(runs: DataFrame) -> DataFrame:
    """(shard, slice, n, ranks, words): each run's words as ranks in their slice, and how many
    distinct words the slice has."""
    def rank(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        words = np.concatenate([unpack(r.as_buffer(), n, ascending=True)
                                for r, n in zip(table["run"], sizes.tolist())])
        distinct, at = np.unique(words, return_inverse=True)
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"shard": table["shard"], "slice": table["slice"], "n": table["n"],
                         "ranks": pa.array([pack(x, ascending=True) for x in np.split(at, cuts)]),
                         "words": pa.array(np.full(len(table), len(distinct)))})

    return runs.groupBy("slice").applyInArrow(
        rank, "shard long, slice long, n long, ranks binary, words long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, Numbering]:
    """The written shards, each with the ranks of its words, and what numbers them."""
    slices = slices_for(docs)
    local = save(_local_shards(docs, slices), "shards")
    ranks = save(_ranks(local.select("shard", F.explode("runs").alias("r"))
                        .select("shard", "r.*")), "ranks")
    sizes = np.zeros(slices, np.int64)  # one number a slice
    for r in ranks.groupBy("slice").agg(F.max("words").alias("words")).collect():
        sizes[r["slice"]] = r["words"]
    back = ranks.groupBy("shard").agg(F.array_sort(F.collect_list(
        F.struct("slice", "n", "ranks"))).alias("parts"))
    return local.drop("runs", "n").join(back, "shard", "left"), Numbering(
        np.cumsum(sizes) - sizes)


@dataclass
class Numbering:
    before: np.ndarray  # words in the slices before each slice

    def shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row, indptr, indices, counts) of each shard, its columns numbered globally."""
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                ids = [np.zeros(0, np.int64)]
                for p in row.column("parts")[0].as_py() or []:
                    ids.append(unpack(p["ranks"], p["n"], ascending=True).astype(np.int64)
                               + self.before[p["slice"]])
                indptr = np.frombuffer(row.column("indptr")[0].as_buffer(), "<i8")
                index, counts = (unpack(row.column(c)[0].as_buffer(), int(indptr[-1]))
                                 for c in ("indices", "counts"))
                yield row, indptr, np.concatenate(ids)[index.astype(np.int64)], \
                    counts.astype(np.int64)


def csr_shards(docs: DataFrame) -> DataFrame:
    """The document-term matrix of ``docs(doc_id, part, text_sha256, text)`` in shards of
    rows: (shard, doc_id, part, text_sha256, capital, special, indptr, indices, counts), the
    first columns as arrays with an entry for each row of the shard.

    ``indptr``, ``indices`` (global word numbers, from 0 without gaps) and ``counts`` are
    little-endian 64-bit integers in bytes.  Words are runs of anything but ASCII white
    space, told apart by a 64-bit hash; every row of ``docs`` is a row of the matrix."""
    local, numbering = _numbered(docs)
    names = ["shard", "doc_id", "part", "text_sha256", "capital", "special", "indptr", "indices",
             "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, indices, counts in numbering.shards(batches):
            yield pa.RecordBatch.from_arrays(
                [*[row.column(c) for c in names[:-2]],
                 *[pa.array([x.astype("<i8").tobytes()]) for x in (indices, counts)]], names)

    return local.mapInArrow(run, f"shard long, {_ROWS}, {_MATRIX}")


def row_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_sha256, capital, special, n_words, n_distinct): row sums and
    nonzero counts of the matrix of :func:`csr_shards`, one row per matrix row."""
    local, numbering = _numbered(docs)
    names = ["doc_id", "part", "text_sha256", "capital", "special", "n_words", "n_distinct"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, indptr, indices, counts in numbering.shards(batches):
            sums = np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays(
                [*[row.column(c)[0].values for c in names[:-2]],
                 pa.array(sums[indptr[1:]] - sums[indptr[:-1]]), pa.array(np.diff(indptr))], names)

    return local.mapInArrow(run, "doc_id long, part string, text_sha256 string, "
                            "capital boolean, special boolean, n_words long, n_distinct long")


def filter_flags(docs: DataFrame, min_words: int = 50, min_distinct: int = 65) -> DataFrame:
    """(doc_id, part, A, B, C, D, E, rows): which filters the rows of ``docs(doc_id, text,
    source)`` fail, equal rows counted together.

    A: under ``min_words`` words; B: distinct words under ``min_distinct`` percent of the
    words; C: capitals A-Z over 5 percent of the code points; D: holds one of ``#$%&*|``;
    E: a smaller doc_id has the identical text.  A null text is empty (it fails A), a null
    source the part ''.  Rows that repeat a doc_id with its text do not fail E for each
    other; a row without doc_id neither fails E nor makes others fail it.  An empty table
    gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    matrix = row_statistics(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        sha256_hex(text).alias("text_sha256"), text.alias("text")))
    rows = save(matrix.select(
        "doc_id", "part", "text_sha256", (F.col("n_words") < min_words).alias("A"),
        (100 * F.col("n_distinct") < min_distinct * F.col("n_words")).alias("B"),
        F.col("capital").alias("C"), F.col("special").alias("D")), "flags")
    # the first document of each text; then doc_id and text together are no hot key
    first = rows.where("doc_id is not null").groupBy("text_sha256") \
        .agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    distinct = rows.groupBy("text_sha256", "doc_id", "part", "A", "B", "C", "D") \
        .agg(F.count("*").alias("rows"))
    return distinct.join(first, ["text_sha256", "doc_id"], "left").select(
        "doc_id", "part", "A", "B", "C", "D",
        (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"), "rows")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): per value of ``source`` all 120 orders of the filters of :func:`filter_flags`,
    five steps each.

    Counts are of documents (rows) of the part: ``kept`` after the step, ``removed`` in it,
    ``redundant`` failing its filter but removed before, ``unique_fails`` failing its filter
    alone, ``good_lost`` / ``toxic_lost`` removed in it with a row of ``labels(doc_id, quality,
    toxic)`` of quality 1 / toxic 1, ``shapley`` removed by its filter summed over all orders.
    Documents without doc_id or labels count as neither; an empty table gives an empty
    result."""
    flags = filter_flags(docs)
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
             F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    masks = [F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(LETTERS)]
    flags = flags.select("doc_id", "part", sum(masks[1:], masks[0]).alias("mask"), "rows")
    named = flags.where("doc_id is not null").join(by_id, "doc_id", "left")
    unnamed = flags.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    counts = named.unionByName(unnamed).groupBy("part", "mask").agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("rows") * F.coalesce("toxic", F.lit(0))).alias("toxic"))

    # at most 32 rows a part: its filter and the filters before it are all a step depends on
    bits = [1 << i for i in range(len(LETTERS))]
    steps = [(f, p) for f in bits for p in range(1 << len(LETTERS)) if not p & f]
    each = counts.withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.lit(p).alias("p")) for f, p in steps]))) \
        .select("part", "mask", "n", "good", "toxic", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("f")) != 0
    gone = F.col("mask").bitwiseAND(F.col("p")) != 0
    total = lambda value, on: F.sum(F.when(on, F.col(value)).otherwise(0)).cast("long")
    per_step = each.groupBy("part", "f", "p").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("f")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"))
    orders = docs.sparkSession.createDataFrame(
        [("".join(order), step + 1, 1 << LETTERS.index(order[step]),
          sum(1 << LETTERS.index(x) for x in order[:step]))
         for order in permutations(LETTERS) for step in range(len(LETTERS))],
        "filter_order string, step int, f int, p int")
    rows = per_step.join(F.broadcast(orders), ["f", "p"])  # 600 rows
    shapley = rows.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")
