"""I-Match document fingerprints, in DataFrame functions alone.

Terms are the lower-cased runs of letters and digits, each known by its slot, a hash into
a fixed number of slots, so that the lexicon is one bit a slot however large the corpus.
Document frequencies of all slots over the whole corpus select the lexicon: slots inside a
band of inverse document frequency.  A fingerprint has one hash for each of several random
subsets of the lexicon, over the sorted distinct slots of the text that lie in the subset.
The subsets' shares fall by powers of two, so that short and long texts alike have some
that hold few of their terms; those survive edits.  The same subsets of all slots stand in
for texts that have little in the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.common import save, sha256_hex

SLOTS = 1 << 20
#: One subset in each family holds one slot of so many.
FAMILIES, SHARES = 4, (4, 8, 16, 32, 64, 128, 256, 512)
#: Texts with less than one slot in so many in the lexicon are compared over all slots.
SPARSE = 4


def slots(text: Column) -> Column:
    """Distinct slots of the terms, ascending."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))))


def lexicon(texts: DataFrame, least_share: float = 0.0005, most_share: float = 0.1) -> DataFrame:
    """One row, ``words array<long>``: the lexicon's bits, 64 slots a word.

    Of ``texts(text)``, slots are in whose document frequency lies between the shares of
    all documents (idf from ln(1/most_share) to ln(1/least_share)); at least two documents
    have to hold one."""
    used = texts.select(F.explode(slots(F.col("text"))).alias("slot")) \
        .groupBy("slot").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("n")).scalar()
    band = used.where((F.col("df") >= 2) & (F.col("df") >= total * least_share)
                      & (F.col("df") <= F.greatest(total * most_share, F.lit(2.0))))
    bits = band.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
    # every word once, in order: as many rows as the lexicon has words, a fixed number
    every = texts.sparkSession.range(0, SLOTS // 64).select(F.col("id").cast("int").alias("word"))
    rows = every.join(bits, "word", "left").select(
        F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return rows.agg(F.array_sort(F.collect_list("w"))["bits"].alias("words"))


def subset_bases(all_slots: Column) -> Column:
    """Of sorted distinct slots, the widest subset of each family: array<struct<j, base>>."""
    return F.transform(F.sequence(F.lit(1), F.lit(FAMILIES)), lambda j: F.struct(
        j.alias("j"), F.filter(all_slots, lambda s: F.pmod(F.xxhash64(s, j), F.lit(SHARES[0])) == 0)
        .alias("base")))


def subset_hashes(bases: Column, inside=None) -> Column:
    """Of :func:`subset_bases`: one hash a subset, empty where it has none of the slots;
    ``inside`` tells which slots count (all if not given).  A family's subsets lie one
    inside the other, so each is taken from the one before."""
    def nested(held: Column, j: Column, shares: tuple[int, ...]) -> Column:
        own = F.array(F.when(F.size(held) == 0, "").otherwise(
            F.lpad(F.hex(F.pmod(F.xxhash64(held), F.lit(1 << 32))), 8, "0")))
        if not shares:
            return own
        less = F.filter(held, lambda s: F.pmod(F.xxhash64(s, j), F.lit(shares[0])) == 0)
        return F.concat(own, F.flatten(F.transform(
            F.array(less), lambda x: nested(x, j, shares[1:]))))

    return F.flatten(F.transform(bases, lambda f: F.flatten(F.transform(
        F.array(f["base"] if inside is None else F.filter(f["base"], inside)),
        lambda held: nested(held, f["j"], SHARES[1:])))))


def fingerprints(docs: DataFrame, words: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``docs`` with a fingerprint column for each text column (``columns``: text column to
    fingerprint column); ``words`` is the written :func:`lexicon`.

    A fingerprint has the subsets' hashes over the slots in the lexicon and, behind ``|``,
    those of the same subsets over all slots.  A ``~`` in place of ``|`` marks texts with
    less than one slot in ``SPARSE`` in the lexicon: copies that are so many that their
    terms lie outside the band.  A text without a term in any subset (a null counts as
    empty) has the digest of its letters and digits instead."""
    def known(s: Column) -> Column:
        return F.getbit(F.get("_lexicon", F.shiftright(s, 6)), s.bitwiseAND(F.lit(63))) == 1

    names = columns.values()
    out = docs.withColumn("_lexicon", words.scalar()).withColumns(
        {f"_slots_{f}": slots(F.coalesce(t, F.lit(""))) for t, f in columns.items()})
    out = out.withColumns({f"_bases_{f}": subset_bases(F.col(f"_slots_{f}")) for f in names} | {
        f"_sparse_{f}": F.size(F.filter(f"_slots_{f}", known)) * SPARSE < F.size(f"_slots_{f}")
        for f in names})
    out = out.withColumns({f"_band_{f}": F.array_join(
        subset_hashes(F.col(f"_bases_{f}"), known), "-") for f in names} | {
        f"_wide_{f}": F.array_join(subset_hashes(F.col(f"_bases_{f}")), "-") for f in names})
    plain = {f: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
             for t, f in columns.items()}
    return out.withColumns({f: F.when(
        F.length(f"_wide_{f}") >= FAMILIES * len(SHARES), F.concat(
            f"_band_{f}", F.when(F.col(f"_sparse_{f}"), "~").otherwise("|"), f"_wide_{f}"))
        .otherwise(F.concat(F.lit("text:"), sha256_hex(F.trim(plain[f])))) for f in names}) \
        .drop("_lexicon", *[f"_{kind}_{f}" for f in names
                            for kind in ("slots", "bases", "sparse", "band", "wide")])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which at least one text has a term; 1
    for equal fingerprints.  Over the lexicon's slots, or over all where either text has
    few in the lexicon."""
    half = F.when(F.contains(a, F.lit("~")) | F.contains(b, F.lit("~")), 1).otherwise(0)
    x, y = (F.split(F.coalesce(F.get(F.split(c, "[|~]"), half), c), "-") for c in (a, b))
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    some = F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != ""))
    same = F.filter(some, lambda p: p["x"] == p["y"])
    return F.when(a == b, 1.0).when((F.size(x) != F.size(y)) | (F.size(some) == 0), 0.0) \
        .otherwise(F.size(same) / F.size(some))


def next_documents(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ``ids(doc_id)``: the next smaller id, for the smallest
    the largest.

    Ids are range-partitioned; inside a part the order is a window, between parts the next
    is the largest id of the part before (one row a part)."""
    parts = save(ids.where("doc_id is not null").distinct().repartitionByRange("doc_id")
                 .withColumn("part", F.spark_partition_id()), "ids")
    edges = parts.groupBy("part").agg(F.max("doc_id").alias("high"))
    edges = edges.select("part", F.lag("high").over(W.orderBy("part")).alias("below"))
    top = parts.agg(F.max("doc_id")).scalar()
    inner = F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id"))
    return parts.withColumn("next_id", inner).join(F.broadcast(edges), "part").select(
        "doc_id", F.coalesce("next_id", "below", top).alias("next_id"))


def with_edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``docs(doc_id, text)`` with n_chars and ``edited``: the last third of the text
    replaced by as many characters from the next document's start; the :func:`next_documents`).
    """
    after = save(next_documents(docs.select("doc_id")), "next")
    sizes = docs.select("doc_id", F.length("text").alias("n")).groupBy("doc_id") \
        .agg(F.max("n").alias("n"))
    asked = after.join(sizes, "doc_id").select(
        F.col("next_id").alias("giver"), F.col("doc_id").alias("taker"),
        F.expr("n div 3").cast("int").alias("m"))
    # both joins read the same shuffle of the texts
    named = docs.where("doc_id is not null")
    given = named.join(asked, F.col("doc_id") == F.col("giver")).select(
        "taker", F.expr("substring(text, 1, m)").alias("piece")) \
        .groupBy("taker").agg(F.max("piece").alias("piece"))
    both = named.join(given, F.col("doc_id") == F.col("taker"), "left").drop("taker") \
        .unionByName(docs.where("doc_id is null").withColumn("piece", F.lit("")))
    own = F.length("text")
    return both.select(
        "doc_id", "text", own.cast("long").alias("n_chars"),
        F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 3 as int))"),
                 F.expr("substring(coalesce(piece, ''), 1, cast(length(text) div 3 as int))"))
        .alias("edited")), after


def imatch(docs: DataFrame, least_share: float = 0.0005, most_share: float = 0.1) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next), one row per row of ``docs(doc_id, text)``.

    A null text counts as empty.  Repeated rows come out alike (of different texts under
    one doc_id the larger piece or fingerprint stands for the id where it is another's
    next); a row without doc_id has no next document: its edited text ends early and
    near_next is null.  An empty table gives an empty result."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = save(lexicon(docs, least_share, most_share), "lexicon")
    both, after = with_edited(docs)
    found = fingerprints(both, words, {"text": "fingerprint", "edited": "edited_fingerprint"})
    found = save(found.select("doc_id", "n_chars", sha256_hex(F.col("edited")).alias(
        "edited_sha256"), "fingerprint", "edited_fingerprint"), "fingerprints")
    nexts = after.join(found.groupBy("doc_id").agg(F.max("fingerprint").alias("next"))
                       .withColumnRenamed("doc_id", "next_id"), "next_id").select("doc_id", "next")
    return found.join(nexts, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
