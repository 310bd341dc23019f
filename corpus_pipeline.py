"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of documents.  Each result is written as Parquet and read
again as the next stage's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import lower_az, save, sha256_hex
from fieldmark.llm.exact_dedup import exact_dedup
from fieldmark.llm.jaccard_join import near_groups
from fieldmark.llm.language import fold, score, train
from fieldmark.llm.packing import pack
from fieldmark.llm.substring_dedup import remove_repeats
from fieldmark.sources.tables import read_table

#: Tokenizers, joins by word and recursion over pairs are beyond DuckDB: tests hold the
#: stages against brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: without letters (or null), or unlike all
    learnt languages.  The ``lang`` column stays as given.  Repeated rows are judged alike; a
    table without labelled rows stays as it is."""
    model = train(docs.where(fold(F.col("doc_id")) != 1))
    if model is None:  # nothing to compare with, so nothing is rejected
        return docs.select(*COLUMNS)
    return score(docs, model, keep=COLUMNS) \
        .where("not rejected").select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose (doc_id, key) is not in ``gone``; no id equals no id."""
    other = gone.select(F.col("doc_id").alias("gone_id"), F.col(key).alias("gone_key"))
    return docs.join(other, (F.col(key) == F.col("gone_key"))
                     & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased, null as empty), the one with the largest
    doc_id, once; one without doc_id only if none of them has an id.  A doc_id that comes
    with several texts is a document in each group.  An empty table stays empty."""
    digest = sha256_hex(lower_az(F.coalesce("text", F.lit(""))))
    rows = _without(docs.withColumn("text_sha256", digest),
                    exact_dedup(docs).where("not kept"), "text_sha256")
    # rows that repeat an id and its text: one of each, the others stay out of the shuffle
    several = save(docs.select("doc_id", digest.alias("text_sha256"))
                   .groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
                   .where("n > 1").select("doc_id", "text_sha256"), "repeats")
    again = several.withColumnsRenamed({"doc_id": "again_id", "text_sha256": "again_key"})
    once = rows.join(again, (F.col("text_sha256") == F.col("again_key"))
                     & F.col("doc_id").eqNullSafe(F.col("again_id")), "left_semi") \
        .groupBy("doc_id", "text_sha256").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return _without(rows, several, "text_sha256").select(*COLUMNS) \
        .unionByName(once.select("row.*"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id (one without doc_id
    only if none has an id; of texts with one id the one with the smallest hash).  Null texts
    and those without words are no copies of anything.  An empty table stays empty."""
    found = near_groups(docs).where("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    stays = found.groupBy("component").agg(F.min(key).alias("stays"))
    gone = found.join(stays, "component").where(key != F.col("stays")) \
        .select("doc_id", "text_hash").distinct()
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    return _without(docs.withColumn("text_hash", text_hash), gone, "text_hash").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in 20-word windows that occur earlier; texts without any stay as they
    are (null as empty), the others are the words left, joined by one space.  Rows without
    doc_id keep all words.  An empty table stays empty."""
    found = remove_repeats(docs, keep=("lang", "source", "n_chars"), keep_untouched=True)
    return found.select("doc_id", "text", "lang", "source",
                        F.when(F.col("n_removed") == 0, F.col("n_chars"))
                        .otherwise(F.length("text").cast("long")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in a sequence of at most 4096; a null or empty text is its
    end alone.  Rows that repeat are packed each, an empty table has no sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies),
          ("jaccard_join", near_copies), ("substring_dedup", repeated_passages),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
