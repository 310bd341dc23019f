"""Batch inference: prompts built from golden inputs, sent to a user-supplied
model callable in Arrow batches (``mapInPandas``), structured answers parsed
with ``from_json``.

The callable gets a pandas DataFrame (``example_id, raw_title,
raw_description, prompt``) and returns one with ``job_info`` (JSON text of the
record) and optionally ``latency_ms`` and ``total_tokens``; missing latency is
measured around the call, missing token usage counts as 0.  ``concurrency``
sets how many partitions (so how many callers) run at once.  Persist the
result before scoring: a lost task would otherwise call the model again.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from fieldmark.operators.validate import DEFAULT_DOMAINS
from fieldmark.schemas import JOB_INFO

ModelFn = Callable[[pd.DataFrame], pd.DataFrame]

ANSWER = T.StructType(JOB_INFO.fields + [T.StructField("_corrupt", T.StringType())])

CALL_OUT = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("job_info_json", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
])

#: What a model callable gets, and a stored answer.
REQUEST = ["example_id", "raw_title", "raw_description", "prompt"]
STORED = T.StructType([T.StructField("request_key", T.StringType()), *CALL_OUT.fields[1:],
                       T.StructField("run", T.StringType())])


def prompt(raw_title: Column, raw_description: Column) -> Column:
    """``Title: <t>\\n\\nDescription:\\n<d>``."""
    return F.concat(F.lit("Title: "), raw_title, F.lit("\n\nDescription:\n"), raw_description)


def _caller(fn: ModelFn, key: str = "example_id"):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            t0 = time.monotonic()
            out = fn(b[REQUEST])
            elapsed = (time.monotonic() - t0) * 1000.0 / len(b)
            latency = out["latency_ms"] if "latency_ms" in out else pd.Series(elapsed, index=b.index)
            tokens = out["total_tokens"] if "total_tokens" in out else pd.Series(0, index=b.index)
            yield pd.DataFrame({
                key: b[key].values,
                "job_info_json": out["job_info"].values,
                "latency_ms": pd.Series(latency).astype("float64").values,
                "total_tokens": pd.Series(tokens).fillna(0).astype("int64").values,
            })
    return run


def request_key() -> Column:
    """SHA-256 of a request's example and texts (as JSON, so that parts cannot run together)."""
    return F.sha2(F.to_json(F.struct("example_id", "raw_title", "raw_description")), 256)


def read_answers(spark: SparkSession, store: str, run: str) -> DataFrame | None:
    """A run's stored answers, or None if there is no store yet; a key can occur twice."""
    try:
        return spark.read.schema(STORED).parquet(store).where(F.col("run") == run)
    except AnalysisException as e:
        if (e.getCondition() or "") == "PATH_NOT_FOUND":
            return None
        raise


def _stored_answers(req: DataFrame, fn: ModelFn, run: str, store: str,
                    concurrency: int | None) -> DataFrame:
    """Answers to every request: those in the store, and the others asked now and stored.

    Each task's answers become part of the store when the task commits (the committer's second
    algorithm), not with the job, so a job that breaks keeps what its finished tasks paid for.
    A task commit that breaks half-way can leave a key twice; one answer a key is read."""
    spark = req.sparkSession
    keyed = req.withColumn("request_key", request_key())
    parts = concurrency or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of partitions, which adaptive execution does not merge: one shuffle of
    # the texts serves the distinct requests and the join with the answers known
    asked = keyed.repartition(parts, "request_key").dropDuplicates(["request_key"])
    known = read_answers(spark, store, run)
    if known is not None:
        asked = asked.join(known.select("request_key"), "request_key", "left_anti")
    schema = T.StructType([T.StructField("request_key", T.StringType()), *CALL_OUT.fields[1:]])
    asked.mapInPandas(_caller(fn, "request_key"), schema) \
        .where("job_info_json IS NOT NULL").withColumn("run", F.lit(run)) \
        .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2") \
        .partitionBy("run").parquet(store)
    wanted = keyed.select("example_id", "request_key")
    one = read_answers(spark, store, run) \
        .join(wanted.select("request_key"), "request_key", "left_semi") \
        .groupBy("request_key").agg(F.min(F.struct(*CALL_OUT.names[1:])).alias("one"))
    return wanted.join(one, "request_key", "left").select("example_id", "one.*")


def predict(golden: DataFrame, fn: ModelFn, run: str, concurrency: int | None = None,
            persist: bool = True, domains: dict[str, list[str]] = DEFAULT_DOMAINS,
            store: str | None = None) -> DataFrame:
    """Predictions (``PREDICTIONS`` layout) for every golden example, plus
    ``answer_error``: null, or why the model's answer is not a valid record (not
    parseable, or a value outside ``domains``).

    ``persist`` writes the predictions to the shared folder before anything
    uses them: recomputing them would call the model again.

    ``store`` names a shared folder of answers by run and request: a request answered there is
    not asked again, so a run that broke goes on where its tasks ended.  Requests that repeat
    are asked once, one whose texts changed is asked anew.  An answer that cannot be parsed is
    an answer; a null one is none, is reported here and asked again by the next call."""
    req = golden.select(
        F.col("id").alias("example_id"),
        F.col("input")["raw_title"].alias("raw_title"),
        F.col("input")["raw_description"].alias("raw_description"),
        prompt(F.col("input")["raw_title"], F.col("input")["raw_description"]).alias("prompt"))
    if store:
        out = _stored_answers(req, fn, run, store, concurrency)
    else:
        if concurrency:
            req = req.repartition(concurrency)
        out = req.mapInPandas(_caller(fn), CALL_OUT)
    parsed = F.from_json("job_info_json", ANSWER, {"columnNameOfCorruptRecord": "_corrupt"})
    info = F.struct(*[parsed[f.name].alias(f.name) for f in JOB_INFO.fields])
    bad = parsed.isNull() | parsed["_corrupt"].isNotNull()
    preds = out.select(
        F.lit(run).alias("run"), "example_id",
        F.when(~bad, info.withField("skills", F.coalesce(info["skills"],
                                                          F.array().cast("array<string>"))))
        .alias("job_info"),
        "latency_ms",
        F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"),
        F.when(bad, F.lit("unparseable answer")).alias("answer_error"))
    preds = flag_answers(preds, domains)
    if persist:
        from fieldmark.operators.materialize import materialize

        preds = materialize(preds, "predictions")
    return preds


def flag_answers(preds: DataFrame, domains: dict[str, list[str]] = DEFAULT_DOMAINS) -> DataFrame:
    """``answer_error`` filled where a value lies outside its domain or the record is
    missing; errors already there stay."""
    known = F.col("answer_error") if "answer_error" in preds.columns else F.lit(None).cast("string")
    found = F.filter(F.array(*[
        F.when(~F.col("job_info")[f].isin(*values), F.lit(f"{f} not in domain"))
        for f, values in domains.items()]), lambda m: m.isNotNull())
    return preds.withColumn("answer_error", F.coalesce(
        known, F.when(F.col("job_info").isNull(), F.lit("missing job_info")),
        F.when(F.size(found) > 0, F.array_join(found, "; "))))


def documents_as_golden(docs: DataFrame) -> DataFrame:
    """``documents`` rows as golden inputs: the source and language as title,
    the whole text as description (no expected record)."""
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("category"),
        F.create_map(F.lit("raw_title"), F.concat_ws(" ", "source", "lang"),
                     F.lit("raw_description"), F.col("text")).alias("input"),
        F.lit(None).cast(JOB_INFO).alias("expected"),
        F.lit(None).cast("string").alias("notes"))


# ---------------------------------------------------------------------------
# A deterministic stand-in for a model (no network here).
# The skill words it recognises.
# ---------------------------------------------------------------------------
STUB_SKILLS = ["python", "sql", "spark", "java"]


def stub_extract(raw_title: str, raw_description: str, prompt_text: str) -> dict:
    """Rules over the whole text: title echoed; seniority 'senior' / 'junior'
    when the word occurs (senior first); work mode 'remote' when it occurs;
    no location; skills = recognised words that occur; latency 0.01 ms per
    prompt character; tokens = ceil(prompt characters / 4)."""
    d = raw_description.lower()
    seniority = "senior" if "senior" in d else ("junior" if "junior" in d else None)
    return {
        "job_info": json.dumps({
            "title": raw_title, "seniority": seniority,
            "work_mode": "remote" if "remote" in d else None, "location": None,
            "skills": [s for s in STUB_SKILLS if s in d]}),
        "latency_ms": len(prompt_text) * 0.01,
        "total_tokens": math.ceil(len(prompt_text) / 4),
    }


def stub_extractor(batch: pd.DataFrame) -> pd.DataFrame:
    rows = [stub_extract(t, d, p) for t, d, p in
            zip(batch["raw_title"], batch["raw_description"], batch["prompt"])]
    return pd.DataFrame(rows, index=batch.index)
