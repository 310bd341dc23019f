"""Streaming evaluation gives the batch result."""

from pyspark.sql import functions as F

from fieldmark.operators.judge import token_overlap_judge
from fieldmark.operators.score import ExactMatch, FieldSpec, FuzzyMatch, ListOverlap
from fieldmark.plans.evaluate import default_specs, evaluate
from fieldmark.schemas import PREDICTIONS
from fieldmark.session import scratch_path
from fieldmark.sources.fixtures import fixture
from fieldmark.streaming.evaluate_stream import evaluate_stream, score_columns_stream, stream_summary


def _summary(df):
    return sorted((r["run"], r["n_examples"], round(r["mean_score"], 12)) for r in df.collect())


def test_evaluate_stream_matches_batch(spark, sf_small):
    golden, preds = fixture(spark, sf_small)
    src = scratch_path(spark, "stream_src")
    preds.where("run = 'baseline'").write.parquet(f"{src}/part=1")
    preds.where("run = 'candidate'").write.parquet(f"{src}/part=2")
    stream = spark.readStream.schema(PREDICTIONS).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    specs = default_specs("stub", token_overlap_judge)
    sink = scratch_path(spark, "stream_sink")
    q = evaluate_stream(stream, golden, specs, sink, scratch_path(spark, "stream_ckpt"),
                        available_now=True)
    q.awaitTermination(300)
    batch = evaluate(golden, preds, specs).summary()
    assert _summary(stream_summary(spark, sink)) == _summary(batch)


def test_column_scorers_on_stream(spark, sf_small):
    golden, preds = fixture(spark, sf_small)
    src = scratch_path(spark, "stream_src2")
    preds.write.parquet(src)
    specs = [FieldSpec("seniority", ExactMatch()), FieldSpec("work_mode", ExactMatch()),
             FieldSpec("location", FuzzyMatch(dedupe=False)), FieldSpec("skills", ListOverlap())]
    stream = spark.readStream.schema(PREDICTIONS).parquet(src)
    out = score_columns_stream(stream, golden, specs)
    q = (out.select("run", "example_id", "overall_score").writeStream.format("memory")
         .queryName("scored_stream").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT run, avg(overall_score) AS m, count(*) AS n FROM scored_stream GROUP BY run")
    ev = evaluate(golden, preds, specs, persist=False)
    want = ev.examples.groupBy("run").agg(F.avg("overall_score").alias("m"), F.count("*").alias("n"))
    norm = lambda df: sorted((r["run"], round(r["m"], 12), r["n"]) for r in df.collect())
    assert norm(got) == norm(want)
