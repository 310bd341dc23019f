"""Scoring predictions as they arrive (Structured Streaming).

Predictions of a long run land over time; each micro-batch is paired with the
static golden set and scored with the same operators as a batch run.  The
column scorers (exact, inline similarity, list overlap) are stateless and run
on the streaming DataFrame itself; judged fields need their own jobs (distinct
pairs, verdict cache), so full evaluation runs per micro-batch in
``foreachBatch``.  Each batch's output goes to its own ``batch_id=<n>``
folder, overwritten on replay, so a restarted query never double counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmark.operators.aggregate import run_summary
from fieldmark.operators.materialize import materialize
from fieldmark.operators.pair import flatten_golden, flatten_predictions
from fieldmark.operators.score import (
    FieldSpec, add_overall, declares, field_results_array, score_fields, takes_pairs)
from fieldmark.plans.evaluate import evaluate
from fieldmark.session import free_scratch, recorded_scratch


def score_columns_stream(predictions: DataFrame, golden: DataFrame,
                         specs: list[FieldSpec]) -> DataFrame:
    """Streaming pairs scored by column scorers only (stream-static join on
    example_id; no state is kept)."""
    for s in specs:
        if takes_pairs(s.scorer) and declares(s.scorer, "batched", True):
            raise ValueError(f"{s.field}: {s.scorer.name} needs evaluate_stream (foreachBatch)")
    paired = flatten_predictions(predictions).join(flatten_golden(golden), "example_id")
    scored = add_overall(score_fields(paired, specs), specs)
    return scored.withColumn("field_results", field_results_array(specs))


def evaluate_stream(predictions: DataFrame, golden: DataFrame, specs: list[FieldSpec],
                    sink: str, checkpoint_location: str, available_now: bool = False,
                    processing_time: str | None = None) -> StreamingQuery:
    """Start a query that scores every micro-batch of ``predictions`` and
    writes the per-example rows (artifact layout) under ``sink/examples``.

    A prediction whose id the golden set lacks goes to ``sink/unmatched``; one
    sent twice inside a batch is scored once (as is one sent in two batches, in
    ``stream_summary``)."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        with recorded_scratch() as made:
            # writes once what three jobs read; a batch holds some of the examples
            # of predictions that differ the first in the order of their JSON, so that a
            # replay writes the same rows
            row = F.struct(*batch.columns)
            once = materialize(batch.groupBy("run", "example_id").agg(
                F.min_by(row, F.to_json(row)).alias("row")).select("row.*"), "stream_batch")
        (once.join(golden.select(F.col("id").alias("example_id")), "example_id", "left_anti")
         .select("run", "example_id").write.mode("overwrite")
         .parquet(f"{sink}/unmatched/batch_id={batch_id}"))
        with evaluate(golden, once, specs, missing="drop", bad_answers="fail") as ev:
            (ev.scored.select("run", "example_id", "category", "field_results", "overall_score",
                              "passed", "latency_ms", "total_tokens")
             .write.mode("overwrite").parquet(f"{sink}/examples/batch_id={batch_id}"))
        free_scratch(batch.sparkSession, made)

    writer = (predictions.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_summary(spark: SparkSession, sink: str) -> DataFrame:
    """Run summary over everything the stream has written so far; of a prediction
    sent in several batches the first one counts."""
    rows = spark.read.parquet(f"{sink}/examples").groupBy("run", "example_id").agg(
        F.min_by(F.struct("overall_score", "passed", "latency_ms", "total_tokens"), "batch_id")
        .alias("first"))
    return run_summary(rows.select("run", "example_id", "first.*"))
