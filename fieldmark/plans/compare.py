"""Comparison of two stored runs (the side-by-side report).

Reads the run summaries, picks the default pair (oldest as baseline, newest as
candidate) when none is named, reads only those two runs' example partitions
(partition pruning on ``run``), applies first-wins inside each example row and
compares per field and overall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.compare import compare_runs
from fieldmark.operators.reshape import first_wins_nested, melt_means
from fieldmark.schemas import FIELDS
from fieldmark.sources.artifacts import pick_runs, read_run_examples, read_run_summaries


@dataclass
class Comparison:
    baseline: str
    candidate: str
    rows: DataFrame      # field, means, pass rates, deltas, trends (+ overall)
    melted: DataFrame    # field, model, mean_score (fields only)


def compare_stored_runs(spark: SparkSession, root: str, baseline: str | None = None,
                        candidate: str | None = None, fields: list[str] = FIELDS,
                        fmt: str = "json") -> Comparison:
    runs = read_run_summaries(spark, root, fmt)
    if baseline is None or candidate is None:
        oldest, newest = pick_runs(runs)
        baseline, candidate = baseline or oldest, candidate or newest
    examples = read_run_examples(spark, root, [baseline, candidate], fmt)
    primary = (examples.select("run", "example_id",
                               F.inline(first_wins_nested(F.col("field_results"))))
               .select("run", "example_id", "field", F.col("result.score").alias("score")))
    rows = compare_runs(primary, runs, baseline, candidate, fields)
    return Comparison(baseline, candidate, rows, melt_means(rows))
