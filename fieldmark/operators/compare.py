"""Side-by-side comparison of two runs, per field and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.schemas import FIELD_PASS, FIELDS, TREND_EPS


def trend(delta: Column, eps: float = TREND_EPS) -> Column:
    """``better`` when delta > eps, ``worse`` when delta < -eps, else ``same``."""
    return (F.when(delta > F.lit(eps), "better").when(delta < F.lit(-eps), "worse")
            .otherwise("same"))


def compare_runs(primary: DataFrame, runs: DataFrame, baseline: str, candidate: str,
                 fields: list[str] = FIELDS, pass_threshold: float = FIELD_PASS) -> DataFrame:
    """One row per field plus an ``overall`` row: baseline / candidate mean and
    pass rate (score >= 0.5) and their deltas, with a trend class per delta.

    ``primary``: (run, example_id, field, score), first-wins applied.
    ``runs``: stored run scalars (run, mean_score, pass_rate); the overall row
    uses them as stored.  One conditional aggregate over both runs (no join of
    the runs against each other); a field a run never scored counts as 0.0."""
    both = primary.where(F.col("run").isin(baseline, candidate) & F.col("field").isin(*fields))
    is_b, is_c = F.col("run") == baseline, F.col("run") == candidate
    hit = (F.col("score") >= F.lit(pass_threshold)).cast("double")
    per_field = both.groupBy("field").agg(
        F.avg(F.when(is_b, F.col("score"))).alias("baseline_mean"),
        F.avg(F.when(is_c, F.col("score"))).alias("candidate_mean"),
        F.avg(F.when(is_b, hit)).alias("baseline_pr"),
        F.avg(F.when(is_c, hit)).alias("candidate_pr"),
    )
    dim = primary.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    per_field = dim.join(per_field, "field", "left").select(
        "field", *[F.coalesce(c, F.lit(0.0)).alias(c)
                   for c in ("baseline_mean", "candidate_mean", "baseline_pr", "candidate_pr")])
    r = runs.where(F.col("run").isin(baseline, candidate))
    overall = r.agg(
        F.max(F.when(F.col("run") == baseline, F.col("mean_score"))).alias("baseline_mean"),
        F.max(F.when(F.col("run") == candidate, F.col("mean_score"))).alias("candidate_mean"),
        F.max(F.when(F.col("run") == baseline, F.col("pass_rate"))).alias("baseline_pr"),
        F.max(F.when(F.col("run") == candidate, F.col("pass_rate"))).alias("candidate_pr"),
    ).select(F.lit("overall").alias("field"), "*")
    rows = per_field.unionByName(overall)
    return (rows
            .withColumn("delta_mean", F.col("candidate_mean") - F.col("baseline_mean"))
            .withColumn("delta_pr", F.col("candidate_pr") - F.col("baseline_pr"))
            .withColumn("trend_mean", trend(F.col("delta_mean")))
            .withColumn("trend_pr", trend(F.col("delta_pr")))
            .withColumn("delta_sign", F.when(F.col("delta_mean") > 0, "up").otherwise("down")))


def display_names(compare_rows: DataFrame) -> DataFrame:
    """Column titles of the comparison table."""
    return compare_rows.withColumnsRenamed({
        "field": "Scored field", "baseline_mean": "Mean before", "candidate_mean": "Mean after",
        "delta_mean": "Mean change", "baseline_pr": "Passed before",
        "candidate_pr": "Passed after", "delta_pr": "Passed change",
    })
