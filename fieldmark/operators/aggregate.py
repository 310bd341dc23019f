"""Roll-ups of scored examples: per run, per field, per category.

Every aggregate here is a ``groupBy`` over a handful of low-cardinality keys
(run, field, category), so Spark aggregates partially inside each map task
and shuffles only one row per key per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.schemas import FIELD_PASS


def run_summary(examples: DataFrame) -> DataFrame:
    """One row per run: examples, passed, mean overall, pass rate, mean latency,
    total tokens.  A run with no examples has no row."""
    return examples.groupBy("run").agg(
        F.count("*").alias("n_examples"),
        F.count_if(F.col("passed")).alias("n_passed"),
        F.avg("overall_score").alias("mean_score"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"),
    )


def field_stats(primary: DataFrame, pass_threshold: float = FIELD_PASS,
                keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Mean score and share of scores >= ``pass_threshold`` per (run, field).

    ``primary`` holds one score per run, example and field (first-wins
    already applied).  Fields without scores have no row; ``complete_fields``
    fills them with 0.0 where a report wants every field."""
    return primary.groupBy(*keys, "field").agg(
        F.count("score").alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg((F.col("score") >= F.lit(pass_threshold)).cast("double")).alias("pass_rate"),
    )


def complete_fields(stats: DataFrame, fields: list[str], runs: DataFrame) -> DataFrame:
    """Every (run, field) of ``fields``; a field never scored gets 0.0 mean and
    pass rate.  The (run x field) frame is built with ``explode`` on the
    small table of runs, not with a join."""
    dim = runs.select("run").distinct().withColumn(
        "field", F.explode(F.array(*[F.lit(f) for f in fields])))
    return (dim.join(stats, ["run", "field"], "left")
            .select("run", "field",
                    F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
                    F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate")))


def field_means_all_entries(long: DataFrame) -> DataFrame:
    """Mean per (run, field) over *all* field results (no first-wins)."""
    return long.groupBy("run", "field").agg(F.avg("score").alias("mean_score"),
                                            F.count("*").alias("n"))


def score_distribution(primary: DataFrame, exact: bool = True) -> DataFrame:
    """Min, quartiles and max of the scores per (run, field).

    ``exact`` uses ``percentile`` (linear interpolation; its state is a map of
    distinct value -> count, bounded by the distinct scores, not the rows);
    ``exact=False`` uses the mergeable sketch ``percentile_approx``."""
    if exact:
        q = F.percentile(F.col("score"), [0.25, 0.5, 0.75])
    else:
        q = F.percentile_approx(F.col("score"), [0.25, 0.5, 0.75], 10000)
    return (primary.groupBy("run", "field")
            .agg(F.min("score").alias("min_score"), q.alias("_q"), F.max("score").alias("max_score"))
            .select("run", "field", "min_score",
                    F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q75"), "max_score"))


def category_counts(golden: DataFrame) -> DataFrame:
    """Golden examples per category."""
    return golden.groupBy("category").agg(F.count("*").alias("n"))


def category_breakdown(primary_with_category: DataFrame, pass_threshold: float = FIELD_PASS
                       ) -> DataFrame:
    """Mean score, pass rate and count over GROUPING SETS ((run), (run, category),
    (run, field), (run, category, field)); ``level`` names the set.

    The scored rows are aggregated once, to sums and counts per (run, category, field);
    the other sets roll up those few rows."""
    cells = primary_with_category.groupBy("run", "category", "field").agg(
        F.count("score").alias("n"), F.sum("score").alias("total"),
        F.count_if(F.col("score") >= F.lit(pass_threshold)).alias("hits"))
    gid = F.grouping_id()  # bits: run (always grouped), category, field
    return (cells.groupingSets([["run"], ["run", "category"], ["run", "field"],
                                ["run", "category", "field"]], "run", "category", "field")
            .agg(F.sum("n").alias("n"),
                 F.try_divide(F.sum("total"), F.sum("n")).alias("mean_score"),
                 F.try_divide(F.sum("hits"), F.sum("n")).cast("double").alias("pass_rate"),
                 gid.alias("_gid"))
            .withColumn("level", F.when(F.col("_gid") == 3, "run")
                        .when(F.col("_gid") == 1, "run_category")
                        .when(F.col("_gid") == 2, "run_field")
                        .otherwise("run_category_field"))
            .drop("_gid"))
