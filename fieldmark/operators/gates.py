"""Quality gates and the abstention (hallucination) check.

Every measure is an exact aggregate with constant-size state (avg, max,
count), so a gate over a huge run is a partial aggregation and never holds a
group's values in one task.  The latency percentile target is checked in its
equivalent counting form: the nearest-rank 95th percentile is below B exactly
when at least 95% of the examples are below B.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.schemas import FIELDS, RUN_GATE_FIELD_MEAN, RUN_GATE_PASS_RATE, SPARSE_CATEGORY

# ---------------------------------------------------------------------------
# Targets of the extraction task.
# (gate, field, measure, op, bound); field '*' is a run-level measure.
# ---------------------------------------------------------------------------
LATENCY_BOUND_MS = 10000.0
TOKENS_BOUND = 2000
DEFAULT_TARGETS = (
    [("run_gate", "*", "pass_rate", ">=", RUN_GATE_PASS_RATE)]
    + [("field_gate", f, "mean_all", ">=", RUN_GATE_FIELD_MEAN) for f in FIELDS]
    + [
        ("target", "title", "mean", ">=", 0.85),
        ("target", "seniority", "mean", ">=", 0.80),
        ("target", "work_mode", "mean", ">=", 0.95),
        ("target", "location", "mean", ">=", 0.60),
        ("target", "skills", "mean", ">=", 0.80),
        ("target", "*", "mean_score", ">=", 0.80),
        ("target", "*", "pass_rate", ">=", 0.85),
        ("target", "*", "share_latency_below_bound", ">=", 0.95),
        ("target", "*", "max_tokens", "<", float(TOKENS_BOUND)),
    ]
)

def run_measures(examples: DataFrame, long: DataFrame, primary: DataFrame,
                 latency_bound_ms: float = LATENCY_BOUND_MS) -> DataFrame:
    """(run, field, measure, value) for every measure a target can name.

    Three narrow partial aggregations (run level, all entries, first entries).
    A single grouping-sets pass over the exploded entries was measured 2x
    slower: its Expand doubles the rows and every aggregate becomes
    conditional."""
    run_level = examples.groupBy("run").agg(
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.avg("overall_score").alias("mean_score"),
        F.avg((F.col("latency_ms") < F.lit(latency_bound_ms)).cast("double"))
        .alias("share_latency_below_bound"),
        F.max("total_tokens").cast("double").alias("max_tokens"),
    ).unpivot(["run"], ["pass_rate", "mean_score", "share_latency_below_bound", "max_tokens"],
              "measure", "value").withColumn("field", F.lit("*"))
    mean_all = (long.groupBy("run", "field").agg(F.avg("score").alias("value"))
                .withColumn("measure", F.lit("mean_all")))
    mean_first = (primary.groupBy("run", "field").agg(F.avg("score").alias("value"))
                  .withColumn("measure", F.lit("mean")))
    return run_level.unionByName(mean_all).unionByName(mean_first)


def gates(measures: DataFrame, targets=DEFAULT_TARGETS) -> DataFrame:
    """Each target (configuration: a short list of tuples) checked against its
    measure for every run.  Targets are attached to the runs with ``inline``
    of a literal array, a per-row generator rather than a join; a target whose
    measure is missing (e.g. a field never scored) fails with a null value.
    The few measures of a run become one map first, so they are read once."""
    lit_targets = F.array(*[
        F.struct(F.lit(g).alias("gate"), F.lit(f).alias("field"), F.lit(m).alias("measure"),
                 F.lit(o).alias("op"), F.lit(float(b)).alias("bound"))
        for g, f, m, o, b in targets])
    of_run = measures.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("/", "field", "measure"), "value"))).alias("_measures"))
    joined = of_run.select("run", "_measures", F.inline(lit_targets)).select(
        "run", "field", "measure", "gate", "op", "bound",
        F.try_element_at("_measures", F.concat_ws("/", "field", "measure")).alias("value"))
    ok = (F.when(F.col("op") == ">=", F.col("value") >= F.col("bound"))
          .when(F.col("op") == ">", F.col("value") > F.col("bound"))
          .when(F.col("op") == "<", F.col("value") < F.col("bound"))
          .when(F.col("op") == "<=", F.col("value") <= F.col("bound")))
    return joined.withColumn("passed", F.coalesce(ok, F.lit(False)))


def latency_p95(examples: DataFrame, percent: int = 95) -> DataFrame:
    """(run, n, p95_latency_ms): the nearest-rank percentile as a value, exact.

    Counts per whole millisecond find the millisecond that holds the rank; only
    the distinct values inside it are then counted.  The windows run over
    counts, never over rows."""
    timed = examples.where("latency_ms IS NOT NULL").select(
        "run", "latency_ms", F.floor("latency_ms").alias("ms"))
    up_to = W.partitionBy("run").orderBy("ms")
    whole = W.partitionBy("run")
    bins = timed.groupBy("run", "ms").agg(F.count("*").alias("k")).select(
        "run", "ms", "k", F.sum("k").over(up_to).alias("upto"), F.sum("k").over(whole).alias("n"))
    rank = F.expr(f"(n * {int(percent)} + 99) div 100")
    at = bins.withColumn("rank", rank).where("upto >= rank AND upto - k < rank") \
        .select("run", "ms", "n", (F.col("rank") - (F.col("upto") - F.col("k"))).alias("left"))
    values = timed.join(at, ["run", "ms"]) \
        .groupBy("run", "n", "left", "latency_ms").agg(F.count("*").alias("k"))
    seen = F.sum("k").over(W.partitionBy("run").orderBy("latency_ms"))
    return values.withColumn("upto", seen).where(F.col("upto") >= F.col("left")) \
        .groupBy("run", "n").agg(F.min("latency_ms").alias("p95_latency_ms"))


def failing_fields(long: DataFrame, threshold: float = RUN_GATE_FIELD_MEAN) -> DataFrame:
    """Fields whose mean over all entries is below ``threshold`` (the offenders)."""
    return (long.groupBy("run", "field").agg(F.avg("score").alias("mean_score"))
            .where(F.col("mean_score") < F.lit(threshold)))


def hallucinations(scored: DataFrame, fields: tuple[str, ...] = ("location", "skills"),
                   category: str = SPARSE_CATEGORY) -> DataFrame:
    """Examples of the abstention subset whose ``fields`` scored exactly 0.0.

    ``strict`` marks the narrower reading: expected null/empty and predicted
    non-empty (a real hallucination rather than any miss)."""
    parts = []
    for f in fields:
        e, a = F.col(f"e_{f}"), F.col(f"a_{f}")
        if isinstance(scored.schema[f"e_{f}"].dataType, T.ArrayType):
            e_empty, a_empty = e.isNull() | (F.size(e) == 0), a.isNull() | (F.size(a) == 0)
        else:
            e_empty, a_empty = e.isNull() | (F.length(e) == 0), a.isNull() | (F.length(a) == 0)
        parts.append(F.when(F.col(f)["score"] == 0.0,
                            F.struct(F.lit(f).alias("field"), (e_empty & ~a_empty).alias("strict"))))
    hits = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return (scored.where(F.col("category") == category)
            .select("run", "example_id", F.explode(hits).alias("h"))
            .select("run", "example_id", "h.field", "h.strict"))


def status_flags(examples: DataFrame, primary: DataFrame,
                 run_pass_rate: float = RUN_GATE_PASS_RATE,
                 field_mean: float = RUN_GATE_FIELD_MEAN) -> DataFrame:
    """Green/red flags of a run report: the run is green when its pass rate is
    at least 0.7 (field ``'*'``), a field when its first-wins mean is at least
    0.5.  One row per (run, field) with the value the flag was decided on."""
    runs = examples.groupBy("run").agg(F.avg(F.col("passed").cast("double")).alias("value")) \
        .select("run", F.lit("*").alias("field"), "value",
                F.when(F.col("value") >= F.lit(run_pass_rate), "green").otherwise("red")
                .alias("status"))
    fields = primary.groupBy("run", "field").agg(F.avg("score").alias("value")) \
        .select("run", "field", "value",
                F.when(F.col("value") >= F.lit(field_mean), "green").otherwise("red")
                .alias("status"))
    return runs.unionByName(fields)
