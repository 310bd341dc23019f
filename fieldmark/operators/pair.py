"""Pairing expected with predicted records (one row per run and example)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.schemas import FIELDS


def empty_list():
    return F.array().cast("array<string>")


def _field(struct_col: str, f: str):
    c = F.col(struct_col)[f]
    return F.coalesce(c, empty_list()) if f == "skills" else c


def flatten_golden(golden: DataFrame) -> DataFrame:
    """``GOLDEN`` rows -> example_id, category, e_<field> (skills default ``[]``)."""
    return golden.select(
        F.col("id").alias("example_id"),
        "category",
        *[_field("expected", f).alias(f"e_{f}") for f in FIELDS],
    )


def flatten_predictions(predictions: DataFrame) -> DataFrame:
    """``PREDICTIONS`` rows -> run, example_id, a_<field>, latency_ms, total_tokens, and
    ``answer_error`` where the predictions carry it.

    Missing latency counts as 0.0 and missing token usage as 0."""
    return predictions.select(
        "run",
        "example_id",
        *[_field("job_info", f).alias(f"a_{f}") for f in FIELDS],
        F.coalesce(F.col("latency_ms"), F.lit(0.0)).alias("latency_ms"),
        F.coalesce(F.col("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        *[c for c in ("answer_error",) if c in predictions.columns],
    )


def pair(golden: DataFrame, predictions: DataFrame, missing: str = "error",
         runs: list[str] | None = None) -> DataFrame:
    """Join each golden example with its prediction of each run (equi-join on
    ``example_id``; ids are unique per side, so no key is hot).

    ``missing``: ``'error'`` (default) writes the joined rows once and raises
    unless every run predicts each golden example exactly once and nothing else
    (see ``check_pairs``); ``'drop'`` keeps matched pairs only; ``'null'`` keeps
    every golden example of each run with null predictions, latency 0.0 and no
    tokens, in one join.  ``runs`` names the runs of ``'null'``; by default they
    are those of ``predictions`` (one small row, so a run without any row has
    to be named)."""
    if missing == "drop":
        return flatten_predictions(predictions).join(flatten_golden(golden), "example_id")
    if missing == "error":
        from fieldmark.operators.materialize import materialize

        return matched(materialize(pair_all(golden, predictions), "pairing"), golden)
    if missing == "null":
        if runs:
            names = F.array(*[F.lit(r) for r in runs])
        else:
            names = predictions.agg(F.array_sort(F.collect_set("run")).alias("runs")).scalar()
        frame = (flatten_golden(golden).withColumn("_runs", names)
                 .withColumn("run", F.explode("_runs")).drop("_runs"))
        out = frame.join(flatten_predictions(predictions), ["run", "example_id"], "left")
        return (out.withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0)))
                .withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0).cast("bigint"))))
    raise ValueError(f"missing must be 'drop', 'error' or 'null', not {missing!r}")


def pair_all(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every prediction with its golden example; ``known`` is false where the
    golden set lacks the id.  Write it before :func:`matched` scans it."""
    g = flatten_golden(golden).withColumn("known", F.lit(True))
    return (flatten_predictions(predictions).join(g, "example_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))


def matched(joined: DataFrame, golden: DataFrame) -> DataFrame:
    """The rows of ``pair_all``, after :func:`check_pairs`."""
    check_pairs(joined, golden)
    return joined.drop("known")


def check_pairs(joined: DataFrame, golden: DataFrame) -> None:
    """Raise unless every run pairs each golden example exactly once and has no
    other id.  ``joined`` is the written table of :func:`pair_all`, which holds
    every prediction: a run without any match is in it too.

    One aggregation over (run, example_id), then a tiny one per run.  Duplicate
    golden ids are caught too (a run can then never reach the golden row count).
    Predictions without any row raise as well: there is no run to evaluate."""
    n_golden = golden.count()
    per_id = joined.groupBy("run", "example_id").agg(F.count("*").alias("k"),
                                                     F.min("known").alias("known"))
    per_run = per_id.groupBy("run").agg(
        F.count_if("known").alias("ids"), F.count_if(~F.col("known")).alias("strangers"),
        F.max("k").alias("most"))
    bad = ((F.col("ids") != n_golden) | (F.col("strangers") > 0) | (F.col("most") > 1))
    seen = per_run.agg(F.count("*").alias("runs"), F.min(F.when(bad, F.struct(
        "run", "ids", "strangers", "most"))).alias("bad")).first()
    if not seen["runs"]:
        raise ValueError("no predictions: there is no run to evaluate")
    b = seen["bad"]
    if b:
        raise ValueError(
            f"run {b['run']!r}: {b['ids']} distinct examples paired (an id at most {b['most']} "
            f"times), {b['strangers']} ids not in the golden set; expected each of {n_golden} "
            "golden rows once")


def duplicate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once (a pairing join would multiply their rows)."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def attach_category(reports: DataFrame, golden: DataFrame, order_col: str | None = None,
                    max_broadcast_rows: int | None = None) -> DataFrame:
    """Category of each example looked up from the golden set, ``''`` when absent.

    With duplicate golden ids the last one (largest ``order_col``) wins."""
    from fieldmark.operators.joins import DEFAULT_BROADCAST_ROWS, join_small_side

    if order_col is not None:
        lookup = golden.groupBy(F.col("id").alias("example_id")).agg(
            F.max_by("category", order_col).alias("_category"))
    else:
        lookup = golden.select(F.col("id").alias("example_id"), F.col("category").alias("_category"))
    out = join_small_side(reports, lookup, "example_id", "left",
                          max_rows=max_broadcast_rows or DEFAULT_BROADCAST_ROWS)
    return out.withColumn("category", F.coalesce(F.col("_category"), F.lit(""))).drop("_category")
