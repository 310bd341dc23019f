"""Quantiles of a run's measures from mergeable sketches.

A sketch of bounded size (KLL) stands for all values of one measure of one run.  Sketches are
partial aggregates, so a run is sketched in one pass with a sketch per group and task in the
shuffle, never a value; stored with the run (``sources/artifacts``), they are merged on
reading, so runs are compared, or put together, without another scan of their examples.
Compaction is random: merging the same sketches again may give other quantiles, within the
stated error.  Write them (``materialize``) where several jobs must see the same ones.
``score_distribution`` and ``latency_p95`` stay as the exact way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.joins import join_small_side
from fieldmark.operators.reshape import first_wins_nested

#: Size parameter of the sketches: about 0.3 % of rank error, some 10 to 20 KB a sketch.
SKETCH_K = 1024
SKETCH_KEYS = ("run", "field", "measure")


def rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of one quantile, kept with a probability of 99 % (the published
    fit for this sketch; merging does not add to it)."""
    return 2.296 / k ** 0.9723


def measure_values(examples: DataFrame) -> DataFrame:
    """(run, field, measure, value) of example rows with nested ``field_results``: the first
    score of each field, and under field ``*`` overall score, latency and tokens.  A per-row
    generator; absent values have no row."""
    scores = F.transform(first_wins_nested(F.col("field_results")), lambda x: F.struct(
        x["field"].alias("field"), F.lit("score").alias("measure"),
        x["result"]["score"].cast("double").alias("value")))
    whole = F.array(*[F.struct(F.lit("*").alias("field"), F.lit(c).alias("measure"),
                               F.col(c).cast("double").alias("value"))
                      for c in ("overall_score", "latency_ms", "total_tokens")])
    none = F.array().cast("array<struct<field:string,measure:string,value:double>>")
    return examples.select("run", F.inline(F.concat(F.coalesce(scores, none), whole))) \
        .where("value IS NOT NULL")


def sketch(values: DataFrame, keys: tuple[str, ...] = SKETCH_KEYS, k: int = SKETCH_K) -> DataFrame:
    """Count, least and greatest value and sketch of ``value`` per ``keys``."""
    return values.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merge(sketches: DataFrame, keys: tuple[str, ...], k: int = SKETCH_K) -> DataFrame:
    """Sketches put together over all columns but ``keys``."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("n"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A row per sketch and share: ``value``, with about that share of the values at or below."""
    rest = [c for c in sketches.columns if c != "sketch"]
    found = F.array(*[F.struct(F.lit(float(p)).alias("share"), F.kll_sketch_get_quantile_double(
        "sketch", F.lit(float(p))).alias("value")) for p in shares])
    return sketches.select(*rest, F.inline(found))


def rank_gaps(values: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How far each quantile's share lies outside the ranks its value really has among
    ``values`` (0.0: inside).  One scan; the quantiles, an array per group, go to the rows."""
    tall = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "share", F.col("value").alias("at")))).alias("marks"))  # a short list of shares a group
    n_marks = found.select("share").distinct().count()

    def tally(cond) -> list[Column]:
        return [F.count_if(cond(F.get("marks", F.lit(i))["at"])) for i in range(n_marks)]

    ranks = join_small_side(values.select(*keys, "value"), tall, list(keys)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("marks").alias("marks"),
        F.array(*tally(lambda at: F.col("value") < at)).alias("below"),
        F.array(*tally(lambda at: F.col("value") <= at)).alias("upto"))
    share = F.col("mark.share")
    return ranks.select(*keys, "n", F.inline(F.arrays_zip(
        F.col("marks").alias("mark"), "below", "upto"))).select(
        *keys, "n", share.alias("share"), F.col("mark.at").alias("value"),
        F.greatest(F.lit(0.0), F.col("below") / F.col("n") - share,
                   share - F.col("upto") / F.col("n")).alias("gap"))


def shifts(sketches: DataFrame, baseline: str, candidate: str,
           shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Quantiles of two runs side by side, with the candidate's change; reads sketches only.
    A measure that one of the runs lacks has nulls there."""
    both = [quantiles(sketches.where(F.col("run") == run), shares).select(
        "field", "measure", "share", F.col("value").alias(name))
        for run, name in ((baseline, "baseline"), (candidate, "candidate"))]
    return reduce(lambda a, b: a.join(b, ["field", "measure", "share"], "full"), both) \
        .withColumn("delta", F.col("candidate") - F.col("baseline"))
