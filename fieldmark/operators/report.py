"""Report tables: per-example score table and the failure breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import reshape as rs
from fieldmark.operators.reshape import first_wins, pivot_fields
from fieldmark.schemas import FIELDS


def example_table(long: DataFrame, examples: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row per run and example: category, the first-wins score of each field
    (0.0 where a field has no result), overall score and passed.

    ``long``: field results (run, example_id, pos, field, ...); ``examples``:
    (run, example_id, category, overall_score, passed).  The pivot is a
    ``groupBy`` on (run, example_id) with an explicit field list; the results are dealt by
    these keys first, which serves first-wins, pivot and join with one shuffle of them."""
    dealt = long.select("run", "example_id", "pos", "field", "score").repartition("run", "example_id")
    wide = pivot_fields(first_wins(dealt, score_only=True), ["run", "example_id"], fields)
    out = examples.select("run", "example_id", "category", "overall_score", "passed").join(
        wide, ["run", "example_id"], "left")
    return out.select(
        "run", "example_id", F.coalesce(F.col("category"), F.lit("")).alias("category"),
        *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in fields],
        "overall_score", "passed")


def example_table_wide(scored: DataFrame, firsts: dict[str, str], fields: list[str] = FIELDS
                       ) -> DataFrame:
    """Same table from wide scored rows, where first-wins is already resolved:
    a projection, no shuffle."""
    return scored.select(
        "run", "example_id", F.coalesce(F.col("category"), F.lit("")).alias("category"),
        *[(F.coalesce(F.col(firsts[f])["score"], F.lit(0.0)) if f in firsts else F.lit(0.0)).alias(f)
          for f in fields],
        "overall_score", "passed")


def example_table_nested(examples: DataFrame, fields: list[str] = FIELDS,
                         field_results_col: str = "field_results") -> DataFrame:
    """Same table from per-example rows holding the nested field results (the
    artifact layout): first-wins inside each row, then a map lookup per field.
    The pivot happens within the row, so nothing is shuffled."""
    firsts = rs.first_wins_nested(F.col(field_results_col))
    scores = F.map_from_arrays(F.transform(firsts, lambda x: x["field"]),
                               F.transform(firsts, lambda x: x["result"]["score"]))
    return examples.select(
        "run", "example_id", F.coalesce(F.col("category"), F.lit("")).alias("category"),
        *[F.coalesce(F.element_at(scores, F.lit(f)), F.lit(0.0)).alias(f) for f in fields],
        "overall_score", "passed")


def failures(scored: DataFrame, field_results_col: str = "field_results") -> DataFrame:
    """Every failed field result (all entries, no first-wins) of every failed
    example: example, field, scorer, score, reason (``''`` when none)."""
    failed = F.filter(F.col(field_results_col), lambda x: ~x["result"]["passed"])
    return (scored.where(~F.col("passed"))
            .select("run", F.col("example_id").alias("example"), F.explode(failed).alias("fr"))
            .select("run", "example", F.col("fr.field").alias("field"),
                    F.col("fr.scorer").alias("scorer"), F.col("fr.result.score").alias("score"),
                    F.coalesce(F.col("fr.result.reason"), F.lit("")).alias("reason")))
