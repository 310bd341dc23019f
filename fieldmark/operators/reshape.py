"""First-wins dedupe, pivot and unpivot of field scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.schemas import FIELDS


def first_wins(long: DataFrame, keys: tuple[str, ...] = ("run", "example_id"),
               score_only: bool = False) -> DataFrame:
    """Keep the first result (smallest ``pos``) of each field of each example.

    ``min_by`` is an ordinary aggregate, so Spark reduces duplicates inside
    each map task before the shuffle on (keys, field).  With ``score_only`` the other
    columns of a result are left out, and numbers alone need no sort."""
    if score_only:
        return long.groupBy(*keys, "field").agg(F.min("pos").alias("pos"),
                                                F.min_by("score", "pos").alias("score"))
    res = F.min_by(F.struct("scorer", "score", "passed", "reason"), F.col("pos"))
    return (long.groupBy(*keys, "field")
            .agg(F.min("pos").alias("pos"), res.alias("_r"))
            .select(*keys, "pos", "field", "_r.scorer", "_r.score", "_r.passed", "_r.reason"))


def first_wins_nested(field_results: Column) -> Column:
    """First-wins inside one example's ``ARRAY<STRUCT<field, ...>>``: keep an
    entry when its field first occurs at its own position.  Per row, no shuffle."""
    names = F.transform(field_results, lambda x: x["field"])
    return F.filter(field_results,
                    lambda x, i: F.array_position(names, x["field"]) == (i + F.lit(1)))


def pivot_fields(primary: DataFrame, keys: list[str], fields: list[str] = FIELDS,
                 value: str = "score") -> DataFrame:
    """Long (keys, field, score) -> one row per keys with a column per field.
    The field list is explicit, so Spark skips the distinct-values job."""
    return primary.groupBy(*keys).pivot("field", fields).agg(F.first(value))


def unpivot_fields(wide: DataFrame, keys: list[str], fields: list[str] = FIELDS,
                   value: str = "score") -> DataFrame:
    """One column per field -> (keys, field, score): a per-row generator, no shuffle."""
    return wide.unpivot(keys, fields, "field", value)


def primary_scores(scored: DataFrame, firsts: dict[str, str],
                   keys: tuple[str, ...] = ("run", "example_id")) -> DataFrame:
    """Wide scored rows -> (keys, field, score, passed) of each field's first
    scorer; the wide layout already resolved first-wins, so this is narrow."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c)["score"].alias("score"),
                                 F.col(c)["passed"].alias("passed"))
                        for f, c in firsts.items()])
    return (scored.select(*keys, F.inline(entries)))


def melt_means(compare_rows: DataFrame) -> DataFrame:
    """(field, baseline_mean, candidate_mean) -> (field, model, mean_score) with
    ``model`` = ``baseline`` / ``candidate``; the ``overall`` row is left out."""
    fields_only = compare_rows.where(F.col("field") != "overall")
    melted = fields_only.unpivot(["field"], ["baseline_mean", "candidate_mean"], "model", "mean_score")
    return melted.withColumn("model", F.regexp_replace("model", "_mean", ""))


def field_order(field: Column | str, fields: list[str] = FIELDS) -> Column:
    """Display position of a field (1-based; fields outside the list sort last)."""
    f = F.col(field) if isinstance(field, str) else field
    pos = F.array_position(F.array(*[F.lit(x) for x in fields]), f)
    return F.when(pos > 0, pos).otherwise(F.lit(len(fields) + 1))


def in_display_order(df: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Rows ordered as reports show them: by run, then field order, then
    example id (a sort for presentation only; nothing inside the engine
    depends on row order)."""
    keys = [c for c in ("run",) if c in df.columns]
    if "field" in df.columns:
        keys.append(field_order("field", fields))
    keys += [c for c in ("example_id",) if c in df.columns]
    return df.orderBy(*keys)
