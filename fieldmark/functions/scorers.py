"""Scorer expressions: each returns ``STRUCT<score DOUBLE, passed BOOLEAN, reason STRING>``.

Null rules shared by the string scorers: both null -> 1.0, passed, no reason;
exactly one null -> 0.0, failed, reason ``expected=<repr>, actual=<repr>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.similarity import (
    indel_similarity,
    levenshtein_similarity,
    token_set_similarity,
)
from fieldmark.functions.text import as_col, format_2f, is_empty, mismatch_reason, norm


def null_string() -> Column:
    return F.lit(None).cast("string")


def result(score: Column, passed: Column, reason: Column | None = None) -> Column:
    return F.struct(
        score.cast("double").alias("score"),
        passed.cast("boolean").alias("passed"),
        (reason if reason is not None else null_string()).cast("string").alias("reason"),
    )


def exact_match(expected: Column | str, actual: Column | str,
                matched: Column | None = None) -> Column:
    """Case-insensitive, whitespace-trimmed equality of ``str()`` forms.

    ``matched`` may carry the normalised comparison computed once in a
    preceding projection (it is used by both score and passed)."""
    e, a = as_col(expected), as_col(actual)
    both_null = e.isNull() & a.isNull()
    one_null = e.isNull() | a.isNull()
    if matched is None:
        matched = norm(e) == norm(a)
    score = F.when(both_null, 1.0).when(one_null, 0.0).when(matched, 1.0).otherwise(0.0)
    passed = F.when(both_null, True).when(one_null, False).otherwise(matched)
    reason = F.when(~both_null & one_null, mismatch_reason(e, a))
    return result(score, passed, reason)


SIMILARITY = {
    "indel": indel_similarity,
    "levenshtein": levenshtein_similarity,
    "token_set": token_set_similarity,
}


def similarity_of(expected: Column, actual: Column, metric: str = "indel") -> Column:
    """Similarity of the lower-cased values (no strip), by metric name."""
    return SIMILARITY[metric](F.lower(expected.cast("string")), F.lower(actual.cast("string")))


def fuzzy_result(expected: Column | str, actual: Column | str, ratio: Column,
                 threshold: float) -> Column:
    """Wrap a precomputed similarity in the null rules and the pass threshold."""
    e, a = as_col(expected), as_col(actual)
    both_null = e.isNull() & a.isNull()
    one_null = e.isNull() | a.isNull()
    score = F.when(both_null, 1.0).when(one_null, 0.0).otherwise(ratio)
    passed = F.when(both_null, True).when(one_null, False).otherwise(ratio >= F.lit(threshold))
    reason = (F.when(both_null, null_string())
              .when(one_null, mismatch_reason(e, a))
              .otherwise(F.concat(F.lit("ratio="), format_2f(ratio))))
    return result(score, passed, reason)


def fuzzy_match(expected: Column | str, actual: Column | str, threshold: float = 0.8,
                metric: str = "indel") -> Column:
    """Similarity scorer computed inline on every row (no pair dedupe)."""
    e, a = as_col(expected), as_col(actual)
    return fuzzy_result(e, a, similarity_of(e, a, metric), threshold)


def judge_precheck(expected: Column | str, actual: Column | str,
                   dtype: T.DataType | None = None) -> Column:
    """Rules the judge applies before any model call.

    Returns a scorer result for pairs it settles (both null or both empty ->
    1.0 passed; one empty -> 0.0 failed with a reason) and null for pairs that
    need a verdict."""
    e, a = as_col(expected), as_col(actual)
    e_empty, a_empty = is_empty(e, dtype), is_empty(a, dtype)
    return (
        F.when(e_empty & a_empty, result(F.lit(1.0), F.lit(True)))
        .when(e_empty | a_empty, result(F.lit(0.0), F.lit(False), mismatch_reason(e, a, dtype)))
    )


def list_overlap(expected: Column | str, actual: Column | str, measure: str = "f1",
                 threshold: float = 0.5) -> Column:
    """Set overlap of two string lists (lower-cased, distinct): precision,
    recall, f1 or jaccard.  Both empty -> 1.0; one empty -> 0.0."""
    e, a = as_col(expected), as_col(actual)
    le = F.array_distinct(F.transform(F.coalesce(e, F.array().cast("array<string>")), F.lower))
    la = F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower))
    inter = F.size(F.array_intersect(le, la)).cast("double")
    n_e, n_a = F.size(le).cast("double"), F.size(la).cast("double")
    union = F.size(F.array_union(le, la)).cast("double")
    if measure == "precision":
        value = inter / n_a
    elif measure == "recall":
        value = inter / n_e
    elif measure == "f1":
        value = F.when(inter == 0, 0.0).otherwise(F.lit(2.0) * inter / (n_e + n_a))
    elif measure == "jaccard":
        value = inter / union
    else:
        raise ValueError(f"unknown overlap measure {measure!r}")
    both_empty = (n_e == 0) & (n_a == 0)
    one_empty = (n_e == 0) | (n_a == 0)
    score = F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(value)
    return result(score, score >= F.lit(threshold))


def overlap_measures(expected: Column | str, actual: Column | str) -> dict[str, Column]:
    """All four overlap measures at once, as plain double columns."""
    return {m: list_overlap(expected, actual, m)["score"]
            for m in ("precision", "recall", "f1", "jaccard")}
