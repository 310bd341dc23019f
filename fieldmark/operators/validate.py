"""Record validation as columns.

Spark's readers are lenient (a missing required field, a value outside an
enum, a number where a string is expected all load fine), so the checks of
the record types are expressions: each row gets ``violations ARRAY<STRING>``.
``validate(on_error='raise')`` stops at the first bad record like a strict
loader (one aggregate job); ``on_error='split'`` returns (good, bad) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.schemas import INPUT_KEYS, SENIORITY_VALUES, WORK_MODE_VALUES

DEFAULT_DOMAINS = {"seniority": SENIORITY_VALUES, "work_mode": WORK_MODE_VALUES}
REQUIRED = ["id", "category", "input", "expected"]


def _check(cond: Column, message: str) -> Column:
    return F.when(cond, F.lit(message))


def golden_checks(domains: dict[str, list[str]] = DEFAULT_DOMAINS,
                  strict_skills: bool = True) -> list[Column]:
    checks = [_check(F.col(c).isNull(), f"missing {c}") for c in REQUIRED]
    for f, values in domains.items():
        v = F.col("expected")[f]
        checks.append(_check(v.isNotNull() & ~v.isin(*values), f"{f} not in domain"))
    for k in INPUT_KEYS:
        checks.append(_check(F.col("input").isNotNull() & ~F.map_contains_key("input", k),
                             f"input lacks {k}"))
    checks.append(_check(F.exists(F.map_values("input"), lambda x: x.isNull()),
                         "input has a null value"))
    if strict_skills:
        checks.append(_check(F.col("expected").isNotNull() & F.col("expected")["skills"].isNull(),
                             "skills is null"))
    return checks


def prediction_checks(domains: dict[str, list[str]] = DEFAULT_DOMAINS) -> list[Column]:
    """Checks of the ``PREDICTIONS`` layout (a structured model answer)."""
    checks = [_check(F.col(c).isNull(), f"missing {c}") for c in ("run", "example_id", "job_info")]
    for f, values in domains.items():
        v = F.col("job_info")[f]
        checks.append(_check(v.isNotNull() & ~v.isin(*values), f"{f} not in domain"))
    checks.append(_check(F.col("latency_ms") < 0, "negative latency"))
    checks.append(_check(F.col("total_tokens") < 0, "negative token count"))
    return checks


def violations(df: DataFrame, checks: list[Column] | None = None,
               domains: dict[str, list[str]] = DEFAULT_DOMAINS) -> DataFrame:
    """Add ``violations``: messages of every failed check (empty when valid)."""
    checks = checks if checks is not None else golden_checks(domains)
    found = F.filter(F.array(*checks), lambda m: m.isNotNull())
    return df.withColumn("violations", found)


def validate(df: DataFrame, on_error: str = "raise", checks: list[Column] | None = None,
             domains: dict[str, list[str]] = DEFAULT_DOMAINS):
    """``raise``: error naming the first bad row, else the rows unchanged.
    ``split``: (good rows, bad rows with their violations)."""
    v = violations(df, checks, domains)
    bad = v.where(F.size("violations") > 0)
    if on_error == "raise":
        # an aggregate reads all parts at once; a limit would try them a few at a time
        first = bad.agg(F.first(F.struct(*bad.columns)).alias("row")).first()["row"]
        if first:
            raise ValueError(f"invalid record: {first.asDict(recursive=True)}")
        return df
    if on_error == "split":
        return v.where(F.size("violations") == 0).drop("violations"), bad
    raise ValueError(f"on_error must be 'raise' or 'split', not {on_error!r}")


def plant_violations(golden: DataFrame) -> DataFrame:
    """Test input: the golden set with defects planted at fixed key residues,
    plus ``row_key`` naming each row (``id`` itself is one of the defects)."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    e = F.col("expected")
    bad_expected = (
        F.when(k % 73 == 0, e.withField("skills", F.lit(None).cast("array<string>")))
        .when(k % 71 == 0, e.withField("work_mode", F.lit("Remote")))
        .when(k % 97 == 0, e.withField("seniority", F.lit("boss")))
        .otherwise(e))
    no_title = F.map_filter("input", lambda key, _: key != F.lit("raw_title"))
    return golden.select(
        F.concat(F.lit("row_"), k.cast("string")).alias("row_key"),
        F.when(k % 89 != 0, F.col("id")).alias("id"),
        F.when(k % 79 != 0, F.col("category")).alias("category"),
        F.when(k % 83 == 0, no_title).otherwise(F.col("input")).alias("input"),
        bad_expected.alias("expected"),
        "notes")
