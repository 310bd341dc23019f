"""Golden set scan (JSON Lines, one example per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.text import py_strip
from fieldmark.operators.validate import DEFAULT_DOMAINS, golden_checks, validate
from fieldmark.schemas import GOLDEN

# Text fields of a golden record (name -> JSON path).
STRING_PATHS = {
    "id": "$.id", "category": "$.category", "notes": "$.notes",
    "expected.title": "$.expected.title", "expected.seniority": "$.expected.seniority",
    "expected.work_mode": "$.expected.work_mode", "expected.location": "$.expected.location",
}


def read_golden(spark: SparkSession, path: str, on_error: str | None = "raise",
                domains: dict[str, list[str]] = DEFAULT_DOMAINS):
    """Read a golden set: whitespace around a line is ignored and blank lines
    are skipped; ``line_order`` sorts as the lines stand in the files: by file path, by the
    byte offset of the block a task read (a file is split among tasks, and tasks get blocks
    of several files by size, not in order), then by place in the block.

    ``on_error``: ``'raise'`` (first bad record stops the load), ``'split'``
    (returns (good, bad)), or ``None`` (no checks).  A typed read cannot tell an
    absent ``skills`` key (defaults to ``[]``) from an explicit ``null`` (an
    error), nor text from numbers, so types are checked on the parsed line.  A
    line that is no JSON is a bad record like any other."""
    place = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block_start"),
                     F.monotonically_increasing_id().alias("line"))
    lines = (spark.read.text(path)
             .select(py_strip(F.col("value")).alias("line"), place.alias("line_order"))
             .where(F.length("line") > 0))
    # A generator of one row: filters and later steps are not merged with it, so a line is
    # parsed once, not once for every field that is checked.
    lines = lines.select("line_order", F.inline(F.array(F.struct(
        F.from_json("line", GOLDEN).alias("r"), F.try_parse_json("line").alias("v")))))
    # The typed read turns a JSON number into a string and a wrong type into a null; the
    # variant keeps the JSON type of each value.
    v = F.col("v")

    def kind(path):
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    lines = lines.select(
        "line_order", "r", v.isNull().alias("broken"), kind("$.expected.skills").alias("skills"),
        F.try_variant_get(v, "$.expected.skills", "array<string>").alias("listed"),
        F.map_values(F.try_variant_get(v, "$.input", "map<string,variant>")).alias("inputs"),
        *[kind(path).alias(name.replace(".", "_")) for name, path in STRING_PATHS.items()])
    skills = F.col("skills")
    raw_skills_null = F.coalesce(skills == "VOID", F.lit(False))
    text = {name: F.col(name.replace(".", "_")) for name in STRING_PATHS}
    wrong = F.filter(F.array(
        F.when(F.col("broken"), F.lit("malformed JSON")),
        *[F.when(k.isNotNull() & ~k.isin("STRING", "VOID"), F.lit(f"{name} is not a string"))
          for name, k in text.items()],
        F.when(skills.isNotNull() & ~skills.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"),
               F.lit("skills is not a list of strings")),
        F.when(skills.isin("ARRAY<STRING>", "ARRAY<VOID>")
               & F.exists("listed", lambda x: x.isNull()), F.lit("skills is not a list of strings")),
        F.when(F.exists("inputs", lambda x: ~F.schema_of_variant(x).isin("STRING", "VOID")),
               F.lit("input has a value that is not a string"))),
        lambda m: m.isNotNull())
    df = lines.select("line_order", F.inline(F.array(F.struct(
        "r", raw_skills_null.alias("_skills_null"), wrong.alias("_type_errors")))))
    expected = F.col("r.expected")
    df = df.select(
        "line_order", "r.id", "r.category", "r.input",
        F.when(expected.isNotNull() & ~F.col("_skills_null"),
               expected.withField("skills", F.coalesce(expected["skills"],
                                                       F.array().cast("array<string>"))))
        .otherwise(expected).alias("expected"),
        "r.notes", "_type_errors")
    if on_error is None:
        return df.drop("_type_errors")
    checks = golden_checks(domains, strict_skills=True) + [
        F.when(F.size("_type_errors") > 0, F.array_join("_type_errors", "; "))]
    out = validate(df, on_error=on_error, checks=checks)
    if on_error == "split":
        good, bad = out
        return good.drop("_type_errors"), bad.drop("_type_errors")
    return out.drop("_type_errors")


def write_golden(golden: DataFrame, path: str) -> None:
    """Write a golden set as JSON Lines."""
    golden.select("id", "category", "input", "expected", "notes").write.mode("overwrite").json(path)
