"""Record types of the engine as Spark schemas, and the fixed values of the
extraction task (field list, enum domains, thresholds)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that results depend on (must stay exactly as written).
# ---------------------------------------------------------------------------
# Fields of a job record, in the order reports show them.
FIELDS = ["title", "seniority", "work_mode", "location", "skills"]
# Order in which an evaluation emits field results (position = ``pos``).
SCORING_ORDER = ["seniority", "work_mode", "location", "title", "skills"]
# Closed domains (case-sensitive; null allowed).
SENIORITY_VALUES = ["intern", "junior", "mid", "senior", "lead", "executive"]
WORK_MODE_VALUES = ["remote", "hybrid", "onsite"]
VERDICT_VALUES = [0, 1, 2]
# Example passes when its overall score >= 0.7.
EXAMPLE_PASS = 0.7
# A field counts as passed in field statistics when its score >= 0.5.
FIELD_PASS = 0.5
# Default pass thresholds of the scorers.
FUZZY_PASS = 0.8
JUDGE_PASS = 0.5
# Run gate: pass rate >= 0.7; every field mean >= 0.5.
RUN_GATE_PASS_RATE = 0.7
RUN_GATE_FIELD_MEAN = 0.5
# Delta classes of a comparison: > 0.01 better, < -0.01 worse.
TREND_EPS = 0.01
# Category of the abstention subset.
SPARSE_CATEGORY = "sparse_description"
# Keys the prompt is built from.
INPUT_KEYS = ["raw_description", "raw_title"]

JOB_INFO = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("work_mode", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
])

GOLDEN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("input", T.MapType(T.StringType(), T.StringType())),
    T.StructField("expected", JOB_INFO),
    T.StructField("notes", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("example_id", T.StringType()),
    T.StructField("job_info", JOB_INFO),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
])

SCORER_RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])

FIELD_RESULT = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("scorer", T.StringType()),
    T.StructField("result", SCORER_RESULT),
])

FIELD_RESULTS_LONG = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("example_id", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("field", T.StringType()),
    T.StructField("scorer", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])

EXAMPLE_REPORT = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("field_results", T.ArrayType(FIELD_RESULT)),
    T.StructField("overall_score", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
])

# One run as a single document (small, legacy artifacts).
EXPERIMENT = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("examples", T.ArrayType(EXAMPLE_REPORT)),
    T.StructField("mean_score", T.DoubleType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("mean_latency_ms", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
])

JUDGE_VERDICT = T.StructType([
    T.StructField("score", T.IntegerType()),
    T.StructField("reasoning", T.StringType()),
])
