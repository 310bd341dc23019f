"""Versioned run artifacts.

A save writes three datasets under one root:

* ``attempts/attempt=<id>/run=<run>/``: one JSON line per example with its nested field
  results, overall score, pass flag, latency and tokens (gzip files of bounded length);
* ``sketches/attempt=<id>/``: per run and measure a quantile sketch (``read_sketches``);
* ``saves/``: one line per run with the run-level scalars, the model, the judge model, the UTC
  creation time and the attempt that holds the examples.

Every attempt of a save has a folder of its own, and the lines of all runs of a save are one
file, put in place by one rename after all examples are written.  Readers go by these lines
alone: a save that broke before is not seen, whatever it left, and may be repeated;
``unpublished_attempts`` names what it left.  A comparison reads the partitions of its two
runs only.

No run is ever gathered into a single document (that would put a whole run through one
task); legacy single-document artifacts can still be read with ``read_experiment``, and
``examples/run=<run>/`` with ``runs/run=<run>/``, the layout without attempts, too.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators.aggregate import run_summary
from fieldmark.operators.materialize import materialize
from fieldmark.operators.sketches import measure_values, sketch
from fieldmark.schemas import EXAMPLE_REPORT, EXPERIMENT

EXAMPLE_ROW = T.StructType([T.StructField("run", T.StringType())] + EXAMPLE_REPORT.fields)

RUN_ROW = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("judge", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("n_examples", T.LongType()),
    T.StructField("n_passed", T.LongType()),
    T.StructField("mean_score", T.DoubleType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("mean_latency_ms", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("attempt", T.StringType()),
])

NUMBER = r"(DOUBLE|FLOAT|BIGINT|DECIMAL\(\d+, ?\d+\))"
#: JSON types of the required fields of a line, and of those that may be absent or null.
EXAMPLE_KINDS = {"example_id": "STRING", "passed": "BOOLEAN"}, {
    "overall_score": NUMBER, "latency_ms": NUMBER, "total_tokens": "BIGINT"}
RUN_KINDS = {"model": "STRING", "created_at": "STRING", "artifact": "STRING", "n_examples": "BIGINT"}, {
    "judge": "STRING", "n_passed": "BIGINT", "mean_score": NUMBER, "pass_rate": NUMBER,
    "mean_latency_ms": NUMBER, "total_tokens": "BIGINT", "attempt": "STRING"}


#: Lines of a stored file: packed files are not split, so their number sets the tasks of a read.
FILE_ROWS = 100_000
#: Folders a task keeps open at once before it sorts its rows by them.
OPEN_FOLDERS = 16


@contextmanager
def _unsorted_folders(spark: SparkSession):
    """Writes into few folders keep a file open in each: a task that first sorts its rows by
    folder would spill them all."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(OPEN_FOLDERS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_by_run(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """``rows`` in a folder for each ``run``; texts are packed, their files bounded."""
    out = rows.write.partitionBy("run").format(fmt)
    if fmt in ("json", "text"):
        out = out.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS)
    with _unsorted_folders(rows.sparkSession):
        out.save(path)


@dataclass
class Staged:
    """A save whose examples are written and that no reader sees yet."""

    root: str
    attempt: str
    runs: DataFrame
    fmt: str

    def publish(self) -> None:
        """One file with a line per run (an evaluation has few): one rename."""
        self.runs.coalesce(1).write.mode("append").format(self.fmt).save(f"{self.root}/saves")


def write_run(ev, root: str, model: str | None = None, judge: str | None = None,
              save: bool = True, fmt: str = "json", created: datetime | None = None) -> str | None:
    """Store the examples and the run summaries of an evaluation under ``root``.

    Every save is an artifact of its own, ``<model>_<yyyyMMdd_HHmmss>`` in UTC
    (``created``, now by default; without ``model`` each run's name stands for
    it).  An id that is stored already, or one ``model`` for several runs,
    raises before anything is written.  A save that broke half-way stored nothing and
    can be repeated, with the same ``created`` too.  ``save=False`` skips the sink."""
    if not save:
        return None
    stage_run(ev, root, model, judge, fmt, created).publish()
    return root


def stage_run(ev, root: str, model: str | None = None, judge: str | None = None,
              fmt: str = "json", created: datetime | None = None) -> Staged:
    """The first half of :func:`write_run`: all but the line that makes the runs visible."""
    spark = ev.scored.sparkSession
    created = created or datetime.now(timezone.utc)
    stamp = created.astimezone(timezone.utc).strftime("%Y%m%d_%H%M%S")
    name = F.coalesce(F.lit(model).cast("string"), F.col("run"))
    artifact = F.concat(name, F.lit(f"_{stamp}"))
    attempt = uuid.uuid4().hex
    runs = materialize(run_summary(ev.examples).select(
        artifact.alias("run"), name.alias("model"), F.lit(judge).cast("string").alias("judge"),
        F.timestamp_micros(F.lit(int(created.timestamp() * 1_000_000))).alias("created_at"),
        artifact.alias("artifact"), "n_examples", "n_passed", "mean_score", "pass_rate",
        "mean_latency_ms", "total_tokens", F.lit(attempt).alias("attempt")), "run_summary")
    new = runs.groupBy("run").agg(F.count("*").alias("k"))
    stored = _stored_runs(spark, root, fmt)
    if stored is None:
        new = new.withColumn("stored", F.lit(None).cast("boolean"))
    else:
        new = new.join(stored.select("run").distinct().withColumn("stored", F.lit(True)), "run", "left")
    taken = new.where("k > 1 OR stored").agg(F.min("run").alias("run")).first()["run"]
    if taken is not None:
        raise FileExistsError(f"artifact {taken!r} is stored already, or stands for several runs")
    examples = ev.scored.select(artifact.alias("run"), "example_id", "field_results",
                                "overall_score", "passed", "latency_ms", "total_tokens")
    write_by_run(examples, f"{root}/attempts/attempt={attempt}", fmt)
    sketch(measure_values(examples)).write.parquet(f"{root}/sketches/attempt={attempt}")
    return Staged(root, attempt, runs, fmt)


def unpublished_attempts(spark: SparkSession, root: str, fmt: str = "json") -> list[str]:
    """Attempts that no stored line names: saves that broke, or are being written now."""
    found = _files(spark, f"{root}/attempts", "attempt string, run string")
    if found is None:
        return []
    rows = found.select("attempt").distinct()  # from the folders' names
    stored = _stored_runs(spark, root, fmt)
    if stored is not None:
        rows = rows.join(stored.select("attempt").distinct(), "attempt", "left_anti")
    return sorted(r["attempt"] for r in rows.collect())


def list_runs(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """The stored runs, oldest first (runs written together by name)."""
    return read_run_summaries(spark, root, fmt).orderBy("created_at", "run")


def read_run_examples(spark: SparkSession, root: str, runs: list[str] | None = None,
                      fmt: str = "json") -> DataFrame:
    """The stored examples of ``runs`` (of all by default), those of the attempts that stored
    lines name; a row that is malformed, lacks a required field or has one of a wrong type
    fails the read and names its run (checked in the scan itself).  A score may be absent: an
    invalid verdict has none."""
    parts = [read(spark, root, runs, fmt) for read in (_published, _flat_examples)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.read.schema(EXAMPLE_ROW).format(fmt).load(f"{root}/attempts")  # not found
    df = reduce(DataFrame.unionByName, parts)
    name = F.concat_ws("/", "run", "example_id")
    return _complete(df, F.col("fault").isNotNull(), F.concat_ws(": ", name, "fault")).drop("fault")


def example_faults(spark: SparkSession, root: str, runs: list[str] | None = None,
                   fmt: str = "json") -> DataFrame:
    """(run, example_id, fault) of the stored rows that :func:`read_run_examples` would fail
    on; ``example_id`` is null where a line is no JSON."""
    parts = [read(spark, root, runs, fmt) for read in (_published, _flat_examples)]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None]) \
        .where("fault is not null").select("run", "example_id", "fault")


def _published(spark: SparkSession, root: str, runs: list[str] | None, fmt: str) -> DataFrame | None:
    named = _named_attempts(spark, root, runs, fmt)
    if not named:
        return None
    rows = _example_rows(spark, f"{root}/attempts", "attempt string, run string", fmt)
    rows = rows.where(F.col("attempt").isin(*{r["attempt"] for r in named})
                      & F.col("run").isin(*[r["run"] for r in named]))  # prunes partitions
    pairs = spark.createDataFrame([(r["run"], r["attempt"]) for r in named], "run string, attempt string")
    return rows.join(F.broadcast(pairs), ["run", "attempt"], "left_semi").drop("attempt")


def _named_attempts(spark: SparkSession, root: str, runs: list[str] | None, fmt: str) -> list:
    """(run, attempt) of the stored lines, a few rows."""
    stored = _stored_runs(spark, root, fmt)
    if stored is None:
        return []
    stored = stored.where("attempt is not null")
    if runs:
        stored = stored.where(F.col("run").isin(*runs))
    # one line a run: of two saves at once under one id the earlier one stands
    return stored.groupBy("run").agg(F.min(F.struct("created_at", "attempt"))["attempt"]
                                     .alias("attempt")).collect()


def read_sketches(spark: SparkSession, root: str, runs: list[str] | None = None,
                  fmt: str = "json") -> DataFrame:
    """(run, field, measure, n, min_value, max_value, sketch) of the stored ``runs`` (of all by
    default), from their attempts' folders alone.  A run that was stored without sketches (before
    they were, or without attempts) gets them from its examples; a root without runs has none."""
    named = _named_attempts(spark, root, runs, fmt)
    pairs = spark.createDataFrame([(r["run"], r["attempt"]) for r in named], "run string, attempt string")
    schema = "run string, field string, measure string, n bigint, min_value double, " \
        "max_value double, sketch binary"
    try:
        rows = spark.read.schema(schema + ", attempt string").parquet(f"{root}/sketches") \
            .where(F.col("attempt").isin(*{r["attempt"] for r in named}))  # prunes partitions
        kept = rows.join(F.broadcast(pairs), ["run", "attempt"], "left_semi").drop("attempt")
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], schema)
    have = {r["run"] for r in kept.select("run").distinct().collect()}
    wanted = read_run_summaries(spark, root, fmt).where("n_examples > 0").select("run")
    if runs:
        wanted = wanted.where(F.col("run").isin(*runs))
    lacking = [r["run"] for r in wanted.distinct().collect() if r["run"] not in have]
    if not lacking:
        return kept
    again = sketch(measure_values(read_run_examples(spark, root, lacking, fmt)))
    return kept.unionByName(again)


def _flat_examples(spark: SparkSession, root: str, runs: list[str] | None, fmt: str) -> DataFrame | None:
    rows = _example_rows(spark, f"{root}/examples", "run string", fmt)
    return rows.where(F.col("run").isin(*runs)) if runs and rows is not None else rows


def _files(spark: SparkSession, path: str, partitions: str) -> DataFrame | None:
    """(value, partitions): the lines of all files; None if there is no such folder."""
    try:
        return spark.read.schema(f"value string, {partitions}").text(path)
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        return None


def _lines(spark: SparkSession, path: str, partitions: str, schema: T.StructType,
           kinds: tuple[dict, dict], fmt: str) -> DataFrame | None:
    """The rows of a folder with ``fault``: null, or what is malformed, absent or of a wrong
    type, from the JSON types as they are written; other formats carry types of their own."""
    own = [f.split()[0] for f in partitions.split(", ")] if partitions else []
    fields = T.StructType([f for f in schema.fields if f.name not in own])
    required, others = kinds
    if fmt != "json":
        try:
            df = spark.read.schema(T.StructType(
                fields.fields + [T.StructField(c, T.StringType()) for c in own])).format(fmt).load(path)
        except AnalysisException as e:
            if (e.getCondition() or "") != "PATH_NOT_FOUND":
                raise
            return None
        return df.withColumn("fault", F.coalesce(*[
            F.when(F.col(c).isNull(), F.lit(f"{c} is absent")) for c in required]))
    lines = _files(spark, path, partitions) if partitions else _plain(spark, path)
    if lines is None:
        return None
    # Each step is a generator of one row: filters and later steps are not merged with it, so a
    # line is parsed once, not once for every field that is checked.
    rec = F.from_json("value", fields)
    parsed = lines.where(F.trim("value") != "").select(*own, F.inline(F.array(F.struct(
        rec.alias("r"), F.try_parse_json("value").alias("v")))))
    checked = [*required, *others] + [n for n in ("field_results",) if n in fields.names]
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")),
                        F.lit("VOID")).alias(n) for n in checked]
    parsed = parsed.select(*own, "r", F.col("v").isNull().alias("broken"), F.struct(*kinds).alias("kinds"))
    faults = [F.when(F.col("broken"), F.lit("malformed JSON"))]
    for name, want in (required | others).items():
        k = F.col("kinds")[name]
        fits = k.rlike(f"^{want}$")
        faults.append(F.when(~(fits if name in required else fits | (k == "VOID")),
                             F.lit(f"{name} is absent or of a wrong type")))
    if "field_results" in fields.names:
        faults.append(_result_faults(F.col("kinds.field_results")))
    if "field_results" in fields.names:
        results = F.col("r.field_results")
        lacks = F.exists(results, lambda r: r["field"].isNull() | r["scorer"].isNull()
                         | r["result"].isNull() | r["result"]["passed"].isNull())
        faults.append(F.when(results.isNull() | lacks, F.lit("field_results lack a required field")))
    return parsed.select(*own, F.inline(F.array(F.struct(
        "r", F.coalesce(*faults).alias("fault"))))).select(*own, "r.*", "fault")


def _plain(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        return None


def _result_faults(kind: Column) -> Column:
    """What the JSON type of a list of field results shows: a number that is a text, or so."""
    wrong = [rf"\b{name}: (?!{want}|VOID\b)" for name, want in (
        ("field", r"STRING\b"), ("scorer", r"STRING\b"), ("result", "OBJECT<"),
        ("passed", r"BOOLEAN\b"), ("score", NUMBER), ("reason", r"STRING\b"))]
    return F.when(~F.startswith(F.coalesce(kind, F.lit("")), F.lit("ARRAY<")),
                  F.lit("field_results are no list")) \
        .when(kind.rlike("|".join(wrong)), F.lit("field_results have a wrong type"))


def _example_rows(spark: SparkSession, path: str, partitions: str, fmt: str) -> DataFrame | None:
    return _lines(spark, path, partitions, EXAMPLE_ROW, EXAMPLE_KINDS, fmt)


def _complete(df: DataFrame, lacks: Column, name: Column) -> DataFrame:
    """``df``, failing with ``name`` when a row ``lacks`` something."""
    problem = F.concat(F.lit("artifact with required fields missing or of a wrong type: "), name)
    return df.where(F.when(lacks, F.raise_error(problem).cast("boolean")).otherwise(True))


def _stored_runs(spark: SparkSession, root: str, fmt: str) -> DataFrame | None:
    """The stored lines of both layouts, checked; None before the first save."""
    named = _lines(spark, f"{root}/saves", "", RUN_ROW, RUN_KINDS, fmt)
    flat = _lines(spark, f"{root}/runs", "run string", RUN_ROW, RUN_KINDS, fmt)
    found = [x for x in (named, flat) if x is not None]
    if not found:
        return None
    df = reduce(DataFrame.unionByName, found)
    name = F.concat_ws(": ", F.coalesce("run", F.lit("a line of the stored runs")), "fault")
    return _complete(df, F.col("fault").isNotNull(), name).select(*RUN_ROW.names)


def read_run_summaries(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """The stored runs, a line each; a line that is malformed, lacks a required field or has
    one of a wrong type fails the read."""
    found = _stored_runs(spark, root, fmt)
    if found is None:
        return spark.read.schema(RUN_ROW).format(fmt).load(f"{root}/saves")  # not found
    return found


def flatten_examples(examples: DataFrame) -> DataFrame:
    """Nested example rows -> field results, one row each, with ``pos``."""
    return (examples.select("run", "example_id",
                            F.posexplode("field_results").alias("pos", "fr"))
            .select("run", "example_id", F.col("pos").cast("int").alias("pos"),
                    F.col("fr.field").alias("field"), F.col("fr.scorer").alias("scorer"),
                    F.col("fr.result.score").alias("score"),
                    F.col("fr.result.passed").alias("passed"),
                    F.col("fr.result.reason").alias("reason")))


def read_experiment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legacy artifacts, one JSON document per run (``path`` may hold many).

    Returns (runs, examples); the run is named after the file stem.  Each
    document is read by one task, which is what the format allows.  A document
    that lacks a required field, or has one of a wrong type, fails the read."""
    v = F.try_parse_json("value")
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("run"),
        F.col("_metadata.file_modification_time").alias("mtime"), v.alias("v"),
        F.from_json("value", EXPERIMENT).alias("d"))

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))

    wrong = [rf"\b{name}: (?!{want}|VOID\b)" for name, want in (
        ("example_id", r"STRING\b"), ("overall_score", NUMBER), ("passed", r"BOOLEAN\b"),
        ("latency_ms", NUMBER), ("total_tokens", r"BIGINT\b"), ("field_results", "ARRAY<"),
        ("field", r"STRING\b"), ("scorer", r"STRING\b"), ("result", "OBJECT<"), ("score", NUMBER),
        ("reason", r"STRING\b"))]
    typed = kind("$.model").rlike("^STRING$") & kind("$.mean_score").rlike(f"^{NUMBER}$") \
        & kind("$.pass_rate").rlike(f"^{NUMBER}$") & ~kind("$.examples").rlike("|".join(wrong)) \
        & kind("$.mean_latency_ms").rlike(f"^({NUMBER}|VOID)$") \
        & kind("$.total_tokens").rlike("^(BIGINT|VOID)$")
    doc = files.select("run", "mtime", typed.alias("typed"), "d.*")

    def absent(record, *names: str) -> Column:
        return reduce(Column.__or__, [record(n).isNull() for n in names])

    bad_result = lambda r: absent(r.getField, "field", "scorer") | absent(
        r["result"].getField, "score", "passed")
    bad_example = lambda e: absent(
        e.getField, "example_id", "field_results", "overall_score", "passed") | F.exists(
        e["field_results"], bad_result)
    doc = _complete(doc, ~F.col("typed") | absent(F.col, "model", "examples", "mean_score", "pass_rate")
                    | F.exists("examples", bad_example), F.col("run"))
    runs = doc.select("run", "model", "mtime", "mean_score", "pass_rate",
                      F.coalesce("mean_latency_ms", F.lit(0.0)).alias("mean_latency_ms"),
                      F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"))
    examples = (doc.select("run", F.explode("examples").alias("ex"))
                .select("run", "ex.*")
                .withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0)))
                .withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0)).cast("bigint")))
    return runs, examples


def pick_runs(runs: DataFrame, time_col: str = "created_at") -> tuple[str, str]:
    """Default comparison pair: (oldest, newest) run; needs at least two runs.
    One aggregate row reaches the driver."""
    order = F.struct(F.col(time_col), F.col("run"))  # runs written together tie on time
    row = runs.agg(F.count("*").alias("n"), F.min_by("run", order).alias("oldest"),
                   F.max_by("run", order).alias("newest")).first()
    if row["n"] < 2:
        raise ValueError("need at least 2 runs to compare")
    return row["oldest"], row["newest"]
