"""Stored quantile sketches, and the order of golden lines over files and blocks."""

import json

import numpy as np
from pyspark.sql import functions as F

from fieldmark.operators import sketches as sk
from fieldmark.operators.judge import token_overlap_judge
from fieldmark.operators.materialize import materialize
from fieldmark.plans.evaluate import default_specs, evaluate
from fieldmark.session import scratch_path
from fieldmark.sources.artifacts import (
    read_run_summaries, read_sketches, stage_run, unpublished_attempts, write_run)
from fieldmark.sources.fixtures import fixture


def test_quantiles_of_merged_sketches_keep_the_stated_error(spark):
    values = spark.range(60000).select(
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("run"), F.lit("f").alias("field"),
        F.lit("m").alias("measure"), ((F.col("id") * 7919) % 60013).cast("double").alias("value"))
    parts = sk.sketch(values)
    assert parts.count() == 3 and parts.agg(F.max(F.length("sketch"))).first()[0] < 100_000
    whole = sk.merge(parts, ("field", "measure"))
    row = whole.first()
    assert (row["n"], row["min_value"]) == (60000, 0.0)
    truth = np.sort([r["value"] for r in values.select("value").collect()])
    eps = 2 * sk.rank_error()
    taken = materialize(sk.quantiles(whole), "quantiles")  # the next merge compacts by other coin flips
    found = {r["share"]: r["value"] for r in taken.collect()}
    assert set(found) == {0.25, 0.5, 0.75, 0.95}
    for p, v in found.items():
        assert abs(np.searchsorted(truth, v) / len(truth) - p) <= eps
    gaps = {r["share"]: r["gap"] for r in sk.rank_gaps(values, taken, ("field", "measure")).collect()}
    for p, v in found.items():  # against a plain count
        low, high = np.searchsorted(truth, v, "left") / 60000, np.searchsorted(truth, v, "right") / 60000
        assert abs(gaps[p] - max(0.0, low - p, p - high)) < 1e-12


def test_rank_gaps_sees_a_wrong_quantile(spark):
    values = spark.range(100).select(F.lit("f").alias("field"), F.col("id").cast("double").alias("value"))
    wrong = spark.createDataFrame([("f", 0.5, 90.0)], "field string, share double, value double")
    (r,) = sk.rank_gaps(values, wrong, ("field",)).collect()
    assert abs(r["gap"] - 0.4) < 1e-12 and r["n"] == 100


def test_stored_sketches_follow_the_published_saves(spark, sf_small):
    g, p = fixture(spark, sf_small)
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    root = scratch_path(spark, "sketched")
    stage_run(ev, root)  # never published
    write_run(ev, root)
    assert len(unpublished_attempts(spark, root)) == 1
    stored = read_sketches(spark, root)
    runs = sorted(r["run"] for r in read_run_summaries(spark, root).collect())
    assert stored.count() == 2 * (5 + 3)  # each run once, not its broken save
    n = {r["run"]: r["n"] for r in stored.where("measure = 'overall_score'").collect()}
    assert n == {r["run"]: r["n_examples"] for r in read_run_summaries(spark, root).collect()}
    assert read_sketches(spark, root, [runs[0]]).select("run").distinct().count() == 1
    plan = sk.quantiles(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "field_results" not in plan  # the examples are not read again
    rows = sk.shifts(stored, *runs).collect()
    assert len(rows) == 8 * 4
    assert all(abs(r["delta"] - (r["candidate"] - r["baseline"])) < 1e-12 for r in rows)


def test_runs_without_stored_sketches_get_them_from_their_examples(spark, tmp_path):
    ex = {"example_id": "e1", "overall_score": 0.5, "passed": False, "latency_ms": 3.0, "total_tokens": 2,
          "field_results": [{"field": "title", "scorer": "s", "result": {"score": s, "passed": True}}
                            for s in (0.25, 1.0)]}
    old = tmp_path / "examples" / "run=m_1"
    old.mkdir(parents=True)
    (old / "a.json").write_text("\n".join(map(json.dumps, [ex, {**ex, "example_id": "e2", "overall_score": None}])))
    line = tmp_path / "runs" / "run=m_1"
    line.mkdir(parents=True)
    (line / "a.json").write_text(json.dumps({"model": "m", "created_at": "2026-01-01T00:00:00Z",
                                             "artifact": "m_1", "n_examples": 2}))
    got = {(r["field"], r["measure"]): (r["n"], r["max_value"])
           for r in read_sketches(spark, str(tmp_path)).collect()}
    assert got == {("title", "score"): (2, 0.25), ("*", "overall_score"): (1, 0.5),
                   ("*", "latency_ms"): (2, 3.0), ("*", "total_tokens"): (2, 2.0)}


def test_golden_lines_keep_file_order_over_blocks_and_files(spark, tmp_path):
    from fieldmark.sources.golden import read_golden

    def line(i):
        return json.dumps({"id": f"ex_{i}", "category": "c" * (i % 90),
                           "input": {"raw_title": "t", "raw_description": "d" * (i % 300)},
                           "expected": {"title": "T"}})

    want, i = [], 0
    for name, n in (("a", 40), ("b", 900), ("c", 300), ("d", 5)):  # tasks take large files first
        want += [f"ex_{k}" for k in range(i, i + n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(line(k) for k in range(i, i + n)) + "\n")
        i += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_golden(spark, str(tmp_path), on_error=None)
        assert rows.rdd.getNumPartitions() > 4
        got = [r["id"] for r in rows.orderBy("line_order").select("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
