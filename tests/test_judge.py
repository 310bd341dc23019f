"""Judge: verdict mapping, null/empty rules, list text, dedupe and the cache."""

import json

import pandas as pd
from pyspark.sql import functions as F

from fieldmark.operators.judge import (
    Judge,
    judge_variance,
    noisy_token_overlap_judge,
    read_cache,
    repeat_judgements,
    token_overlap_judge,
)
from fieldmark.session import scratch_path


def _const(score, reasoning="r"):
    def fn(req: pd.DataFrame) -> pd.Series:
        return pd.Series([json.dumps({"score": score, "reasoning": reasoning})] * len(req))
    return fn


def _judge(fn, path=None, rubric_id="title"):
    return Judge(rubric_id=rubric_id, rubric="R", model="m", call=fn, cache_path=path)


def _score(spark, judge, rows, schema="e string, a string"):
    df = spark.createDataFrame(rows, schema)
    return [r["out"] for r in judge.apply(df, "e", "a", "out").select("out").collect()]


def test_verdict_mapping(spark):
    for v, s, p in [(2, 1.0, True), (1, 0.5, True), (0, 0.0, False)]:
        (r,) = _score(spark, _judge(_const(v, "why")), [("Data Engineer", "Data Analyst")])
        assert r["score"] == s and r["passed"] == p and r["reason"] == "why"


def test_null_and_empty_rules(spark):
    rows = [(None, None), ("", ""), ("", None), ("Head of Accounting", None)]
    got = _score(spark, _judge(_const(2)), rows)
    assert [g["score"] for g in got] == [1.0, 1.0, 1.0, 0.0]
    assert got[3]["reason"] == "expected='Head of Accounting', actual=None"


def test_lists(spark):
    rows = [(["Python", "Spark"], ["Python", "Apache Spark"]), ([], []), (["Python"], [])]
    got = _score(spark, _judge(_const(2), rubric_id="skills"), rows,
                 "e array<string>, a array<string>")
    assert [g["score"] for g in got] == [1.0, 1.0, 0.0]
    assert got[2]["reason"] == "expected=['Python'], actual=[]"


def test_same_pair_judged_once_and_cached(spark):
    path = scratch_path(spark, "test_cache")
    j = _judge(token_overlap_judge, path)
    df = spark.createDataFrame([("A", "B")] * 5 + [("a b", "b a")], "e string, a string")
    first = j.apply(df, "e", "a", "out").select("out").collect()
    assert read_cache(spark, path).count() == 2          # two distinct pairs, one call each
    second = j.apply(df, "e", "a", "out").select("out").collect()
    assert read_cache(spark, path).count() == 2          # all hits: nothing appended
    assert first == second
    assert [r["out"]["score"] for r in first] == [0.0] * 5 + [1.0]


def test_invalid_verdict_is_an_error_not_a_crash(spark):
    def bad(req):
        return pd.Series(["not json", json.dumps({"score": 7, "reasoning": "x"})][: len(req)]
                         + ["{}"] * max(0, len(req) - 2))
    df = spark.createDataFrame([("a", "b")], "e string, a string")
    out = _judge(bad).apply(df, "e", "a", "out").collect()[0]
    assert out["out"]["score"] is None and not out["out"]["passed"]
    assert out["out_judge_error"].startswith("invalid verdict")


def test_repeated_judgements_variance(spark):
    j = _judge(noisy_token_overlap_judge)
    pairs = j.distinct_pairs(spark.createDataFrame(
        [("Head of Accounting", "Accounting Lead"),
         ("Trainee Electrician", "Electrical Apprentice"),
         ("Pastry Chef", "Hotel Receptionist")], "e string, a string"), "e", "a")
    v = judge_variance(repeat_judgements(j, pairs, 3)).collect()
    assert len(v) == 3 and all(r["n"] == 3 for r in v)
    for r in v:  # scores in {0, .5, 1}: the gate fails only when both 0 and 1 occur
        assert r["passed"] == (r["variance"] < 0.2)
    one = judge_variance(repeat_judgements(j, pairs.limit(1), 1)).collect()[0]
    assert one["variance"] == 0.0


def test_shuffle_path_with_hot_key_matches_broadcast_path(spark):
    """Force the non-broadcast join: one pair holds most rows (hot), others are
    cold, some rows are settled by the rules; results must not depend on the path."""
    rows = ([("Data Engineer", "data engineer")] * 400 + [(f"role {i}", f"role {i % 7}") for i in range(60)]
            + [(None, "x")] * 30 + [(None, None)] * 30)
    df = spark.createDataFrame(rows, "e string, a string").withColumn("id", F.monotonically_increasing_id())
    df = df.cache()
    small = Judge(rubric_id="title", rubric="R", model="m", call=token_overlap_judge)
    forced = Judge(rubric_id="title", rubric="R", model="m", call=token_overlap_judge,
                   max_broadcast_rows=0)
    a = {r["id"]: r["out"] for r in small.apply(df, "e", "a", "out").collect()}
    plan_df = forced.apply(df, "e", "a", "out")
    b = {r["id"]: r["out"] for r in plan_df.collect()}
    assert a == b and len(a) == len(rows)
    assert sum(1 for v in b.values() if v["score"] == 1.0) >= 400


def test_duplicate_cache_entries_do_not_multiply_rows(spark):
    path = scratch_path(spark, "dup_cache")
    j = _judge(token_overlap_judge, path)
    df = spark.createDataFrame([("a b", "b c")] * 3, "e string, a string")
    j.apply(df, "e", "a", "out").collect()
    # simulate a re-run append of the same verdicts
    spark.read.parquet(path).write.mode("append").partitionBy("judge").parquet(path)
    assert read_cache(spark, path).count() == 2
    out = j.apply(df, "e", "a", "out").collect()
    assert len(out) == 3 and all(r["out"]["score"] == 0.5 for r in out)


def test_judge_request_carries_rubric_and_prompt(spark):
    def fn(req):
        ok = [(r == "R" and p == f"Expected: {e}\nActual: {a}")
              for r, p, e, a in zip(req["rubric"], req["prompt"], req["expected"], req["actual"])]
        return pd.Series([json.dumps({"score": 2 if k else 0, "reasoning": "r"}) for k in ok])
    (r,) = _score(spark, _judge(fn), [("Head of Accounting", "Accounting Lead")])
    assert r["score"] == 1.0


def test_judge_tokens_recorded_apart(spark):
    from fieldmark.operators.judge import judge_usage

    def fn(req):
        return pd.DataFrame({"verdict": [json.dumps({"score": 1, "reasoning": "r"})] * len(req),
                             "total_tokens": [40] * len(req)})
    path = scratch_path(spark, "tok_cache")
    df = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "b")], "e string, a string")
    _judge(fn, path).apply(df, "e", "a", "out").collect()
    (u,) = judge_usage(spark, path).collect()
    assert u["verdicts"] == 2 and u["judge_tokens"] == 80


def test_meta_eval_identical_high_unrelated_low(spark):
    j = _judge(token_overlap_judge)
    same, unrelated = _score(spark, j, [("Pastry Chef", "Pastry Chef"),
                                        ("Pastry Chef", "Night Porter")])
    assert same["score"] == 1.0 and unrelated["score"] <= 0.5


def test_judge_spend_counts_only_fresh_calls(spark, sf_small):
    from fieldmark.plans.evaluate import default_specs, evaluate
    from fieldmark.sources.fixtures import fixture

    def fn(req):
        out = token_overlap_judge(req)
        return pd.DataFrame({"verdict": out.values, "total_tokens": [10] * len(req)})
    g, p = fixture(spark, sf_small)
    path = scratch_path(spark, "spend_cache")
    first = evaluate(g, p, default_specs("m", fn, cache_path=path))
    (s1,) = first.judge_spend().collect()
    assert s1["calls"] == read_cache(spark, path).count() and s1["judge_tokens"] == 10 * s1["calls"]
    second = evaluate(g, p, default_specs("m", fn, cache_path=path))
    assert second.judge_spend().count() == 0          # every verdict came from the cache
    def rounded(ev):  # sums of doubles may differ in the last bit between runs
        return sorted((r["run"], r["n_passed"], round(r["mean_score"], 9)) for r in ev.summary().collect())
    assert rounded(first) == rounded(second)


def _answers(text):
    def fn(req):
        return pd.Series([text] * len(req))
    return fn


def test_invalid_verdict_is_not_cached(spark, tmp_path):
    path = f"file://{tmp_path}/verdicts"
    rows = [("Pastry Chef", "Baker")]
    (bad,) = _score(spark, _judge(_answers("no verdict"), path=path), rows)
    assert bad["score"] is None
    (good,) = _score(spark, _judge(_const(2), path=path), rows)
    assert good["score"] == 1.0


def test_colliding_keys_do_not_multiply_rows(spark):
    # the key joins the texts with "||", so these two pairs share one
    got = _score(spark, _judge(_const(2)), [("a||b", "c"), ("a", "b||c")])
    assert [g["score"] for g in got] == [1.0, 1.0]


def test_missing_cache_is_none(spark, tmp_path):
    from fieldmark.operators.judge import read_cache

    assert read_cache(spark, f"file://{tmp_path}/none") is None
