"""Stored answers: a broken run goes on where its tasks ended."""

import glob
import json
import time
from collections import Counter

import pandas as pd
import pytest

from fieldmark.operators.predict import documents_as_golden, predict, read_answers, stub_extractor
from fieldmark.sources.tables import read_table


def _golden(spark, rows):
    return spark.createDataFrame(
        [(i, {"raw_title": t, "raw_description": "d"}) for i, t in rows],
        "id string, input map<string,string>")


def _model(log, store=None, poison=None, parts=0):
    """Answers each example and logs it; the poisoned one waits until the other tasks' answers
    are stored, then fails."""
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        if poison and poison in set(batch["example_id"]):
            for _ in range(600):
                if len(glob.glob(f"{store}/run=*/*.parquet")) >= parts:
                    break
                time.sleep(0.1)
            raise RuntimeError("the model is gone")
        with open(log, "a") as f:
            f.writelines(f"{i}\n" for i in batch["example_id"])
        return pd.DataFrame({
            "job_info": [json.dumps({"title": t, "skills": []}) for t in batch["raw_title"]],
            "total_tokens": 1}, index=batch.index)
    return fn


def _asked(log) -> Counter:
    with open(log) as f:
        return Counter(f.read().split())


def test_a_broken_run_asks_only_the_rest(spark, tmp_path):
    store, log = str(tmp_path / "answers"), str(tmp_path / "log")
    ids = [f"e{i}" for i in range(200)]
    golden = _golden(spark, [(i, f"title {i}") for i in ids])
    with pytest.raises(Exception, match="the model is gone"):
        predict(golden, _model(log, store, poison="e7", parts=3), "m", concurrency=4, store=store)
    first = _asked(log)
    kept = read_answers(spark, store, "m").count()
    assert 0 < kept == len(first) < len(ids) and "e7" not in first

    preds = predict(golden, _model(log), "m", concurrency=4, store=store)
    assert {r["example_id"]: r["job_info"]["title"] for r in preds.collect()} \
        == {i: f"title {i}" for i in ids}
    assert preds.where("answer_error IS NOT NULL").count() == 0
    assert _asked(log) == Counter(ids)  # each request once over both calls

    predict(golden, _model(log), "m", store=store)
    assert _asked(log) == Counter(ids)


def test_changed_repeated_and_unanswered_requests(spark, tmp_path):
    store, log = str(tmp_path / "answers"), str(tmp_path / "log")
    twice = _golden(spark, [("a", "x"), ("a", "x"), ("b", "y"), (None, "z")])
    preds = predict(twice, _model(log), "m", store=store)
    assert sorted(str(r["example_id"]) for r in preds.collect()) == ["None", "a", "a", "b"]
    assert _asked(log) == Counter({"a": 1, "b": 1, "None": 1})

    predict(_golden(spark, [("a", "x"), ("b", "new")]), _model(log), "m", store=store)
    assert _asked(log)["a"] == 1 and _asked(log)["b"] == 2
    predict(_golden(spark, [("a", "x")]), _model(log), "other", store=store)  # another run
    assert _asked(log)["a"] == 2

    def silent(batch):
        return pd.DataFrame({"job_info": [None] * len(batch)}, index=batch.index)

    preds = predict(_golden(spark, [("q", "x")]), silent, "m", store=store).collect()
    assert [r["answer_error"] for r in preds] == ["unparseable answer"]
    preds = predict(_golden(spark, [("q", "x")]), _model(log), "m", store=store).collect()
    assert [r["answer_error"] for r in preds] == [None] and _asked(log)["q"] == 1

    empty = predict(_golden(spark, []), _model(log), "fresh", store=str(tmp_path / "none"))
    assert empty.count() == 0


def test_stored_answers_equal_plain_ones(spark, sf_small, tmp_path):
    golden = documents_as_golden(read_table(spark, sf_small, "documents"))
    plain = predict(golden, stub_extractor, "s")
    stored = predict(golden, stub_extractor, "s", store=str(tmp_path / "answers"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
