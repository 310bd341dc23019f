"""Scorers from outside the library in the shared pass over distinct pairs, and long verdicts."""

from collections import Counter
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.scorers import result
from fieldmark.operators.judge import Judge
from fieldmark.operators.score import FieldSpec, score_fields, takes_pairs
from fieldmark.plans.evaluate import evaluate

SEEN = []


@dataclass(frozen=True)
class SameLength:
    """Half a point for texts of equal length; batched, and added last."""

    name: str = "same_length"
    added_last = True

    def pair_columns(self, df, expected, actual):
        e, a = F.col(expected), F.col(actual)
        return e.isNotNull() & a.isNotNull(), e, a

    def attach(self, df, expected, actual, out, pairs, stats):
        SEEN.append((out, stats.pairs, stats.rows, pairs.count()))
        scored = pairs.select(F.col("expected").alias("_e"), F.col("actual").alias("_a"),
                              (F.length("expected") == F.length("actual")).alias("_same"))
        joined = df.join(scored, (F.col(expected) == F.col("_e")) & (F.col(actual) == F.col("_a")), "left")
        same = F.coalesce("_same", F.lit(False))
        return joined.withColumn(out, result(F.when(same, 0.5).otherwise(0.0), same, F.lit("length"))) \
            .drop("_e", "_a", "_same")


def runs(spark, answers):
    golden = spark.createDataFrame(
        [(str(i), "c", {"raw_title": "t"}, (e, e, None, None, [])) for i, (e, _) in enumerate(answers)],
        "id string, category string, input map<string,string>, expected struct<title: string, "
        "seniority: string, work_mode: string, location: string, skills: array<string>>")
    predictions = spark.createDataFrame(
        [("r", str(i), (a, a, None, None, []), 1.0, 1) for i, (_, a) in enumerate(answers)],
        "run string, example_id string, job_info struct<title: string, seniority: string, "
        "work_mode: string, location: string, skills: array<string>>, latency_ms double, "
        "total_tokens long")
    return golden, predictions


@pytest.fixture(scope="module")
def paired(spark):
    rows = [(str(i), e, a) for i, (e, a) in enumerate([("ab", "cd")] * 40 + [("ab", "c"), (None, "c")])]
    return spark.createDataFrame(rows, "example_id string, e_title string, a_title string") \
        .withColumns({"e_seniority": F.col("e_title"), "a_seniority": F.col("a_title")})


def test_a_foreign_batch_scorer_takes_part(paired):
    SEEN.clear()
    assert takes_pairs(SameLength())
    specs = [FieldSpec("title", SameLength()), FieldSpec("seniority")]
    got = score_fields(paired, specs).select("title.score", "seniority.score").collect()
    # two distinct pairs stand for 41 rows; the row without an expected text is in none
    assert SEEN == [("title", 2, 41, 2)]
    assert Counter(r[0] for r in got) == {0.5: 40, 0.0: 2}


def test_a_foreign_scorer_is_added_last_and_finds_written_rows(spark, monkeypatch):
    from fieldmark.operators import score
    from fieldmark.plans import evaluate as plan

    specs = [FieldSpec("title", SameLength()), FieldSpec("seniority")]
    text = str(score.overall_score(specs)._jc.toString())
    assert text.index("seniority") < text.index("title")
    written = []
    materialize = plan.materialize
    monkeypatch.setattr(plan, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    golden, predictions = runs(spark, [("ab", "cd"), ("ab", "ab")])
    ev = evaluate(golden, predictions, specs, missing="drop")
    assert "paired" in written and ev.scored.count() == 2
    ev.close()


def test_long_reasons_of_common_verdicts_are_not_broadcast(paired):
    import pandas as pd

    def judge(batch):
        return pd.Series(['{"score": 1, "reasoning": "' + "long " * 50 + '"}'] * len(batch))

    def scored(**bounds):
        spec = FieldSpec("title", Judge("r", "rubric", "m", judge, **bounds))
        out = score_fields(paired, [spec])
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.select("example_id", "title.*").collect()
        return sorted(map(str, rows)), plan

    want, _ = scored()
    short, plan = scored(max_broadcast_rows=0)
    assert short == want and "Broadcast" in plan
    long, plan = scored(max_broadcast_rows=0, max_broadcast_chars=10)
    assert long == want and len(want) == 42 and "_share" in plan
