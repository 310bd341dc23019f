"""End-to-end evaluation on the driver tables and the engine's edge cases."""

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import reshape as rs
from fieldmark.operators.aggregate import run_summary
from fieldmark.operators.judge import token_overlap_judge
from fieldmark.operators.pair import pair
from fieldmark.operators.report import failures
from fieldmark.operators.score import (
    ExactMatch,
    FieldSpec,
    FuzzyMatch,
    add_overall,
    field_results_array,
    score_fields,
)
from fieldmark.operators.validate import validate
from fieldmark.plans.evaluate import default_specs, evaluate
from fieldmark.session import scratch_path
from fieldmark.sources.artifacts import (
    list_runs,
    pick_runs,
    read_run_examples,
    read_run_summaries,
    write_run,
)
from fieldmark.sources.fixtures import fixture

FIXED_SF001 = {  # FIXTURES.md: values at sf0.01
    "baseline": (0.8780, 0.9208, 1998.46, 5242500),
    "candidate": (0.8829, 0.9229, 1998.66, 5242500),
}


def test_fixture_numbers_sf001(spark):
    g, p = fixture(spark, "/root/testdata/sf0.01")
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    for r in ev.summary().collect():
        mean, pr, lat, tok = FIXED_SF001[r["run"]]
        assert round(r["mean_score"], 4) == mean and round(r["pass_rate"], 4) == pr
        assert round(r["mean_latency_ms"], 2) == lat and r["total_tokens"] == tok
        assert r["n_examples"] == 15000


def _summary_rows(spark, sf):
    g, p = fixture(spark, sf)
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    return sorted((r["run"], round(r["mean_score"], 12), r["n_passed"]) for r in ev.summary().collect())


def test_same_result_for_1_and_8_partitions(spark, sf_small):
    a = _summary_rows(spark, sf_small)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = _summary_rows(spark, sf_small)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_overall_goldens(spark):
    """Saved-report rows: overall = mean of the five field scores (tolerance 0.01)."""
    rows = [(1.0, 1.0, 1.0, 0.57, 1.0, 0.91), (0.83, 1.0, 1.0, 0.75, 1.0, 0.92),
            (0.85, 1.0, 1.0, 0.69, 1.0, 0.91), (0.83, 1.0, 1.0, 0.0, 1.0, 0.77),
            (1.0, 1.0, 1.0, 0.64, 0.96, 0.92)]
    df = spark.createDataFrame(rows, "title double, seniority double, work_mode double, "
                                     "location double, skills double, expect double")
    specs = [FieldSpec(f) for f in ("seniority", "work_mode", "location", "title", "skills")]
    wide = df.select("expect", *[F.struct(F.col(f).alias("score")).alias(f) for f in
                                 ("seniority", "work_mode", "location", "title", "skills")])
    for r in add_overall(wide, specs).collect():
        assert abs(r["overall_score"] - r["expect"]) <= 0.01 and r["passed"]


def _tiny(spark, golden_rows, pred_rows):
    g = spark.createDataFrame(golden_rows, "id string, category string, input map<string,string>, "
                              "expected struct<title:string,seniority:string,work_mode:string,"
                              "location:string,skills:array<string>>, notes string")
    p = spark.createDataFrame(pred_rows, "run string, example_id string, job_info struct<title:string,"
                              "seniority:string,work_mode:string,location:string,skills:array<string>>,"
                              " latency_ms double, total_tokens bigint")
    return g, p


def test_empty_run_and_all_null_field(spark):
    inp = {"raw_title": "t", "raw_description": "d"}
    g, p = _tiny(spark, [("e1", "c", inp, ("T", None, None, None, []), None)],
                 [("r", "e1", ("T", None, None, None, None), None, None)])
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    (r,) = ev.scored.collect()
    assert r["overall_score"] == 1.0 and r["passed"]  # null/null and []/[] all score 1.0
    assert r["latency_ms"] == 0.0 and r["total_tokens"] == 0
    empty = evaluate(g, p.where("false"), default_specs("stub", token_overlap_judge))
    assert run_summary(empty.examples).count() == 0


def test_missing_prediction_modes(spark):
    inp = {"raw_title": "t", "raw_description": "d"}
    g, p = _tiny(spark, [("e1", "c", inp, ("T", None, None, None, []), None),
                         ("e2", "c", inp, ("T", None, None, None, []), None)],
                 [("r", "e1", ("T", None, None, None, []), 1.0, 1)])
    assert pair(g, p, "drop").count() == 1
    with pytest.raises(ValueError):
        pair(g, p, "error")
    nulls = pair(g, p, "null", runs=["r"]).orderBy("example_id").collect()
    assert [r["example_id"] for r in nulls] == ["e1", "e2"] and nulls[1]["a_title"] is None


def test_first_wins_on_duplicate_fields(spark):
    inp = {"raw_title": "t", "raw_description": "d"}
    g, p = _tiny(spark, [("e1", "c", inp, ("Data Engineer", "mid", None, None, []), None)],
                 [("r", "e1", ("data engineer", "mid", None, None, []), 1.0, 1)])
    specs = [FieldSpec("title", ExactMatch()), FieldSpec("seniority"),
             FieldSpec("title", FuzzyMatch(threshold=0.99))]
    scored = add_overall(score_fields(pair(g, p), specs), specs)
    long = scored.select("run", "example_id", F.posexplode(field_results_array(specs)).alias("pos", "fr")) \
        .select("run", "example_id", "pos", "fr.field", "fr.scorer", "fr.result.*")
    fw = {r["field"]: r["scorer"] for r in rs.first_wins(long).collect()}
    assert fw == {"title": "exact_match", "seniority": "exact_match"}
    nested = scored.select(rs.first_wins_nested(field_results_array(specs)).alias("x")).first()["x"]
    assert [x["field"] for x in nested] == ["title", "seniority"]
    assert scored.first()["overall_score"] == 1.0


def test_failures_only_failed_examples(spark, sf_small):
    g, p = fixture(spark, sf_small)
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    f = failures(ev.scored)
    failed_ids = {r["example_id"] for r in ev.scored.where(~F.col("passed")).collect()}
    assert {r["example"] for r in f.collect()} <= failed_ids
    assert f.where(F.col("reason").isNull()).count() == 0


def test_artifact_round_trip(spark, sf_small):
    g, p = fixture(spark, sf_small)
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    root = scratch_path(spark, "test_artifacts")
    write_run(ev, root, judge="stub")
    runs = read_run_summaries(spark, root)
    stored = {r["model"]: r["run"] for r in runs.collect()}
    assert set(stored) == {"baseline", "candidate"}
    assert all(r["artifact"] == r["run"] and r["run"].startswith(r["model"] + "_")
               for r in runs.collect())
    back = read_run_examples(spark, root, runs=[stored["baseline"]])
    assert back.count() == ev.scored.where("run = 'baseline'").count()
    orig = {r["example_id"]: r["overall_score"] for r in ev.scored.where("run='baseline'").collect()}
    assert {r["example_id"]: r["overall_score"] for r in back.collect()} == orig
    assert pick_runs(runs) == (stored["baseline"], stored["candidate"])
    assert [r["run"] for r in list_runs(spark, root).collect()] == sorted(stored.values())
    assert write_run(ev, root, save=False) is None


def test_close_deletes_scratch_and_keeps_artifacts(spark, sf_small):
    import os

    g, p = fixture(spark, sf_small)
    root = scratch_path(spark, "kept_artifacts")
    with evaluate(g, p, default_specs("stub", token_overlap_judge)) as ev:
        write_run(ev, root)
        folders = [f.replace("file:", "", 1) for f in ev.scratch]
        assert {os.path.basename(f).rsplit("-", 1)[0] for f in folders} >= {
            "paired", "pairs", "judge_verdicts", "scored"}
        assert sum(map(os.path.isdir, folders)) >= 4
    assert not any(map(os.path.exists, folders)) and ev.scratch == []
    assert read_run_summaries(spark, root).count() == 2
    ev.close()  # once more changes nothing


def test_artifact_readers_check_required_fields(spark, tmp_path):
    import json

    from fieldmark.sources.artifacts import read_experiment

    good = {"example_id": "e1", "overall_score": 1.0, "passed": True, "field_results": [
        {"field": "title", "scorer": "s", "result": {"score": 1.0, "passed": True}}]}
    doc = {"model": "m", "examples": [good], "mean_score": 1.0, "pass_rate": 1.0}
    bad = {
        "no_model": {**doc, "model": None}, "no_rate": {**doc, "pass_rate": "high"},
        "no_id": {**doc, "examples": [{k: v for k, v in good.items() if k != "example_id"}]},
        "no_score": {**doc, "examples": [{**good, "field_results": [
            {"field": "title", "scorer": "s", "result": {"passed": True}}]}]}}
    (tmp_path / "ok.json").write_text(json.dumps(doc))
    assert read_experiment(spark, str(tmp_path / "ok.json"))[1].count() == 1
    for name, value in bad.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        with pytest.raises(Exception, match=f"wrong type: {name}"):
            read_experiment(spark, str(tmp_path / f"{name}.json"))[0].collect()

    rows = tmp_path / "own" / "examples" / "run=m_1"
    rows.mkdir(parents=True)
    unscored = {**good, "example_id": "e2", "overall_score": None}
    (rows / "a.json").write_text("\n".join(map(json.dumps, [good, unscored])))
    assert read_run_examples(spark, str(tmp_path / "own")).count() == 2
    (rows / "b.json").write_text(json.dumps({"example_id": "e3"}))
    with pytest.raises(Exception, match="wrong type: m_1/e3"):
        read_run_examples(spark, str(tmp_path / "own")).collect()


def test_validate_raise_and_split(spark, sf_small):
    from fieldmark.operators.validate import plant_violations
    from fieldmark.sources.fixtures import FIXTURE_DOMAINS

    g, _ = fixture(spark, sf_small)
    assert validate(g, domains=FIXTURE_DOMAINS) is g
    bad = plant_violations(g).drop("row_key")
    with pytest.raises(ValueError):
        validate(bad, domains=FIXTURE_DOMAINS)
    good, rejected = validate(bad, on_error="split", domains=FIXTURE_DOMAINS)
    assert good.count() + rejected.count() == g.count() and rejected.count() > 0


def test_read_golden_jsonl(spark):
    import json

    from fieldmark.sources.golden import read_golden

    def write_lines(path, lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)

    good = {"id": "ex_1", "category": "c", "input": {"raw_title": "t", "raw_description": "d"},
            "expected": {"title": "T", "seniority": "senior"}}
    d = scratch_path(spark, "golden_src")
    write_lines(d, ["", json.dumps(good) + "  ", "", "   ", json.dumps(dict(good, id="ex_3"))])
    rows = read_golden(spark, d).orderBy("line_order").collect()
    assert [r["id"] for r in rows] == ["ex_1", "ex_3"] and rows[0]["expected"]["skills"] == []
    d2 = scratch_path(spark, "golden_src")
    write_lines(d2, [json.dumps(good),
                     json.dumps(dict(good, id="ex_2", expected={"title": "T", "skills": None})),
                     json.dumps(dict(good, id="ex_4", expected={"seniority": "boss"})),
                     json.dumps(dict(good, id="ex_5")),
                     json.dumps(dict(good, id=6))])
    with pytest.raises(ValueError):
        read_golden(spark, d2)
    ok, bad = read_golden(spark, d2, on_error="split")
    assert ok.count() == 2
    assert sorted(tuple(r["violations"]) for r in bad.collect()) == [
        ("id is not a string",), ("seniority not in domain",), ("skills is null",)]


def test_predict_flags_bad_answers_and_validates(spark):
    import json as _json

    import pandas as pd

    from fieldmark.operators.predict import predict
    from fieldmark.operators.validate import prediction_checks

    inp = {"raw_title": "t", "raw_description": "d"}
    g, _ = _tiny(spark, [(f"e{i}", "c", inp, ("T", None, None, None, []), None) for i in range(3)],
                 [("r", "e0", ("T", None, None, None, []), 1.0, 1)])

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        answers = {"e0": _json.dumps({"title": "T", "seniority": "senior"}),
                   "e1": "not json at all",
                   "e2": _json.dumps({"title": "T", "seniority": "boss"})}
        return pd.DataFrame({"job_info": [answers[i] for i in batch["example_id"]],
                             "total_tokens": [7] * len(batch)})

    preds = predict(g, model, run="r")
    rows = {r["example_id"]: r for r in preds.collect()}
    assert rows["e0"]["answer_error"] is None and rows["e0"]["job_info"]["skills"] == []
    assert rows["e1"]["answer_error"] == "unparseable answer" and rows["e1"]["job_info"] is None
    assert rows["e0"]["latency_ms"] >= 0 and rows["e0"]["total_tokens"] == 7
    good, bad = validate(preds, on_error="split", checks=prediction_checks())
    assert {r["example_id"]: list(r["violations"]) for r in bad.collect()} == {
        "e1": ["missing job_info"], "e2": ["seniority not in domain"]}


def test_run_evaluation_end_to_end_and_compare_stored(spark, sf_small):
    from fieldmark.operators.predict import stub_extractor
    from fieldmark.plans.compare import compare_stored_runs
    from fieldmark.plans.evaluate import run_evaluation
    from fieldmark.sources.fixtures import FIXTURE_DOMAINS
    from fieldmark.sources.golden import write_golden

    g, _ = fixture(spark, sf_small)
    gpath = scratch_path(spark, "golden_e2e")
    write_golden(g, gpath)
    root = scratch_path(spark, "runs_e2e")
    for model in ("stub-a", "stub-b"):
        ev = run_evaluation(spark, gpath, stub_extractor, model, token_overlap_judge, "stub-judge",
                            out_root=root, domains=FIXTURE_DOMAINS)
        assert ev.summary().first()["n_examples"] == g.count()
    c = compare_stored_runs(spark, root)
    assert {c.baseline[:6], c.candidate[:6]} == {"stub-a", "stub-b"}
    rows = {r["field"]: r for r in c.rows.collect()}
    assert set(rows) == {"title", "seniority", "work_mode", "location", "skills", "overall"}
    assert all(abs(r["delta_mean"]) < 1e-12 for r in rows.values())  # same stub, same scores
    assert c.melted.count() == 10


def test_complete_fields_and_display_order(spark, sf_small):
    from fieldmark.operators.aggregate import complete_fields, field_stats
    from fieldmark.operators.reshape import in_display_order

    g, p = fixture(spark, sf_small)
    specs = [FieldSpec("seniority"), FieldSpec("work_mode")]
    ev = evaluate(g, p, specs, persist=False)
    stats = field_stats(ev.primary)
    full = complete_fields(stats, ["title", "seniority", "work_mode", "location", "skills"],
                           ev.examples)
    rows = in_display_order(full).collect()
    assert [r["field"] for r in rows[:5]] == ["title", "seniority", "work_mode", "location", "skills"]
    missing = [r for r in rows if r["field"] in ("title", "location", "skills")]
    assert missing and all(r["mean_score"] == 0.0 and r["pass_rate"] == 0.0 and r["n"] == 0
                           for r in missing)


def test_predict_concurrency_partitions(spark, sf_small):
    from fieldmark.operators.predict import predict, stub_extractor

    g, _ = fixture(spark, sf_small)
    preds = predict(g, stub_extractor, run="s", concurrency=3, persist=False)
    assert preds.rdd.getNumPartitions() == 3
    assert preds.count() == g.count() and preds.where("answer_error IS NOT NULL").count() == 0


def test_legacy_single_document_artifacts(spark):
    import json
    import os
    import time as _time

    from fieldmark.sources.artifacts import flatten_examples, read_experiment

    root = scratch_path(spark, "legacy").replace("file:", "", 1)
    os.makedirs(root)

    def doc(model, scores):
        ex = [{"example_id": f"ex_{i}", "overall_score": s, "passed": s >= 0.7,
               "field_results": [{"field": "title", "scorer": "llm_judge",
                                  "result": {"score": s, "passed": s >= 0.5, "reason": None}},
                                 {"field": "title", "scorer": "exact_match",
                                  "result": {"score": 0.0, "passed": False, "reason": None}}]}
              for i, s in enumerate(scores)]
        return {"model": model, "examples": ex, "mean_score": sum(scores) / len(scores),
                "pass_rate": sum(s >= 0.7 for s in scores) / len(scores)}

    for name, scores in (("m-old_20260101_000000", [1.0, 0.5]), ("m-new_20260102_000000", [1.0, 1.0])):
        with open(f"{root}/{name}.json", "w") as fh:
            json.dump(doc(name.split("_")[0], scores), fh, indent=2)
        _time.sleep(1.1)  # distinct modification times
    runs, examples = read_experiment(spark, root)
    assert {r["run"] for r in runs.collect()} == {"m-old_20260101_000000", "m-new_20260102_000000"}
    assert examples.count() == 4 and examples.where("total_tokens = 0 AND latency_ms = 0.0").count() == 4
    oldest, newest = pick_runs(runs, time_col="mtime")
    assert (oldest, newest) == ("m-old_20260101_000000", "m-new_20260102_000000")
    long = flatten_examples(examples)
    assert long.count() == 8
    fw = rs.first_wins(long).where("run = 'm-old_20260101_000000'").orderBy("example_id").collect()
    assert [r["scorer"] for r in fw] == ["llm_judge", "llm_judge"] and [r["score"] for r in fw] == [1.0, 0.5]


def test_evaluate_rejects_duplicate_or_missing_predictions(spark):
    inp = {"raw_title": "t", "raw_description": "d"}
    gold = [("e1", "c", inp, ("T", None, None, None, []), None),
            ("e2", "c", inp, ("T", None, None, None, []), None)]
    pred = ("r", "e1", ("T", None, None, None, []), 1.0, 1)
    specs = [FieldSpec("title")]
    g, p = _tiny(spark, gold, [pred, pred])          # e1 twice, e2 missing: counts agree
    with pytest.raises(ValueError):
        evaluate(g, p, specs)
    g, p = _tiny(spark, gold, [pred])
    with pytest.raises(ValueError):
        evaluate(g, p, specs)
    assert evaluate(g, p, specs, missing="drop").scored.count() == 1


def test_large_scale_paths_give_same_results(spark, sf_small):
    """max_broadcast_rows=0 forces the paths taken when distinct pairs are too
    many to broadcast: similarities and judge verdicts by a shuffle join with
    hot pairs split off.  Every score, pass flag and reason must be unchanged."""
    import dataclasses

    g, p = fixture(spark, sf_small)
    specs = default_specs("stub", token_overlap_judge)
    big = [FieldSpec(s.field, dataclasses.replace(s.scorer, max_broadcast_rows=0))
           if hasattr(s.scorer, "max_broadcast_rows") else s for s in specs]
    cols = ["run", "example_id", "seniority", "work_mode", "location", "title", "skills",
            "overall_score", "passed"]
    a = {(r["run"], r["example_id"]): r for r in evaluate(g, p, specs).scored.select(cols).collect()}
    b = {(r["run"], r["example_id"]): r for r in evaluate(g, p, big).scored.select(cols).collect()}
    assert a == b and len(a) == 2 * g.count()


def test_duplicate_golden_ids_rejected(spark):
    inp = {"raw_title": "t", "raw_description": "d"}
    gold = [("e1", "c", inp, ("T", None, None, None, []), None)] * 2
    g, p = _tiny(spark, gold, [("r", "e1", ("T", None, None, None, []), 1.0, 1)])
    with pytest.raises(ValueError):
        evaluate(g, p, [FieldSpec("title")])


def test_report_helpers(spark, sf_small):
    from fieldmark.operators.aggregate import field_means_all_entries, score_distribution
    from fieldmark.operators.compare import compare_runs, display_names
    from fieldmark.operators.gates import failing_fields

    g, p = fixture(spark, sf_small)
    ev = evaluate(g, p, default_specs("stub", token_overlap_judge))
    shown = display_names(compare_runs(ev.primary, ev.summary(), "baseline", "candidate"))
    assert {"Scored field", "Mean before", "Mean change", "Passed change"} <= set(shown.columns)
    means = {(r["run"], r["field"]): r["mean_score"] for r in field_means_all_entries(ev.long).collect()}
    low = {(r["run"], r["field"]) for r in failing_fields(ev.long, threshold=0.9).collect()}
    assert low == {k for k, v in means.items() if v < 0.9}
    exact = {(r["run"], r["field"]): r for r in score_distribution(ev.primary).collect()}
    approx = {(r["run"], r["field"]): r for r in score_distribution(ev.primary, exact=False).collect()}
    for k, r in exact.items():
        assert approx[k]["min_score"] == r["min_score"] and approx[k]["max_score"] == r["max_score"]
        assert r["min_score"] <= r["q25"] <= r["median"] <= r["q75"] <= r["max_score"]


def test_fuzzy_pass_only_length_bound(spark, sf_small):
    """The length bound decides some failures without LCS; pass flags agree
    with the full scorer everywhere, scores wherever they are computed."""
    from pyspark.sql import functions as F

    g, p = fixture(spark, sf_small)
    paired = pair(g, p)
    rows = paired.select("run", "example_id", "e_location", "a_location").union(
        paired.select("run", "example_id", F.lit("Berlin, Germany"), F.lit("Berlin")))
    full = {(r[0], r[1], r[2]): r[3] for r in FuzzyMatch().inline(rows, "e_location", "a_location", "x")
            .select("run", "example_id", "e_location", "x").collect()}
    for dedupe in (False, True):
        scorer = FuzzyMatch(pass_only=True, dedupe=dedupe)
        out = (scorer.apply(rows, "e_location", "a_location", "x") if dedupe
               else scorer.inline(rows, "e_location", "a_location", "x"))
        got = {(r[0], r[1], r[2]): r[3] for r in out.select("run", "example_id", "e_location", "x").collect()}
        assert {k: v["passed"] for k, v in got.items()} == {k: v["passed"] for k, v in full.items()}
        decided = [k for k, v in got.items() if v["score"] is None]
        assert decided  # "Berlin, Germany" vs "Berlin": bound 12/21 < 0.8
        assert all(got[k]["score"] == full[k]["score"] for k in got if k not in decided)


def test_weighted_overall(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.5)], "title double, seniority double, location double")
    specs = [FieldSpec("seniority"), FieldSpec("location"), FieldSpec("title")]
    wide = df.select(*[F.struct(F.col(f).alias("score")).alias(f) for f in ("seniority", "location", "title")])
    plain = add_overall(wide, specs).first()
    weighted = add_overall(wide, specs, weights={"title": 2.0}).first()
    assert plain["overall_score"] == 0.5 and not plain["passed"]
    assert weighted["overall_score"] == (2 * 1.0 + 0.0 + 0.5) / 4 and not weighted["passed"]
    assert add_overall(wide, specs, pass_threshold=0.6, weights={"title": 4.0}).first()["passed"]


def _one_field_runs(spark, golden_ids, predicted, title="x"):
    """Golden rows and predictions ``(run, example_id, seniority)`` of a tiny evaluation."""
    from fieldmark.schemas import GOLDEN, PREDICTIONS

    g = spark.createDataFrame(
        [(i, "c", {"raw_title": "t", "raw_description": "d"}, (title, "senior", None, None, []),
          None) for i in golden_ids], GOLDEN)
    p = spark.createDataFrame(
        [{"run": r, "example_id": i, "job_info": {"title": title, "seniority": s, "skills": []}}
         for r, i, s in predicted], PREDICTIONS)
    return g, p, [FieldSpec("seniority", ExactMatch())]


@pytest.mark.parametrize("predicted", [
    [("r", "ex_1", "senior")],                              # a run without any match
    [("r", "1", "senior"), ("s", "ex_1", "senior")],        # one beside a good run
    [("r", "1", "senior"), ("r", "2", "senior")],           # an id the golden set lacks
    [("r", "1", "senior"), ("r", "1", "senior")]])          # an id twice
def test_incomplete_runs_raise(spark, predicted):
    g, p, specs = _one_field_runs(spark, ["1"], predicted)
    with pytest.raises(ValueError):
        evaluate(g, p, specs)


def test_missing_null_in_one_pass(spark):
    g, p, specs = _one_field_runs(spark, ["1", "2"], [("r", "1", "senior"), ("s", "2", "lead")])
    got = {(r["run"], r["example_id"]): (r["overall_score"], r["latency_ms"], r["total_tokens"])
           for r in evaluate(g, p, specs, missing="null").scored.collect()}
    assert got == {("r", "1"): (1.0, 0.0, 0), ("r", "2"): (0.0, 0.0, 0),
                   ("s", "1"): (0.0, 0.0, 0), ("s", "2"): (0.0, 0.0, 0)}


def test_bad_answers_raise_or_fail(spark):
    g, p, specs = _one_field_runs(spark, ["1", "2"], [("r", "1", "senior"), ("r", "2", "BOSS")])
    domains = {"seniority": ["senior", "lead"]}
    with pytest.raises(ValueError, match="seniority not in domain"):
        evaluate(g, p, specs, domains=domains)
    ev = evaluate(g, p, specs, domains=domains, bad_answers="fail")
    assert {r["example_id"]: (r["overall_score"], r["passed"]) for r in ev.scored.collect()} == {
        "1": (1.0, True), "2": (0.0, False)}
    assert ev.error_counts().first().asDict() == {
        "run": "r", "bad_answers": 1, "unscored_results": 0}
    from fieldmark.operators.predict import predict

    def garbage(batch):
        import pandas as pd

        return pd.DataFrame({"job_info": ["not json"] * len(batch)}, index=batch.index)
    with pytest.raises(ValueError, match="unparseable"):
        evaluate(g, predict(g, garbage, run="r"), specs)


def test_one_model_saved_twice(spark):
    from datetime import datetime, timezone

    from fieldmark.plans.compare import compare_stored_runs

    root = scratch_path(spark, "versions")
    for day, answer in ((1, "lead"), (2, "senior")):
        g, p, specs = _one_field_runs(spark, ["1"], [("r", "1", answer)])
        ev = evaluate(g, p, specs)
        when = datetime(2026, 3, day, tzinfo=timezone.utc)
        write_run(ev, root, model="m", created=when)
        with pytest.raises(FileExistsError):
            write_run(ev, root, model="m", created=when)
    c = compare_stored_runs(spark, root)
    assert (c.baseline, c.candidate) == ("m_20260301_000000", "m_20260302_000000")
    row = c.rows.where("field = 'seniority'").first()
    assert (row["baseline_mean"], row["candidate_mean"]) == (0.0, 1.0)
    two = _one_field_runs(spark, ["1"], [("r", "1", "lead"), ("s", "1", "lead")])
    with pytest.raises(FileExistsError):
        write_run(evaluate(*two), root, model="m")


def test_golden_types_are_strict(spark):
    import json

    from fieldmark.sources.golden import read_golden

    def record(i, skills=("python",), **over):
        return json.dumps({"id": i, "category": "c",
                           "input": {"raw_title": "t", "raw_description": "d"},
                           "expected": {"title": "T", "skills": skills}} | over)

    path = scratch_path(spark, "golden_types")
    lines = [record("ok"), "\t", " \u00a0" + record("empty", []), '{"id": "cut', record("a", "python"),
             record("b", [1, 2]), record("c", ["x", None]),
             record("d", input={"raw_title": 5, "raw_description": "d"}), record("e", {"x": "y"})]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = read_golden(spark, path, on_error="split")
    assert sorted(r["id"] for r in good.collect()) == ["empty", "ok"]
    found = {r["id"]: list(r["violations"]) for r in bad.collect()}
    assert set(found) == {None, "a", "b", "c", "d", "e"}
    assert any("malformed JSON" in m for m in found[None])
    assert all(any("skills is not a list of strings" in m for m in found[i]) for i in "abce")
    assert any("input has a value that is not a string" in m for m in found["d"])


def test_latency_p95_is_nearest_rank(spark):
    from fieldmark.operators.gates import latency_p95

    values = {"r": [float(i) + 0.25 * (i % 3) for i in range(1, 42)], "s": [7.5, 7.25, 7.25],
              "t": [3.0]}
    rows = [(run, v) for run, vs in values.items() for v in vs]
    got = {r["run"]: r["p95_latency_ms"] for r in latency_p95(
        spark.createDataFrame(rows, "run string, latency_ms double")).collect()}
    assert got == {run: sorted(vs)[-(-95 * len(vs) // 100) - 1] for run, vs in values.items()}


def test_a_broken_save_is_not_seen_and_can_be_repeated(spark):
    from datetime import datetime, timezone

    from fieldmark.sources.artifacts import stage_run, unpublished_attempts

    root = scratch_path(spark, "broken_save")
    g, p, specs = _one_field_runs(spark, ["1", "2"], [("r", "1", "lead"), ("r", "2", "lead")])
    ev, when = evaluate(g, p, specs), datetime(2026, 5, 1, tzinfo=timezone.utc)
    broken = stage_run(ev, root, model="m", created=when)
    assert unpublished_attempts(spark, root) == [broken.attempt]
    write_run(ev, root, model="m", created=when)
    assert read_run_examples(spark, root).count() == 2
    assert read_run_examples(spark, root, runs=["m_20260501_000000"]).count() == 2
    assert read_run_summaries(spark, root).first()["n_examples"] == 2
    assert unpublished_attempts(spark, root) == [broken.attempt]
    with pytest.raises(FileExistsError):
        write_run(ev, root, model="m", created=when)
    # two saves at once under one id: the one that was created first, or has the smaller attempt
    broken.publish()
    assert read_run_examples(spark, root).count() == 2


def test_stored_lines_of_wrong_types_name_their_run(spark, tmp_path):
    import json

    good = {"example_id": "e", "overall_score": 1.0, "passed": True, "field_results": [
        {"field": "title", "scorer": "s", "result": {"score": 1, "passed": True, "reason": None}}]}
    result = good["field_results"][0]
    bad = {
        "score": {**good, "field_results": [{**result, "result": {"score": "high", "passed": True}}]},
        "overall": {**good, "overall_score": "x"}, "id": {**good, "example_id": 3},
        "lacks": {**good, "field_results": [result, {"field": "title", "scorer": "s"}]},
        "list": {**good, "field_results": {"a": 1}}, "passed": {**good, "passed": "yes"}}
    for name, row in bad.items():
        folder = tmp_path / name / "examples" / f"run=run_{name}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "field_results": []}))
        assert read_run_examples(spark, str(tmp_path / name)).count() == 2
        (folder / "b.json").write_text(json.dumps(row))
        with pytest.raises(Exception, match=f"wrong type: run_{name}/"):
            read_run_examples(spark, str(tmp_path / name)).collect()
    (tmp_path / "line" / "runs" / "run=m_7").mkdir(parents=True)
    (tmp_path / "line" / "runs" / "run=m_7" / "a.json").write_text("not json")
    with pytest.raises(Exception, match="wrong type: m_7: malformed"):
        read_run_summaries(spark, str(tmp_path / "line")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_run_summaries(spark, str(tmp_path / "nothing"))


def test_documents_of_wrong_types_name_their_run(spark, tmp_path):
    import json

    from fieldmark.sources.artifacts import read_experiment

    ex = {"example_id": "e1", "overall_score": 1.0, "passed": True, "field_results": [
        {"field": "title", "scorer": "s", "result": {"score": 1.0, "passed": True}}]}
    doc = {"model": "m", "examples": [ex], "mean_score": 1, "pass_rate": 1.0}
    for name, value in {
            "text_score": {**doc, "examples": [ex, {**ex, "overall_score": "x"}]},
            "text_flag": {**doc, "examples": [{**ex, "passed": "true"}]},
            "number_model": {**doc, "model": 5}, "text_rate": {**doc, "pass_rate": "0.5"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        with pytest.raises(Exception, match=f"wrong type: {name}"):
            read_experiment(spark, str(tmp_path / f"{name}.json"))[0].collect()
    (tmp_path / "broken.json").write_text('{"model": "m", "examples": [')
    with pytest.raises(Exception, match="wrong type: broken"):
        read_experiment(spark, str(tmp_path / "broken.json"))[0].collect()


def test_an_evaluation_without_predictions_raises(spark):
    g, p, specs = _one_field_runs(spark, ["1"], [("r", "1", "lead")])
    with pytest.raises(ValueError, match="no predictions"):
        evaluate(g, p.limit(0), specs)
