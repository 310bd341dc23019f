"""What a step does to each row, or moves for it: plans and files that decide how it grows."""

import glob
import re

from pyspark.sql import functions as F

from fieldmark.operators.judge import token_overlap_judge
from fieldmark.operators.report import example_table
from fieldmark.plans.evaluate import default_specs, evaluate
from fieldmark.session import scratch_path
from fieldmark.sources import artifacts
from fieldmark.sources.artifacts import read_run_examples, write_run
from fieldmark.sources.fixtures import FIXTURE_DOMAINS, fixture
from fieldmark.sources.golden import read_golden, write_golden


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_lines_are_parsed_once_and_packed(spark, sf_small, monkeypatch):
    monkeypatch.setattr(artifacts, "FILE_ROWS", 40)
    golden, preds = fixture(spark, sf_small)
    root = scratch_path(spark, "growth").replace("file:", "", 1)
    with evaluate(golden, preds, default_specs("stub", token_overlap_judge)) as ev:
        write_run(ev, root)
        want = {tuple(r) for r in ev.scored.select("example_id", "overall_score", "passed").collect()}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    files = glob.glob(f"{root}/attempts/*/*/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    assert max(spark.read.text(f).count() for f in files) <= 40
    back = read_run_examples(spark, root)
    plan = _plan(back)
    assert len(re.findall("parseJson", plan)) == 1 and len(re.findall("from_json", plan)) == 1
    assert {tuple(r) for r in back.select("example_id", "overall_score", "passed").collect()} == want


def test_golden_lines_are_parsed_once(spark, sf_small):
    golden, _ = fixture(spark, sf_small)
    path = scratch_path(spark, "growth_golden")
    write_golden(golden, path)
    good, bad = read_golden(spark, path, on_error="split", domains=FIXTURE_DOMAINS)
    for df in (good, bad):
        assert len(re.findall("parseJson", _plan(df))) == 1
        assert len(re.findall("from_json", _plan(df))) == 1
    assert good.count() == golden.count() and bad.count() == 0


def test_verdicts_are_written_once_and_shuffled_by_short_keys(spark, sf_small):
    golden, preds = fixture(spark, sf_small)
    specs = default_specs("stub", token_overlap_judge)
    few = evaluate(golden, preds, specs)
    names = {f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in few.scratch}
    assert "judge_verdicts" in names and "verdict_fresh" not in names
    for s in specs:
        if hasattr(s.scorer, "max_broadcast_rows"):
            object.__setattr__(s.scorer, "max_broadcast_rows", 1)  # the path of many pairs
    many = evaluate(golden, preds, specs, persist=False)
    assert many.scored.columns == few.scored.columns
    cols = ["run", "example_id", "overall_score", "passed", F.col("field_results").cast("string")]
    assert sorted(map(tuple, many.scored.select(*cols).collect())) == \
        sorted(map(tuple, few.scored.select(*cols).collect()))
    # the first shuffle of the rows carries no result of another scorer
    joins = [x for x in _plan(many.scored).split("\n") if "_pre#" in x]
    assert not joins


def test_scoring_stages_are_compiled_by_the_jvm(spark, sf_small, monkeypatch):
    """HotSpot leaves methods of over 8,000 bytes to its interpreter."""
    from fieldmark.plans import evaluate as plan

    sizes = {}
    kept = plan.materialize

    def measured(df, name):
        seq = df._jdf.queryExecution().debug().codegenToSeq()
        sizes[name] = max(seq.apply(i)._3().maxMethodCodeSize() for i in range(seq.size()))
        return kept(df, name)

    monkeypatch.setattr(plan, "materialize", measured)
    golden, preds = fixture(spark, sf_small)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages are not planned before they run
    try:
        evaluate(golden, preds, default_specs("stub", token_overlap_judge)).close()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes["paired"] <= 8000 and sizes["scored"] <= 8000


def test_texts_with_the_separator_are_judged_once_a_key(spark):
    from fieldmark.schemas import GOLDEN, PREDICTIONS

    def info(title):
        return (title, "mid", "remote", None, ["a"])

    golden = spark.createDataFrame([("e1", "c", {}, info("a||b"), None), ("e2", "c", {}, info("a"), None)], GOLDEN)
    preds = spark.createDataFrame([("r", "e1", info("c"), 1.0, 1), ("r", "e2", info("b||c"), 1.0, 1)], PREDICTIONS)
    ev = evaluate(golden, preds, default_specs("stub", token_overlap_judge))
    assert ev.scored.count() == 2  # one key for both pairs: a repeated verdict would double rows


def test_table_of_long_results_is_shuffled_once(spark, sf_small):
    golden, preds = fixture(spark, sf_small)
    ev = evaluate(golden, preds, default_specs("stub", token_overlap_judge))
    plan = _plan(example_table(ev.long, ev.examples))
    assert len(re.findall("Exchange hashpartitioning", plan)) <= 2
    assert "SortAggregate" not in plan
