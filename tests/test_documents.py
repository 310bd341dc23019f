"""Run documents streamed by the Python data source, against the reader by JSON functions."""

import io
import json

import pytest

from fieldmark.sources.artifacts import read_experiment
from fieldmark.sources.documents import CHUNK, JsonText, read_run_documents


def _doc(n, **more):
    ex = [{"example_id": f"e{i}", "overall_score": i / max(n, 1), "passed": i % 2 == 0, "extra": [i],
           "field_results": [{"field": "title", "scorer": "s", "result": {
               "score": 1, "passed": True, "reason": 'é"\\]}, 中' * (i % 5)}}]} for i in range(n)]
    return {"model": "m", "examples": ex, "mean_score": 0.5, "pass_rate": 1, **more}


@pytest.mark.parametrize("step", [1, 2, 7, CHUNK])
def test_values_do_not_depend_on_the_chunks(step):
    doc = {"a": 123456, "examples": [{"x": [1, {"y": "]}"}]}, -1.5e3, "s", None], "b": {}, "c": True}
    for text in (json.dumps(doc), json.dumps(doc, indent=3) + "\n "):
        stream = io.StringIO(text)
        got = list(JsonText(lambda size: stream.read(min(size, step))).members("examples"))
        assert [v for _, v, item in got if item] == doc["examples"]
        assert {k: v for k, v, item in got if not item} == {**doc, "examples": None}


def test_streamed_documents_equal_the_whole_reader(spark, tmp_path):
    (tmp_path / "m_1.json").write_text(json.dumps(_doc(2500, total_tokens=7), ensure_ascii=False))
    (tmp_path / "m_2.json").write_text(json.dumps(dict(reversed(_doc(3).items())), indent=2))
    (tmp_path / "m_3.json").write_text(json.dumps(_doc(0)))
    runs, examples = read_run_documents(spark, str(tmp_path))
    old_runs, old_examples = read_experiment(spark, str(tmp_path))
    assert examples.rdd.getNumPartitions() == 3  # a document a task
    cols = old_examples.columns
    assert sorted(map(str, examples.select(*cols).collect())) == sorted(map(str, old_examples.collect()))
    cols = [c for c in old_runs.columns if c != "mtime"]
    assert sorted(map(str, runs.select(*cols).collect())) == sorted(map(str, old_runs.select(*cols).collect()))
    assert {r["run"]: r["n_examples"] for r in runs.collect()} == {"m_1": 2500, "m_2": 3, "m_3": 0}


def test_names_of_files_and_an_empty_listing(spark, tmp_path):
    (tmp_path / "m 2%é.json").write_text(json.dumps(_doc(2)))
    runs, examples = read_run_documents(spark, str(tmp_path))
    assert [r["run"] for r in runs.collect()] == ["m 2%é"] and examples.count() == 2
    none = tmp_path / "none"
    none.mkdir()
    assert [df.count() for df in read_run_documents(spark, str(none))] == [0, 0]


def test_faulty_documents_name_their_run(spark, tmp_path):
    ex = _doc(1)["examples"][0]
    bad = {
        "no_model": json.dumps(_doc(1, model=None)), "rate": json.dumps(_doc(1, pass_rate="x")),
        "flag": json.dumps(_doc(0, examples=[ex, {**ex, "passed": "yes"}])),
        "score": json.dumps(_doc(0, examples=[{**ex, "overall_score": True}])),
        "result": json.dumps(_doc(0, examples=[{**ex, "field_results": [{"field": "f", "scorer": "s"}]}])),
        "examples": json.dumps(_doc(0, examples={})), "null": json.dumps(_doc(0, examples=[None])),
        "cut": json.dumps(_doc(3))[:-30], "after": json.dumps(_doc(1)) + "x", "empty": "",
        "nan": json.dumps(_doc(1, mean_score=float("nan")))}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match=f"wrong type: {name}:"):
            read_run_documents(spark, str(tmp_path / f"{name}.json"))[0].collect()


def test_tasks_share_many_documents_and_know_their_own_files_only(spark, tmp_path):
    import pickle

    from fieldmark.sources.documents import EXAMPLES, TASKS_A_PARTITION, RunDocumentReader, RunDocuments

    bound = TASKS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = bound + 5
    for i in range(n):
        (tmp_path / f"m_{i}.json").write_text(json.dumps(_doc(i % 3)))
    runs, examples = read_run_documents(spark, str(tmp_path))
    assert examples.rdd.getNumPartitions() == bound
    assert {r["run"]: r["n_examples"] for r in runs.collect()} == {f"m_{i}": i % 3 for i in range(n)}
    assert examples.count() == sum(i % 3 for i in range(n))
    paths = [f"/folder/{i}.json" for i in range(10_000)]
    source = RunDocuments({"paths": json.dumps(paths), "tasks": "7"})
    reader = source.reader(EXAMPLES)
    parts = reader.partitions()
    assert isinstance(reader, RunDocumentReader) and len(parts) == 7
    assert sorted(p for part in parts for p in part.paths) == sorted(paths)
    assert len(pickle.dumps(reader)) < 10_000 and len(pickle.dumps(source)) < 10_000
