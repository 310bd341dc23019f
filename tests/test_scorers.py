"""Column scorers against the reference's literal cases and plain-Python models."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.scorers import exact_match, fuzzy_match, list_overlap
from fieldmark.functions.similarity import (
    indel_ratio,
    lcs_length,
    levenshtein_similarity,
    token_set_similarity,
)
from fieldmark.functions.text import format_2f, format_plain, norm, py_repr


def test_number_formats(spark):
    values = [0.0, 0.125, 0.5, 0.005, 0.285, 1.0, -0.25, -0.0004, 0.0125, 1234567.0, -4321.5, None]
    forms = {".0%": dict(percent=True), "+.3f": dict(digits=3, signed=True),
             "+.0%": dict(percent=True, signed=True), ",.0f": dict(grouped=True), ".0f": {}}
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for spec, how in forms.items():
        got = [r[0] for r in df.select(format_plain("x", **how)).collect()]
        assert got == [None if v is None else format(v, spec) for v in values], spec


def _score(spark, fn, rows, schema="e string, a string"):
    df = spark.createDataFrame(rows, schema)
    return [r["r"] for r in df.select(fn("e", "a").alias("r")).collect()]


@pytest.mark.parametrize("e,a,score,passed", [
    ("senior", "senior", 1.0, True),
    ("Senior", "senior", 1.0, True),
    ("senior", "mid", 0.0, False),
    (None, None, 1.0, True),
    ("senior", None, 0.0, False),
    ("  senior　", "SENIOR\t", 1.0, True),
])
def test_exact_match(spark, e, a, score, passed):
    (r,) = _score(spark, exact_match, [(e, a)])
    assert r["score"] == score and r["passed"] == passed


def test_exact_match_reason(spark):
    (r,) = _score(spark, exact_match, [("senior", None)])
    assert r["reason"] == "expected='senior', actual=None"
    (r,) = _score(spark, exact_match, [("senior", "mid")])
    assert r["reason"] is None


@pytest.mark.parametrize("e,a,threshold,check", [
    ("Porto, Portugal", "Porto, Portugal", 0.8, lambda s, p: s == 1.0 and p),
    ("San Jose, Peru", "San Jose, Per", 0.8, lambda s, p: s >= 0.8 and p),
    ("Porto, Portugal", "Oslo, Norway", 0.8, lambda s, p: s < 0.8 and not p),
    (None, None, 0.8, lambda s, p: s == 1.0 and p),
    ("Porto", None, 0.8, lambda s, p: s == 0.0 and not p),
    ("Madrid", "Mdrd", 0.5, lambda s, p: p),
])
def test_fuzzy_match(spark, e, a, threshold, check):
    (r,) = _score(spark, lambda x, y: fuzzy_match(x, y, threshold), [(e, a)])
    assert check(r["score"], r["passed"])


def test_fuzzy_ratios_and_reason(spark):
    rows = [("San Jose, Peru", "San Jose, Per"), ("Porto, Portugal", "Oslo, Norway"),
            ("Madrid", "Mdrd"), ("Porto, Portugal", "Porto")]
    got = _score(spark, fuzzy_match, rows)
    for (e, a), r in zip(rows, got):
        expect = indel_ratio(e.lower(), a.lower())
        assert r["score"] == expect
        assert r["reason"] == f"ratio={expect:.2f}"
    assert got[0]["score"] == 26 / 27
    assert got[3]["score"] == 0.5


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_lcs_random_against_dp():
    rng = random.Random(7)
    alphabet = "abcdé 中😀"
    for _ in range(400):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert lcs_length(a, b) == _lcs_dp(a, b)
    # long strings take the numpy mask path
    a = "".join(rng.choice("abcdefgh") for _ in range(700))
    b = "".join(rng.choice("abcdefgh") for _ in range(300))
    assert lcs_length(a, b) == _lcs_dp(a, b)


def test_indel_udf_matches_python(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice("xyz ,") for _ in range(rng.randint(0, 25))),
             "".join(rng.choice("xyz ,") for _ in range(rng.randint(0, 25)))) for _ in range(300)]
    got = _score(spark, lambda e, a: fuzzy_match(e, a)["score"], rows)
    assert got == [indel_ratio(e, a) for e, a in rows]


def test_levenshtein_similarity(spark):
    (r,) = _score(spark, levenshtein_similarity, [("london", "lndn")])
    assert abs(r - (1 - 2 / 6)) < 1e-12
    (r,) = _score(spark, levenshtein_similarity, [("", "")])
    assert r == 1.0


def _token_set_py(s1, s2):
    """Token-set ratio / 100 written from its public definition."""
    ta, tb = set(s1.split()), set(s2.split())
    if not ta or not tb:
        return 0.0
    inter, dab, dba = ta & tb, ta - tb, tb - ta
    if inter and (not dab or not dba):
        return 1.0
    ab, ba = " ".join(sorted(dab)), " ".join(sorted(dba))
    sect = " ".join(sorted(inter))
    sl = len(sect)
    sab, sba = sl + (sl != 0) + len(ab), sl + (sl != 0) + len(ba)
    dist = len(ab) + len(ba) - 2 * lcs_length(ab, ba)
    res = 1.0 - dist / (sab + sba) if sab + sba else 1.0
    if not sl:
        return res
    r1 = 1.0 - ((sl != 0) + len(ab)) / (sl + sab)
    r2 = 1.0 - ((sl != 0) + len(ba)) / (sl + sba)
    return max(res, r1, r2)


def test_token_set_matches_definition(spark):
    rng = random.Random(3)
    words = ["berlin", "germany", "new", "york", "usa", "us", "de"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))),
             " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for _ in range(300)]
    got = _score(spark, token_set_similarity, rows)
    for (e, a), g in zip(rows, got):
        assert abs(g - _token_set_py(e, a)) < 1e-12, (e, a)


def test_py_repr_parity(spark):
    values = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "tab\tnl\n", ""]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    got = [r[0] for r in df.select(py_repr("v")).collect()]
    assert got == [repr(v) for v in values] + ["None"]
    ldf = spark.createDataFrame([(["a", "b'c"],), ([],), (None,)], "v array<string>")
    got = [r[0] for r in ldf.select(py_repr("v", ldf.schema["v"].dataType)).collect()]
    assert got == [repr(["a", "b'c"]), "[]", "None"]


def test_norm_strips_python_whitespace(spark):
    ws = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    df = spark.createDataFrame([(ws + "AbC" + ws,), ("​x",)], "v string")
    got = [r[0] for r in df.select(norm("v")).collect()]
    assert got == [(ws + "AbC" + ws).lower().strip(), "​x".lower().strip()]


def test_format_2f_matches_python(spark):
    vals = sorted({2 * l / t for t in range(1, 80) for l in range(0, t // 2 + 1)})
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(format_2f("v")).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def test_list_overlap(spark):
    rows = [(["Python", "Spark"], ["python", "Apache Spark"]), ([], []), (["a"], []),
            (["a", "b", "c"], ["b", "c", "d", "e"])]
    df = spark.createDataFrame(rows, "e array<string>, a array<string>")
    out = df.select(*[list_overlap("e", "a", m)["score"].alias(m)
                      for m in ("precision", "recall", "f1", "jaccard")]).collect()
    assert out[0]["f1"] == 0.5 and out[0]["jaccard"] == 1 / 3
    assert out[1]["f1"] == 1.0 and out[2]["f1"] == 0.0
    assert out[3]["precision"] == 0.5 and out[3]["recall"] == 2 / 3 and out[3]["jaccard"] == 0.4
