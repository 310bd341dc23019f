"""LCS by edits, and the bag bound, against plain models."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from fieldmark.functions.similarity import (
    BAG_CHARACTERS,
    _equal_run,
    _lcs_kernel,
    bag_bound,
    edit_distance_within,
    lcs_length,
)
from fieldmark.operators.score import FuzzyMatch


def _lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _edited(rng, text, edits, letters):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text[at:at + rng.choice((0, 1))] = rng.choice(("", rng.choice(letters)))
    return "".join(text)


def test_equal_runs():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randrange(70)
        a = "x" * n + rng.choice(("", "a", "ab"))
        b = "yy" + "x" * n + rng.choice(("", "b", "bb"))
        plain = next((i for i, (p, q) in enumerate(zip(a, b[2:])) if p != q), min(len(a), len(b) - 2))
        assert _equal_run(a, b, 0, 2) == plain
    assert _equal_run("abc", "abc", 3, 3) == 0 and _equal_run("abc", "abc", 5, 4) == 0


def test_edit_distance_and_lcs_against_the_table():
    rng = random.Random(11)
    for letters in ("ab", "abcdefgh é😀"):
        for _ in range(150):
            a = "".join(rng.choices(letters, k=rng.randrange(60)))
            b = (_edited(rng, a, rng.randrange(9), letters) if rng.random() < 0.7
                 else "".join(rng.choices(letters, k=rng.randrange(60))))
            lcs = _lcs_table(a, b)
            edits = len(a) + len(b) - 2 * lcs
            assert lcs_length(a, b) == lcs_length(b, a) == lcs
            assert edit_distance_within(a, b, edits) == edits
            assert edit_distance_within(a, b, len(a) + len(b)) == edits
            if edits:
                assert edit_distance_within(a, b, edits - 1) is None


def test_long_near_copies_take_the_short_way():
    rng = random.Random(5)
    letters = "abcdefghij klmnop"
    a = "".join(rng.choices(letters, k=130_000))
    b = _edited(rng, a, 60, letters)
    t0 = time.perf_counter()
    got = lcs_length(a, b)
    t1 = time.perf_counter()
    plain = _lcs_kernel(a, b)
    t2 = time.perf_counter()
    assert got == plain and t1 - t0 < (t2 - t1) / 3
    far = "".join(rng.choices(letters, k=3_000))  # many edits: the kernel takes over
    assert lcs_length(a[:3_000], far) == _lcs_kernel(a[:3_000], far)


def _bag(text):
    return Counter(c if c in BAG_CHARACTERS else "" for c in text)


def test_bag_bound_and_fewer_pairs_for_the_udf(spark):
    rng = random.Random(9)
    letters = "abc 12éß-😀z"
    rows = [("".join(rng.choices(letters, k=rng.randrange(25))),
             "".join(rng.choices(letters, k=rng.randrange(25)))) for _ in range(300)]
    rows += [(a, _edited(rng, a, 2, letters)) for a, _ in rows] + [("", ""), ("ß" * 9, "é" * 9)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, e string, a string")
    for r in df.select("e", "a", bag_bound("e", "a").alias("n")).collect():
        assert r["n"] == (_bag(r["e"]) & _bag(r["a"])).total() >= _lcs_table(r["e"], r["a"])

    full = {r["i"]: r["x"] for r in FuzzyMatch().inline(df, "e", "a", "x").collect()}
    for dedupe in (False, True):
        scorer = FuzzyMatch(pass_only=True, dedupe=dedupe)
        got = {r["i"]: r["x"] for r in scorer.apply(df, "e", "a", "x").collect()}
        assert {i: x["passed"] for i, x in got.items()} == {i: x["passed"] for i, x in full.items()}
        assert all(x["score"] in (None, full[i]["score"]) for i, x in got.items())
    by_length = df.where(scorer._bound_ok(F.col("e"), F.col("a"))).count()
    by_both = df.where(scorer._open(F.col("e"), F.col("a"))).count()
    assert by_both < by_length and any(x["reason"] == "ratio<0.8" for x in got.values())
