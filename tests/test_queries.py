"""Every registered query against its DuckDB oracle (sf0.001), and the queries
without an oracle against brute force."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fieldmark.sources.tables import TABLES

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def _key(r):
    return tuple((x is None, str(x)) for x in r)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(entry.QUERIES)))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    assert got == want


def test_every_query_has_oracle_or_brute_force():
    own = set(entry.QUERIES)  # the text queries have their own tests
    assert own - set(ORACLE) == {"score_fuzzy_documents"}


def _lcs_np(a: str, b: str) -> int:
    """Row-by-row LCS table with numpy: L[i][j] is the running max of
    max(L[i-1][j], L[i-1][j-1] + match)."""
    if not a or not b:
        return 0
    bb = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    prev = np.zeros(len(b) + 1, dtype=np.int32)
    for ch in a:
        m = (bb == ord(ch)).astype(np.int32)
        t = np.maximum(prev[1:], prev[:-1] + m)
        prev = np.concatenate(([0], np.maximum.accumulate(t)))
    return int(prev[-1])


def test_documents_similarity_over_gaps(spark, tmp_path):
    texts = {-4: "one", 3: "ONE two", 5: "", 90: "two three", 91: "two tree", 4000: "x" * 700}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in QUERIES["score_fuzzy_documents"](spark, str(tmp_path)).collect()}
    ids = sorted(texts)
    assert {d: r["next_doc_id"] for d, r in out.items()} == dict(zip(ids, ids[1:]))
    for d, n in zip(ids, ids[1:]):
        assert out[d]["lcs"] == _lcs_np(texts[d].lower(), texts[n].lower())


def test_documents_similarity_brute_force(spark, sf_small):
    out = {r["doc_id"]: r for r in QUERIES["score_fuzzy_documents"](spark, sf_small).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet")
            .select("doc_id", "text").collect()}
    assert set(out) == {d for d in docs if d + 1 in docs}
    # a fixed subset of short documents keeps the brute force cheap
    small = sorted(d for d in out if len(docs[d]) + len(docs[d + 1]) < 4000)[:25]
    assert small
    for d in small:
        a, b = docs[d].lower(), docs[d + 1].lower()
        assert out[d]["lcs"] == _lcs_np(a, b)
        assert out[d]["ratio"] == round(2 * _lcs_np(a, b) / (len(a) + len(b)), 6)
