"""Language-model scoring, centroid clustering and the filter audit against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import centroids, filter_audit, ngram_model
from fieldmark.llm.words import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(7)


def draw(n, vocabulary=40):
    return " ".join(f"w{i}" for i in RNG.zipf(1.6, n) % vocabulary)


TEXTS = [draw(int(n)) for n in RNG.integers(1, 120, 90)] + [
    None, "", " \t\r\n ", "The the THE tHe", "ÉTÉ ß \U0001f600 　x", "unseen-1 unseen-2",
    " ".join(f"x{i % 3000}" for i in range(30000)), "CAPS AND #TAGS & more", draw(60), draw(60)]
TEXTS += [TEXTS[3]] * 60  # copies of one text hold a third of all rows


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, texts and sources, a repeated row, an id with two texts, clashing columns."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (8, "another text of this id", "s1"), (None, TEXTS[3], "s2"),
             (None, "without id", None), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("clash") for c in ("part", "slice", "n", "h", "mask", "shard", "rows", "run")})


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


class Brute:
    """Interpolated modified Kneser-Ney from the definition, in dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.tables = {}
        top = Counter()
        for t in texts:
            seq = ["<s>"] * (order - 1) + tokens(t)
            top.update(tuple(seq[i:i + order]) for i in range(len(seq) - order + 1))
        self.counts = Counter(w for t in texts for w in tokens(t))
        for size in range(order, 0, -1):
            by = defaultdict(list)
            for g, c in top.items():
                by[g[:-1]].append(c)
            d = ngram_model.discounts([sum(c == k for c in top.values()) for k in (1, 2, 3, 4)])
            self.tables[size] = top, {g: (sum(cs), sum(d[min(c, 3)] for c in cs))
                                      for g, cs in by.items()}, d
            top = Counter(g[1:] for g in top)

    def p(self, gram):
        if not gram:
            return 1 / (len(self.counts) + 1)
        top, by, d = self.tables[len(gram)]
        lower = self.p(gram[1:])
        if gram[:-1] not in by:
            return lower
        c, (total, free) = top.get(gram, 0), by[gram[:-1]]
        return (max(c - d[min(c, 3)], 0) + free * lower) / total


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_equal_the_definition(spark, docs, order, monkeypatch):
    monkeypatch.setattr(ngram_model, "slices_for", lambda d: 5)  # contexts split over slices
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    train = [t for i, t in rows if not held_out(i)]
    model = Brute(train, order)
    n, v = sum(model.counts.values()), len(model.counts)
    want = Counter()
    for i, t in rows:
        tok = tokens(t)
        seq = ["<s>"] * (order - 1) + tok
        score = sum(math.log10(model.p(tuple(seq[k:k + order]))) for k in range(len(tok)))
        base = sum(math.log10((model.counts[w] + 1) / (n + v + 1)) for w in tok)
        want[i, held_out(i), len(tok), sum(model.counts[w] > 0 for w in tok), n,
             round(base, 5), round(score, 5)] += 1
    got = ngram_model.score_documents(docs, order)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 5), round(r.score, 5)) for r in got.collect()) == want


def test_lm_probabilities_add_up_and_beat_single_tokens(spark, docs):
    model = ngram_model.train(docs)  # of all texts, so that one word alone is unknown
    words = sorted({w for r in docs.collect() for w in tokens(r.text) if w})
    for context in ("w1", "w2", "x77", "never"):
        # one token behind the context: all known words, the end, and one unknown word
        texts = [f"{context} {w}" for w in (*words, "notaword")]
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        (block,) = blocks(frame.toArrow()["text"].combine_chunks())
        p, _ = ngram_model.probabilities(model, *ngram_model.tokens(block))
        ends = p[2::3]  # the end behind the word is no successor of the context
        alone = next(blocks(spark.createDataFrame([(context,)], "text string").toArrow()["text"]
                            .combine_chunks()))
        end, _ = ngram_model.probabilities(model, *ngram_model.tokens(alone))
        assert len(ends) == len(texts) and abs(p[1::3].sum() + end[1] - 1) < 1e-9
    held = ngram_model.score_documents(docs).where("held_out and n_tokens > 20").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_lm_without_training_text(spark, docs):
    assert ngram_model.score_documents(docs.limit(0)).count() == 0
    only = docs.where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 7) = 2")
    for r in ngram_model.score_documents(only).collect():
        assert r.held_out and r.train_tokens == r.n_known == 0
        assert r.score == 0 and r.base_score == 0  # one possible token, the unknown


def test_lm_counts_grow_with_the_corpus(spark):
    model = [ngram_model.train(spark.range(n).select(
        F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("text"))) for n in (500, 2000)]
    assert model[1].n_words - model[0].n_words == 1500 and model[1].n_tokens == 6000


# --- centroid clustering -------------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None
            and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(),
                     np.array(r[1], "<i4").tobytes())
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    x = np.array([v for _, v in kept], object)

    def assign():
        d = np.stack([((x - np.array(c, object)) ** 2).sum(axis=1) for c in cents], axis=1)
        return d.argmin(axis=1), d.min(axis=1)
    for _ in range(rounds):
        at, _ = assign()
        cents = [[int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)]
                 if (at == j).any() else c for j, c in enumerate(cents)]
    at, d = assign()
    sums = Counter()
    for a, y in zip(at, d):
        sums[a] += y
    return Counter((i, int(a), int(y), sums[a], sum(sums.values()),
                    hashlib.sha256(",".join(map(str, cents[a])).encode()).hexdigest())
                   for (i, _), a, y in zip(kept, at, d))


def test_clusters_equal_the_definition(spark):
    middles = RNG.normal(0, 1, (12, 64))
    x = [list(map(float, m + RNG.normal(0, 0.4, 64))) for m in middles for _ in range(60)]
    rows = list(enumerate(x)) + [(1000 + i, x[0]) for i in range(400)]  # one vector, very common
    rows += [(0, x[0]), (None, x[5]), (2000, None), (2001, x[1][:63]), (2002, [None] + x[1][1:]),
             (2003, [float("nan")] + x[1][1:]), (2004, [float("-inf")] + x[1][1:]), (2005, []),
             (2006, [0.0] * 64), (2007, [-1e-9] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("v", "cluster", "upper", "distance", "label")})
    want = brute_clusters(rows)
    trace = []
    got = centroids.cluster_vectors(frame, trace=trace)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert min(share for share, _ in trace) < 0.1  # bounds do rule vectors out
    for rescan in (0.0, 2.0):  # bounds written in every other round, or never
        got = centroids.cluster_vectors(frame, rescan=rescan)
        assert Counter(tuple(r) for r in got.collect()) == want


def test_clusters_of_ties_and_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    same = [(i, [0.5] * 64) for i in range(20)]  # all centroids alike: the first takes all
    assert Counter(tuple(r) for r in centroids.cluster_vectors(
        spark.createDataFrame(same, schema)).collect()) == brute_clusters(same)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert Counter(tuple(r) for r in centroids.cluster_vectors(
        spark.createDataFrame(few, schema)).collect()) == brute_clusters(few)
    empty = centroids.cluster_vectors(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    huge = centroids.cluster_vectors(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)],
                                                           schema)).collect()
    assert [r.distance for r in huge] == [0, 0]


def test_no_point_of_a_ball_comes_nearer_than_the_bound():
    for _ in range(300):
        centre, old = RNG.normal(0, 10, 3), RNG.normal(0, 10, 3)
        new, radius = old + RNG.normal(0, 3, 3), abs(RNG.normal(0, 4))
        bound = centroids.Moved.nearer(centre, radius, old, new)
        away = RNG.normal(0, 1, (4000, 3))
        x = centre + away / np.linalg.norm(away, axis=1)[:, None] * radius * RNG.random((4000, 1)) ** 0.2
        gain = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        assert gain.max() <= bound + 1e-9 <= np.linalg.norm(new - old) + 1e-6


# --- filter audit --------------------------------------------------------------------------

def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((s or "", {x for x in fails if fails[x]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                now = [d for d in own if f in d[1] and not d[1] & before]
                out[part, "".join(order), k + 1] = [
                    sum(not d[1] & (before | {f}) for d in own), len(now),
                    sum(f in d[1] and bool(d[1] & before) for d in own),
                    sum(d[1] == {f} for d in own), sum(d[2] for d in now), sum(d[3] for d in now)]
                shapley[part, f] += len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_the_definition(spark, docs, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD", 2000)  # many shards
    monkeypatch.setattr(filter_audit, "slices_for", lambda d: 3)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 160, 3)] + [
        (3, None, None), (3, 1, 1), (None, 1, 1), (99999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int") \
        .withColumns({c: F.lit("clash") for c in ("part", "good", "n", "text")})
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:]
           for r in filter_audit.audit(docs, table).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).count() == len(got)


def test_matrix_is_numbered_alike_in_all_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD", 2000)
    monkeypatch.setattr(filter_audit, "slices_for", lambda d: 3)
    rows = docs.select("doc_id", F.lit("p").alias("part"), F.lit("x").alias("text_sha256"),
                       F.coalesce("text", F.lit("")).alias("text"))
    texts = Counter(r.text for r in rows.collect())
    seen, n = Counter(), 0
    held = [(dict(Counter(WORD.findall(t))), t) for t in texts]
    for r in filter_audit.csr_shards(rows).collect():
        indptr, index, counts = (np.frombuffer(bytes(x), "<i8") for x in (r.indptr, r.indices, r.counts))
        assert len(indptr) == len(r.doc_id) + 1
        for a, b in zip(indptr, indptr[1:]):
            seen[tuple(sorted(zip(index[a:b].tolist(), counts[a:b].tolist())))] += 1
            n += 1
    assert n == sum(texts.values())
    numbers = {i for row in seen for i, _ in row}
    assert numbers == set(range(len({w for bag, _ in held for w in bag})))
    assert Counter(tuple(sorted(c for _, c in row)) for row in seen.elements()) == Counter(
        tuple(sorted(bag.values())) for bag, t in held for _ in range(texts[t]))
    totals = Counter()
    for row, k in seen.items():
        for i, c in row:
            totals[i] += k * c
    words = Counter()
    for bag, t in held:
        for w, c in bag.items():
            words[w] += c * texts[t]
    assert sorted(totals.values()) == sorted(words.values())
