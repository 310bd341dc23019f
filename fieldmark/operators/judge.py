"""Rubric judge as a batch job with a persistent verdict cache.

A pair that the null/empty rules do not settle is judged once per
``(judge model, key)``, ``key = sha256(rubric || expected || actual)``:

1. distinct pairs (partial aggregation before the shuffle: a pair repeated in a
   third of all rows is one row per map task by the time it is shuffled);
2. one scan of the cache's partition for the judge model, probed with the
   run's keys; the hits (one verdict per key) are written;
3. misses go to the user's batch callable through ``mapInPandas`` (judges
   of one model share the job; ``concurrency`` partitions call at once), the
   raw verdict text is parsed with ``from_json`` and checked against the 0/1/2
   domain;
4. fresh verdicts are written *before use* and appended to the cache, so a
   lost task downstream re-reads a verdict instead of paying for another call;
5. verdicts are joined back to the rows, broadcast when their rows and
   characters are within bounds, else by a shuffle join in which hot keys
   are split off (see ``Judge.attach``).

The callable gets a pandas DataFrame with columns ``rubric_id, rubric,
expected, actual, prompt`` (``prompt`` is the user message ``Expected: <e>\nActual: <a>``;
``rep`` numbers repeated judgements) and returns one JSON string per row,
e.g. ``{"score": 2, "reasoning": "..."}``, or a DataFrame with that text as
``verdict`` and the call's ``total_tokens`` (stored as ``judge_tokens``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from fieldmark.functions.scorers import judge_precheck, result
from fieldmark.functions.text import list_text
from fieldmark.operators.joins import DEFAULT_BROADCAST_CHARS, DEFAULT_BROADCAST_ROWS
from fieldmark.operators.materialize import materialize
from fieldmark.schemas import JUDGE_VERDICT, VERDICT_VALUES
from fieldmark.session import scratch_path

VerdictFn = Callable[[pd.DataFrame], pd.Series]

CALL_SCHEMA = T.StructType([
    T.StructField("judge", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("rep", T.IntegerType()),
    T.StructField("raw_verdict", T.StringType()),
    T.StructField("judge_tokens", T.LongType()),
])

VERDICTS_SCHEMA = T.StructType([
    T.StructField("judge", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("verdict", T.IntegerType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("judge_error", T.StringType()),
    T.StructField("judge_tokens", T.LongType()),
])
VERDICT_COLS = [f.name for f in VERDICTS_SCHEMA.fields]


def cache_key(rubric: Column, expected_text: Column, actual_text: Column) -> Column:
    """sha256 hex of ``rubric || expected || actual`` (UTF-8, literal ``||``)."""
    return F.sha2(F.concat(rubric, F.lit("||"), expected_text, F.lit("||"), actual_text), 256)


def verdict_score(verdict: Column) -> Column:
    """0 -> 0.0, 1 -> 0.5, 2 -> 1.0; null outside the domain."""
    return F.when(verdict.isin(*VERDICT_VALUES), verdict.cast("double") / F.lit(2.0))


def parse_verdicts(calls: DataFrame) -> DataFrame:
    """Raw verdict text -> (verdict, reasoning, judge_error).  Unparseable text or
    a score outside {0, 1, 2} yields a null verdict and an error, not a failure."""
    parsed = F.from_json(F.col("raw_verdict"), JUDGE_VERDICT)
    out = calls.withColumn("_v", parsed)
    ok = F.coalesce(F.col("_v.score").isin(*VERDICT_VALUES), F.lit(False))
    return out.select(
        "judge", "key", *([c for c in ("rep",) if c in calls.columns]),
        F.col("judge_tokens").cast("bigint").alias("judge_tokens"),
        F.when(ok, F.col("_v.score")).alias("verdict"),
        F.when(ok, F.col("_v.reasoning")).alias("reasoning"),
        F.when(~ok, F.concat(F.lit("invalid verdict: "),
                             F.coalesce(F.col("raw_verdict"), F.lit("null"))))
        .alias("judge_error"),
    )


def _caller(fn: VerdictFn, rubrics: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            req = pd.DataFrame({
                "rubric_id": b["rubric_id"],
                "rubric": b["rubric_id"].map(rubrics),
                "expected": b["expected"],
                "actual": b["actual"],
                # the user message of the judge call; the rubric is the system message
                "prompt": "Expected: " + b["expected"] + "\nActual: " + b["actual"],
                "rep": b["rep"] if "rep" in b else 0,
            })
            answer = fn(req)
            if isinstance(answer, pd.DataFrame):  # verdict text plus token usage
                raw = pd.Series(answer["verdict"].values, index=b.index).astype(object)
                tokens = (pd.Series(answer["total_tokens"].values, index=b.index)
                          if "total_tokens" in answer else pd.Series(None, index=b.index))
            else:
                raw = pd.Series(answer, index=b.index).astype(object)
                tokens = pd.Series(None, index=b.index)
            yield pd.DataFrame({
                "judge": b["judge"], "key": b["key"],
                "rep": (b["rep"] if "rep" in b else pd.Series(0, index=b.index)).astype("int32"),
                "raw_verdict": raw.where(raw.notna(), None),
                "judge_tokens": tokens.astype("Int64"),
            })
    return run


@dataclass(frozen=True)
class Judge:
    """Field scorer backed by a rubric judge (the model is a required argument)."""

    rubric_id: str
    rubric: str
    model: str
    call: VerdictFn
    name: str = "llm_judge"
    threshold: float = 0.5
    cache_path: str | None = None
    concurrency: int | None = None
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
    max_broadcast_chars: int = DEFAULT_BROADCAST_CHARS
    resolves_verdicts = True  # no field: declared for all judges

    # -- pieces -------------------------------------------------------------
    def pair_columns(self, df: DataFrame, expected: str, actual: str):
        """(condition, expected text, actual text) of rows that need a verdict."""
        dtype = df.schema[expected].dataType
        return (judge_precheck(expected, actual, dtype).isNull(),
                list_text(F.col(expected), dtype), list_text(F.col(actual), dtype))

    def pair_rows(self, df: DataFrame, expected: str, actual: str) -> DataFrame:
        """(expected, actual) text of every row that needs a verdict (not deduplicated)."""
        cond, e_text, a_text = self.pair_columns(df, expected, actual)
        return df.where(cond).select(e_text.alias("expected"), a_text.alias("actual"))

    def keyed(self, pairs: DataFrame) -> DataFrame:
        """Text pairs -> (judge, key, rubric_id, expected, actual)."""
        return pairs.select(F.lit(self.model).alias("judge"),
                            cache_key(F.lit(self.rubric), F.col("expected"), F.col("actual")).alias("key"),
                            F.lit(self.rubric_id).alias("rubric_id"), "expected", "actual")

    def pairs(self, df: DataFrame, expected: str, actual: str) -> DataFrame:
        """Rows that need a verdict, with text forms and key (not deduplicated)."""
        return self.keyed(self.pair_rows(df, expected, actual))

    def distinct_pairs(self, df: DataFrame, expected: str, actual: str) -> DataFrame:
        return self.pairs(df, expected, actual).dropDuplicates(["judge", "key"])

    def call_pairs(self, pairs: DataFrame, reps: int | None = None) -> DataFrame:
        """Judge every row of ``pairs`` (``reps`` times each when given); parsed verdicts."""
        if reps is not None:
            pairs = pairs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
        if self.concurrency:
            pairs = pairs.repartition(self.concurrency)
        calls = pairs.mapInPandas(_caller(self.call, {self.rubric_id: self.rubric}), CALL_SCHEMA)
        return parse_verdicts(calls)

    def resolve(self, pairs: DataFrame, stable: bool = False, n_pairs: int | None = None
                ) -> DataFrame:
        """Verdicts for distinct keyed ``pairs``: cache hits plus freshly judged
        misses (see ``resolve_verdicts``).  Unless ``pairs`` comes from a
        written table (``stable=True``) it is materialised first: it is
        scanned more than once."""
        if not stable:
            pairs = materialize(pairs, "judge_pairs")
        path = self.cache_path or scratch_path(pairs.sparkSession, "judge_verdicts")
        return resolve_verdicts([self], pairs, path, n_pairs)

    # -- scorer protocol ----------------------------------------------------
    def attach(self, df: DataFrame, expected: str, actual: str, out: str, pairs: DataFrame,
               stats, verdicts: DataFrame | None = None,
               verdicts_fit: bool | None = None) -> DataFrame:
        """Add the result column given the distinct text pairs of ``df`` (from a
        written table, with ``n_rows`` per pair when known) and their counts.

        Few pairs: one broadcast hash join, no shuffle of ``df``.  Many pairs: a
        shuffle join in which no key can be hot: pairs standing for more than
        1/(2P) of the rows (P = shuffle partitions; so at most 2P of them, a
        proven bound) are joined first, through a broadcast if their reasons are short
        enough, else by shares of their rows, and those rows, like
        rows the null/empty rules settled, carry a per-row spread key into
        the shuffle join with the remaining verdicts."""
        spark = df.sparkSession
        dtype = df.schema[expected].dataType
        pre = judge_precheck(expected, actual, dtype)
        e_text, a_text = list_text(F.col(expected), dtype), list_text(F.col(actual), dtype)
        if verdicts is None:
            verdicts = self.resolve(self.keyed(pairs), stable=True, n_pairs=stats.pairs)
        verdicts = verdicts.select(
            F.unhex("key").alias("_jkey"), F.col("verdict").alias("_verdict"),
            F.col("reasoning").alias("_reasoning"), F.col("judge_error").alias(f"{out}_judge_error"))
        hashable = [F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
        # 32 bytes a key (not its 64 digits) go into the shuffle; a spread key is shorter
        spread = F.concat(F.lit("#"), F.xxhash64(*hashable).cast("string") if hashable else F.lit("")) \
            .cast("binary")
        key = F.unhex(cache_key(F.lit(self.rubric), e_text, a_text))
        keyed = df.withColumn("_jkey", F.when(pre.isNull(), key).otherwise(spread))
        fits = verdicts_fit if verdicts_fit is not None else self._fits(verdicts, out)
        if stats.pairs <= self.max_broadcast_rows and fits:
            joined = keyed.join(F.broadcast(verdicts), "_jkey", "left")
        else:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            hot_min = max(2, stats.rows // (2 * parts)) if stats.rows else None
            if hot_min is not None and "n_rows" in pairs.columns:
                hot_keys = F.broadcast(self.keyed(pairs.where(F.col("n_rows") >= hot_min)).select(
                    F.unhex("key").alias("_jkey")))  # at most 2P
                hot = verdicts.join(hot_keys, "_jkey", "left_semi")
                cold = verdicts.join(hot_keys, "_jkey", "left_anti")
                hot = hot.select("_jkey", *[F.col(c).alias(c + "_h") for c in hot.columns
                                            if c != "_jkey"])
                if verdict_chars(hot.select(F.col("_reasoning_h").alias("reasoning"),
                                            F.col(f"{out}_judge_error_h").alias("judge_error"))
                                 ) <= self.max_broadcast_chars:
                    first = keyed.join(F.broadcast(hot), "_jkey", "left")
                else:  # long reasons: each hot verdict goes to all shares of its rows
                    share = F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")
                    hot = hot.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                    first = keyed.withColumn("_share", share).join(hot, ["_jkey", "_share"], "left") \
                        .drop("_share")
                is_hot = F.col("_verdict_h").isNotNull() | F.col(f"{out}_judge_error_h").isNotNull()
                second = first.withColumn("_jkey", F.when(is_hot, spread).otherwise(F.col("_jkey")))
                joined = second.join(cold, "_jkey", "left")
                for c in ("_verdict", "_reasoning", f"{out}_judge_error"):
                    joined = joined.withColumn(c, F.coalesce(F.col(c + "_h"), F.col(c))).drop(c + "_h")
            else:
                joined = keyed.join(verdicts, "_jkey", "left")
        score = verdict_score(F.col("_verdict"))
        judged = result(score, F.coalesce(score >= F.lit(self.threshold), F.lit(False)),
                        F.col("_reasoning"))
        return (joined.withColumn(out, F.coalesce(pre, judged))
                .drop("_jkey", "_verdict", "_reasoning"))

    def _fits(self, verdicts: DataFrame, out: str) -> bool:
        """Characters a broadcast of the verdicts would carry (keys, reasons,
        errors: free text from the judge), measured on the written verdicts."""
        return verdict_chars(verdicts.select(F.col("_reasoning").alias("reasoning"),
                                             F.col(f"{out}_judge_error").alias("judge_error"))
                             ) <= self.max_broadcast_chars

    def apply(self, df: DataFrame, expected: str, actual: str, out: str) -> DataFrame:
        from fieldmark.operators.score import PairStats

        pairs = materialize(self.pair_rows(df, expected, actual).groupBy("expected", "actual")
                            .agg(F.count("*").alias("n_rows")), "judge_pairs")
        n = pairs.agg(F.count("*").alias("p"), F.sum("n_rows").alias("r")).first()
        return self.attach(df, expected, actual, out, pairs, PairStats(n["p"], n["r"] or 0))


def verdict_chars(verdicts: DataFrame) -> int:
    """Characters a broadcast of verdicts carries: 64 per key plus the free
    text of reasons and errors."""
    text = (F.lit(64) + F.coalesce(F.length("reasoning"), F.lit(0))
            + F.coalesce(F.length("judge_error"), F.lit(0)))
    return verdicts.agg(F.sum(text).alias("c")).first()["c"] or 0


def call_group(judge: Judge) -> tuple:
    """Judges with equal group keys share one cache probe, one call job and one
    append (the callable gets each row's rubric)."""
    return (judge.model, id(judge.call), judge.cache_path, judge.concurrency,
            judge.max_broadcast_rows, judge.max_broadcast_chars)


def keys_differ(judges: list[Judge]) -> bool:
    """Whether texts without ``|`` that differ have keys that differ, for all of ``judges``."""
    rubrics = [j.rubric for j in judges]
    return len(set(rubrics)) == len(rubrics) and not any("|" in r for r in rubrics)


def resolve_verdicts(judges: list[Judge], keyed: DataFrame, path: str,
                     n_pairs: int | None = None, unique: bool = False) -> DataFrame:
    """Verdicts of every keyed pair (judge, key, rubric_id, expected, actual)
    of ``judges`` (one call group).  ``unique``: no key is there twice, so none is looked for.
    Without a named cache ``path`` is a fresh folder, where the verdicts are written once.

    The cache, which grows with every run, is scanned once per call: its
    judge-model partition is probed for the run's keys (against a broadcast of
    them when ``n_pairs`` is at most the broadcast bound, so the cache is
    streamed, never shuffled), one verdict per key is kept and written as the
    run's hits.  The misses are judged in one ``mapInPandas`` job whose output
    is written before anything uses it, then appended to the cache.  The
    result is hits plus fresh verdicts, both read from written tables."""
    spark = keyed.sparkSession
    lead = judges[0]
    # one request per (judge, key): texts that hold the separator, or one rubric judged by
    # two specs, give a key more than once
    if not unique:
        keyed = keyed.groupBy("judge", "key").agg(
            F.min(F.struct("rubric_id", "expected", "actual")).alias("one")) \
            .select("judge", "key", "one.*")
    small = n_pairs is not None and n_pairs <= lead.max_broadcast_rows
    cols = VERDICT_COLS
    cached = read_cache(spark, path) if lead.cache_path else None
    hits = None
    if cached is not None:
        keys = keyed.select("judge", "key")
        mine = cached.where((F.col("judge") == lead.model) & F.col("judge_error").isNull()
                            & F.col("verdict").isNotNull()).join(
            F.broadcast(keys) if small else keys, ["judge", "key"], "left_semi")
        # A re-run append or two runs writing at once can store a key twice;
        # keep one verdict per key, chosen deterministically.
        one = F.min(F.struct(*cols[2:])).alias("v")
        hits = materialize(mine.groupBy("judge", "key").agg(one).select("judge", "key", "v.*"),
                           "verdict_hits")
    if hits is None:
        misses = keyed
    else:
        hit_keys = hits.select("judge", "key")
        misses = keyed.join(F.broadcast(hit_keys) if small else hit_keys,
                            ["judge", "key"], "left_anti")
    if lead.concurrency:
        misses = misses.repartition(lead.concurrency)
    rubrics = {j.rubric_id: j.rubric for j in judges}
    calls = misses.mapInPandas(_caller(lead.call, rubrics), CALL_SCHEMA)
    fresh = parse_verdicts(calls).select(*cols)
    if not lead.cache_path:
        fresh.write.parquet(path)
        return spark.read.parquet(path).withColumn("fresh", F.lit(True))
    fresh = materialize(fresh, "verdict_fresh")
    # an invalid verdict is reported, never cached: the pair is asked again next time
    fresh.where(F.col("judge_error").isNull() & F.col("verdict").isNotNull()) \
        .write.mode("append").partitionBy("judge").parquet(path)
    fresh = fresh.withColumn("fresh", F.lit(True))  # judged by this call (tokens spent now)
    if hits is None:
        return fresh
    return hits.select(*cols).withColumn("fresh", F.lit(False)).unionByName(fresh)


def read_cache(spark, path: str) -> DataFrame | None:
    """The verdict cache at ``path`` (partitioned by judge model), or None if there is none
    yet; any other problem with it raises."""
    try:
        return spark.read.schema(VERDICTS_SCHEMA).parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "") == "PATH_NOT_FOUND":
            return None
        raise


# ---------------------------------------------------------------------------
# A deterministic stand-in for a model judge (no network here).
# ---------------------------------------------------------------------------
# The stub's reasoning sentence per verdict.
STUB_REASONS = {
    2: "same tokens",
    1: "some tokens shared",
    0: "no token shared",
}
# Items of a judged list are separated by this text (see ``list_text``).
LIST_SEPARATOR = ", "


def stub_tokens(text: str, rubric_id: str) -> set[str]:
    """Lower-cased list items for the skills rubric, space-separated words otherwise."""
    sep = LIST_SEPARATOR if rubric_id == "skills" else " "
    return set(text.lower().split(sep))


def stub_verdict(expected: str, actual: str, rubric_id: str) -> int:
    te, ta = stub_tokens(expected, rubric_id), stub_tokens(actual, rubric_id)
    if te == ta:
        return 2
    return 1 if te & ta else 0


def token_overlap_judge(req: pd.DataFrame) -> pd.Series:
    """Stub judge: 2 when the token sets are equal, 1 when they share a token, else 0."""
    out = []
    for e, a, r in zip(req["expected"], req["actual"], req["rubric_id"]):
        v = stub_verdict(e, a, r)
        out.append(json.dumps({"score": v, "reasoning": STUB_REASONS[v]}))
    return pd.Series(out)


def noisy_token_overlap_judge(req: pd.DataFrame) -> pd.Series:
    """Stub with deterministic disagreement between repetitions: when
    ``(len(expected) + len(actual) + rep) % 3 == 0`` the verdict moves one step
    (2 -> 1, 1 -> 2, 0 -> 1)."""
    out = []
    for e, a, r, rep in zip(req["expected"], req["actual"], req["rubric_id"], req["rep"]):
        v = stub_verdict(e, a, r)
        if (len(e) + len(a) + int(rep)) % 3 == 0:
            v = 1 if v != 1 else 2
        out.append(json.dumps({"score": v, "reasoning": STUB_REASONS[v]}))
    return pd.Series(out)


# ---------------------------------------------------------------------------
# Meta-evaluation of a judge.
# ---------------------------------------------------------------------------
def repeat_judgements(judge: Judge, pairs: DataFrame, n: int) -> DataFrame:
    """Judge each distinct pair ``n`` times, bypassing the cache."""
    return judge.call_pairs(pairs, reps=n).withColumn("score", verdict_score(F.col("verdict")))


def judge_variance(repeated: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Sample variance of repeated scores per pair (0.0 for a single judgement);
    the pair passes when it is below ``threshold``."""
    return (repeated.groupBy("judge", "key")
            .agg(F.count("*").alias("n"),
                 F.avg("score").alias("mean_score"),
                 F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("variance"))
            .withColumn("passed", F.col("variance") < F.lit(threshold)))


def judge_usage(spark, path: str) -> DataFrame:
    """Verdicts stored per judge model and the tokens the judge reported for
    them (judge tokens are kept apart from extraction tokens)."""
    cache = read_cache(spark, path)
    return cache.groupBy("judge").agg(F.count("*").alias("verdicts"),
                                      F.sum("judge_tokens").cast("bigint").alias("judge_tokens"))


def cache_consistency(verdicts_seen: DataFrame) -> DataFrame:
    """Per key, how many different (verdict, reasoning) results were seen; a
    consistent cache shows exactly one."""
    return (verdicts_seen.groupBy("judge", "key")
            .agg(F.count_distinct(F.struct("verdict", "reasoning")).alias("n_results"))
            .withColumn("consistent", F.col("n_results") == 1))
