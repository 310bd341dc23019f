"""Field scoring: a registry of (field, scorer) specs compiled onto paired rows.

The paired table is *wide* (one row per run and example, ``e_<field>`` and
``a_<field>`` columns), so every column scorer is one projection and the
overall score of an example needs no shuffle.  Scorers that need a job of their
own (fuzzy over distinct pairs, the judge) add their result column through a
join that is broadcast behind a size check.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.scorers import (
    SIMILARITY,
    exact_match,
    fuzzy_result,
    list_overlap,
    similarity_of,
)
from fieldmark.functions.similarity import bag_bound
from fieldmark.functions.text import norm
from fieldmark.operators.joins import DEFAULT_BROADCAST_CHARS, DEFAULT_BROADCAST_ROWS
from fieldmark.operators.materialize import materialize
from fieldmark.schemas import EXAMPLE_PASS


class Scorer(Protocol):
    """Adds a result column ``STRUCT<score, passed, reason>`` to the paired rows."""

    name: str

    def apply(self, df: DataFrame, expected: str, actual: str, out: str) -> DataFrame: ...


class BatchScorer(Scorer, Protocol):
    """A scorer of distinct (expected, actual) texts, however often they occur.

    Any class with these members takes part: one pass over the written pairs collects the
    texts of all batch scorers, counts them, and hands each scorer its own.  ``batched`` may
    be left out (true) or be false for a configuration that scores row by row."""

    batched: bool
    #: Whether its term comes after the others in the sum of the overall score (doubles with
    #: many digits last, so that sums do not depend on the order of fields).
    added_last: bool
    #: Whether verdicts of several fields are resolved together (see ``operators/judge``).
    resolves_verdicts: bool

    def pair_columns(self, df: DataFrame, expected: str, actual: str) -> tuple[Column, Column, Column]:
        """(condition, expected text, actual text): which rows need a score, and of what."""

    def attach(self, df: DataFrame, expected: str, actual: str, out: str, pairs: DataFrame,
               stats: PairStats) -> DataFrame:
        """``df`` with the result column, given ``pairs(expected, actual, n_rows)`` and counts."""


def declares(scorer, capability: str, default: bool = False) -> bool:
    return bool(getattr(scorer, capability, default))


@dataclass(frozen=True)
class ExactMatch:
    name: str = "exact_match"

    def apply(self, df, expected, actual, out):
        # the comparison is its own column so score and passed share it (Spark
        # does not inline a non-trivial expression that is used twice)
        m = f"_{out}_matched"
        return (df.withColumn(m, norm(expected) == norm(actual))
                .withColumn(out, exact_match(expected, actual, F.col(m))).drop(m))


@dataclass(frozen=True)
class FuzzyMatch:
    """Similarity of lower-cased strings, passed at ``threshold``.

    ``dedupe=True`` scores each distinct (expected, actual) pair once, at any
    size, and joins the scores back (see ``attach``).  ``metric`` is ``indel`` (default), ``levenshtein`` or
    ``token_set``.

    ``pass_only=True`` (indel only) is for checks that need the pass flag and
    not the score: since LCS <= min(|a|, |b|), a pair whose bound
    2*min/(|a|+|b|) is below the threshold fails without any LCS (score
    null, reason ``ratio<=<bound>``), and so does one whose characters, counted as
    bags, leave no room for it (reason ``ratio<<threshold>``); such pairs reach the
    UDF as nulls, which it skips (``when`` does not keep a Python UDF from running)."""

    name: str = "fuzzy_match"
    threshold: float = 0.8
    metric: str = "indel"
    dedupe: bool = True
    pass_only: bool = False
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
    max_broadcast_chars: int = DEFAULT_BROADCAST_CHARS
    added_last = True  # no field: declared for all similarities

    @property
    def batched(self) -> bool:
        """Scored over distinct pairs (a job of its own) rather than inline."""
        return self.dedupe and self.metric != "levenshtein"

    def _bound_ok(self, fa, fb):
        la, lb = F.length(fa), F.length(fb)
        bound = F.try_divide(F.lit(2.0) * F.least(la, lb), la + lb)  # may run for empty pairs too
        return (la + lb == 0) | (bound >= F.lit(self.threshold))

    def _open(self, fa, fb):
        """Whether neither lengths nor characters settle that a pair fails."""
        total = F.length(fa) + F.length(fb)
        bound = F.try_divide(F.lit(2.0) * bag_bound(fa, fb), total)
        return self._bound_ok(fa, fb) & ((total == 0) | (bound >= F.lit(self.threshold)))

    def _ratio(self, fa, fb):
        """Similarity of lower-cased values; with ``pass_only`` only where the
        bounds leave the outcome open, else null."""
        if not (self.pass_only and self.metric == "indel"):
            return SIMILARITY[self.metric](fa, fb)
        ok = self._open(fa, fb)
        return SIMILARITY[self.metric](F.when(ok, fa), F.when(ok, fb))

    def _result(self, e, a, ratio):
        res = fuzzy_result(e, a, ratio, self.threshold)
        if not (self.pass_only and self.metric == "indel"):
            return res
        fa, fb = F.lower(e.cast("string")), F.lower(a.cast("string"))
        la, lb = F.length(fa), F.length(fb)
        decided = e.isNotNull() & a.isNotNull() & (ratio.isNull() | ~self._bound_ok(fa, fb))
        bound = F.try_divide(F.lit(2.0) * F.least(la, lb), la + lb)
        reason = F.when(self._bound_ok(fa, fb), F.lit(f"ratio<{self.threshold:g}")) \
            .otherwise(F.concat(F.lit("ratio<="), F.format_number(bound, 2)))
        return F.when(decided, F.struct(
            F.lit(None).cast("double").alias("score"), F.lit(False).alias("passed"),
            reason.alias("reason"))).otherwise(res)

    def inline(self, df, expected, actual, out):
        e, a = F.col(expected), F.col(actual)
        fa, fb = F.lower(e.cast("string")), F.lower(a.cast("string"))
        return df.withColumn(out, self._result(e, a, self._ratio(fa, fb)))

    def pair_columns(self, df, expected, actual):
        """(condition, expected, actual): lower-cased values where both are present."""
        e, a = F.col(expected), F.col(actual)
        return (e.isNotNull() & a.isNotNull(), F.lower(e.cast("string")),
                F.lower(a.cast("string")))

    def pair_rows(self, df, expected, actual):
        cond, fe, fa = self.pair_columns(df, expected, actual)
        return df.where(cond).select(fe.alias("expected"), fa.alias("actual"))

    def attach(self, df, expected, actual, out, pairs, stats):
        """Join the similarity of each distinct pair back.

        Few short pairs: one broadcast join.  Otherwise a shuffle join on a
        digest of the pair in which no key is hot: pairs that stand for more
        than 1/(2P) of the rows (P = shuffle partitions, so at most 2P pairs)
        come by a broadcast of digest and similarity, and their rows, like
        rows with a missing side, take a key of their own into the shuffle."""
        e, a = F.col(expected), F.col(actual)
        scored = pairs.withColumn("_ratio", self._ratio(F.col("expected"), F.col("actual")))
        if stats.pairs <= self.max_broadcast_rows and stats.chars <= self.max_broadcast_chars:
            scored = scored.select(F.col("expected").alias("_fa"), F.col("actual").alias("_fb"),
                                   "_ratio")
            joined = (df.withColumn("_fa", F.lower(e.cast("string")))
                      .withColumn("_fb", F.lower(a.cast("string")))
                      .join(F.broadcast(scored), ["_fa", "_fb"], "left"))
            return (joined.withColumn(out, self._result(e, a, F.col("_ratio")))
                    .drop("_fa", "_fb", "_ratio"))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot_min = max(2, stats.rows // (2 * parts))
        # scored once: the hot and the other pairs read the written similarities
        scored = materialize(scored.select(
            _pair_digest(F.col("expected"), F.col("actual")).alias("_pair"), "_ratio",
            (F.col("n_rows") >= hot_min).alias("_hot")), "fuzzy_scored")
        hot = scored.where("_hot").select("_pair", F.col("_ratio").alias("_hot_ratio"),
                                          F.lit(True).alias("_is_hot"))
        cold = scored.where("NOT _hot").drop("_hot")
        fa, fb = F.lower(e.cast("string")), F.lower(a.cast("string"))
        hashable = [F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
        own = F.concat(F.lit("#"), F.xxhash64(*hashable).cast("string"))
        keyed = df.withColumn("_pair", F.when(e.isNull() | a.isNull(), own)
                              .otherwise(_pair_digest(fa, fb)))
        joined = keyed.join(F.broadcast(hot), "_pair", "left") \
            .withColumn("_pair", F.when(F.col("_is_hot"), own).otherwise(F.col("_pair"))) \
            .join(cold, "_pair", "left")
        ratio = F.coalesce(F.col("_hot_ratio"), F.col("_ratio"))
        return (joined.withColumn(out, self._result(e, a, ratio))
                .drop("_pair", "_ratio", "_hot_ratio", "_is_hot"))

    def apply(self, df, expected, actual, out):
        if not self.batched:
            return self.inline(df, expected, actual, out)
        pairs = materialize(self.pair_rows(df, expected, actual).groupBy("expected", "actual")
                            .agg(F.count("*").alias("n_rows")), "fuzzy_pairs")
        n = pairs.agg(F.count("*").alias("p"), F.sum("n_rows").alias("r"),
                      F.sum(F.length("expected") + F.length("actual")).alias("c")).first()
        return self.attach(df, expected, actual, out, pairs,
                           PairStats(n["p"], n["r"] or 0, n["c"] or 0))


def _pair_digest(a, b):
    """SHA-256 of a text pair; the first text's length keeps ('ab', 'c') and ('a', 'bc') apart."""
    return F.sha2(F.concat(F.length(a).cast("string"), F.lit(":"), a, b), 256)


@dataclass(frozen=True)
class ListOverlap:
    """Deterministic overlap of two string lists (precision/recall/f1/jaccard)."""

    measure: str = "f1"
    threshold: float = 0.5
    name: str = "list_overlap"

    def apply(self, df, expected, actual, out):
        return df.withColumn(out, list_overlap(expected, actual, self.measure, self.threshold))


@dataclass(frozen=True)
class FieldSpec:
    field: str
    scorer: Scorer = field(default_factory=ExactMatch)


def result_columns(specs: list[FieldSpec]) -> list[str]:
    """Name of each spec's result column: the field name for the first spec of
    a field, ``<field>__<pos>`` for later ones."""
    seen: set[str] = set()
    names = []
    for pos, s in enumerate(specs):
        names.append(s.field if s.field not in seen else f"{s.field}__{pos}")
        seen.add(s.field)
    return names


@dataclass(frozen=True)
class PairStats:
    """Distinct pairs of a batch scorer, the rows they stand for, and the
    characters of their texts (what a broadcast of them would carry)."""

    pairs: int
    rows: int
    chars: int = 0


def _judge_verdicts(batch, pairs: DataFrame, counts: dict, bars: dict) -> tuple[dict[str, tuple], DataFrame | None]:
    """(verdicts, fits a broadcast) per judged slot; judges of one call group
    (same model, callable and cache) are resolved together: one cache probe,
    one call job, and one size measurement of the group's verdicts (an upper
    bound for every slot's share).  ``bars``: slots with a text that holds ``|``."""
    from fieldmark.operators.judge import call_group, keys_differ, resolve_verdicts, verdict_chars
    from fieldmark.session import scratch_path

    groups: dict[tuple, list] = {}
    for n, s in batch:
        if declares(s.scorer, "resolves_verdicts"):
            groups.setdefault(call_group(s.scorer), []).append((n, s.scorer))
    out = {}
    calls = None
    for members in groups.values():
        keyed = None
        for n, j in members:
            part = j.keyed(pairs.where(F.col("slot") == n)).withColumn("_slot", F.lit(n))
            keyed = part if keyed is None else keyed.unionByName(part)
        judges = [j for _, j in members]
        path = judges[0].cache_path or scratch_path(pairs.sparkSession, "judge_verdicts")
        n_pairs = sum(counts.get(n, PairStats(0, 0)).pairs for n, _ in members)
        unique = keys_differ(judges) and not any(bars.get(n) for n, _ in members)
        resolved = resolve_verdicts(judges, keyed.drop("_slot"), path, n_pairs, unique)
        fit = verdict_chars(resolved) <= judges[0].max_broadcast_chars
        spent = resolved.where(F.col("fresh")).select("judge", "key", "judge_tokens")
        calls = spent if calls is None else calls.unionByName(spent)
        for n, j in members:
            mine = j.keyed(pairs.where(F.col("slot") == n)).select("judge", "key")
            small = counts.get(n, PairStats(0, 0)).pairs <= j.max_broadcast_rows
            # keys: 64 characters each, bounded by rows; many pairs are joined by key in a
            # shuffle, where the verdicts of other rubrics find no row
            out[n] = (resolved.join(F.broadcast(mine), ["judge", "key"], "left_semi")
                      if small else resolved, fit)
    return out, calls


def takes_pairs(scorer) -> bool:
    """Whether a scorer has the members of :class:`BatchScorer`; the paired rows are then read
    more than once."""
    return hasattr(scorer, "attach") and hasattr(scorer, "pair_columns")


def _batched(scorer) -> bool:
    return takes_pairs(scorer) and declares(scorer, "batched", True)


def score_fields(paired: DataFrame, specs: list[FieldSpec]) -> DataFrame:
    """Add one ``STRUCT<score, passed, reason>`` column per spec (see
    ``score_fields_with_calls``)."""
    return score_fields_with_calls(paired, specs)[0]


def score_fields_with_calls(paired: DataFrame, specs: list[FieldSpec]
                            ) -> tuple[DataFrame, DataFrame | None]:
    """Add one ``STRUCT<score, passed, reason>`` column per spec; also returns
    the verdicts judged by this call (judge, key, judge_tokens), or None.

    Scorers that work on distinct pairs share one pass over ``paired``: the
    pairs of all of them are extracted and deduplicated together (partial
    aggregation before the shuffle, so a pair repeated in a third of all rows
    is one row per map task by then), written once, and counted per scorer
    in one small aggregate that decides each join strategy."""
    names = result_columns(specs)
    batch = [(n, s) for n, s in zip(names, specs) if _batched(s.scorer)]
    pairs = counts = bars = None
    if batch:
        entries = []
        for n, s in batch:
            cond, e_text, a_text = s.scorer.pair_columns(paired, f"e_{s.field}", f"a_{s.field}")
            entries.append(F.when(cond, F.struct(F.lit(n).alias("slot"), e_text.alias("expected"),
                                                 a_text.alias("actual"))))
        # one scan: each row contributes the pairs of every batch scorer it needs
        rows = paired.select(F.inline(F.array(*entries))).where("slot IS NOT NULL")
        pairs = materialize(rows.groupBy("slot", "expected", "actual")
                            .agg(F.count("*").alias("n_rows")), "pairs")
        seen = pairs.groupBy("slot").agg(
            F.count("*").alias("pairs"), F.sum("n_rows").alias("rows"),
            F.sum(F.length("expected") + F.length("actual")).alias("chars"),
            F.bool_or(F.contains("expected", F.lit("|")) | F.contains("actual", F.lit("|")))
            .alias("bars")).collect()
        counts = {r["slot"]: PairStats(r["pairs"], r["rows"], r["chars"] or 0) for r in seen}
        bars = {r["slot"]: r["bars"] for r in seen}
    verdicts, calls = _judge_verdicts(batch, pairs, counts, bars) if batch else ({}, None)
    out, added = paired, {}
    # the scorer of the most pairs first: a shuffle for its scores carries no other results
    for n, s in sorted(zip(names, specs), key=lambda x: -(
            counts.get(x[0], PairStats(0, 0)).pairs if _batched(x[1].scorer) else -1)):
        before = out.columns
        e, a = f"e_{s.field}", f"a_{s.field}"
        if _batched(s.scorer):
            slot_pairs = pairs.where(F.col("slot") == n).drop("slot")
            extra = ({"verdicts": verdicts[n][0], "verdicts_fit": verdicts[n][1]}
                     if n in verdicts else {})
            out = s.scorer.attach(out, e, a, n, slot_pairs, counts.get(n, PairStats(0, 0)), **extra)
        else:
            out = s.scorer.apply(out, e, a, n)
        added[n] = [c for c in out.columns if c not in before]
    return out.select(*paired.columns, *[c for n in names for c in added[n]]), calls


def first_wins_columns(specs: list[FieldSpec]) -> dict[str, str]:
    """field -> result column of its first spec."""
    firsts: dict[str, str] = {}
    for s, name in zip(specs, result_columns(specs)):
        firsts.setdefault(s.field, name)
    return firsts


def overall_score(specs: list[FieldSpec]):
    """Unweighted mean of the first-wins score of each distinct field.

    Terms are added in a fixed order (fields scored by similarity last) so the
    double result never depends on partitioning."""
    firsts = first_wins_columns(specs)
    scorer_of = {s.field: s.scorer for s in reversed(specs)}
    order = sorted(firsts, key=lambda f: declares(scorer_of[f], "added_last"))
    total = None
    for f in order:
        term = F.col(firsts[f])["score"]
        total = term if total is None else total + term
    return total / F.lit(float(len(order)))


def add_overall(scored: DataFrame, specs: list[FieldSpec], pass_threshold: float = EXAMPLE_PASS,
                weights: dict[str, float] | None = None) -> DataFrame:
    """``overall_score`` and ``passed`` (overall >= threshold; null overall fails).

    ``weights`` (field -> weight) gives a weighted mean instead."""
    if weights:
        firsts = first_wins_columns(specs)
        num = sum((F.col(c)["score"] * F.lit(float(weights.get(f, 1.0))) for f, c in firsts.items()),
                  F.lit(0.0))
        den = float(sum(weights.get(f, 1.0) for f in firsts))
        overall = num / F.lit(den)
    else:
        overall = overall_score(specs)
    return (scored.withColumn("overall_score", overall)
            .withColumn("passed", F.coalesce(F.col("overall_score") >= F.lit(pass_threshold),
                                             F.lit(False))))


def field_results_array(specs: list[FieldSpec]):
    """The nested per-example list: ``ARRAY<STRUCT<field, scorer, result>>`` in spec order."""
    return F.array(*[
        F.struct(F.lit(s.field).alias("field"), F.lit(s.scorer.name).alias("scorer"),
                 F.col(name).alias("result"))
        for s, name in zip(specs, result_columns(specs))
    ])


def to_long(scored: DataFrame, specs: list[FieldSpec], keys: tuple[str, ...] = ("run", "example_id")
            ) -> DataFrame:
    """Wide scored rows -> ``field_results`` (one row per field result, with
    ``pos``).  A per-row generator: no shuffle."""
    return (scored.select(*keys, F.posexplode(field_results_array(specs)).alias("pos", "fr"))
            .select(*keys, F.col("pos").cast("int").alias("pos"),
                    F.col("fr.field").alias("field"), F.col("fr.scorer").alias("scorer"),
                    F.col("fr.result.score").alias("score"), F.col("fr.result.passed").alias("passed"),
                    F.col("fr.result.reason").alias("reason")))
