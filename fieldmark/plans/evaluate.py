"""End-to-end evaluation of prediction runs against a golden set.

``read -> pair (join) -> score (projection + batch scorers) -> overall
(narrow) -> reports (partial aggregations)``.  The paired rows are written once
to the shared folder because every batch scorer scans them for its distinct
pairs; the scored rows are written once because every report reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.aggregate import field_stats, run_summary
from fieldmark.operators.judge import Judge, VerdictFn
from fieldmark.operators.materialize import materialize
from fieldmark.operators.pair import matched, pair, pair_all
from fieldmark.operators.predict import flag_answers
from fieldmark.operators.reshape import primary_scores
from fieldmark.operators.score import (
    ExactMatch,
    FieldSpec,
    FuzzyMatch,
    add_overall,
    field_results_array,
    first_wins_columns,
    result_columns,
    score_fields_with_calls,
    takes_pairs,
    to_long,
)
from fieldmark.operators.validate import DEFAULT_DOMAINS
from fieldmark.schemas import EXAMPLE_PASS, FUZZY_PASS, JUDGE_PASS
from fieldmark.session import free_scratch, recorded_scratch

# Rubrics of the two judged fields (our wording).
TITLE_RUBRIC = (
    "Decide whether the predicted job title names the same role as the expected title.\n"
    "2: the same role, possibly reworded, reordered, abbreviated or translated.\n"
    "1: a related role that differs in substance.\n"
    "0: an unrelated role, or a clearly wrong title.\n"
    "Give the score (0, 1 or 2) and a one-sentence reason."
)
SKILLS_RUBRIC = (
    "Decide whether the predicted list of skills covers the expected list.\n"
    "Order does not matter; abbreviations and synonyms of one skill count as the same skill.\n"
    "2: the same skills.\n"
    "1: the core skills are there, but some are missing or some were added.\n"
    "0: little or no overlap.\n"
    "Give the score (0, 1 or 2) and a one-sentence reason."
)


def default_specs(judge_model: str, judge_fn: VerdictFn, cache_path: str | None = None,
                  concurrency: int | None = None) -> list[FieldSpec]:
    """The extraction task's field -> scorer registry, in scoring order:
    seniority and work_mode exact, location fuzzy (0.8), title and skills judged."""
    judge = dict(model=judge_model, call=judge_fn, cache_path=cache_path,
                 concurrency=concurrency, threshold=JUDGE_PASS)
    return [
        FieldSpec("seniority", ExactMatch()),
        FieldSpec("work_mode", ExactMatch()),
        FieldSpec("location", FuzzyMatch(threshold=FUZZY_PASS)),
        FieldSpec("title", Judge(rubric_id="title", rubric=TITLE_RUBRIC, name="llm_judge", **judge)),
        FieldSpec("skills", Judge(rubric_id="skills", rubric=SKILLS_RUBRIC, name="llm_judge_skills",
                                  **judge)),
    ]


@dataclass
class Evaluation:
    """Scored rows of one or more runs and the tables derived from them."""

    scored: DataFrame
    specs: list[FieldSpec]
    judge_calls: DataFrame | None = None   # verdicts judged by this evaluation
    scratch: list[str] = field(default_factory=list)   # folders it wrote

    def close(self) -> None:
        """Delete the folders this evaluation wrote (stored artifacts and a named verdict
        cache stay); its tables cannot be read afterwards."""
        free_scratch(self.scored.sparkSession, self.scratch)
        self.scratch = []

    def __enter__(self) -> Evaluation:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def firsts(self) -> dict[str, str]:
        return first_wins_columns(self.specs)

    @property
    def examples(self) -> DataFrame:
        """run, example_id, category, overall_score, passed, latency_ms, total_tokens."""
        return self.scored.select("run", "example_id", "category", "overall_score", "passed",
                                  "latency_ms", "total_tokens")

    @property
    def long(self) -> DataFrame:
        """All field results, one row each, with ``pos`` (no first-wins)."""
        return to_long(self.scored, self.specs)

    @property
    def primary(self) -> DataFrame:
        """(run, example_id, field, score, passed), first result of each field."""
        return primary_scores(self.scored, self.firsts)

    def summary(self) -> DataFrame:
        return run_summary(self.examples)

    def error_counts(self) -> DataFrame:
        """Per run: bad model answers, and field results without a score because the
        judge's verdict was invalid (means leave those out)."""
        answer = (F.col("answer_error").isNotNull() if "answer_error" in self.scored.columns
                  else F.lit(False))
        unscored = [F.col(c)["score"].isNull().cast("bigint") for c in result_columns(self.specs)]
        return self.scored.groupBy("run").agg(
            F.count_if(answer).alias("bad_answers"),
            F.sum(sum(unscored[1:], unscored[0])).alias("unscored_results"))

    def field_stats(self) -> DataFrame:
        return field_stats(self.primary)

    def judge_spend(self) -> DataFrame | None:
        """Judge calls this evaluation made and the tokens they reported, per
        judge model (cache hits cost nothing); None without judged fields."""
        if self.judge_calls is None:
            return None
        return self.judge_calls.groupBy("judge").agg(
            F.count("*").alias("calls"), F.sum("judge_tokens").cast("bigint").alias("judge_tokens"))


def evaluate(golden: DataFrame, predictions: DataFrame, specs: list[FieldSpec],
             missing: str = "error", pass_threshold: float = EXAMPLE_PASS,
             weights: dict[str, float] | None = None, persist: bool = True,
             bad_answers: str = "error", domains: dict[str, list[str]] | None = None
             ) -> Evaluation:
    """Pair, score every field, add overall score and pass flag.

    ``missing='error'`` (default) stops when a run lacks a prediction, has
    duplicate ids or ids unknown to the golden set, checked on the written
    paired rows; ``'drop'`` / ``'null'`` as in ``pair``.  Answers with an
    ``answer_error`` (see ``predict``; with ``domains`` also values outside
    them) stop the evaluation, or with ``bad_answers='fail'`` score 0.0 in
    every field.  ``persist`` writes paired and scored rows to the shared
    folder (see the module note); turn it off for a single cheap report.
    ``Evaluation.close`` deletes what was written there."""
    with recorded_scratch() as made:
        ev = _evaluate(golden, predictions, specs, missing, pass_threshold, weights, persist,
                       bad_answers, domains)
    ev.scratch = made
    return ev


def _evaluate(golden, predictions, specs, missing, pass_threshold, weights, persist, bad_answers,
              domains) -> Evaluation:
    if bad_answers not in ("error", "fail"):
        raise ValueError(f"bad_answers must be 'error' or 'fail', not {bad_answers!r}")
    if domains:
        predictions = flag_answers(predictions, domains)
    if missing == "error":
        paired = materialize(pair_all(golden, predictions), "paired")
        paired = matched(paired, golden)
    else:
        paired = pair(golden, predictions, missing=missing)
        frame_scorers = any(takes_pairs(s.scorer) for s in specs)
        if persist and frame_scorers:
            paired = materialize(paired, "paired")
    flagged = "answer_error" in paired.columns
    if flagged and bad_answers == "error":
        r = paired.where("answer_error IS NOT NULL").agg(
            F.count("*").alias("n"), F.min(F.struct("run", "example_id", "answer_error"))
            .alias("one")).first()
        if r["n"]:
            raise ValueError(f"{r['n']} bad answers, one of them: {r['one'].asDict()}")
    scored, calls = score_fields_with_calls(paired, specs)
    if flagged and bad_answers == "fail":
        scored = scored.withColumns({c: F.when(F.col("answer_error").isNotNull(), F.struct(
            F.lit(0.0).alias("score"), F.lit(False).alias("passed"),
            F.concat(F.lit("bad answer: "), F.col("answer_error")).alias("reason")))
            .otherwise(F.col(c)) for c in result_columns(specs)})
    scored = add_overall(scored, specs, pass_threshold, weights)
    if persist:
        scored = materialize(scored, "scored")
    # the nested per-example list is a projection of the result columns:
    # computed on read rather than stored twice
    return Evaluation(scored.withColumn("field_results", field_results_array(specs)), specs,
                      calls)


def run_evaluation(spark, golden_path: str, model_fn, model: str, judge_fn, judge_model: str,
                   out_root: str | None = None, save: bool = True, concurrency: int | None = None,
                   cache_path: str | None = None, domains=None,
                   bad_answers: str = "error", answers_path: str | None = None) -> Evaluation:
    """One evaluation run end to end: scan and validate the golden set, ask
    the model for every example (batch job, persisted), score every field,
    and store the run under ``out_root`` unless ``save`` is off.  With
    ``answers_path`` a run that broke asks only what no finished task answered."""
    from fieldmark.operators.predict import predict
    from fieldmark.sources.artifacts import write_run
    from fieldmark.sources.golden import read_golden

    golden = (read_golden(spark, golden_path) if domains is None
              else read_golden(spark, golden_path, domains=domains))
    preds = predict(golden, model_fn, run=model, concurrency=concurrency,
                    domains=DEFAULT_DOMAINS if domains is None else domains, store=answers_path)
    ev = evaluate(golden, preds, default_specs(judge_model, judge_fn, cache_path=cache_path,
                                               concurrency=concurrency), bad_answers=bad_answers)
    if save and out_root:
        write_run(ev, out_root, model=model, judge=judge_model)
    return ev
