"""Benchmark: score + aggregate + compare on the fixture golden set.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints one JSON line.  The fixture (golden set and two prediction runs) is
built and written to parquet first, as stored inputs would be; the headline
value is the time from those stored tables to every report table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from fieldmark.operators import aggregate as agg  # noqa: E402
from fieldmark.operators import compare as cmp  # noqa: E402
from fieldmark.operators import gates as gt  # noqa: E402
from fieldmark.operators import report as rp  # noqa: E402
from fieldmark.operators.judge import token_overlap_judge  # noqa: E402
from fieldmark.operators.materialize import materialize  # noqa: E402
from fieldmark.plans.evaluate import default_specs, evaluate  # noqa: E402
from fieldmark.operators.reshape import primary_scores  # noqa: E402
from fieldmark.plans.registry import QUERIES  # noqa: E402
from fieldmark.session import local_session  # noqa: E402
from fieldmark.sources.fixtures import fixture  # noqa: E402


def pipeline(spark, sf_dir: str, times: dict[str, float]) -> tuple[float, int, int]:
    """Fixture to stored tables, then score + aggregate + compare; returns the
    headline seconds (from stored tables to every report) and row counts."""

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    golden, preds = fixture(spark, sf_dir)
    golden = timed("fixture_golden", lambda: materialize(golden, "bench_golden"))
    preds = timed("fixture_predictions", lambda: materialize(preds, "bench_predictions"))

    t0 = time.perf_counter()
    specs = default_specs("stub-token-overlap", token_overlap_judge)
    ev = timed("score", lambda: evaluate(golden, preds, specs))
    summary = timed("run_summary", lambda: materialize(ev.summary(), "bench_summary"))
    timed("field_stats", lambda: ev.field_stats().collect())
    timed("field_distribution", lambda: agg.score_distribution(ev.primary).collect())
    timed("example_table", lambda: rp.example_table_wide(ev.scored, ev.firsts)
          .write.mode("overwrite").format("noop").save())
    timed("failures", lambda: rp.failures(ev.scored).write.mode("overwrite").format("noop").save())
    timed("category_breakdown", lambda: agg.category_breakdown(
        primary_scores(ev.scored, ev.firsts, keys=("run", "example_id", "category"))).collect())
    timed("gates", lambda: gt.gates(gt.run_measures(ev.examples, ev.long, ev.primary)).collect())
    timed("compare", lambda: cmp.compare_runs(ev.primary, summary, "baseline", "candidate")
          .collect())
    total = time.perf_counter() - t0

    # operators over other driver tables (whole texts)
    for q in ("score_fuzzy_documents", "predict_stub", "label_eval"):
        timed(q, lambda q=q: QUERIES[q](spark, sf_dir).write.mode("overwrite").format("noop").save())
    return total, golden.count(), preds.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="fieldmark-bench")

    # Warm-up on the smallest scale (JVM code generation, Python workers), untimed.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir)
    if warm:
        pipeline(spark, warm_dir, {})

    times: dict[str, float] = {}
    total, n_golden, n_preds = pipeline(spark, sf_dir, times)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "score_aggregate_compare_sec",
        "value": round(total, 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "rows": {"examples": n_golden, "predictions": n_preds},
        "predictions_per_sec": round(n_preds / total, 1) if total else None,
        "warmup": warm_dir if warm else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
