"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Tables ``region nation customer supplier part orders lineitem documents
labels ...`` are views over the same parquet files.  Each statement rebuilds
the fixture from them and computes the expected result independently of the
Spark code (its own LCS as a recursive CTE, its own stub-judge rule, ...).
Doubles are rounded to 6 digits, as on the Spark side."""

from __future__ import annotations

JUDGE_MODEL = "stub-token-overlap"

# Fixed values, written out here so that a wrong one in the package shows as a mismatch.
FIXTURE_DOMAINS = {
    "seniority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "work_mode": ["F", "O", "P"],
}
STUB_REASONS = {2: "same tokens", 1: "some tokens shared", 0: "no token shared"}
STUB_SKILLS = ["python", "sql", "spark", "java"]
LATENCY_BOUND_MS = 10000.0
# (gate, field, measure, op, bound)
DEFAULT_TARGETS = [
    ("run_gate", "*", "pass_rate", ">=", 0.7),
    ("field_gate", "title", "mean_all", ">=", 0.5),
    ("field_gate", "seniority", "mean_all", ">=", 0.5),
    ("field_gate", "work_mode", "mean_all", ">=", 0.5),
    ("field_gate", "location", "mean_all", ">=", 0.5),
    ("field_gate", "skills", "mean_all", ">=", 0.5),
    ("target", "title", "mean", ">=", 0.85),
    ("target", "seniority", "mean", ">=", 0.8),
    ("target", "work_mode", "mean", ">=", 0.95),
    ("target", "location", "mean", ">=", 0.6),
    ("target", "skills", "mean", ">=", 0.8),
    ("target", "*", "mean_score", ">=", 0.8),
    ("target", "*", "pass_rate", ">=", 0.85),
    ("target", "*", "share_latency_below_bound", ">=", 0.95),
    ("target", "*", "max_tokens", "<", 2000.0),
]
# The rubrics are part of the judge's key.
TITLE_RUBRIC = """\
Decide whether the predicted job title names the same role as the expected title.
2: the same role, possibly reworded, reordered, abbreviated or translated.
1: a related role that differs in substance.
0: an unrelated role, or a clearly wrong title.
Give the score (0, 1 or 2) and a one-sentence reason."""
SKILLS_RUBRIC = """\
Decide whether the predicted list of skills covers the expected list.
Order does not matter; abbreviations and synonyms of one skill count as the same skill.
2: the same skills.
1: the core skills are there, but some are missing or some were added.
0: little or no overlap.
Give the score (0, 1 or 2) and a one-sentence reason."""


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Python's whitespace (str.isspace) as an RE2 class.
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def esc(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), "
            f"chr(13), '\\r'), chr(9), '\\t')")


def repr_str(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'None' "
            f"WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc(x)} || '\"' "
            f"ELSE '''' || replace({esc(x)}, '''', '\\''') || '''' END)")


def repr_list(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'None' ELSE '[' || "
            f"array_to_string(list_transform({x}, lambda s: {repr_str('s')}), ', ') || ']' END)")


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


D = "CAST({} AS DOUBLE)"

FX_GOLDEN = """
SELECT o_orderkey AS k,
       'ex_' || CAST(o_orderkey AS VARCHAR) AS id,
       CASE WHEN o_orderkey % 10 = 9 THEN 'sparse_description' ELSE c_mktsegment END AS category,
       c_mktsegment || ' account' AS e_title,
       c_mktsegment AS seg,
       n_name AS city,
       o_orderpriority AS e_seniority,
       CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderstatus END AS e_work_mode,
       CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE n_name || ', ' || r_name END AS e_location,
       CASE WHEN o_orderkey % 10 = 9 THEN []::VARCHAR[] ELSE coalesce(sk.skills, []::VARCHAR[]) END AS e_skills
FROM orders JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey
     LEFT JOIN (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS skills
                FROM lineitem JOIN part ON l_partkey = p_partkey
                GROUP BY l_orderkey) sk ON l_orderkey = o_orderkey
"""

FX_PRED = """
SELECT run, id AS example_id, m,
       CASE WHEN m % 23 = 0 THEN NULL
            WHEN m % 29 = 0 THEN 'unknown'
            WHEN m % 7 = 0 THEN 'account ' || seg
            WHEN m % 11 = 0 THEN 'GENERAL account'
            ELSE lower(e_title) END AS a_title,
       CASE WHEN m % 10 = 0 THEN '5-LOW'
            WHEN m % 3 = 0 THEN lower(e_seniority)
            WHEN m % 4 = 0 THEN ' ' || e_seniority || ' '
            ELSE e_seniority END AS a_seniority,
       CASE WHEN e_work_mode IS NULL AND m % 5 = 0 THEN 'O'
            WHEN m % 17 = 0 THEN NULL
            ELSE lower(e_work_mode) END AS a_work_mode,
       CASE WHEN e_location IS NULL AND m % 7 = 0 THEN 'Berlin'
            WHEN m % 19 = 0 THEN NULL
            WHEN e_location IS NULL THEN NULL
            WHEN m % 3 = 0 THEN city
            WHEN m % 2 = 0 THEN upper(e_location)
            ELSE e_location END AS a_location,
       CASE WHEN len(e_skills) = 0 AND m % 7 = 0 THEN ['Brand#0']
            WHEN len(e_skills) = 0 OR m % 13 = 0 THEN []::VARCHAR[]
            WHEN m % 4 = 0 THEN e_skills[1:len(e_skills) - 1]
            ELSE e_skills END AS a_skills,
       CAST(800 + (m * 37) % 2400 AS DOUBLE) AS latency_ms,
       CAST(200 + (m * 13) % 300 AS BIGINT) AS total_tokens
FROM (SELECT g.*, r.run, g.k + r.seed AS m
      FROM fx_golden g
      CROSS JOIN (SELECT 'baseline' AS run, 0 AS seed UNION ALL SELECT 'candidate', 5) r) q
"""

PAIRED = """
SELECT p.run, p.example_id, g.k, g.category,
       g.e_title, g.e_seniority, g.e_work_mode, g.e_location, g.e_skills,
       p.a_title, p.a_seniority, p.a_work_mode, p.a_location, p.a_skills,
       p.latency_ms, p.total_tokens
FROM fx_pred p JOIN fx_golden g ON p.example_id = g.id
"""

LCS_DP_TEMPLATE = """
SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda z: 0::BIGINT) AS r FROM {src}
UNION ALL
SELECT a, b, i + 1,
  list_reduce(list_transform(range(1, length(b) + 1),
                lambda j: [j, CASE WHEN a[i + 1] = b[j] THEN 1 ELSE 0 END]),
    lambda c, x: list_append(c, CASE WHEN x[2] = 1 THEN r[x[1]] + 1
                                ELSE greatest(r[x[1] + 1], c[len(c)]) END),
    [0::BIGINT])
FROM {dp} WHERE i < length(a)
"""
LCS_DP = LCS_DP_TEMPLATE.format(src="lpairs", dp="dp")


def _ctes(extra: str = "") -> str:
    base = (f"WITH RECURSIVE fx_golden AS ({FX_GOLDEN}), fx_pred AS ({FX_PRED}), "
            f"paired AS ({PAIRED})")
    return base + (", " + extra if extra else "")


# -- scorer expressions ---------------------------------------------------------
def exact_cols(f: str) -> dict[str, str]:
    e, a = f"e_{f}", f"a_{f}"
    m = f"({strip(f'lower({e})')} = {strip(f'lower({a})')})"
    return {
        "score": f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN 1.0 WHEN {e} IS NULL OR {a} IS NULL "
                 f"THEN 0.0 WHEN {m} THEN 1.0 ELSE 0.0 END",
        "passed": f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN true WHEN {e} IS NULL OR {a} IS NULL "
                  f"THEN false ELSE {m} END",
        "reason": f"CASE WHEN NOT ({e} IS NULL AND {a} IS NULL) AND ({e} IS NULL OR {a} IS NULL) "
                  f"THEN 'expected=' || {repr_str(e)} || ', actual=' || {repr_str(a)} END",
    }


def fuzzy_cols(ratio: str, f: str = "location", threshold: float = 0.8) -> dict[str, str]:
    e, a = f"e_{f}", f"a_{f}"
    return {
        "score": f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN 1.0 WHEN {e} IS NULL OR {a} IS NULL "
                 f"THEN 0.0 ELSE {ratio} END",
        "passed": f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN true WHEN {e} IS NULL OR {a} IS NULL "
                  f"THEN false ELSE {ratio} >= {threshold} END",
        "reason": f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN NULL WHEN {e} IS NULL OR {a} IS NULL "
                  f"THEN 'expected=' || {repr_str(e)} || ', actual=' || {repr_str(a)} "
                  f"ELSE 'ratio=' || printf('%.2f', {ratio}) END",
    }


def judge_text(f: str, side: str) -> str:
    c = f"{side}_{f}"
    return f"array_to_string({c}, ', ')" if f == "skills" else c


def judge_empty(f: str, side: str) -> str:
    c = f"{side}_{f}"
    return f"({c} IS NULL OR len({c}) = 0)" if f == "skills" else f"({c} IS NULL OR length({c}) = 0)"


def stub_verdict(e_text: str, a_text: str, f: str) -> str:
    sep = "', '" if f == "skills" else "' '"
    te = f"string_split(lower({e_text}), {sep})"
    ta = f"string_split(lower({a_text}), {sep})"
    return (f"(CASE WHEN list_sort(list_distinct({te})) = list_sort(list_distinct({ta})) THEN 2 "
            f"WHEN len(list_intersect({te}, {ta})) > 0 THEN 1 ELSE 0 END)")


def reason_of(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} = {k} THEN {lit(t)}" for k, t in STUB_REASONS.items()) + " END"


RUBRIC = {"title": TITLE_RUBRIC, "skills": SKILLS_RUBRIC}


def judge_key(f: str) -> str:
    return (f"sha256({lit(RUBRIC[f])} || '||' || {judge_text(f, 'e')} || '||' || "
            f"{judge_text(f, 'a')})")


def judge_cols(f: str) -> dict[str, str]:
    ee, ae = judge_empty(f, "e"), judge_empty(f, "a")
    v = stub_verdict(judge_text(f, "e"), judge_text(f, "a"), f)
    rep = repr_list if f == "skills" else repr_str
    return {
        "score": f"CASE WHEN {ee} AND {ae} THEN 1.0 WHEN {ee} OR {ae} THEN 0.0 ELSE {v} / 2.0 END",
        "passed": f"CASE WHEN {ee} AND {ae} THEN true WHEN {ee} OR {ae} THEN false "
                  f"ELSE {v} / 2.0 >= 0.5 END",
        "reason": f"CASE WHEN {ee} AND {ae} THEN NULL WHEN {ee} OR {ae} THEN "
                  f"'expected=' || {rep(f'e_{f}')} || ', actual=' || {rep(f'a_{f}')} "
                  f"ELSE {reason_of(v)} END",
    }


LOC_PAIRS = ("lpairs AS (SELECT DISTINCT lower(e_location) AS a, lower(a_location) AS b FROM paired "
             "WHERE e_location IS NOT NULL AND a_location IS NOT NULL), "
             f"dp AS ({LCS_DP}), "
             "lcs AS (SELECT a, b, r[len(r)] AS lcs FROM dp WHERE i = length(a))")
LOC_RATIO = ("CASE WHEN length(lower(e_location)) + length(lower(a_location)) = 0 THEN 1.0 "
             "ELSE 2.0 * l.lcs / (length(lower(e_location)) + length(lower(a_location))) END")
LOC_JOIN = "LEFT JOIN lcs l ON l.a = lower(e_location) AND l.b = lower(a_location)"

SCORERS = {"seniority": "exact_match", "work_mode": "exact_match", "location": "fuzzy_match",
           "title": "llm_judge", "skills": "llm_judge_skills"}
ORDER = ["seniority", "work_mode", "location", "title", "skills"]


def _field_cols(f: str) -> dict[str, str]:
    if f in ("seniority", "work_mode"):
        return exact_cols(f)
    if f == "location":
        return fuzzy_cols(LOC_RATIO)
    return judge_cols(f)


def _scored_select() -> str:
    cols = []
    for f in ORDER:
        for k, expr in _field_cols(f).items():
            cols.append(f"{D.format(expr) if k == 'score' else expr} AS {f}_{k}")
    return (f"SELECT paired.*, {', '.join(cols)} FROM paired {LOC_JOIN}")


SCORED = (f"scored0 AS ({_scored_select()}), "
          "scored AS (SELECT *, (seniority_score + work_mode_score + title_score + skills_score "
          "+ location_score) / CAST(5 AS DOUBLE) AS overall_score, "
          "(seniority_score + work_mode_score + title_score + skills_score + location_score) "
          "/ CAST(5 AS DOUBLE) >= 0.7 AS passed FROM scored0)")

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT run, example_id, k, category, {i} AS pos, '{f}' AS field, '{SCORERS[f]}' AS scorer, "
    f"{f}_score AS score, {f}_passed AS fpassed, {f}_reason AS reason FROM scored"
    for i, f in enumerate(ORDER)) + ")"


def _with_scored(extra: str = "") -> str:
    return _ctes(LOC_PAIRS + ", " + SCORED + ", " + LONG + (", " + extra if extra else ""))


# -- statements ---------------------------------------------------------------------
def _skills_text(c):
    return f"array_to_string({c}, '|')"


Q: dict[str, str] = {}

Q["pair_examples"] = _ctes() + f"""
SELECT run, example_id, category, e_title, a_title, e_seniority, a_seniority, e_work_mode,
       a_work_mode, e_location, a_location, {_skills_text('e_skills')} AS e_skills,
       {_skills_text('a_skills')} AS a_skills, latency_ms, total_tokens FROM paired"""

Q["sparse_filter"] = _ctes() + f"""
SELECT run, example_id, e_location, a_location, {_skills_text('e_skills')} AS e_skills,
       {_skills_text('a_skills')} AS a_skills FROM paired WHERE category = 'sparse_description'"""


def _result_select(f, cols):
    return (f"{r6(D.format(cols['score']))} AS {f}_score, {cols['passed']} AS {f}_passed, "
            f"{cols['reason']} AS {f}_reason")


Q["score_exact"] = _ctes() + f"""
SELECT run, example_id, {_result_select('seniority', exact_cols('seniority'))},
       {_result_select('work_mode', exact_cols('work_mode'))} FROM paired"""

Q["score_fuzzy_location"] = _ctes(LOC_PAIRS) + f"""
SELECT run, example_id, {_result_select('location', fuzzy_cols(LOC_RATIO))} FROM paired {LOC_JOIN}"""

LEV_RATIO = ("CASE WHEN greatest(length(lower(e_location)), length(lower(a_location))) = 0 THEN 1.0 "
             "ELSE 1.0 - CAST(levenshtein(lower(e_location), lower(a_location)) AS DOUBLE) / "
             "greatest(length(lower(e_location)), length(lower(a_location))) END")
Q["score_levenshtein"] = _ctes() + f"""
SELECT run, example_id, {_result_select('location', fuzzy_cols(LEV_RATIO))} FROM paired"""


def _toks(x: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_split_to_array({x}, '{WS}+'), "
            f"lambda t: t <> '')))")


_TS_CTES = (
    "tpairs AS (SELECT DISTINCT lower(e_location) AS a, lower(a_location) AS b FROM paired "
    "WHERE e_location IS NOT NULL AND a_location IS NOT NULL), "
    f"tok AS (SELECT a, b, {_toks('a')} AS ta, {_toks('b')} AS tb FROM tpairs), "
    "parts AS (SELECT a, b, ta, tb, "
    "list_filter(ta, lambda t: list_contains(tb, t)) AS sect, "
    "array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS ab, "
    "array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS ba FROM tok), "
    "rpairs AS (SELECT DISTINCT ab AS a, ba AS b FROM parts), "
    f"rdp AS ({LCS_DP_TEMPLATE.format(src='rpairs', dp='rdp')}), "
    "rlcs AS (SELECT a, b, r[len(r)] AS lcs FROM rdp WHERE i = length(a)), "
    "m AS (SELECT p.a, p.b, len(ta) AS nta, len(tb) AS ntb, len(sect) AS nsect, "
    "CAST(length(array_to_string(sect, ' ')) AS DOUBLE) AS sl, "
    "CAST(CASE WHEN len(sect) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hs, "
    "CAST(length(ab) AS DOUBLE) AS abl, CAST(length(ba) AS DOUBLE) AS bal, "
    "CAST(r.lcs AS DOUBLE) AS lcs FROM parts p JOIN rlcs r ON r.a = p.ab AND r.b = p.ba), "
    "ts AS (SELECT a, b, CASE WHEN nta = 0 OR ntb = 0 THEN 0.0 "
    "WHEN nsect > 0 AND (nta = nsect OR ntb = nsect) THEN 1.0 "
    "WHEN nsect = 0 THEN (CASE WHEN (sl + hs + abl) + (sl + hs + bal) = 0 THEN 1.0 "
    "ELSE 1.0 - (abl + bal - 2 * lcs) / ((sl + hs + abl) + (sl + hs + bal)) END) "
    "ELSE greatest(1.0 - (abl + bal - 2 * lcs) / ((sl + hs + abl) + (sl + hs + bal)), "
    "1.0 - (hs + abl) / (sl + (sl + hs + abl)), 1.0 - (hs + bal) / (sl + (sl + hs + bal))) END "
    "AS ratio FROM m)")
TS_RATIO = "CAST(ts.ratio AS DOUBLE)"
Q["score_token_set"] = _ctes(_TS_CTES) + f"""
SELECT run, example_id, {_result_select('location', fuzzy_cols(TS_RATIO))} FROM paired
LEFT JOIN ts ON ts.a = lower(e_location) AND ts.b = lower(a_location)"""


def _overlap(measure: str) -> str:
    le = "list_distinct(list_transform(e_skills, lambda x: lower(x)))"
    la = "list_distinct(list_transform(a_skills, lambda x: lower(x)))"
    inter = f"CAST(len(list_intersect({le}, {la})) AS DOUBLE)"
    ne, na = f"CAST(len({le}) AS DOUBLE)", f"CAST(len({la}) AS DOUBLE)"
    union = f"CAST(len(list_distinct(list_concat({le}, {la}))) AS DOUBLE)"
    value = {"precision": f"{inter} / {na}", "recall": f"{inter} / {ne}",
             "f1": f"CASE WHEN {inter} = 0 THEN 0.0 ELSE 2.0 * {inter} / ({ne} + {na}) END",
             "jaccard": f"{inter} / {union}"}[measure]
    return (f"CASE WHEN {ne} = 0 AND {na} = 0 THEN 1.0 WHEN {ne} = 0 OR {na} = 0 THEN 0.0 "
            f"ELSE {value} END")


Q["score_list_overlap"] = _ctes() + """
SELECT run, example_id, """ + ", ".join(
    f"{r6(_overlap(m))} AS {m}" for m in ("precision", "recall", "f1", "jaccard")) + " FROM paired"


def _pairs_select(f: str, where: str = "") -> str:
    cond = f"NOT ({judge_empty(f, 'e')} OR {judge_empty(f, 'a')})" + (f" AND {where}" if where else "")
    return (f"SELECT DISTINCT '{f}' AS field, {judge_key(f)} AS key, {judge_text(f, 'e')} AS expected, "
            f"{judge_text(f, 'a')} AS actual FROM paired WHERE {cond}")


Q["judge_pairs"] = _ctes() + f"{_pairs_select('title')} UNION ALL {_pairs_select('skills')}"

for _f in ("title", "skills"):
    Q[f"judge_{_f}"] = _ctes() + f"""
SELECT run, example_id, {_result_select(_f, judge_cols(_f))} FROM paired"""

Q["judge_cache_hits"] = _ctes(
    f"jp AS ({_pairs_select('title', 'run = ' + lit('baseline'))} UNION ALL "
    f"{_pairs_select('skills', 'run = ' + lit('baseline'))}), "
    f"jc AS ({_pairs_select('title', 'run = ' + lit('candidate'))} UNION ALL "
    f"{_pairs_select('skills', 'run = ' + lit('candidate'))})") + """
SELECT jc.field, CAST(count(*) AS BIGINT) AS n_pairs,
       CAST(count(jp.key) AS BIGINT) AS hits, CAST(count(*) - count(jp.key) AS BIGINT) AS misses
FROM jc LEFT JOIN jp ON jc.key = jp.key AND jc.field = jp.field GROUP BY jc.field"""


def _noisy(v: str, e: str, a: str) -> str:
    return f"CASE WHEN (length({e}) + length({a}) + rep) % 3 = 0 THEN (CASE WHEN {v} <> 1 THEN 1 ELSE 2 END) ELSE {v} END"


Q["judge_consistency"] = _ctes(
    f"jp AS ({_pairs_select('title')} UNION ALL {_pairs_select('skills')}), "
    "reps AS (SELECT jp.*, rep FROM jp, range(1, 4) t(rep)), "
    "verd AS (SELECT field, key, CAST(" + _noisy(
        "CASE WHEN field = 'skills' THEN " + stub_verdict("expected", "actual", "skills")
        + " ELSE " + stub_verdict("expected", "actual", "title") + " END", "expected", "actual")
    + " AS DOUBLE) / 2.0 AS score FROM reps)") + f"""
SELECT field, key, CAST(count(*) AS BIGINT) AS n, {r6('avg(score)')} AS mean_score,
       {r6('coalesce(var_samp(score), 0.0)')} AS variance,
       coalesce(var_samp(score), 0.0) < 0.2 AS passed
FROM verd GROUP BY field, key"""

Q["judge_cache_consistency"] = _ctes(
    f"jp AS ({_pairs_select('title')} UNION ALL {_pairs_select('skills')})") + """
SELECT true AS consistent, CAST(count(*) AS BIGINT) AS n_keys FROM jp"""

Q["first_wins"] = _with_scored(
    "dup AS (SELECT run, example_id, pos, field, scorer, score FROM long UNION ALL "
    f"SELECT run, example_id, 5, 'title', 'exact_match', "
    f"CAST({exact_cols('title')['score']} AS DOUBLE) FROM scored)") + f"""
SELECT run, example_id, field, min(pos) AS pos, arg_min(scorer, pos) AS scorer,
       {r6('arg_min(score, pos)')} AS score
FROM dup GROUP BY run, example_id, field"""

Q["overall_scores"] = _with_scored() + f"""
SELECT run, example_id, {r6('overall_score')} AS overall_score, passed FROM scored"""

Q["run_summary"] = _with_scored() + f"""
SELECT run, CAST(count(*) AS BIGINT) AS n_examples,
       CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_passed,
       {r6('avg(overall_score)')} AS mean_score, {r6('avg(CAST(passed AS DOUBLE))')} AS pass_rate,
       {r6('avg(latency_ms)')} AS mean_latency_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM scored GROUP BY run"""

Q["field_stats"] = _with_scored() + f"""
SELECT run, field, CAST(count(score) AS BIGINT) AS n, {r6('avg(score)')} AS mean_score,
       {r6('avg(CAST(score >= 0.5 AS DOUBLE))')} AS pass_rate
FROM long GROUP BY run, field"""

Q["field_distribution"] = _with_scored() + f"""
SELECT run, field, {r6('min(score)')} AS min_score,
       {r6('quantile_cont(score, 0.25)')} AS q25, {r6('quantile_cont(score, 0.5)')} AS median,
       {r6('quantile_cont(score, 0.75)')} AS q75, {r6('max(score)')} AS max_score
FROM long GROUP BY run, field"""

Q["example_table"] = _with_scored() + f"""
SELECT run, example_id, coalesce(category, '') AS category,
       {r6('coalesce(title_score, 0.0)')} AS title, {r6('coalesce(seniority_score, 0.0)')} AS seniority,
       {r6('coalesce(work_mode_score, 0.0)')} AS work_mode,
       {r6('coalesce(location_score, 0.0)')} AS location, {r6('coalesce(skills_score, 0.0)')} AS skills,
       {r6('overall_score')} AS overall_score, passed
FROM scored"""

Q["example_table_long"] = Q["example_table"]

Q["scores_long"] = _with_scored() + f"""
SELECT run, example_id, field, {r6('coalesce(score, 0.0)')} AS score FROM long"""

Q["failures"] = _with_scored() + f"""
SELECT long.run, long.example_id AS example, field, scorer, {r6('score')} AS score,
       coalesce(reason, '') AS reason
FROM long JOIN scored s ON long.run = s.run AND long.example_id = s.example_id
WHERE NOT s.passed AND NOT long.fpassed"""

Q["failure_counts"] = _with_scored() + """
SELECT long.run, field, CAST(count(*) AS BIGINT) AS n_failures
FROM long JOIN scored s ON long.run = s.run AND long.example_id = s.example_id
WHERE NOT s.passed AND NOT long.fpassed GROUP BY long.run, field"""

Q["status_flags"] = _with_scored() + f"""
SELECT run, '*' AS field, {r6('avg(CAST(passed AS DOUBLE))')} AS value,
       CASE WHEN avg(CAST(passed AS DOUBLE)) >= 0.7 THEN 'green' ELSE 'red' END AS status
FROM scored GROUP BY run
UNION ALL
SELECT run, field, {r6('avg(score)')}, CASE WHEN avg(score) >= 0.5 THEN 'green' ELSE 'red' END
FROM long GROUP BY run, field"""

Q["category_counts"] = _ctes() + """
SELECT category, CAST(count(*) AS BIGINT) AS n FROM fx_golden GROUP BY category"""

Q["category_breakdown"] = _with_scored() + f"""
SELECT run, category, field,
       CASE grouping_id(category, field) WHEN 3 THEN 'run' WHEN 1 THEN 'run_category'
            WHEN 2 THEN 'run_field' ELSE 'run_category_field' END AS level,
       CAST(count(score) AS BIGINT) AS n, {r6('avg(score)')} AS mean_score,
       {r6('avg(CAST(score >= 0.5 AS DOUBLE))')} AS pass_rate
FROM long GROUP BY GROUPING SETS ((run), (run, category), (run, field), (run, category, field))"""

_COMPARE = _with_scored(
    "pf AS (SELECT field, "
    "avg(CASE WHEN run = 'baseline' THEN score END) AS baseline_mean, "
    "avg(CASE WHEN run = 'candidate' THEN score END) AS candidate_mean, "
    "avg(CASE WHEN run = 'baseline' THEN CAST(score >= 0.5 AS DOUBLE) END) AS baseline_pr, "
    "avg(CASE WHEN run = 'candidate' THEN CAST(score >= 0.5 AS DOUBLE) END) AS candidate_pr "
    "FROM long GROUP BY field), "
    "ov AS (SELECT 'overall' AS field, "
    "avg(CASE WHEN run = 'baseline' THEN overall_score END) AS baseline_mean, "
    "avg(CASE WHEN run = 'candidate' THEN overall_score END) AS candidate_mean, "
    "avg(CASE WHEN run = 'baseline' THEN CAST(passed AS DOUBLE) END) AS baseline_pr, "
    "avg(CASE WHEN run = 'candidate' THEN CAST(passed AS DOUBLE) END) AS candidate_pr FROM scored), "
    "cmp AS (SELECT *, candidate_mean - baseline_mean AS delta_mean, "
    "candidate_pr - baseline_pr AS delta_pr FROM (SELECT * FROM pf UNION ALL SELECT * FROM ov))")


def _trend(c):
    return f"CASE WHEN {c} > 0.01 THEN 'better' WHEN {c} < -0.01 THEN 'worse' ELSE 'same' END"


Q["compare_runs"] = _COMPARE + f"""
SELECT field, {r6('baseline_mean')} AS baseline_mean, {r6('candidate_mean')} AS candidate_mean,
       {r6('delta_mean')} AS delta_mean, {r6('baseline_pr')} AS baseline_pr,
       {r6('candidate_pr')} AS candidate_pr, {r6('delta_pr')} AS delta_pr,
       {_trend('delta_mean')} AS trend_mean, {_trend('delta_pr')} AS trend_pr,
       CASE WHEN delta_mean > 0 THEN 'up' ELSE 'down' END AS delta_sign
FROM cmp"""

Q["artifact_compare"] = Q["compare_runs"]

Q["compare_melted"] = _COMPARE + f"""
SELECT field, 'baseline' AS model, {r6('baseline_mean')} AS mean_score FROM cmp WHERE field <> 'overall'
UNION ALL
SELECT field, 'candidate' AS model, {r6('candidate_mean')} AS mean_score FROM cmp WHERE field <> 'overall'"""

_TARGETS = " UNION ALL ".join(
    f"SELECT {lit(g)} AS gate, {lit(f)} AS field, {lit(m)} AS measure, {lit(o)} AS op, "
    f"CAST({b!r} AS DOUBLE) AS bound" for g, f, m, o, b in DEFAULT_TARGETS)

Q["gates"] = _with_scored(
    f"targets AS ({_TARGETS}), "
    + "runm AS (SELECT run, avg(CAST(passed AS DOUBLE)) AS pass_rate, avg(overall_score) AS mean_score, "
    f"avg(CAST(latency_ms < {LATENCY_BOUND_MS!r} AS DOUBLE)) AS share_latency_below_bound, "
    "CAST(max(total_tokens) AS DOUBLE) AS max_tokens FROM scored GROUP BY run), "
    "measures AS ("
    "SELECT run, '*' AS field, 'pass_rate' AS measure, pass_rate AS value FROM runm UNION ALL "
    "SELECT run, '*', 'mean_score', mean_score FROM runm UNION ALL "
    "SELECT run, '*', 'share_latency_below_bound', share_latency_below_bound FROM runm UNION ALL "
    "SELECT run, '*', 'max_tokens', max_tokens FROM runm UNION ALL "
    "SELECT run, field, 'mean_all', avg(score) FROM long GROUP BY run, field UNION ALL "
    "SELECT run, field, 'mean', avg(score) FROM long GROUP BY run, field)") + f"""
SELECT r.run, t.gate, t.field, t.measure, t.op, {r6('t.bound')} AS bound, {r6('m.value')} AS value,
       coalesce(CASE t.op WHEN '>=' THEN m.value >= t.bound WHEN '>' THEN m.value > t.bound
                          WHEN '<' THEN m.value < t.bound WHEN '<=' THEN m.value <= t.bound END,
                false) AS passed
FROM (SELECT DISTINCT run FROM measures) r CROSS JOIN targets t
LEFT JOIN measures m ON m.run = r.run AND m.field = t.field AND m.measure = t.measure"""

Q["hallucinations"] = _with_scored() + """
SELECT run, example_id, 'location' AS field,
       (e_location IS NULL OR length(e_location) = 0) AND NOT (a_location IS NULL OR length(a_location) = 0) AS strict
FROM scored WHERE category = 'sparse_description' AND location_score = 0.0
UNION ALL
SELECT run, example_id, 'skills' AS field,
       (e_skills IS NULL OR len(e_skills) = 0) AND NOT (a_skills IS NULL OR len(a_skills) = 0) AS strict
FROM scored WHERE category = 'sparse_description' AND skills_score = 0.0"""


def _in(c, values):
    return f"{c} IN ({', '.join(lit(v) for v in values)})"


Q["validate_golden"] = _ctes(
    "planted AS (SELECT 'row_' || CAST(k AS VARCHAR) AS row_key, "
    "CASE WHEN k % 89 <> 0 THEN id END AS id, CASE WHEN k % 79 <> 0 THEN category END AS category, "
    "k % 83 = 0 AS no_title, "
    "CASE WHEN k % 73 = 0 THEN NULL ELSE e_skills END AS skills, "
    "(k % 73 = 0) AS skills_null, "
    "CASE WHEN k % 73 <> 0 AND k % 71 = 0 THEN 'Remote' ELSE e_work_mode END AS work_mode, "
    "CASE WHEN k % 73 <> 0 AND k % 71 <> 0 AND k % 97 = 0 THEN 'boss' ELSE e_seniority END AS seniority "
    "FROM fx_golden)") + f"""
SELECT row_key, 'missing id' AS violation FROM planted WHERE id IS NULL
UNION ALL SELECT row_key, 'missing category' FROM planted WHERE category IS NULL
UNION ALL SELECT row_key, 'seniority not in domain' FROM planted
  WHERE seniority IS NOT NULL AND NOT {_in('seniority', FIXTURE_DOMAINS['seniority'])}
UNION ALL SELECT row_key, 'work_mode not in domain' FROM planted
  WHERE work_mode IS NOT NULL AND NOT {_in('work_mode', FIXTURE_DOMAINS['work_mode'])}
UNION ALL SELECT row_key, 'input lacks raw_title' FROM planted WHERE no_title
UNION ALL SELECT row_key, 'skills is null' FROM planted WHERE skills_null"""

Q["artifact_roundtrip"] = _with_scored() + f"""
SELECT run, field, CAST(count(score) AS BIGINT) AS n, {r6('avg(score)')} AS mean_score,
       {r6('avg(CAST(score >= 0.5 AS DOUBLE))')} AS pass_rate FROM long GROUP BY run, field
UNION ALL
SELECT run, 'overall', CAST(count(*) AS BIGINT), {r6('avg(overall_score)')},
       {r6('avg(CAST(passed AS DOUBLE))')} FROM scored GROUP BY run"""

Q["artifact_versions"] = Q["compare_runs"]

Q["artifact_retry"] = _ctes() + """
SELECT run, CAST(count(*) AS BIGINT) AS n_examples, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(1 AS BIGINT) AS n_left FROM paired GROUP BY run"""

Q["artifact_documents"] = _with_scored() + f"""
SELECT 'model' AS kind, run AS name, CAST(count(*) AS BIGINT) AS n,
       {r6('CAST(sum(total_tokens) AS DOUBLE)')} AS total FROM scored GROUP BY run
UNION ALL
SELECT 'field', field, CAST(count(*) AS BIGINT), {r6('sum(score)')} FROM long GROUP BY field"""

Q["stored_quantiles"] = _with_scored(
    "vals AS (SELECT field, 'score' AS measure, score AS value FROM long UNION ALL "
    "SELECT '*', 'overall_score', overall_score FROM scored UNION ALL "
    "SELECT '*', 'latency_ms', latency_ms FROM scored UNION ALL "
    "SELECT '*', 'total_tokens', CAST(total_tokens AS DOUBLE) FROM scored)") + f"""
SELECT field, measure, CAST(count(*) AS BIGINT) AS n, {r6('min(value)')} AS min_value,
       {r6('max(value)')} AS max_value, CAST(4 AS BIGINT) AS n_near
FROM vals WHERE value IS NOT NULL GROUP BY field, measure"""

Q["artifact_bad_types"] = _ctes() + """
SELECT run, CASE k % 50 WHEN 0 THEN 'overall_score is absent or of a wrong type'
       WHEN 1 THEN 'passed is absent or of a wrong type'
       WHEN 2 THEN 'field_results lack a required field' ELSE 'malformed JSON' END AS fault,
       CAST(count(*) AS BIGINT) AS n FROM paired WHERE k % 50 < 4 GROUP BY ALL"""

Q["pair_missing_null"] = _ctes() + f"""
SELECT run, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (k % 7 = 0) AS BIGINT) AS n_missing,
       {r6('avg(CASE WHEN k % 7 = 0 THEN 0.0 ELSE latency_ms END)')} AS mean_latency_ms,
       CAST(coalesce(sum(total_tokens) FILTER (k % 7 <> 0), 0) AS BIGINT) AS total_tokens
FROM paired GROUP BY run"""

Q["predict_errors"] = _ctes(
    "planted AS (SELECT run, k, CASE WHEN k % 37 = 0 THEN 'BOSS' ELSE a_seniority END AS s, "
    "CASE WHEN k % 37 = 0 OR k % 41 = 0 THEN 'Z' ELSE a_work_mode END AS w FROM paired), "
    "flagged AS (SELECT run, CASE WHEN k % 31 = 0 THEN 'missing job_info' ELSE concat_ws('; ', "
    "CASE WHEN s NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') "
    "THEN 'seniority not in domain' END, "
    "CASE WHEN w NOT IN ('F', 'O', 'P') THEN 'work_mode not in domain' END) END AS answer_error "
    "FROM planted)") + """
SELECT run, answer_error, CAST(count(*) AS BIGINT) AS n FROM flagged
WHERE answer_error <> '' GROUP BY run, answer_error"""

Q["latency_p95"] = _ctes(
    "ranked AS (SELECT run, latency_ms, row_number() OVER (PARTITION BY run ORDER BY latency_ms) AS r, "
    "count(*) OVER (PARTITION BY run) AS n FROM paired)") + f"""
SELECT run, CAST(n AS BIGINT) AS n, {r6('latency_ms')} AS p95_latency_ms FROM ranked
WHERE r = (n * 95 + 99) // 100"""

Q["golden_jsonl_roundtrip"] = _ctes() + """
SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(e_skills)) AS BIGINT) AS n_skills,
       CAST(count(e_location) AS BIGINT) AS n_location FROM fx_golden GROUP BY category"""

_PROMPT = "('Title: ' || concat_ws(' ', source, lang) || chr(10) || chr(10) || 'Description:' || chr(10) || text)"
_SKILL_LIST = "[" + ", ".join(lit(s) for s in STUB_SKILLS) + "]"
Q["predict_stub"] = f"""
SELECT 'stub' AS run, 'doc_' || CAST(doc_id AS VARCHAR) AS example_id,
       concat_ws(' ', source, lang) AS title,
       CASE WHEN contains(lower(text), 'senior') THEN 'senior'
            WHEN contains(lower(text), 'junior') THEN 'junior' END AS seniority,
       CASE WHEN contains(lower(text), 'remote') THEN 'remote' END AS work_mode,
       CAST(NULL AS VARCHAR) AS location,
       CAST(len(list_filter({_SKILL_LIST}, lambda s: contains(lower(text), s))) AS BIGINT) AS n_skills,
       {r6(f'length({_PROMPT}) * 0.01')} AS latency_ms,
       CAST(ceil(length({_PROMPT}) / 4.0) AS BIGINT) AS total_tokens
FROM documents"""

Q["predict_resume"] = f"""
SELECT 'stub' AS run, count(*) AS n,
       CAST(sum(CAST(ceil(length({_PROMPT}) / 4.0) AS BIGINT)) AS BIGINT) AS total_tokens,
       CAST(sum(len(list_filter({_SKILL_LIST}, lambda s: contains(lower(text), s)))) AS BIGINT) AS n_skills,
       count(DISTINCT doc_id) FILTER (doc_id % 2 = 0) AS n_before,
       count(DISTINCT doc_id) FILTER (doc_id % 2 <> 0) AS n_asked
FROM documents"""

Q["label_eval"] = f"""
WITH s AS (
  SELECT d.source, CASE WHEN lower(CAST(l.quality AS VARCHAR)) = (CASE WHEN d.n_chars >= 500 THEN '1' ELSE '0' END)
                        THEN 1.0 ELSE 0.0 END AS quality,
         CASE WHEN l.toxic IS NULL THEN 0.0 WHEN CAST(l.toxic AS VARCHAR) = '0' THEN 1.0 ELSE 0.0 END AS toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
long AS (SELECT source, 'quality' AS field, CAST(quality AS DOUBLE) AS score FROM s
         UNION ALL SELECT source, 'toxic', CAST(toxic AS DOUBLE) FROM s)
SELECT source, field, CAST(count(score) AS BIGINT) AS n, {r6('avg(score)')} AS mean_score,
       {r6('avg(CAST(score >= 0.5 AS DOUBLE))')} AS pass_rate FROM long GROUP BY source, field"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)
