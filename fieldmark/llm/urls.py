"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest, in
DataFrame functions and Spark's own trees alone."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import save
from fieldmark.operators.joins import fits_broadcast

#: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"),
         ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host words whose URLs count as labelled "block" when no rule fits.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
LEXICAL = ("n_chars", "host_chars", "depth", "digit_ratio", "entropy", "n_parameters",
           "host_labels", "host_hyphens", "fragment", "secure")
#: Most labelled URLs the trees learn from, about (by a hash of page_id and URL).
MAX_LABELLED = 20_000
STATS = ("suffix", "ending", "section")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.  A rule fits its host and
    all subdomains if the path starts with its path."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(
            path, F.lit(start))
        rule = F.when(fits, own + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def part(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                       lambda acc, c: acc + F.when(c == "", 0.0).otherwise(part(c)))


def _keys() -> dict[str, Column]:
    return {"suffix": F.substring_index("host", ".", -2),
            "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1),
            "section": F.regexp_extract("path", r"^/([^/]*)", 1)}


def statistic_keys(pages: DataFrame) -> DataFrame:
    """``pages(host, path)`` with the columns whose blocked shares are features."""
    return pages.withColumns(_keys())


def features(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, host, path)`` with the lexical features and the suffixes whose
    statistics are joined later."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    digits = n - F.length(F.regexp_replace(url, "[0-9]", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return pages.withColumns({
        "n_chars": n.cast("double"), "host_chars": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "entropy": entropy(url),
        "n_parameters": F.when(query == "", 0.0).otherwise(
            F.size(F.split(query, "&")).cast("double")),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "host_hyphens": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"),
                                                               F.lit("")))).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
    } | _keys())


def labelled(pages: DataFrame, rules=RULES, words=BLOCKED_WORDS) -> DataFrame:
    """``pages(url, host, path)`` that have a label, with it: the rule's verdict, or block
    for a host with a blocked word."""
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    word = F.col("host").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")
    label = F.when(verdict.isNotNull(), (verdict == "block").cast("double")) \
        .when(word, F.lit(1.0))
    return pages.withColumn("label", label).where("label is not null")


class UrlModel:
    """Trees over the lexical features and the statistics of host suffix, file ending and
    first path section: share of labelled URLs that are blocked (smoothed)."""

    def __init__(self, labelled_urls: DataFrame, max_labelled: int = MAX_LABELLED,
                 iterations: int = 10, depth: int = 4):
        """``labelled_urls(page_id, url, host, path, label)``: the statistics count all of
        them; the trees learn from about ``max_labelled``, taken for each label by a hash of
        page_id and URL.  A rarer label keeps its rows up to half of that number; weights
        bring the labels back to their shares."""
        counts = {r["label"]: r["n"] for r in labelled_urls.groupBy("label").agg(
            F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        self.share = counts.get(1.0, 0) / total if total else 0.0
        self.trees, self.stats, self.frequent = None, {}, {}
        if self.share in (0.0, 1.0):
            return  # nothing to tell apart
        keys = statistic_keys(labelled_urls)
        for key in STATS:
            stat = save(keys.groupBy(key).agg(
                F.count("*").alias("n"),
                ((F.sum("label") + 10 * self.share) / (F.count("*") + 10))
                .alias(f"{key}_blocked")), f"url_{key}")
            self.stats[key] = stat.drop("n")
            if not fits_broadcast(self.stats[key]):
                # frequent keys, at most 1000, go by broadcast so that none is hot in the shuffle
                self.frequent[key] = stat.where((F.col("n") > total / 1000)
                                                & (F.length(key) <= 1000)).drop("n")
        rarer = min(min(counts.values()), max_labelled // 2)
        part = {label: min(1.0, (rarer if n == min(counts.values()) else max_labelled - rarer) / n)
                for label, n in counts.items()}
        taken = F.when(F.col("label") == 1.0, part[1.0]).otherwise(part[0.0])
        unit = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) / float(1 << 20)
        rows = features(labelled_urls.where(unit < taken).withColumn("weight", 1.0 / taken))
        data = save(self._vectors(rows).select("features", "label", "weight"), "url_sample")
        self.trees = GBTClassifier(maxIter=iterations, maxDepth=depth, seed=7, maxBins=32,
                                   weightCol="weight").fit(data)

    def _vectors(self, rows: DataFrame) -> DataFrame:
        for key, stat in self.stats.items():
            if key in self.frequent:
                top = self.frequent[key].withColumnRenamed(f"{key}_blocked", "_top")
                rows = rows.join(F.broadcast(top), key, "left")
                # settled rows look for no statistic and are spread in the shuffle
                rows = rows.withColumn("_spread", F.when(F.col("_top").isNotNull(), F.xxhash64(
                    "page_id", "url")).otherwise(F.lit(0))).withColumn("_key", F.when(
                        F.col("_top").isNull(), F.col(key)).otherwise(F.lit("")))
                rows = rows.join(stat.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias(
                    "_spread"), f"{key}_blocked"), ["_key", "_spread"], "left").withColumn(
                        f"{key}_blocked", F.coalesce("_top", f"{key}_blocked")) \
                    .drop("_top", "_spread", "_key")
            else:
                rows = rows.join(F.broadcast(stat), key, "left")
            rows = rows.fillna({f"{key}_blocked": self.share})
        return VectorAssembler(inputCols=[*LEXICAL, *[f"{k}_blocked" for k in self.stats]],
                               outputCol="features").transform(rows)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows(page_id, url, host, path)`` with ``blocked``, the probability of block."""
        if self.trees is None:
            return rows.withColumn("blocked", F.lit(self.share))
        own = rows.columns
        found = self.trees.transform(self._vectors(features(rows)))
        return found.select(*own, vector_to_array("probability")[1].alias("blocked"))


def judge(pages: DataFrame, rules=RULES, words=BLOCKED_WORDS,
          max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked), one row per row of
    ``pages(page_id, url)``.

    A null url counts as empty: no rule fits, the trees decide.  The verdict is the longest
    rule's, else block where the trees' probability is over one half.  Without labelled
    URLs of both kinds the trees stay out, and the only kind there is (allow if none)
    decides.  Repeated rows are judged each; an empty table gives an empty result."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    model = UrlModel(labelled(rows, rules, words), max_labelled)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return model.score(rows).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("blocked") > 0.5, "block").otherwise("allow"))
        .alias("verdict"), "blocked")
