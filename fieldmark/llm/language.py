"""Language identification with interpolated Kneser-Ney character models.

One model per language over 5-grams of normalised text (lower case; every run of
characters that are not letters is one space).  The counts come from a Spark aggregation
over the training sample; the interpolated log-probabilities of all seen n-grams are kept
in sorted hash arrays, one row per n-gram with a column per language, and unseen n-grams
back off through the context weights of the shorter orders.  A text gets the language of
the lowest cross-entropy per character; it is rejected when that lies too far above what
the language's calibration texts have."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.words import freeing, parts

ORDER = 5
#: Characters whose n-grams are looked up at once; a longer text is a block of its own.
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"
#: The 70th and 90th percentile of the standard normal distribution.
_Z70, _Z90 = 0.5244, 1.2816
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> code point of the lower-case letter, 32 for all else."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x32000):
            ch = chr(cp)
            if ch.isalpha():
                table[cp] = ord(ch.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def normalise(text: str) -> np.ndarray:
    """Code points of the normalised text with one space at each end; empty if it has no
    letter."""
    cps = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cps = np.concatenate(([np.uint32(32)], cps, [np.uint32(32)]))
    cps = cps[np.concatenate(([True], (cps[1:] != 32) | (cps[:-1] != 32)))]
    return cps if len(cps) > 1 else cps[:0]


def hashes(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, one per row of code points."""
    h = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1]):
        h = (h + grams[:, i].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the sorted ``keys``, found) of each hash."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Sorted hash arrays: per order 1..ORDER the n-grams' log2 probabilities and the
    contexts' log2 interpolation weights, a column per language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    weights: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray | None = None  # per language: a character never seen
    limit: dict[str, tuple[float, float]] = field(default_factory=dict)

    def log2(self, windows: np.ndarray) -> np.ndarray:
        """log2 p(last | others) of n-grams (rows of code points), a column per language."""
        size = windows.shape[1]
        keys, values = self.grams[size - 1]
        at, found = lookup(keys, hashes(windows))
        out = values[at] if len(values) else np.zeros((len(at), len(self.languages)), np.float32)
        if not found.all():
            miss = np.flatnonzero(~found)
            lower = self.log2(windows[miss][:, 1:]) if size > 1 else \
                np.broadcast_to(self.floor, (len(miss), len(self.languages)))
            out[miss] = lower + self._weight(windows[miss][:, :-1])
        return out

    def _weight(self, contexts: np.ndarray) -> np.ndarray:
        keys, values = self.weights[contexts.shape[1]]
        at, found = lookup(keys, hashes(contexts))
        out = np.zeros((len(contexts), len(self.languages)), np.float32)
        if len(keys):
            out[found] = values[at[found]]
        return out

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits per character of each normalised text under each language."""
        out = np.full((len(texts), len(self.languages)), np.inf)
        full = [i for i, t in enumerate(texts) if len(t) >= ORDER]
        block, chars = [], 0
        for j, i in enumerate(full):
            block.append(i)
            chars += len(texts[i])
            if chars > BLOCK_CHARS or j == len(full) - 1:
                self._block(texts, block, out)
                block, chars = [], 0
        for i, t in enumerate(texts):
            if 0 < len(t) < ORDER:
                out[i] = -self.log2(t[None, :])[0]  # no whole n-gram: its last character
        return out

    def _block(self, texts: list[np.ndarray], block: list[int], out: np.ndarray) -> None:
        joined = np.concatenate([texts[i] for i in block])
        lengths = np.array([len(texts[i]) for i in block])
        ends = np.cumsum(lengths)
        scores = self.log2(np.lib.stride_tricks.sliding_window_view(joined, ORDER))
        # grams that reach into the next text belong to none
        at = np.arange(len(scores))
        own = np.repeat(ends, lengths)[:len(scores)] - at >= ORDER
        owner = np.repeat(np.arange(len(block)), lengths)[:len(scores)]
        for k in range(len(self.languages)):
            total = np.bincount(owner[own], scores[own, k], len(block))
            out[block, k] = -total / (lengths - ORDER + 1)


def _interpolate(languages: list[str], counts: pd.DataFrame) -> Model:
    """The model of 5-gram counts (lang, gram, n), by interpolated Kneser-Ney."""
    n_lang = len(languages)
    column = {lang: k for k, lang in enumerate(languages)}
    per_order: list[dict[int, pd.Series]] = [{} for _ in range(ORDER + 1)]
    for lang, rows in counts.groupby("lang"):
        k = column[lang]
        per_order[ORDER][k] = rows.groupby("gram")["n"].sum()
        for size in range(ORDER - 1, 0, -1):
            # continuation counts: the distinct characters that come before the n-gram
            grams = pd.Series(per_order[size + 1][k].index).str[1:]
            per_order[size][k] = grams.value_counts()
    vocabulary = 1 + max((len(per_order[1][k]) for k in per_order[1]), default=1)

    model = Model(languages)
    model.floor = np.full(n_lang, -np.log2(vocabulary), np.float32)
    below: list[dict[str, float]] = [_Uniform(1 / vocabulary) for _ in range(n_lang)]
    for size in range(1, ORDER + 1):
        probs, weights = [{} for _ in range(n_lang)], [{} for _ in range(n_lang)]
        for k, series in per_order[size].items():
            c = series.to_numpy(float)
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            frame = pd.DataFrame({"g": series.index, "c": c})
            frame["ctx"] = frame["g"].str[:-1]
            by = frame.groupby("ctx")["c"].agg(["sum", "size"])
            weight = discount * by["size"] / by["sum"]
            weights[k] = weight.to_dict()
            total, w = frame["ctx"].map(by["sum"]), frame["ctx"].map(weight)
            lower = frame["g"].str[1:].map(below[k])
            frame["p"] = (frame["c"] - discount) / total + w * lower
            probs[k] = dict(zip(frame["g"], frame["p"]))
        seen = sorted(set().union(*probs))
        table = np.zeros((len(seen), n_lang))
        for k in range(n_lang):
            for i, g in enumerate(seen):
                p = probs[k].get(g)
                if p is None:  # unseen in this language: weight of its context, lower order
                    p = weights[k].get(g[:-1], 1.0) * below[k][g[1:]]
                table[i, k] = p
        model.grams.append(_sorted(seen, np.log2(table).astype(np.float32), size))
        contexts = sorted(set().union(*weights))
        ctx = np.array([[np.log2(weights[k].get(g, 1.0)) for k in range(n_lang)]
                        for g in contexts], np.float32).reshape(len(contexts), n_lang)
        model.weights.append(_sorted(contexts, ctx, size - 1))
        below = [_Lower(probs[k], weights[k], below[k]) for k in range(n_lang)]
    return model


class _Uniform(dict):
    def __init__(self, value: float):
        super().__init__()
        self.value = value

    def __missing__(self, gram: str) -> float:
        return self.value


class _Lower(dict):
    """Probabilities of one order and language; a missing n-gram backs off."""

    def __init__(self, probs: dict, weights: dict, below: dict):
        super().__init__(probs)
        self.weights, self.below = weights, below

    def __missing__(self, gram: str) -> float:
        return self.weights.get(gram[:-1], 1.0) * self.below[gram[1:]]


def _sorted(grams: list[str], values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by the hashes of ``grams`` in ascending order."""
    cps = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
    keys = hashes(cps.reshape(len(grams), size))
    order = np.argsort(keys)
    return keys[order], values[order]


def train(labelled: DataFrame, max_docs: int = 400, deviations: float = 8.0) -> Model | None:
    """The model of ``labelled(doc_id, text, lang)``; null if it has no labelled letter.

    At most about ``max_docs`` distinct texts of each language are used (a text is in when
    its hash is below the share that gives that number), whole texts each, so the model
    is bounded however large the table.  Of texts that differ in case or in what is no
    letter, one is used.  A fifth of them calibrates: the limit of a language lies as far
    above the 90th percentile of their cross-entropies as ``deviations`` standard deviations
    lie above the mean in a normal distribution.  The deviation comes from the 70th and
    90th percentile: near copies of training texts score low, and neither they nor a few
    odd texts move these."""
    rows = labelled.where("text is not null and lang is not null") \
        .select("text", F.col("lang").cast("string"), F.xxhash64("text").alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.countDistinct("key").alias("n")).collect()}
    if not sizes:
        return None
    unit = F.pmod(F.xxhash64("key", F.lit("s")), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items())
                                        for x in (lang, min(1.0, max_docs / n))]), F.col("lang"))
    letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    # of equal texts the least, so that the sample is the same each time it is read
    sample = rows.where(unit < share).groupBy("lang", F.xxhash64(letters).alias("key")) \
        .agg(F.min("text").alias("text")).withColumn(
            "calibrates", F.pmod(F.xxhash64("key", F.lit("c")), F.lit(5)) == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                found: Counter[str] = Counter()
                for text in part["text"]:
                    cps = normalise(text)
                    s = cps.tobytes().decode("utf-32-le")
                    found.update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})

    def counted(part: DataFrame) -> pd.DataFrame:
        return part.select("lang", "text").mapInPandas(count, "lang string, gram string, n long") \
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()

    counts = counted(sample.where("not calibrates"))
    missing = sorted(set(sizes) - set(counts["lang"]))
    if missing:  # too few rows to hold some back
        counts = pd.concat([counts, counted(sample.where(F.col("lang").isin(missing)))])
    if counts.empty:
        return None
    model = _interpolate(sorted(counts["lang"].unique()), counts)
    held = score(sample.where("calibrates"), model, keep=("lang",))
    for r in held.where("bits is not null and lang = lang_pred").groupBy("lang").agg(
            F.percentile("bits", F.array(F.lit(0.7), F.lit(0.9))).alias("q")).collect():
        sd = max((r["q"][1] - r["q"][0]) / (_Z90 - _Z70), 0.05)
        model.limit[r["lang"]] = (r["q"][1] + (deviations - _Z90) * sd, deviations)
    return model


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",),
          text_col: str = "text") -> DataFrame:
    """``keep`` columns with (lang_pred, score, bits, n_letters, rejected), a row per row.

    ``lang_pred`` is the language of the lowest cross-entropy (of equal ones the first by
    name), ``und`` for a text that is null or has no letter (and for all without a model);
    ``score`` compares its probability over at most 64 characters with the others'.
    ``rejected`` marks ``und`` and texts above their language's calibrated limit, which
    leaves more room to short texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [
        "lang_pred string, score double, bits double, n_letters long, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        for batch in (p for b in batches for p in parts(b, text_col)):
            cps = [normalise(x.as_py() or "") for x in batch.column(text_col)]
            letters = [int((c != 32).sum()) for c in cps]
            lang, prob, bits, out = [], [], [], []
            every = m.cross_entropies(cps) if m else None
            for i, n in enumerate(letters):
                if not n or m is None:
                    lang.append(UNKNOWN), prob.append(0.0), bits.append(None), out.append(True)
                    continue
                best = int(every[i].argmin())
                gap = every[i] - every[i][best]
                lang.append(m.languages[best])
                prob.append(float(1 / np.exp2(-gap * min(n, 64)).sum()))
                bits.append(float(every[i][best]))
                top, slack = m.limit.get(lang[-1], (np.inf, 0.0))
                out.append(bool(bits[-1] > top + slack / np.sqrt(n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [
                    pa.array(lang, pa.string()), pa.array(prob, pa.float64()),
                    pa.array(bits, pa.float64()), pa.array(letters, pa.int64()),
                    pa.array(out, pa.bool_())],
                [f.name for f in fields] + ["lang_pred", "score", "bits", "n_letters", "rejected"])

    return docs.select(*dict.fromkeys((*keep, text_col))).mapInArrow(freeing(run), schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def identify(docs: DataFrame, max_docs: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, n_letters, rejected) of every row of
    ``docs(doc_id, text, lang)``.

    The model learns from rows whose :func:`fold` is not 1 and whose lang is not null.
    Repeated rows are predicted each, an empty table gives an empty result; without any
    labelled row everything is ``und``."""
    model = train(docs.where(fold(F.col("doc_id")) != 1), max_docs)
    return score(docs, model).withColumn("held_out", F.coalesce(
        fold(F.col("doc_id")) == 1, F.lit(False)))
