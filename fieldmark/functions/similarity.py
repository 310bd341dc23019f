"""String similarity measures.

``indel_similarity`` is ``2 * LCS(a, b) / (len(a) + len(b))`` (1.0 when both are
empty): insert/delete distance normalised by total length.  Spark has no LCS
built-in, so it runs as an Arrow-batched pandas UDF whose per-pair body is the
bit-parallel LCS of Allison & Dix / Crochemore et al. (2001) / Hyyrö (2004):
one pass over the shorter string with a few big-integer operations per
character, O(len(a) * len(b) / 64) word operations in all.  Near copies do not get
that far: common ends are taken off, and strings few edits apart are measured by
their edits.  Everything else here (Levenshtein variant, token-set variant, the bag
bound) is native Column code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.text import PY_WHITESPACE_CLASS, as_col


#: Edits are counted up to this share of the strings' (geometric mean) length; beyond it the
#: kernel costs less.
EDITS_SHARE = 256

#: Strings with fewer characters together go to the kernel as they are.
SHORT = 64

#: Characters that the bag bound counts one by one (lower-cased text); all others count as one.
BAG_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _match_masks(a: str) -> dict[str, int]:
    """Bit i of masks[ch] is set where a[i] == ch."""
    if len(a) <= 256:
        masks: dict[str, int] = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        return masks
    codes = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32)
    masks = {}
    for code in np.unique(codes):
        bits = np.packbits(codes == code, bitorder="little")
        masks[chr(int(code))] = int.from_bytes(bits.tobytes(), "little")
    return masks


def _equal_run(a: str, b: str, x: int, y: int) -> int:
    """How many characters of ``a`` from ``x`` equal those of ``b`` from ``y``: slices of doubling,
    then halving length are compared, so a run costs few steps however long it is."""
    most = min(len(a) - x, len(b) - y)
    got, step, growing = 0, 1, True
    while step:
        same = got + step <= most and a[x + got:x + got + step] == b[y + got:y + got + step]
        if same:
            got += step
        growing = growing and same
        step = step * 2 if growing else step // 2
    return got


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """Insertions and deletions between two strings, or None if there are more than ``most``.

    For each number of edits, the farthest place reached on every diagonal (Myers 1986); work
    grows with the square of the edits, hardly with the lengths."""
    if abs(len(a) - len(b)) > most:
        return None
    reached = {1: 0}
    for edits in range(most + 1):
        for diagonal in range(-edits, edits + 1, 2):
            x = max(reached.get(diagonal + 1, -1), reached.get(diagonal - 1, -1) + 1)
            x += _equal_run(a, b, x, x - diagonal)
            reached[diagonal] = x
            if x >= len(a) and x - diagonal >= len(b):
                return edits
    return None


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings (code points).

    Common ends count as they are.  Of what is left, strings a few edits apart are measured by
    their edits; only the others, and short ones, go through the bit-parallel kernel."""
    if len(a) + len(b) < SHORT:
        return _lcs_kernel(a, b)
    head = _equal_run(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _equal_run(a[::-1], b[::-1], 0, 0)
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    edits = edit_distance_within(a, b, math.isqrt(len(a) * len(b)) // EDITS_SHARE)
    if edits is None:
        return head + tail + _lcs_kernel(a, b)
    return head + tail + (len(a) + len(b) - edits) // 2


def _lcs_kernel(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks = _match_masks(a)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


@F.pandas_udf(T.LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if (x is None or y is None) else lcs_length(x, y) for x, y in zip(a, b)]
    return pd.Series(out, dtype="Int64")


def lcs(a: Column | str, b: Column | str) -> Column:
    """LCS length of two string columns; null when either is null."""
    return lcs_udf(as_col(a), as_col(b))


def bag_bound(a: Column | str, b: Column | str) -> Column:
    """An upper bound of the LCS length: what two strings share as bags of characters (those
    outside BAG_CHARACTERS as one).  All JVM."""
    def counts(s: Column) -> list[Column]:
        return [F.length(s) - F.length(F.translate(s, c, "")) for c in BAG_CHARACTERS] + [
            F.length(F.translate(s, BAG_CHARACTERS, ""))]

    shared = [F.least(x, y) for x, y in zip(counts(as_col(a)), counts(as_col(b)))]
    total = shared[0]
    for n in shared[1:]:
        total = total + n
    return total


def indel_similarity(a: Column | str, b: Column | str) -> Column:
    """2*LCS/(|a|+|b|) in one division; 1.0 for two empty strings, null for nulls."""
    a, b = as_col(a), as_col(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * lcs(a, b) / total.cast("double"))


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein(a, b) / max(|a|, |b|); 1.0 for two empty strings.  All JVM."""
    a, b = as_col(a), as_col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))


def _tokens(c: Column) -> Column:
    """Python ``set(s.split())``, sorted: whitespace-separated, non-empty tokens."""
    parts = F.split(c, f"{PY_WHITESPACE_CLASS}+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: F.length(t) > 0)))


def token_set_similarity(a: Column | str, b: Column | str) -> Column:
    """Token-set ratio / 100: compare the sorted shared tokens and the two sorted
    remainders; 1.0 when one token set contains the other, 0.0 when a side has
    no token.  One LCS (remainder vs remainder); the other two candidate ratios
    follow from lengths alone because the shared part matches itself."""
    ta, tb = _tokens(as_col(a)), _tokens(as_col(b))
    sect = F.array_intersect(ta, tb)
    ab = F.array_join(F.array_except(ta, tb), " ")
    ba = F.array_join(F.array_except(tb, ta), " ")
    sect_len = F.length(F.array_join(sect, " "))
    ab_len, ba_len = F.length(ab), F.length(ba)
    has_sect = (F.size(sect) > 0).cast("int")
    sect_ab_len = sect_len + has_sect + ab_len
    sect_ba_len = sect_len + has_sect + ba_len
    lensum = (sect_ab_len + sect_ba_len).cast("double")
    dist = (ab_len + ba_len - F.lit(2) * lcs(ab, ba)).cast("double")
    rest = F.when(lensum == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dist / lensum)
    ab_ratio = F.lit(1.0) - (has_sect + ab_len).cast("double") / (sect_len + sect_ab_len).cast("double")
    ba_ratio = F.lit(1.0) - (has_sect + ba_len).cast("double") / (sect_len + sect_ba_len).cast("double")
    with_sect = F.greatest(rest, ab_ratio, ba_ratio)
    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
        .when((F.size(sect) > 0) & ((F.size(ta) == F.size(sect)) | (F.size(tb) == F.size(sect))), F.lit(1.0))
        .when(F.size(sect) == 0, rest)
        .otherwise(with_sect)
    )
