"""Packed runs of numbers that tasks send each other, and how many slices they are dealt
into: byte planes of the values (of their gaps, where they ascend), compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Non-negative integers as compressed byte planes."""
    values = values.astype("<u8")
    if ascending:
        values = np.diff(values, prepend=np.uint64(0))
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd",
                       asbytes=True)


def unpack(packed, n: int, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view("<u8")[:, 0]
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def slices_for(texts: DataFrame, column: str = "text", share: int = 1 << 24) -> int:
    """How many slices the words of a text column are dealt into: one for ``share`` bytes,
    so that what meets in one slice stays bounded as the table grows."""
    n = texts.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"]
    return max(1, -(-(n or 0) // share))
