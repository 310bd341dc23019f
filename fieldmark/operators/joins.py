"""Join helpers: a broadcast that is only taken behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default bounds of a broadcast side: rows, and characters of its string
# columns (a row count alone is no size bound when rows carry free text).
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_CHARS = 64_000_000


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_chars: int = DEFAULT_BROADCAST_CHARS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows whose string columns hold
    at most ``max_chars`` characters in all: one partial aggregation, a row a task."""
    from pyspark.sql import types as T

    text = [F.coalesce(F.length(F.col(f.name)), F.lit(0)) for f in df.schema.fields
            if isinstance(f.dataType, T.StringType)]
    chars = sum(text[1:], text[0]) if text else F.lit(0)
    r = df.agg(F.count("*").alias("n"), F.sum(chars).alias("c")).first()
    return r["n"] <= max_rows and (r["c"] or 0) <= max_chars


def join_small_side(big: DataFrame, small: DataFrame, on: Column | str | list[str],
                    how: str = "inner", max_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_chars: int = DEFAULT_BROADCAST_CHARS) -> DataFrame:
    """Join with ``small`` broadcast when its size is proven below the bounds
    (rows and characters); otherwise a shuffle join (AQE may still turn it into
    a broadcast from the measured size, and splits skewed partitions of the
    big side)."""
    if fits_broadcast(small, max_rows, max_chars):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
