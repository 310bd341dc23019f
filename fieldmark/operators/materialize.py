"""Cutting lineage: reliable checkpoints and written tables in the cluster's
shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldmark.session import checkpoint_dir, scratch_path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back.

    Later stages read the written files instead of recomputing the lineage: a
    lost executor costs a re-read, not a re-run of joins or model calls, and a
    job that needs two columns of a wide intermediate reads only those two
    (columnar pruning).  Never a local checkpoint: those die with the
    executor."""
    spark = df.sparkSession
    checkpoint_dir(spark)  # raises when no shared folder is configured
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
