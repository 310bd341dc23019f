"""Session helpers: a local session for tests and benches, and the shared folder
every materialised intermediate (checkpoints, verdict cache, run artifacts) lives in."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job of the engine relies on.  AQE re-plans joins from real
# shuffle sizes and splits skewed join partitions; speculation stays off because
# a speculative copy of a model-calling task would pay for the call twice.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.speculation": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fieldmark") -> SparkSession:
    """A local session configured like the cluster one, for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fieldmark`` importable in the Python workers (UDFs and
    ``mapInPandas`` functions are pickled by module reference).

    Zips the package once per application and adds it with ``addPyFile``;
    Spark sends it to every executor and puts it on the workers' path.  A
    cluster that installs the package on its executors needs none of this."""
    import zipfile

    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect: no SparkContext on the client
        app = f"connect-{spark.session_id}" if hasattr(spark, "session_id") else "connect"
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="fieldmark-pkg-"), "fieldmark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    try:
        spark.sparkContext.addPyFile(target)
    except Exception:  # Spark Connect ships Python files as session artifacts
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``).

    Raises when none is configured: a machine-local folder is not safe on a
    cluster, so the library never invents one by itself."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the session conf is visible
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if d:
        return d.rstrip("/")
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if sc is None:
            return d.rstrip("/")
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir().rstrip("/")
    raise RuntimeError(
        "no checkpoint folder: set spark.checkpoint.dir to a folder shared by all executors")


def local_master(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    try:
        master = spark.sparkContext.master
    except Exception:  # Spark Connect: the client does not see the master
        return False
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Like :func:`checkpoint_dir`, but sets a scratch folder when none is set.

    Only for local masters (tests, bench, smoke checks); a cluster names its own folder,
    and without one this raises."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        if not local_master(spark):
            raise
        d = tempfile.mkdtemp(prefix="fieldmark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # a static conf on some deployments; the context still takes it
            pass
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:
            pass
        return checkpoint_dir(spark)


_MADE: ContextVar[list[str] | None] = ContextVar("scratch_folders", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    import uuid

    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The list of scratch folders asked for inside the block (the innermost block's)."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def free_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders.  A Spark Connect client has no file system: there they stay."""
    try:
        sc = spark.sparkContext
    except Exception:
        return
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
