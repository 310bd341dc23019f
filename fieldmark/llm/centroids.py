"""Clustering of vectors around moving centroids, with bounds that rule most distance
computations out, in exact integer arithmetic.

Every vector carries an upper bound of the distance to its centroid and a lower bound of
the distance to all others, both taken at some reference round.  When centroids move, a
lower bound need not shrink by a centroid's whole drift.  The vectors of a cluster lie in
a ball around its reference centroid.  For a centroid that moved from b to b', with m in
the middle and D the drift, a point x comes nearer by at most D * cos(angle at m between
x and b').  In the plane through b, b' and the ball's centre, the least such angle over
the ball is the centre's less that of the tangent from m: so the loosening is D times its
cosine, and nothing at all if the whole ball lies on b's side.  Vectors whose bounds still
leave a doubt are scanned exactly.

A round reads the written vectors, and only sums of the vectors that changed their cluster
leave the tasks.  When a round had to scan many, the next one writes bounds at a new
reference.  All decisions are proven by bounds with a margin for rounding, so results do
not depend on when that happens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import save
from fieldmark.session import free_scratch, recorded_scratch

#: Components beyond this are set to it, so that a squared distance of up to 64 of them fits
#: in 64 bits.
MOST = 1 << 27
#: Relative and absolute margin of the bounds, and of angles, for rounding.
MARGIN, ANGLE = 1e-9, 1e-6
STATE = "vec_id long, v binary, cluster int, upper double, lower double"


def integers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors with exactly ``size`` finite components, as 32-bit integers
    floor(scale * x) in bytes."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where((F.size("embedding") == size) & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = np.floor(x.astype(np.float64) * scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _binary(np.clip(x, -MOST, MOST).astype("<i4"), size)],
                ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def _binary(values: np.ndarray, size: int) -> pa.Array:
    n = len(values) // size
    return pa.Array.from_buffers(pa.binary(4 * size), n, [
        None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:][:len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]].view("<i4").reshape(-1, size).astype(np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the first of equal ones; squared distance; that to the second)."""
    d = np.stack([squared(x, c) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    best = d[np.arange(len(x)), at]
    d[np.arange(len(x)), at] = np.iinfo(np.int64).max
    return at, best, d.min(axis=1)


class Moved:
    """What became of the bounds when centroids moved from ``old`` to ``new``; ``radius``
    is that of each cluster's ball around its old centroid."""

    def __init__(self, old: np.ndarray, new: np.ndarray, radius: np.ndarray):
        a, b = old.astype(float), new.astype(float)
        k = len(a)
        drift = np.sqrt(((b - a) ** 2).sum(axis=1))
        self.new, self.drift = new, drift
        self.loosen, self.half = np.zeros(k), np.full(k, np.inf)
        for i in range(k):
            others = [j for j in range(k) if j != i]
            self.loosen[i] = max((self.nearer(a[i], radius[i], a[j], b[j]) for j in others),
                                 default=0.0)
            self.half[i] = min((np.sqrt(((b[i] - b[j]) ** 2).sum()) / 2 for j in others),
                               default=np.inf)

    @staticmethod
    def nearer(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
        """The most that a point of the ball comes nearer to a centroid that moves."""
        drift = float(np.sqrt(((new - old) ** 2).sum()))
        middle = (old + new) / 2
        away = float(np.sqrt(((centre - middle) ** 2).sum()))
        radius = radius * (1 + MARGIN) + MARGIN
        if drift == 0 or away <= radius:
            return drift
        cosine = float((centre - middle) @ (new - old)) / (away * drift)
        angle = np.arccos(np.clip(cosine, -1, 1)) - np.arcsin(radius / away) - ANGLE
        return drift * max(0.0, float(np.cos(max(angle, 0.0))))

    def settle(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, upper, lower, scanned) at the new centroids."""
        cluster, scanned = cluster.copy(), np.zeros(len(x), bool)
        upper = upper + self.drift[cluster]
        lower = lower - self.loosen[cluster]
        open_ = np.flatnonzero(~self._apart(upper, np.maximum(lower, self.half[cluster])))
        for i in np.unique(cluster[open_]):
            own = open_[cluster[open_] == i]
            upper[own] = np.sqrt(squared(x[own], self.new[i]))
        own = cluster[open_]
        open_ = open_[~self._apart(upper[open_], np.maximum(lower[open_], self.half[own]))]
        if len(open_):
            at, best, second = scan(x[open_], self.new)
            cluster[open_], scanned[open_] = at, True
            upper[open_], lower[open_] = np.sqrt(best), np.sqrt(second)
        return cluster, upper, lower, scanned

    @staticmethod
    def _apart(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return upper * (1 + MARGIN) + ANGLE < lower * (1 - MARGIN) - ANGLE


def _per_cluster(cluster: np.ndarray, x: np.ndarray, sign: int, k: int) -> np.ndarray:
    """Per cluster the sums of the vectors and their number, times ``sign``."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for i in np.unique(cluster):
        own = cluster == i
        out[i, :-1], out[i, -1] = sign * x[own].sum(axis=0), sign * own.sum()
    return out


def _totals(sums: DataFrame, k: int, size: int) -> tuple[np.ndarray, float]:
    """Exact totals (Python integers) of the tasks' ``sums(cluster, parts)``, and the
    share of scanned vectors."""
    out = np.zeros((k, size + 1), object)
    out[:] = 0
    rows = sums.select("cluster", F.posexplode("parts").alias("at", "part")) \
        .groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    scanned = seen = 0
    for r in rows:  # k * (size + 3) numbers at most
        if r["at"] <= size:
            out[r["cluster"], r["at"]] += int(r["s"])
        elif r["at"] == size + 1:
            scanned += int(r["s"])
        else:
            seen += int(r["s"])
    return out, scanned / max(1, seen)


def _sums(state: DataFrame, moved: Moved | None, k: int, size: int) -> DataFrame:
    """(cluster, parts) per task: sums and number of the vectors that ``moved`` brings into a
    cluster less those that leave it (without it: of all vectors), then scanned, seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 3), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            cluster = batch.column("cluster").to_numpy()
            total[0, size + 2] += len(x)
            if moved is None:
                total[:, :size + 1] += _per_cluster(cluster, x, 1, k)
                continue
            now, _, _, scanned = moved.settle(x, cluster, batch.column("upper").to_numpy(),
                                              batch.column("lower").to_numpy())
            gone = now != cluster
            total[:, :size + 1] += _per_cluster(now[gone], x[gone], 1, k)
            total[:, :size + 1] += _per_cluster(cluster[gone], x[gone], -1, k)
            total[0, size + 1] += scanned.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.int64()))],
            ["cluster", "parts"])

    return state.mapInArrow(run, "cluster int, parts array<long>")


def _bounds(points: DataFrame, moved: Moved | None, centroids: np.ndarray, size: int) -> DataFrame:
    """The state at ``centroids``: bounds moved on from an older state, or of a full scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            if moved is None:
                cluster, best, second = scan(x, centroids)
                upper, lower = np.sqrt(best), np.sqrt(second)
            else:
                cluster, upper, lower, _ = moved.settle(
                    x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(),
                    batch.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)),
                 pa.array(upper.astype(float)), pa.array(lower.astype(float))],
                ["vec_id", "v", "cluster", "upper", "lower"])

    return points.mapInArrow(run, STATE)


def _assigned(state: DataFrame, moved: Moved, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            cluster, _, _, _ = moved.settle(
                x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(),
                batch.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)),
                 pa.array(squared(x, moved.new[cluster]))], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64,
                    scale: int = 1024, seed: str = "3", rescan: float = 0.2,
                    trace: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per
    vector of ``vectors(vec_id, embedding)`` with exactly ``size`` components, none null or
    non-finite; other rows are left out.

    Components become floor(scale * x), at most :data:`MOST` in size.  The centroids start
    as the ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>`` (equal hashes:
    smaller bytes; rows without vec_id last).  Each round assigns every vector to the nearest
    centroid (the first of equally near ones) and moves every non-empty centroid to
    floor(sum / count) of its vectors; then all are assigned once more.  ``distance`` is
    squared.  Repeated rows count each, fewer vectors than ``k`` give as many clusters, an
    empty table gives an empty result.

    ``rescan`` is the share of scanned vectors above which bounds are written anew; it
    steers the work, not the result.  ``trace`` takes (scanned share, rewritten) per round."""
    spark = vectors.sparkSession
    points = save(integers(vectors.select(F.col("vec_id").cast("long"), "embedding"), size, scale),
                  "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(draw.asc_nulls_last(), "v").limit(k).collect()
    k = len(first)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, "
                                     "cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in first]).astype(np.int64)

    def write(source: DataFrame, moved: Moved | None):
        with recorded_scratch() as made:
            state = save(_bounds(source, moved, centroids, size), "bounds")
        totals, _ = _totals(_sums(state, None, k, size), k, size)
        radius = np.zeros(k)
        for r in state.groupBy("cluster").agg(F.max("upper").alias("r")).collect():
            radius[r["cluster"]] = r["r"]
        return state, made, totals, radius

    state, made, base, radius = write(points, None)
    reference, totals, anew = centroids, base, False
    for nth in range(rounds):
        if nth:
            moved = Moved(reference, centroids, radius)
            if anew:
                old = made
                state, made, base, radius = write(state, moved)
                reference, totals, share = centroids, base, 0.0
                free_scratch(spark, old)
            else:
                change, share = _totals(_sums(state, moved, k, size), k, size)
                totals = base + change
            if trace is not None:
                trace.append((share, anew))
            anew = not anew and share > rescan
        centroids = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else list(c)
                              for t, c in zip(totals, centroids)], np.int64)
    found = save(_assigned(state, Moved(reference, centroids, radius), size), "assigned")
    free_scratch(spark, made)

    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = spark.createDataFrame(
        [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode())
          .hexdigest()) for i, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
