"""Exact k-means on integer vectors with geometric bounds on how far a moved centroid can come closer.

Every vector keeps its centroid, an upper bound of its distance to it and a
lower bound of its distance to all others. When centroids move, the vectors of
a cluster lie in a sphere around its old centroid, and how much closer another
centroid can have come to any of them is bounded in the plane through the
sphere's centre and that centroid's old and new place: the points that gained
more than a share of the drift lie in a cone around the direction of the move,
with its tip midway (the asymptotes of the hyperbola of equal gain), so the
largest angle under which the sphere meets the direction gives the gain. It is
the full drift only where the sphere reaches the axis. Vectors whose bounds
overlap are scanned exactly, in integers; ties go to the smaller number.

Each round reads the vectors with their bounds from files, assigns them in
numpy, and writes them again; per task and cluster one row of exact sums goes
to the new centroids. Only centroids, radii and counts (fixed by ``clusters``)
reach the driver.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; empty tables give no rows; with fewer
vectors than clusters there are fewer centroids. Rows without id are kept, come
last in the choice of the first centroids, and repeated ids each count. Equal
centroids tie, so the later ones stay empty and where they are. Extra columns
are ignored. Components beyond 2^26 in magnitude after scaling raise, as their
squared distances do not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkflow.llm.common import save

LARGEST = 1 << 26
_ROWS = 4096
_ROUND_UP = 1 + 1e-9        # widens every bound by far more than its rounding


@dataclass(frozen=True)
class KMeans:
    clusters: int = 16
    rounds: int = 3
    size: int = 64          # components of a vector
    scale: int = 64         # a component x becomes floor(scale * x)


# --- geometry ---------------------------------------------------------------------------------

def gains(centers: np.ndarray, moved: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For every cluster, by how much any other centroid may have come closer to a member.

    ``radii``: at least the distance of every member to the cluster's old centroid.
    """
    k = len(centers)
    step = moved - centers
    drift = np.sqrt((step ** 2).sum(axis=1))
    out = np.zeros(k)
    for i in range(k):
        to_tip = centers[i] - (centers + moved) / 2              # from every other centroid's midway point
        far = np.sqrt((to_tip ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to_tip * step).sum(axis=1) / (far * drift), -1, 1))
            half = np.arcsin(np.clip(radii[i] * _ROUND_UP / far, 0, 1))
            share = np.cos(np.clip(angle - half - 1e-7, 0, np.pi / 2))
        share[(far <= radii[i] * _ROUND_UP) | ~np.isfinite(share)] = 1
        gain = np.where(drift > 0, drift * share, 0)
        gain[i] = 0
        out[i] = gain.max(initial=0)
    return out * _ROUND_UP


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact; in doubles where every partial sum is an exact integer, else in 64-bit integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0))
    if 4 * x.shape[1] * int(largest) ** 2 < 1 << 52:
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a ** 2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b ** 2).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def own_squared(x: np.ndarray, centers: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((x - centers[own]) ** 2).sum(axis=1)


@dataclass(frozen=True)
class Move:
    """What a round needs to know: the centroids, and how far bounds loosen by cluster (None: no bounds yet)."""
    centers: np.ndarray
    drift: np.ndarray | None = None
    gain: np.ndarray | None = None


def assigned(x: np.ndarray, move: Move, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(own, upper, lower, whether scanned) of the vectors after a move of the centroids."""
    own, n = own.copy(), len(x)
    if move.drift is None:
        scan = np.ones(n, bool)
        upper, lower = np.zeros(n), np.zeros(n)
    else:
        upper = (upper + move.drift[own]) * _ROUND_UP
        lower = (lower - move.gain[own]) * (2 - _ROUND_UP) - 1e-9
        scan = upper >= lower
        at = np.flatnonzero(scan)
        upper[at] = np.sqrt(own_squared(x[at], move.centers, own[at])) * _ROUND_UP
        scan = upper >= lower
    at = np.flatnonzero(scan)
    if len(at):
        far = squared_distances(x[at], move.centers)
        own[at] = far.argmin(axis=1)                              # the first of equal ones
        rows = np.arange(len(at))
        upper[at] = np.sqrt(far[rows, own[at]]) * _ROUND_UP
        if far.shape[1] > 1:
            far[rows, own[at]] = np.iinfo(np.int64).max
            lower[at] = np.sqrt(far.min(axis=1)) * (2 - _ROUND_UP)
        else:
            lower[at] = np.inf
    return own, upper, lower, scan


# --- Spark ------------------------------------------------------------------------------------

def whole(vectors: DataFrame, vec_id: str, embedding: str, how: KMeans) -> DataFrame:
    """(vec_id, v): the usable vectors in whole numbers."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = F.forall(x, lambda c: F.abs(c * float(how.scale)) <= float(LARGEST))
    scaled = F.transform(x, lambda c: F.floor(c * float(how.scale)).cast("int"))
    return vectors.where((F.size(x) == how.size) & finite).select(
        F.col(vec_id).alias("vec_id"),
        F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("v"))


def first_centers(points: DataFrame, how: KMeans) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; equal ids by their components."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(mark.asc_nulls_last(), "v").limit(how.clusters).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, how.size)


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _round(state: DataFrame, move: Move, how: KMeans, last: bool) -> DataFrame:
    """One assignment: the state of the next round, or at last (vec_id, cluster, distance)."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def assign(batches):
        for whole_batch in batches:
            for start in range(0, len(whole_batch), _ROWS):
                batch = whole_batch.slice(start, _ROWS)
                x = _vectors(batch, how.size)
                old = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "upper", "lower")]
                own, upper, lower, scan = assigned(x, move, *old)
                if last:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), pa.array(own, pa.int32()),
                         pa.array(own_squared(x, move.centers, own), pa.int64())], ["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper),
                         pa.array(lower), pa.array(scan)], ["vec_id", "v", "own", "upper", "lower", "scanned"])

    columns = f"vec_id {kind}, cluster int, distance bigint" if last else \
        f"vec_id {kind}, v array<int>, own int, upper double, lower double, scanned boolean"
    return state.select("vec_id", "v", "own", "upper", "lower").mapInArrow(assign, columns)


def moved(state: DataFrame, centers: np.ndarray, how: KMeans) -> Move:
    """The next centroids: exact means rounded down, from one row of sums per cluster."""
    sums = [F.sum(F.element_at("v", i + 1).cast("long")).alias(f"s{i}") for i in range(how.size)]
    new, radii = centers.copy(), np.zeros(len(centers))
    for r in state.groupBy("own").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), *sums).collect():
        new[r["own"]] = [r[f"s{i}"] // r["n"] for i in range(how.size)]
        radii[r["own"]] = r["radius"]
    step = np.sqrt(((new - centers) ** 2).sum(axis=1))
    return Move(new, step, gains(centers.astype(np.float64), new.astype(np.float64), radii))


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
            how: KMeans = KMeans()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids."""
    points = save(whole(vectors, vec_id, embedding, how), "centroids-points")
    move = Move(first_centers(points, how))
    state = points.select("*", F.lit(0).alias("own"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    for _ in range(how.rounds):
        state = save(_round(state, move, how, last=False), "centroids-round")
        move = moved(state, move.centers, how)
    return save(_round(state, move, how, last=True), "centroids-final"), move.centers


def with_totals(found: DataFrame, centers: np.ndarray) -> DataFrame:
    """``found`` with its cluster's summed distance, that of all, and its centroid's components as text.

    Joins one row per cluster, a number fixed by ``KMeans.clusters``.
    """
    text = [",".join(map(str, c)) for c in centers.tolist()]
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = [(r["cluster"], r["cluster_inertia"]) for r in own.collect()]
    rows = [(i, n, sum(n for _, n in totals), text[i]) for i, n in totals]
    both = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    return found.join(F.broadcast(both), "cluster")
