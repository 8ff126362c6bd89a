"""Centroid clustering with geometric drift tightening.

Every vector keeps its cluster and one lower bound on its distance to all other
centroids. After the centroids moved, the bound is loosened, but by less than the
largest drift: the vectors of a cluster lie in a sphere around the centroid they were
assigned to, and what a move from p to q can take off a distance inside that sphere
is found in the plane of the sphere's centre, p and q. With m the middle of p and q,
any x has |x-p| - |x-q| <= |p-q| * cos(angle at m between x-m and q-m); the sphere's
least such angle is that of its centre less asin(radius / |centre-m|). A centroid
that moves away from the sphere takes nothing off, or even adds to the bound.

A vector whose own distance, measured exactly, is under its bound (or under half the
distance between its centroid and the nearest other one) stays; the others are
ambiguous and are compared with all centroids in whole numbers. Bounds are doubles
with a margin; assignments and sums are exact.

Per round, one pass over the vectors writes cluster, bound and exact distance to the
shared folder, one aggregate gives each cluster's count, sums and radius; only these
figures, k rows, reach the driver. No vector is shuffled.

Defined results: vectors of another length, null ones, and ones with a null, NaN or
infinite component are left out; a null id hashes as the empty text; repeated rows
all count, also as starting centroids, where equal hashes follow the vectors' order;
with fewer vectors than k each is a centroid; ties go to the smaller number; an empty
table gives no rows. Components beyond 2**27 after scaling are an error, since a
squared distance would not fit a bigint. Only the id and the vector column are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import stored

LIMIT = 1 << 27
#: Relative margin of the bounds against the rounding of doubles.
MARGIN = 1e-9
#: Part of a drift that the angles' rounding may hide.
SLACK = 1e-6
STATE = "id bigint, v array<int>, cluster int, distance bigint, lower double, scans int"


def whole_vectors(vectors: DataFrame, dim: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v: the vectors of ``dim`` finite components, scaled and floored."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = rows.filter((F.size("x") == dim) & F.forall("x", finite))

    def part(c: Column) -> Column:
        scaled = F.floor(c * scale)
        return F.when(F.abs(c * scale) <= LIMIT, scaled.cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large for exact squared distances"))
        )

    return kept.select("id", F.transform("x", part).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest sha256 of seed and id."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    picked = rows.withColumn("key", key).orderBy("key", "v").limit(k).select("v").collect()
    return np.array([r.v for r in picked], dtype=np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per cluster, the most that the moves of the other centroids take off a distance inside its sphere.

    ``old`` are the centroids that the radii and bounds were measured from. Never more
    than the largest drift of the others; negative when all of them moved away.
    """
    k = len(old)
    out = np.full(k, -np.inf)
    move = (new - old).astype(np.float64)
    drift = np.sqrt((move * move).sum(1))
    middle = (new + old) / 2.0
    for i in range(k):
        for j in range(k):
            if j == i:
                continue
            off = old[i] - middle[j]
            away = math.sqrt(float(off @ off))
            reach = radius[i] * (1 + MARGIN) + MARGIN
            if drift[j] == 0.0:
                worst = 0.0
            elif away <= reach:
                worst = drift[j]
            else:
                cosine = max(-1.0, min(1.0, float(off @ move[j]) / (away * drift[j])))
                angle = math.acos(cosine) - math.asin(reach / away)
                worst = drift[j] * math.cos(max(angle, 0.0))
                if worst < 0.0:  # the whole sphere lies on the side that the centroid leaves
                    near = away - reach
                    worst *= near / math.sqrt(near * near + drift[j] * drift[j] / 4)
            out[i] = max(out[i], min(drift[j], worst + SLACK * drift[j]))
    return np.where(np.isinf(out), 0.0, out)


def spacing(centroids: np.ndarray) -> np.ndarray:
    """Distance of each centroid to the nearest other one."""
    c = centroids.astype(np.float64)
    out = np.full(len(c), np.inf)
    for i in range(len(c)):
        gap = c - c[i]
        square = (gap * gap).sum(1)
        square[i] = np.inf
        out[i] = math.sqrt(square.min())
    return out


@dataclass
class Round:
    """What the tasks of one round need: k centroids and three figures each."""

    centroids: np.ndarray
    loosen: np.ndarray | None
    half: np.ndarray


def _squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * v.shape[1] < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        gap = v - c
        out[:, j] = (gap * gap).sum(1)
    return out


def settle(v: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, now: Round):
    """cluster, exact distance, lower bound and who was scanned, for one block of vectors."""
    n, k = len(v), len(now.centroids)
    if cluster is None or lower is None:
        cluster, lower = np.zeros(n, dtype=np.int32), np.full(n, -np.inf)
    elif now.loosen is not None:
        lower = lower - now.loosen[cluster]
    gap = v - now.centroids[cluster]
    distance = (gap * gap).sum(1)
    own = np.sqrt(distance.astype(np.float64))
    bound = np.maximum(lower, 2 * now.half[cluster] - own)
    sure = own * (1 + MARGIN) + MARGIN < bound * (1 - MARGIN)
    scan = np.flatnonzero(~sure)
    cluster, bound = cluster.copy(), bound.copy()
    if len(scan):
        squares = _squares(v[scan], now.centroids)
        best = squares.argmin(1)
        cluster[scan] = best
        distance[scan] = squares[np.arange(len(scan)), best]
        squares[np.arange(len(scan)), best] = np.iinfo(np.int64).max
        bound[scan] = np.sqrt(squares.min(1).astype(np.float64)) if k > 1 else np.inf
    return cluster, distance, bound, ~sure


def _assign(now: Round, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                v = part.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dim)
                known = "cluster" in part.schema.names
                cluster = part.column("cluster").to_numpy() if known else None
                lower = part.column("lower").to_numpy() if known else None
                scans = part.column("scans").to_numpy() if known else np.zeros(len(v), dtype=np.int32)
                cluster, distance, bound, scanned = settle(v, cluster, lower, now)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("v"),
                        pa.array(cluster, pa.int32()),
                        pa.array(distance, pa.int64()),
                        pa.array(bound, pa.float64()),
                        pa.array(scans + scanned, pa.int32()),
                    ],
                    ["id", "v", "cluster", "distance", "lower", "scans"],
                )

    return run


def _figures(state: DataFrame, dim: int) -> dict[int, tuple]:
    """Per cluster: count, farthest squared distance, summed distance and the component sums; k rows."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(dim)]
    rows = state.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.max("distance").alias("far"),
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"),
        *sums,
    )
    return {r.cluster: (r.n, r.far, int(r.inertia), [r[f"s{i}"] for i in range(dim)]) for r in rows.collect()}


@dataclass
class Clusters:
    """The assigned vectors (id, v, cluster, distance, scans), the final centroids and the inertia of each."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def cluster_vectors(rows: DataFrame, dim: int, k: int, rounds: int, seed: str) -> Clusters:
    """``rounds`` rounds of assigning and moving, then a last assignment; ``rows`` come from whole_vectors."""
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        empty = rows.sparkSession.createDataFrame([], STATE).drop("lower")
        return Clusters(empty, centroids, [])
    state, loosen = rows, None
    for turn in range(rounds + 1):
        now = Round(centroids, loosen, spacing(centroids) / 2)
        state = stored(state.mapInArrow(_assign(now, dim), STATE), f"clusters-{turn}")
        figures = _figures(state, dim)
        if turn == rounds:
            break
        moved = centroids.copy()
        radius = np.zeros(len(centroids))
        for c, (n, far, _, sums) in figures.items():
            moved[c] = [s // n for s in sums]
            radius[c] = math.sqrt(far)
        loosen = loosening(centroids, moved, radius)
        centroids = moved
    inertia = [figures[c][2] if c in figures else 0 for c in range(len(centroids))]
    return Clusters(state.drop("lower"), centroids, inertia)
