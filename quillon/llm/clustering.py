"""Centroid clustering of vectors in exact integers.

Components become integers floor(scale * x), and so are distances, sums and centroids: results do not depend on how rows
are split. Distances of a block of vectors to all centroids are expanded to |x|² - 2x·c + |c|², the middle term a
matrix product in float64. This is exact where all that can arise stays below 2^53: where dim (|x| + |c|)², by the largest
components, does. Rows beyond are worked out in int64 while that stays below 2^63, else in Python's integers.

Each round reads the vectors once. A task gives the sums, the counts and the summed distances of its rows, and treeAggregate
combines these in levels, so that what reaches one place is some k rows of `dim` integers, whatever the table's size. Centroids go to
the tasks with the function.

Defined cases: vectors that are null, of another length, or hold a null, NaN or infinity get no row; rows that repeat a vec_id
are vectors of their own, ties among first centroids going by their components; null vec_ids become first centroids last;
with fewer vectors than centroids there are so many centroids; a distance or sum beyond a long is null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Rows that are worked on at once.
BLOCK = 4096
EXACT, LONG = 1 << 53, 1 << 63


def whole(embedding: Column, dim: int) -> Column:
    """Whether a vector has `dim` components, all of them finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dim) & finite, F.lit(False))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): as float64 where that holds the values, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.isfinite(y).all():
        return y
    return np.array([[int(v) * scale if abs(v) >= EXACT else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def exact(x: np.ndarray) -> np.ndarray:
    """Python's integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of rows of integers to all centroids: int64 where each fits, else Python's integers."""
    dim, most = x.shape[1], max((abs(v) for c in centroids for v in c), default=0)
    if x.dtype != object and (reach := np.abs(x).max(initial=0.0)) < EXACT and dim * (int(reach) + most) ** 2 < EXACT:
        c = np.array(centroids, np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    reach = np.array([max(map(abs, row)) for row in exact(x)], object)
    near, far = dim * (reach + most) ** 2 < EXACT, dim * (reach + most) ** 2 >= LONG
    out = np.zeros((len(x), len(centroids)), object if far.any() else np.int64)
    if near.any():
        out[near] = distances(x[near].astype(np.float64), centroids)
    if (middle := ~near & ~far).any():
        y, c = np.array(exact(x[middle]), np.int64), np.array(centroids, np.int64)
        out[middle] = ((y[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    if far.any():
        y, c = exact(x[far]), np.array(centroids, object)
        out[far] = ((y[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    return out


def assigned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equally near ones, and its distance."""
    found = distances(x, centroids)
    best = np.argmin(found, axis=1) if len(found) else np.zeros(0, np.int64)
    return best, found[np.arange(len(x)), best]


def blocks(batch: pa.RecordBatch, scale: int):
    """The rows of a batch (vec_id, embedding) in blocks: ids and integers."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield part.column(0), integers(values.reshape(part.num_rows, -1), scale)


def total(x: np.ndarray) -> list[int]:
    """Column sums, exact."""
    if x.dtype != object and np.abs(x).max(initial=0.0) * max(len(x), 1) < EXACT:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(column) for column in zip(*exact(x).tolist(), strict=True)] or [0] * x.shape[1]


def _summed(centroids: list[list[int]], scale: int):
    """Per task and cluster: count, summed distance, and sums of the components, as decimal text."""
    def run(batches):
        found: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in blocks(batch, scale):
                best, apart = assigned(x, centroids)
                for k in np.unique(best).tolist():
                    own = best == k
                    new = [int(own.sum()), sum(int(v) for v in apart[own].tolist()), *total(x[own])]
                    found[k] = [a + b for a, b in zip(found[k], new, strict=True)] if k in found else new
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([",".join(map(str, v)) for v in found.values()], pa.string())], ["cluster", "sums"])

    return run


def sums(rows: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, list[int]]:
    """By cluster: count, summed distance and component sums of the rows nearest to it; clusters of none are left out."""
    def put(all_: dict, row) -> dict:
        return merged(all_, {row["cluster"]: [int(v) for v in row["sums"].split(",")]})

    def merged(one: dict, other: dict) -> dict:
        for k, v in other.items():
            one[k] = [a + b for a, b in zip(one[k], v, strict=True)] if k in one else v
        return one

    return rows.mapInArrow(_summed(centroids, scale), "cluster long, sums string").rdd.treeAggregate({}, put, merged, 2)


def first_centroids(rows: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The vectors whose vec_ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select("embedding", name.alias("name")).orderBy(F.asc_nulls_last("name"), "embedding").limit(k).collect()  # k rows
    return [[int(v) for v in integers(np.array([r["embedding"]], np.float64), scale)[0].tolist()] for r in chosen]


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of `dim` finite components."""
    rows = vectors.where(whole(F.col("embedding"), dim)).select(F.col("vec_id").cast("bigint"), F.col("embedding"))
    centroids = first_centroids(rows, k, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return rows.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for j, (n, _, *own) in sums(rows, centroids, scale).items():
            centroids[j] = [v // n for v in own]
    inertia = {j: own[1] for j, own in sums(rows, centroids, scale).items()}
    by_cluster = [inertia.get(j, 0) for j in range(len(centroids))]
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fitting(values: list[int]) -> pa.Array:
        return pa.array([v if v < LONG else None for v in values], pa.int64())

    def placed(batches):
        per, names = fitting(by_cluster), pa.array(named)
        for batch in batches:
            for ids, x in blocks(batch, scale):
                best, apart = assigned(x, centroids)
                every = pa.array(best)
                columns = [ids, every.cast(pa.int32()), fitting(apart.tolist()), per.take(every), fitting([sum(by_cluster)] * len(x)), names.take(every)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(placed, schema)
