"""A partitioned vector index: k-means cells, search of the nearest cells, exact ranking of what they hold.

Cells are fitted on a bounded sample (SAMPLE vectors, the smallest hashes of their ids), then every vector is put into the cell of its nearest
centroid and written partitioned by cell. A query is sent to its PROBES nearest cells, reads their partitions alone, and ranks what they hold by
the exact score. Cells of more than PART vectors are dealt into parts, each a task of its own."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import vectors as exact_search
from quillon.sources.tables import kept

SAMPLE, ROUNDS, PROBES, PART = 20_000, 12, 8, 50_000


@dataclass(frozen=True)
class Cells:
    """An index: its folder, the centroids (unit vectors), and how many vectors each cell holds."""

    path: str
    centroids: np.ndarray
    sizes: dict[int, int]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of up to `cells` cells by spherical k-means on the sample; empty cells keep their centroid."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(sample).toPandas()  # a bounded sample
    if rows.empty:
        return np.zeros((0, 0))
    x = unit(np.stack(rows["embedding"]).astype(float))
    centroids = x[: min(cells, len(x))].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=len(centroids)) > 0
        centroids[some] = unit(sums[some])
    return centroids


def build(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
    """Write vectors (vec_id, zim_id, article_id, embedding) by cell; about sqrt(n) cells unless told otherwise."""
    own = vectors.select("vec_id", "zim_id", "article_id", "embedding").where(F.size("embedding") > 0)
    centroids = fitted(own, cells or max(1, math.isqrt(own.count())))

    def placed(frames):
        for f in frames:
            best = np.argmax(np.stack(f["embedding"]).astype(float) @ centroids.T, axis=1) if len(f) else []
            yield f.assign(cell=np.asarray(best, np.int32))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", cell int"
    own.mapInPandas(placed, schema).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    sizes = {r["cell"]: r["count"] for r in own.sparkSession.read.parquet(path).groupBy("cell").count().collect()}  # a row for each cell
    return Cells(path, centroids, sizes)


def nearest(spark: SparkSession, index: Cells, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """query_id, vec_id, score and rank of the k best vectors of the nearest cells of each query (query_id, embedding)."""
    many = min(probes, len(index.centroids))

    def sent(frames):
        for f in frames:
            far = -(unit(np.stack(f["embedding"]).astype(float)) @ index.centroids.T)
            cells = np.argpartition(far, many - 1, axis=1)[:, :many]
            out = f.loc[f.index.repeat(many)].reset_index(drop=True)
            yield out.assign(cell=cells.ravel().astype(np.int32))

    kind = queries.schema["embedding"].dataType.simpleString()
    asked = kept(queries.select("query_id", "embedding").mapInPandas(sent, f"query_id long, embedding {kind}, cell int"))
    opened = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # cells
    parts = F.create_map(*[F.lit(x) for c in opened for x in (c, -(-index.sizes.get(c, 1) // PART))])
    held = spark.read.parquet(index.path).where(F.col("cell").isin(opened)).select("cell", "vec_id", "embedding").withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("cell")]).cast("int"))
    dealt = asked.withColumn("part", F.explode(F.sequence(F.lit(0), (parts[F.col("cell")] - 1).cast("int"))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        scores = np.stack(a["embedding"]).astype(float) @ np.stack(b["embedding"]).astype(float).T
        ids = b["vec_id"].to_numpy()
        top = np.array([np.lexsort((ids, -np.round(row, 9)))[:k] for row in scores])
        return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), top.shape[1]), "vec_id": ids[top.ravel()], "score": np.take_along_axis(scores, top, axis=1).ravel()})

    found = dealt.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(best, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("rank") < k)


def probes_for(spark: SparkSession, index: Cells, vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 64) -> int:
    """The number of cells to probe for a recall: how near, in order of their centroids, the cells are that hold the k best vectors of a
    sample of the queries (query_id, zim_id, embedding) by an exact search."""
    some = kept(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    exact = exact_search.nearest(vectors, some, k).select("query_id", "vec_id")
    held = exact.join(spark.read.parquet(index.path).select("vec_id", "cell"), "vec_id").join(some.select("query_id", "embedding"), "query_id").toPandas()  # sample * k rows
    if held.empty:
        return 1
    far = -(unit(np.stack(held["embedding"]).astype(float)) @ index.centroids.T)
    place = (far < np.take_along_axis(far, held["cell"].to_numpy()[:, None].astype(int), axis=1)).sum(axis=1) + 1
    return int(np.ceil(np.quantile(place, recall, method="higher")))


def read_share(index: Cells, queries: DataFrame, probes: int) -> float:
    """The share of all vectors that lie in the probed cells of a query (query_id, embedding), on average over a sample of 64."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(64).toPandas()  # bounded
    sizes = np.array([index.sizes.get(c, 0) for c in range(len(index.centroids))])
    order = np.argsort(-(unit(np.stack(some["embedding"]).astype(float)) @ index.centroids.T), axis=1)[:, :probes]
    return float(sizes[order].sum(axis=1).mean() / max(sizes.sum(), 1))
