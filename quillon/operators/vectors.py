"""Vector search: exact top-k by blocks of queries against all vectors, scoring, fingerprint guards."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Queries in a block and vectors in a part: what one task sees at once.
QUERY_BLOCK, VECTOR_PART = 1024, 16384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """L2-normalised vector; norms below 1e-12 count as that."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


#: Components of a hashed vector.
HASHED = 64


@F.pandas_udf(S.ArrayType(S.DoubleType()))
def _hashed(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        v = np.zeros(HASHED)
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            v[h % HASHED] += 1 if h & 0x80000000 else -1
        out.append(v / max(np.linalg.norm(v), 1e-12))
    return pd.Series(out)


def hashed(text: Column) -> Column:
    """A vector of unit length from the signed hashes of a text's words: an encoder that needs no model."""
    return _hashed(text)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, same_archive: bool = False) -> DataFrame:
    """query_id, vec_id, zim_id, article_id, score (cosine, vectors being unit length) and rank of each query's `k` nearest.

    Queries are a stated set. They are cut into blocks and the vectors into parts, both of bounded size; each block meets each
    part in one task as a matrix product, and only its best k for each query go on to be ranked."""
    blocks = -(-max(queries.count(), 1) // QUERY_BLOCK)
    parts = -(-max(vectors.count(), 1) // VECTOR_PART)

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # so that queries may come from the vectors themselves
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    asked = dealt(queries.select("query_id", "zim_id", "embedding"), "query_id", "block", blocks, "part", parts)
    held = dealt(vectors.select("vec_id", "zim_id", "article_id", "embedding"), "vec_id", "part", parts, "block", blocks)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "vec_id", "zim_id", "article_id", "score")})
        scores = np.stack(a["embedding"]).astype(float) @ np.stack(b["embedding"]).astype(float).T
        if same_archive:
            scores[a["zim_id"].to_numpy()[:, None] != b["zim_id"].to_numpy()[None, :]] = -np.inf
        ids = b["vec_id"].to_numpy()
        top = np.array([np.lexsort((ids, -np.round(row, 9)))[:k] for row in scores])
        rows = np.repeat(np.arange(len(a)), top.shape[1])
        out = b.iloc[top.ravel()][["vec_id", "zim_id", "article_id"]].reset_index(drop=True)
        out.insert(0, "query_id", a["query_id"].to_numpy()[rows])
        out["score"] = scores[rows, top.ravel()]
        return out[np.isfinite(out["score"])]

    met = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part"))
    found = met.applyInPandas(best, "query_id long, vec_id long, zim_id int, article_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("rank") < k)


def compatible(vectors: DataFrame, meta: DataFrame, wanted: dict) -> tuple[DataFrame, DataFrame]:
    """Vectors of archives whose index was built with the wanted embedder, and (zim_id, reason) of those refused."""
    same = F.lit(True)
    for column, value in wanted.items():
        same = same & F.col(column).eqNullSafe(F.lit(value))
    fits = meta.where(same).select("zim_id")
    refused = meta.where(~same).select("zim_id", F.lit("fingerprint mismatch").alias("reason"))
    return vectors.join(fits, "zim_id", "left_semi"), refused
