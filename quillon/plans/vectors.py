"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import cells, ranking, vectors
from quillon.plans.registry import query
from quillon.sources.tables import folder, small, spread
from quillon.sources.tables import vectors as vector_table

PAIRS = """q AS (SELECT vec_id AS query_id, label AS q_zim, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT query_id, q_zim, vec_id, label AS zim_id, vec_id // 4 AS article_id, list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings)"""
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) - 1"


def asked(spark, sf_dir):
    return vector_table(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "zim_id", "embedding")


@query("MA1", "CS5", "SO2", sql=f"WITH {PAIRS}, r AS (SELECT query_id, vec_id, round(score, 6) AS score, {TOP} AS rank FROM pairs) SELECT * FROM r WHERE rank < 10")
def knn_topk_cosine(spark, sf_dir):
    found = vectors.nearest(vector_table(spark, sf_dir), asked(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("CS5", "MA2", sql=f"WITH {PAIRS}, r AS (SELECT query_id, vec_id, round(-sqrt(greatest(2 - 2 * score, 0)), 4) AS score, {TOP} AS rank FROM pairs WHERE q_zim = zim_id) SELECT * FROM r WHERE rank < 5")
def knn_partition_scoped(spark, sf_dir):
    found = vectors.nearest(vector_table(spark, sf_dir), asked(spark, sf_dir), 5, same_archive=True)
    distance = F.round(-F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))), 4)
    return found.select("query_id", "vec_id", distance.alias("score"), "rank")


@query("WN1", "WN2", sql=f"""WITH {PAIRS}, top AS (SELECT *, {TOP} AS r FROM pairs), best AS (SELECT * FROM top WHERE r < 40 QUALIFY row_number() OVER (PARTITION BY query_id, zim_id, article_id ORDER BY score DESC, vec_id) = 1)
SELECT query_id, zim_id, article_id, row_number() OVER (PARTITION BY query_id, zim_id ORDER BY r) - 1 AS rank FROM best""")
def knn_articles_ranked(spark, sf_dir):
    top = vectors.nearest(vector_table(spark, sf_dir), asked(spark, sf_dir), 40).withColumnRenamed("rank", "r")
    best = ranking.best_per_article(top.select(F.col("query_id").alias("item_id"), "zim_id", F.col("article_id").alias("path"), "score", "vec_id", "r"))
    out = ranking.restart_ranks(best, ["item_id", "zim_id"], ["r"])
    return out.select(F.col("item_id").alias("query_id"), "zim_id", F.col("path").alias("article_id"), F.col("rank").cast("bigint").alias("rank"))


@query("MA3", sql="""SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS norm2, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS first FROM embeddings""")
def vectors_normalised(spark, sf_dir):
    e = F.col("embedding")
    return vector_table(spark, sf_dir).select("vec_id", F.round(vectors.dot(e, e), 5).alias("norm2"), F.round(vectors.normalised(e)[0], 5).alias("first"))


@query("FI5", "FI6", sql="""WITH meta AS (SELECT DISTINCT label AS zim_id, CASE WHEN label % 3 = 0 THEN 'other' ELSE 'm' END AS embedder FROM embeddings)
SELECT zim_id, CASE WHEN embedder = 'm' THEN 'complete' ELSE 'stale' END AS status, (SELECT count(*) FROM embeddings WHERE label = zim_id AND embedder = 'm') AS usable FROM meta""")
def knn_fingerprint_guard(spark, sf_dir):
    rows = vector_table(spark, sf_dir)
    meta = rows.select("zim_id").distinct().withColumn("embedder", F.when(F.col("zim_id") % 3 == 0, "other").otherwise("m")).withColumn("dim", F.lit(64))
    usable, refused = vectors.compatible(rows, meta, {"embedder": "m", "dim": 64})
    counts = usable.groupBy("zim_id").agg(F.count("*").alias("usable"))
    out = meta.join(counts, "zim_id", "left").join(refused, "zim_id", "left")
    return out.select("zim_id", F.when(F.col("reason").isNull(), "complete").otherwise("stale").alias("status"), F.coalesce("usable", F.lit(0)).alias("usable"))


@query("JN1", sql="SELECT article_id, any_value(lang) AS lang, count(*) AS chunks FROM (SELECT vec_id // 4 AS article_id FROM embeddings) JOIN documents ON doc_id = article_id GROUP BY article_id")
def hits_join_chunks_articles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("article_id"), "lang")
    return vector_table(spark, sf_dir).join(docs, "article_id").groupBy("article_id").agg(F.first("lang").alias("lang"), F.count("*").alias("chunks"))


@query("AG38", sql=f"""WITH {PAIRS}, e AS (SELECT query_id, vec_id FROM (SELECT *, {TOP} AS r FROM pairs) WHERE r < 10), a AS (SELECT query_id, vec_id FROM (SELECT *, {TOP} AS r FROM pairs WHERE zim_id % 2 = q_zim % 2) WHERE r < 10)
SELECT query_id, round(count(a.vec_id) / count(*), 6) AS recall FROM e LEFT JOIN a USING (query_id, vec_id) GROUP BY query_id""")
def knn_recall(spark, sf_dir):
    """Recall of a search confined to archives of the query's parity, against the exact one."""
    rows, q = vector_table(spark, sf_dir), asked(spark, sf_dir)
    exact = vectors.nearest(rows, q, 10).select("query_id", "vec_id")
    parts = [vectors.nearest(rows.where(F.col("zim_id") % 2 == p), q.where(F.col("zim_id") % 2 == p), 10).select("query_id", "vec_id", F.lit(1).alias("hit")) for p in (0, 1)]
    return exact.join(parts[0].unionByName(parts[1]), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("SR2", "SO1", sql=f"""WITH {PAIRS}, first AS (SELECT * FROM pairs WHERE q_zim = zim_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vec_id) <= 200),
r AS (SELECT query_id, vec_id, {TOP} AS rank FROM first) SELECT query_id, vec_id, rank FROM r WHERE rank < 20""")
def static_shortlist(spark, sf_dir):
    """The 20 nearest of each query's first 200 candidates, which are the vectors of its archive in their order."""
    q = asked(spark, sf_dir).select("query_id", "zim_id", F.col("embedding").alias("e"))
    nth = F.row_number().over(W.partitionBy("zim_id").orderBy("vec_id"))
    first = small(vector_table(spark, sf_dir).select("vec_id", "zim_id", "embedding").withColumn("nth", nth).where("nth <= 200"))  # the same for all queries of an archive
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    scored = spread(q).join(first, "zim_id").select("query_id", "vec_id", vectors.dot(F.col("e"), F.col("embedding")).alias("score"))
    best = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    return best.select("query_id", "vec_id", (F.col("rank") - 1).cast("bigint").alias("rank"))


@query("MA2", "AG38", "CS5")
def cells_knn_recall(spark, sf_dir):
    """For each query the ten best vectors of the cells nearest to it, as many as a sample needs for its recall, and whether the exact search has
    them too."""
    rows, q = vector_table(spark, sf_dir), asked(spark, sf_dir)
    index = cells.build(rows, f"{folder(spark)}/cells")
    probes = cells.probes_for(spark, index, rows, q, 10)
    exact = vectors.nearest(rows, q, 10).select("query_id", "vec_id", F.lit(True).alias("exact"))
    found = cells.nearest(spark, index, q.select("query_id", "embedding"), 10, probes)
    return found.join(exact, ["query_id", "vec_id"], "left").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank", F.coalesce("exact", F.lit(False)).alias("exact"))
