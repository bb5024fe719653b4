"""Queries over the catalogue: search, facets, sorting, curated ranks, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import catalogue
from quillon.plans.registry import query
from quillon.sources.tables import table

CURATED = [("Brand#11", 1), ("Brand#22", 2), ("Brand#33", 3), ("Brand#44", 4)]
CURATED_SQL = "curated(p_brand, curated_rank) AS (VALUES " + ", ".join(f"('{b}', {r})" for b, r in CURATED) + ")"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def ranked_parts(spark, sf_dir):
    curated = spark.createDataFrame(CURATED, "p_brand string, curated_rank int")
    return parts(spark, sf_dir).join(F.broadcast(curated), "p_brand", "left")  # the curated list is a constant of a few rows


@query("JN16", sql=f"WITH {CURATED_SQL} SELECT p_partkey, p_brand, curated_rank FROM part LEFT JOIN curated USING (p_brand)")
def curated_rank_join(spark, sf_dir):
    return ranked_parts(spark, sf_dir).select("p_partkey", "p_brand", "curated_rank")


@query("FI9", "SO3", sql=f"""WITH {CURATED_SQL}, f AS (SELECT p_partkey, p_size, curated_rank, count(*) OVER () AS total FROM part LEFT JOIN curated USING (p_brand)
  WHERE p_size <= 30 AND list_contains(string_split(lower(p_type), ' '), (SELECT min(w) FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS w FROM part))))
SELECT p_partkey, p_size, curated_rank, total FROM f ORDER BY curated_rank IS NULL, curated_rank, p_size DESC, p_partkey LIMIT 25 OFFSET 10""")
def catalog_search_sort_page(spark, sf_dir):
    """A page of catalogue rows with a word in their type: curated ones first, then by falling size; with the number of all."""
    rows = ranked_parts(spark, sf_dir)
    words = F.split(F.lower("p_type"), " ")
    least = rows.select(F.explode(words).alias("w")).agg(F.min("w").alias("w"))
    found = rows.join(F.broadcast(least)).where((F.col("p_size") <= 30) & F.array_contains(words, F.col("w")))
    page = catalogue.page(found, [F.col("curated_rank").isNull(), F.col("curated_rank"), F.desc("p_size"), F.col("p_partkey")], 10, 25)
    return page.select("p_partkey", "p_size", "curated_rank", "total")


@query("SO3", sql="SELECT p_partkey, row_number() OVER (ORDER BY p_size < 5, p_size, p_partkey) - 1 AS up, row_number() OVER (ORDER BY p_size < 5, p_size DESC, p_partkey) - 1 AS down FROM part")
def missing_last_both_ways(spark, sf_dir):
    """Rows without a date (here: of small size) come last in both directions."""
    return catalogue.missing_last(parts(spark, sf_dir), F.col("p_size") < 5, "p_size", "p_partkey")


@query("AG4", sql="SELECT w AS facet, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w <> '' GROUP BY w")
def catalog_language_facets(spark, sf_dir):
    return catalogue.facets(parts(spark, sf_dir), "p_type", " ")


@query("AG1", sql="SELECT label AS zim_id, count(*) AS n, len(any_value(embedding)) AS dim FROM embeddings GROUP BY label")
def vector_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("zim_id")).agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("bigint").alias("dim"))


@query("AG2", "AG3", sql="SELECT count(*) AS n, max(o_orderdate) AS fetched_at, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(*) > 0 AS available FROM orders")
def catalogue_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("fetched_at"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), (F.count("*") > 0).alias("available"))


@query("JN7", sql="""WITH files AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier WHERE s_suppkey % 5 <> 0), rows AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT coalesce(files.id, rows.id) AS id, CASE WHEN rows.id IS NULL THEN 'added' WHEN files.id IS NULL THEN 'missing' WHEN files.v <> rows.v THEN 'updated' ELSE 'same' END AS change FROM files FULL OUTER JOIN rows ON files.id = rows.id""")
def archive_discovery_full_outer(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v"))
    known = rows.where("id % 3 <> 0").withColumn("v", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("v")))
    return catalogue.discovered(rows.where("id % 5 <> 0"), known)


@query("JN20", sql="SELECT s_suppkey, coalesce(nullif(r_name, ''), nullif(n_name, ''), 'archive ' || s_suppkey) AS label FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 4 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey % 3 = 0")
def archive_labels(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier")
    named = s.join(nation, s.s_nationkey == nation.n_nationkey, "left").join(region, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") % 3 == 0), "left")
    return named.select("s_suppkey", F.coalesce(F.nullif("r_name", F.lit("")), F.nullif("n_name", F.lit("")), F.concat(F.lit("archive "), F.col("s_suppkey").cast("string"))).alias("label"))


@query("MA8", "MA17", sql="""SELECT source, depth, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(round(count(*) * CASE depth WHEN 1 THEN 0.98 WHEN 2 THEN 5.92 ELSE 4.94 END) AS BIGINT) * 1632 AS bytes
FROM documents, (SELECT unnest([1, 2, 3]) AS depth) GROUP BY source, depth""")
def index_disk_estimate(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    return catalogue.disk_estimates(sums)


@query("MA16", "MA12", sql="SELECT p_partkey, round(p_retailprice + p_size * 4.5, 4) AS ram, CAST(p_size * 6 AS BIGINT) AS seconds FROM part")
def run_estimates(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.round(F.col("p_retailprice") + F.col("p_size") * 4.5, 4).alias("ram"), (F.col("p_size") * 6).cast("bigint").alias("seconds"))


@query("TX35", "FI17", "FI2", sql="""WITH c AS (SELECT p_brand, p_partkey, CASE WHEN p_name = 'x' THEN 0 WHEN lower(p_type) LIKE '%steel%' THEN 1 WHEN p_size > 40 THEN 2 ELSE 3 END AS rung FROM part)
SELECT p_brand, arg_min(p_partkey, rung * 10000000 + p_partkey) AS chosen FROM c GROUP BY p_brand""")
def priority_match_ladder(spark, sf_dir):
    rung = F.when(F.col("p_name") == "x", 0).when(F.lower("p_type").contains("steel"), 1).when(F.col("p_size") > 40, 2).otherwise(3)
    return parts(spark, sf_dir).groupBy("p_brand").agg(F.min(F.struct(rung.alias("rung"), "p_partkey"))["p_partkey"].alias("chosen"))


@query("FI1", "SE3", "FI7", sql="SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'fr')")
def scope_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source in ('src1', 'src2', 'src3') and lang in ('en', 'fr')").select("doc_id")


@query("FI18", sql="SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN o_orderstatus WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def bulk_state_update(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(status == "F", status).when(F.col("o_orderpriority").startswith("1"), "X").otherwise(status).alias("status"))


@query("JN2", sql=r"""WITH e AS (SELECT p_partkey AS entry_id, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{L}\p{N}_]+')) AS ws FROM part),
q AS (SELECT DISTINCT p_size AS id, list_distinct(regexp_extract_all(lower(min(p_name)), '[\p{L}\p{N}_]+')) AS ws FROM part GROUP BY p_size)
SELECT id, entry_id FROM q JOIN e ON len(list_intersect(q.ws, e.ws)) = len(q.ws)""")
def catalogue_matches(spark, sf_dir):
    """Catalogue entries that have all words of a query, by an inverted index of their words: the first name of each size searched for."""
    part = table(spark, sf_dir, "part")
    entries = part.select(F.col("p_partkey").alias("entry_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    asked = part.groupBy(F.col("p_size").alias("id")).agg(F.min("p_name").alias("query"))
    return catalogue.catalogue_matches(asked, entries)
