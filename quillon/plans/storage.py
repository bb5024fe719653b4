"""Queries over sinks: the state of a table after a write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources import feeds, judged, sinks, snapshots
from quillon.sources.tables import folder, kept, table, vectors


@query("SK1", "SK2", sql="""WITH n AS (SELECT vec_id + 100 AS vec_id, label + 100 AS zim_id FROM embeddings), m AS (SELECT vec_id, label AS zim_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n)
SELECT zim_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM m GROUP BY zim_id""")
def upsert_keyed_merge(spark, sf_dir):
    own = vectors(spark, sf_dir).select("vec_id", "zim_id")
    new = own.select((F.col("vec_id") + 100).alias("vec_id"), (F.col("zim_id") + 100).alias("zim_id"))
    return sinks.upserted(own, new, ["vec_id"]).groupBy("zim_id").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("SK3", "JN18", sql="SELECT label AS zim_id, count(*) AS n FROM embeddings WHERE label NOT IN (1, 3) AND vec_id // 4 NOT IN (SELECT doc_id FROM documents WHERE lang = 'es') GROUP BY label")
def delete_cascade_anti(spark, sf_dir):
    gone = spark.createDataFrame([(1,), (3,)], "zim_id int")
    articles = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.col("doc_id").alias("article_id"))
    kept = sinks.without(sinks.without(vectors(spark, sf_dir), gone, ["zim_id"]), articles, ["article_id"])
    return kept.groupBy("zim_id").agg(F.count("*").alias("n"))


@query("SK6", sql="SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def last_write_wins(spark, sf_dir):
    return sinks.last_write(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SK7", sql="""SELECT item_id, sha256(concat_ws(chr(31), 'v2', CAST(item_id AS VARCHAR), text, 'm1')) AS cache_key,
CASE WHEN item_id % 3 = 0 THEN 'partial' ELSE 'correct' END AS first, CASE WHEN item_id % 3 = 0 THEN 'partial' WHEN item_id % 5 = 0 THEN 'incorrect' ELSE 'correct' END AS second FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT item_id, sha256(concat_ws(chr(31), 'v2', CAST(item_id AS VARCHAR), text, 'm1')), NULL, NULL FROM benchmark WHERE item_id % 2 > 0""")
def judge_cache_hits(spark, sf_dir):
    """Outcomes of half of the answers put into the cache and got for all, before and after some are put again."""
    name = f"judged_{uuid.uuid4().hex}"
    cache = judged.JudgeCache(spark, name, f"{folder(spark)}/judged")
    keyed = table(spark, sf_dir, "benchmark").select("item_id", judged.cache_key(F.lit("v2"), F.col("item_id"), F.col("text"), F.lit("m1")).alias("cache_key"))
    own = keyed.where("item_id % 2 = 0")
    cache.put(own.select("cache_key", F.when(F.col("item_id") % 3 == 0, "partial").otherwise("correct").alias("outcome")))
    first = kept(cache.get(keyed).withColumnRenamed("cached", "first"))
    cache.put(own.where("item_id % 5 = 0 and item_id % 3 > 0").select("cache_key", F.lit("incorrect").alias("outcome")))
    return cache.get(first).withColumnRenamed("cached", "second").select("item_id", "cache_key", "first", "second")


@query("SC13", "SC17", "SK9", sql="SELECT CAST(item_id AS VARCHAR) AS id, text AS query, 'slice ' || (item_id % 7) AS slice FROM benchmark")
def snapshot_round_trip(spark, sf_dir):
    """Questions written as a snapshot and read back."""
    snapshots.register(spark)
    path = f"{folder(spark)}/snapshot"
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.concat(F.lit("slice "), (F.col("item_id") % 7).cast("string")).alias("slice"))
    rows.write.format("snapshot").mode("append").save(path)
    return spark.read.format("snapshot").schema(rows.schema).load(path)


@query("SK4", sql="SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY source")
def replace_in_full(spark, sf_dir):
    """A table written, then replaced as a whole by a swap."""
    path, docs = f"{folder(spark)}/t", table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sinks.replace_table(docs, path)
    sinks.replace_table(docs.where("lang = 'fr'"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("SK5", sql="SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = 'fr' THEN 0 ELSE doc_id END) AS BIGINT) AS ids FROM documents GROUP BY lang")
def reload_by_partition(spark, sf_dir):
    """One partition wiped and loaded anew; the others stay."""
    path, docs = f"{folder(spark)}/t", table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.write.partitionBy("lang").parquet(path)
    sinks.reload_partitions(docs.where("lang = 'fr'").withColumn("doc_id", F.lit(0).cast("bigint")), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def _paged(rows: DataFrame, root: str, path: str) -> None:
    """Write XML documents of the elements in column x, up to 200 parts to a document and a document to a file, as feeds come in pages."""
    body = F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("x"), ""), F.lit(f"</{root}>"))
    rows.groupBy(F.floor(F.col("p_partkey") / 200).alias("page")).agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("SC9", sql="""SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS title, p_type AS summary, 'D' || p_size AS issued,
CASE p_partkey % 4 WHEN 1 THEN 'http://base/' || p_partkey || '.zim' WHEN 2 THEN 'http://other/' || p_partkey WHEN 3 THEN 'https://third/' || p_partkey ELSE 'http://base/catalog/x' END AS url,
CAST(CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_size END AS BIGINT) AS size FROM part WHERE p_partkey % 5 > 0""")
def atom_feed_rows(spark, sf_dir):
    """The catalogue written as Atom feeds and read back: links of several kinds, some fields left out, some entries with a picture only."""
    home, key, size = folder(spark), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")

    def link(rel: str, kind: str, *href, length=None):
        own = [F.lit(f"<link rel='{rel}' type='{kind}' href='"), *href, F.lit("'")]
        return F.concat(*own, *([F.lit(" length='"), length, F.lit("'")] if length is not None else []), F.lit("/>"))

    def field(name: str, value, when=F.lit(True)):
        return F.when(when, F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))).otherwise("")

    zim, opened = "application/x-zim", "http://opds-spec.org/acquisition/open-access"
    kind = F.col("p_partkey") % 4
    links = (
        F.when(F.col("p_partkey") % 5 == 0, F.lit("")).when(kind == 1, F.concat(link("x", zim, F.lit("/no.zim"), length=F.lit("1")), link(opened, "m", F.lit("/"), key, F.lit(".zim"), length=size)))
        .when(kind == 2, F.concat(link("x", zim, F.lit("http://other/"), key, length=size), link("y", zim, F.lit("/later"), length=F.lit("7"))))
        .when(kind == 3, link(opened, "m", F.lit("//third/"), key, length=F.lit("some"))).otherwise(link(opened, "m", F.lit("x"), length=size))
    )
    entry = F.concat(
        F.lit("<entry>"), field("id", key), field("name", F.col("p_brand")), field("title", F.col("p_name"), F.col("p_partkey") % 3 != 0), field("subtitle", F.col("p_type")),
        field("updated", F.concat(F.lit("D"), size)), link("http://opds-spec.org/image/thumbnail", "image/png", F.lit("/p.png"), length=F.lit("9")), links, F.lit("</entry>"))
    _paged(table(spark, sf_dir, "part").select("p_partkey", entry.alias("x")), "feed", f"{home}/feed")
    return feeds.atom_feed(spark, f"{home}/feed", "http://base/catalog/v2").select("id", "name", "title", "summary", "issued", "url", "size")


@query("SC10", sql="SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS BIGINT) AS size, p_brand AS sha256, 'http://a|http://b|http://c' AS mirrors FROM part")
def metalink_rows(spark, sf_dir):
    home = folder(spark)
    file = F.concat(
        F.lit("<file name='"), F.col("p_partkey").cast("string"), F.lit("'><size>"), F.col("p_size").cast("string"), F.lit("</size><hash type='sha-256'>"), F.col("p_brand"),
        F.lit("</hash><url priority='20'>http://b</url><url>http://c</url><url priority='3'>http://a</url></file>"))
    _paged(table(spark, sf_dir, "part").select("p_partkey", file.alias("x")), "metalink", f"{home}/links")
    return feeds.metalink(spark, f"{home}/links").select("name", "size", "sha256", F.array_join("mirrors", "|").alias("mirrors"))


def _entries(spark, sf_dir):
    """Archive entries made of pages, with a JSON sidecar for every third and a stub for every sixth of these."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("k"), "html")
    flag, no = F.lit(False).alias("is_redirect"), F.lit(None).cast("string").alias("redirect_target")
    html = pages.select(F.lit(1).alias("zim_id"), F.concat(F.lit("A/"), "k").alias("path"), F.lit("text/html; charset=utf-8").alias("mimetype"), F.col("html").alias("content"), flag, no)
    side = pages.where("page_id % 3 = 0").select(
        F.lit(1).alias("zim_id"), F.concat(F.lit("v/"), "k", F.lit(".json")).alias("path"), F.lit("application/json").alias("mimetype"),
        F.concat(F.lit('{"videoPath": "'), "k", F.lit('.webm", "duration": "PT1M"}')).alias("content"), flag, no)
    stub = pages.where("page_id % 6 = 0").select(F.lit(1).alias("zim_id"), F.concat(F.lit("index/"), "k").alias("path"), F.lit("text/html").alias("mimetype"), F.lit("").alias("content"), F.lit(True).alias("is_redirect"), F.concat(F.lit("A/"), "k").alias("redirect_target"))
    return html.unionByName(side).unionByName(stub)


@query("SC7", sql="SELECT 'index/' || page_id AS path, page_id || '.webm' AS video FROM pages WHERE page_id % 6 = 0")
def media_sidecar_rows(spark, sf_dir):
    return feeds.media_sidecars(_entries(spark, sf_dir)).select("path", "video")


@query("SC1", sql="SELECT 'A/' || page_id AS path FROM pages")
def text_entry_scan(spark, sf_dir):
    return feeds.text_entries(_entries(spark, sf_dir)).select("path")


@query("SC8", "SC2", sql="SELECT 'A/' || page_id AS doc_path, 'T' || page_id AS title FROM pages")
def document_manifest_rows(spark, sf_dir):
    k = F.col("page_id").cast("string")
    record = F.concat(F.lit("{'_id': 1, 'ti': 'T"), k, F.lit("', \"aut\": 'x', 'fp': ['A/"), k, F.lit("', 'other']}"))
    scripts = table(spark, sf_dir, "pages").select(F.lit(1).alias("zim_id"), F.concat(F.lit("var DATABASE = ["), record, F.lit(", {'ti': 'gone', 'fp': ['none']}];")).alias("content"))
    return feeds.document_manifest(scripts, _entries(spark, sf_dir)).select("doc_path", "title")


@query("ST9", sql="SELECT doc_id AS question_id, coalesce(CAST(quality AS VARCHAR), 'pending') AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def pending_then_judged(spark, sf_dir):
    """Rows written as pending, then judged by key in a second step."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.lit("pending").alias("verdict"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").cast("string").alias("verdict"))
    return sinks.upserted(docs, judged, ["question_id"])


@query("SK10", "JN17", sql="""SELECT event_id, event_id // 50 AS run_id, CASE WHEN min(ts) OVER (PARTITION BY event_id // 50) < (SELECT max(ts) FROM events) - INTERVAL 9 DAY THEN NULL ELSE props END AS trace FROM events""")
def trace_prune(spark, sf_dir):
    """Traces of a table of runs pruned by when their run began; partitions without such runs are left as they are."""
    events, path = table(spark, sf_dir, "events"), f"{folder(spark)}/traces"
    rows = events.select("event_id", F.floor(F.col("event_id") / 50).alias("run_id"), F.col("props").alias("trace"), F.col("ts").alias("at"))
    runs = rows.groupBy("run_id").agg(F.min("at").alias("started_at"))
    rows.select("event_id", "run_id", "trace", F.floor(F.col("run_id") / 20).cast("int").alias("part")).write.partitionBy("part").parquet(path)
    newest = rows.agg(F.max("at")).first()[0]
    sinks.prune_traces(spark, path, runs, 0, F.lit(newest))
    sinks.prune_traces(spark, path, runs, 9, F.lit(newest))
    return spark.read.parquet(path).select("event_id", "run_id", "trace")
