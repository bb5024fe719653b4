"""Queries over passages, scoring and context assembly, and the whole retrieval pipeline."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import assembly, greedy, passages, windows
from quillon.plans import pipeline
from quillon.plans.registry import query
from quillon.plans.search import BASE, CANDIDATES, DOCS, asked, candidates
from quillon.sources.tables import articles, kept, questions, small, table


def scored(spark, sf_dir):
    """Passages of each question's fused candidates with their lexical scores."""
    return pipeline.run(spark, articles(spark, sf_dir), questions(spark, sf_dir), pipeline.PROFILES["lexical"], until="passage_scorer").passages


@query("CS1", "FU1", "PB1", "SR1", "AS4", "AS6", "SC15", "UD1", "UD2", "UD7")
def retrieve_hybrid(spark, sf_dir):
    """The pipeline end to end: prepare, search, fuse, split, score, assemble; the cards of each question."""
    return pipeline.run(spark, articles(spark, sf_dir), questions(spark, sf_dir), pipeline.PROFILES["hybrid"]).cards


@query("PB2", "TX9")
def passages_sentence_chunks(spark, sf_dir):
    rows = passages.split(articles(spark, sf_dir))
    return rows.select("zim_id", "path", "ordinal", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@query("DP1", "PB2")
def index_chunks_depth(spark, sf_dir):
    docs = articles(spark, sf_dir)
    depths = [passages.index_chunks(docs, d).withColumn("depth", F.lit(d)) for d in (1, 2, 3)]
    every = depths[0].unionByName(depths[1]).unionByName(depths[2])
    return every.groupBy("depth", "path").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def _with_texts(spark, sf_dir, found):
    """item_id, zim_id, path, terms and text of candidates, each once. Texts stay where they are."""
    own = found.select("item_id", "zim_id", "path").distinct().join(asked(spark, sf_dir).select("item_id", "terms"), "item_id")
    return articles(spark, sf_dir).select("zim_id", "path", "text").join(small(own), ["zim_id", "path"])


@query("SR1", sql=f"""{BASE}, {CANDIDATES}, c AS (SELECT DISTINCT item_id, zim_id, path FROM cand)
SELECT item_id, zim_id, path, round(len(list_filter(terms, lambda t: length(t) > 1 AND contains(lower(text), t))) / len(list_filter(terms, lambda t: length(t) > 1)), 6) AS score
FROM c JOIN items USING (item_id) JOIN docs USING (zim_id, path) WHERE len(list_filter(terms, lambda t: length(t) > 1)) > 0""")
def score_lexical_overlap(spark, sf_dir):
    rows = _with_texts(spark, sf_dir, candidates(spark, sf_dir))
    terms = F.filter("terms", lambda t: F.length(t) > 1)
    return rows.where(F.size(terms) > 0).select("item_id", "zim_id", "path", F.round(pipeline.lexical_overlap(F.col("text"), F.col("terms")), 6).alias("score"))


@query("AS1", "WN8", "SO6", sql=f"""WITH {DOCS}, c AS (SELECT *, row_number() OVER (PARTITION BY zim_id, lang ORDER BY n_chars DESC, path) AS nth FROM docs),
k AS (SELECT *, sum(len(toks)) OVER (PARTITION BY zim_id ORDER BY n_chars DESC, path) AS used, row_number() OVER (PARTITION BY zim_id ORDER BY n_chars DESC, path) - 1 AS place FROM c WHERE nth <= 2)
SELECT zim_id, path, place, CAST(used AS BIGINT) AS used FROM k WHERE used <= 2400 OR place = 0""")
def assemble_cap_budget_window(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("size", F.size(T.tokens(F.col("text"))).cast("bigint"))
    out = windows.within_budget(rows, "zim_id", [F.desc("n_chars"), F.col("path")], F.col("size"), 2400, "lang", 2)
    return out.select("zim_id", "path", "place", "used")


@query("AS2", "AS1", "FI11")
def assemble_topk_budget(spark, sf_dir):
    return assembly.assemble(scored(spark, sf_dir), "topk_budget")


@query("AS3", "JN12")
def assemble_section_window(spark, sf_dir):
    return assembly.assemble(scored(spark, sf_dir), "section_window")


@query("AS4", "SR4")
def assemble_lead_boost(spark, sf_dir):
    return assembly.assemble(scored(spark, sf_dir), "lead_boost")


@query("AS5")
def assemble_diverse_mmr(spark, sf_dir):
    return assembly.assemble(scored(spark, sf_dir), "diverse")


@query("DD1", "TX13", sql=r"""WITH d AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT doc_id, source, list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS bg FROM d WHERE len(ws) > 4),
h AS (SELECT *, len(bg) AS n, min(doc_id) OVER (PARTITION BY source, bg) AS head FROM b WHERE len(bg) >= 4), u AS (SELECT * FROM h WHERE doc_id = head),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.bg, y.bg)) AS m, x.n + y.n AS n FROM u x JOIN u y ON x.source = y.source AND x.doc_id < y.doc_id AND least(x.n, y.n) > 0.85 * greatest(x.n, y.n))
SELECT head AS a, doc_id AS b, 1.0::DOUBLE AS likeness, 'same' AS kind FROM h UNION ALL SELECT a, b, round(m / (n - m), 6), 'near' FROM p WHERE m / (n - m) > 0.85""")
def near_dup_bigram_pairs(spark, sf_dir):
    """Near-duplicates within each source: a row for each document beside the least doc_id with the same bigrams (kind same), and one
    for each two such representatives that are alike (kind near)."""
    return _near_duplicates(spark, sf_dir, F.col("source"))


@query("DD1", "TX13")
def near_dup_bigram_sets(spark, sf_dir):
    """The same across sources."""
    return _near_duplicates(spark, sf_dir, F.lit(""))


@query("JN13", "DD1", "AS1")
def near_dup_greedy(spark, sf_dir):
    """What the greedy rule keeps of each source's documents, in the order of doc_id: a document goes if one kept before is alike."""
    pairs = kept(_near_duplicates(spark, sf_dir, F.col("source")))
    gone = greedy.dropped(pairs.where("kind = 'near'").select("a", "b")).withColumn("gone", F.lit(True))
    member = pairs.where("kind = 'same'").select(F.col("a").alias("node"), F.col("b").alias("doc_id"))
    return member.join(gone, "node", "left").select("doc_id", (F.col("gone").isNull() & (F.col("node") == F.col("doc_id"))).alias("kept"))


def _near_duplicates(spark, sf_dir, source):
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").where(F.size(words) > 4)
    rows = docs.select("doc_id", source.alias("source"), T.word_bigrams(F.col("text")).alias("bg")).where(F.size("bg") >= 4)
    near, member = pipeline.likely_sets(rows, 0.85)
    same = member.select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("likeness"), F.lit("same").alias("kind"))
    return same.unionByName(near.select(F.col("ha").alias("a"), F.col("hb").alias("b"), F.round("likeness", 6).alias("likeness"), F.lit("near").alias("kind")))


@query("AS6", "WN7", sql="""SELECT source, lang, count(*) AS passages, arg_max(doc_id, n_chars * 1000000 - doc_id) AS best FROM documents GROUP BY source, lang""")
def cards_best_passage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("passages"), F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id")))["id"].alias("id")).select("source", "lang", "passages", (-F.col("id")).alias("best"))


@query("AG7", sql="""WITH s AS (SELECT source, list_reverse_sort(list(n_chars)) AS v, count(*) AS n FROM documents GROUP BY source), d AS (SELECT source, max(c) AS c FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2) GROUP BY source)
SELECT source, v[1] AS top_score, CASE WHEN n >= 2 AND v[1] > 0 THEN round(v[least(5, n)] / v[1], 6) END AS dropoff, round(c / n, 6) AS density FROM s JOIN d USING (source)""")
def confidence_signals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("path"), F.col("n_chars").alias("score"))
    return pipeline.confidence(docs, "source").select(F.col("source"), F.col("top_score"), F.round("dropoff", 6).alias("dropoff"), F.round("density", 6).alias("density"))


@query("TX12")
def snippet_window(spark, sf_dir):
    rows = _with_texts(spark, sf_dir, candidates(spark, sf_dir).where("rank < 3"))
    return rows.select("item_id", "zim_id", "path", T.snippet(F.col("text"), F.col("terms")).alias("snippet"))


@query("FO1", "FO2", "AG33")
def focused_view(spark, sf_dir):
    """The part of each question's best long article that bears on it, within 2000 characters."""
    first = W.partitionBy("item_id").orderBy("rank", "zim_id", "path")
    best = candidates(spark, sf_dir).where("source = 'fts'").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("item_id", "zim_id", "path")
    rows = best.join(questions(spark, sf_dir).select("item_id", F.array_distinct(T.content_terms(F.col("passage"))).alias("terms")), "item_id")
    rows = rows.join(articles(spark, sf_dir).select("zim_id", "path", "title", "text"), ["zim_id", "path"])
    none = F.array().cast("array<struct<char_start:int,char_end:int>>")
    return passages.focused_views(rows.withColumn("must", none), 2000).select("item_id", "path", "view")


@query("EV2", "MA14", "UD7")
def sweep_rounds(spark, sf_dir):
    """The lexical profile under two passage budgets: what a sweep over a parameter compares. Profiles share the stages that they begin with."""
    runs = pipeline.sweep(pipeline.PROFILES["lexical"], "topk_budget.budget=400,1200")
    out, stages = None, pipeline.Stages()
    for profile in runs:
        found = pipeline.run(spark, articles(spark, sf_dir), questions(spark, sf_dir), profile, stages=stages).selected
        own = found.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).withColumn("profile_hash", F.lit(profile.hash()))
        out = own if out is None else out.unionByName(own)
    return out
