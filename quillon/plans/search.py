"""Queries over lexical search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import spans
from quillon.functions import text as T
from quillon.operators import inverted, ranking, search
from quillon.plans.registry import query
from quillon.sources.tables import articles, folder, kept, questions

STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
INERT = ", ".join(f"'{w}'" for w in T.INERT)

DOCS = r"""docs AS (
  SELECT doc_id, 'doc_' || doc_id AS path, CAST(substr(source, 4) AS INTEGER) AS zim_id, text, lang, n_chars,
    regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks,
    array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:4], ' ') AS title
  FROM documents)"""
POSTINGS = "post AS (SELECT zim_id, path, term, count(*) AS tf FROM (SELECT zim_id, path, unnest(toks) AS term FROM docs) GROUP BY ALL)"
RAW = r"array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:8], ' ')"
ITEMS = rf"""raws AS (SELECT item_id, text AS passage, {RAW} AS raw FROM benchmark),
lad AS (SELECT *, list_filter(regexp_extract_all(lower(raw), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN ({INERT})) AS lterms FROM raws),
lads AS (SELECT *, list_filter(lterms, lambda t: t NOT IN ({STOPS})) AS sterms FROM lad),
chosen AS (SELECT *, CASE WHEN len(sterms) > 0 THEN sterms ELSE lterms END AS every FROM lads),
items AS (SELECT *, list_filter(every, lambda t, i: list_position(every, t) = i) AS terms FROM chosen)"""
SIZES = "sizes AS (SELECT zim_id, count(*) AS n, avg(len(toks)) AS avgdl FROM docs GROUP BY zim_id)"
ASKED = "asked AS (SELECT item_id, len(terms) AS n_terms, unnest(terms) AS term FROM items)"
SCORED = """frequent AS (SELECT zim_id, term, count(*) AS df FROM post GROUP BY ALL),
lens AS (SELECT zim_id, path, len(toks) AS dl FROM docs),
scored AS (
  SELECT item_id, n_terms, zim_id, path, count(*) AS n_met,
    sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN post USING (term) JOIN frequent USING (zim_id, term) JOIN sizes USING (zim_id) JOIN lens USING (zim_id, path)
  GROUP BY item_id, n_terms, zim_id, path)"""
BASE = f"WITH {DOCS}, {POSTINGS}, {ITEMS}, {SIZES}, {ASKED}, {SCORED}"
CANDIDATES = """fts AS (
  SELECT item_id, zim_id, path, 'fts' AS source, row_number() OVER (PARTITION BY item_id, zim_id ORDER BY round(score, 9) DESC, path) - 1 AS rank
  FROM scored WHERE n_met = n_terms),
anyt AS (
  SELECT item_id, zim_id, path, 'any' AS source, row_number() OVER (PARTITION BY item_id, zim_id ORDER BY round(score, 9) DESC, path) - 1 AS rank
  FROM scored),
cand AS (SELECT * FROM fts WHERE rank < 40 UNION ALL SELECT * FROM anyt WHERE rank < 5)"""


def asked(spark, sf_dir):
    return questions(spark, sf_dir).withColumn("terms", T.search_terms(F.col("raw")))


def candidates(spark, sf_dir, index=None):
    """Two sources of candidates: all terms (40 of each archive) and any term (5).

    Both are read off the best 40 of the articles with all terms and of the others, so that articles are scored once."""
    found = search.matches(asked(spark, sf_dir), articles(spark, sf_dir), every=False, index=index)
    best = kept(search.ranked(found.withColumn("full", F.col("n_met") == F.col("n_terms")), 40, "item_id", "zim_id", "full"))
    full = best.where("full").withColumn("source", F.lit("fts"))
    some = search.ranked(best, 5, "item_id", "zim_id").withColumn("source", F.lit("any"))
    return full.unionByName(some).select("item_id", "zim_id", "path", "source", F.col("rank").cast("bigint").alias("rank"))


@query("TX2", "SC11", sql=f"WITH {DOCS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM docs) GROUP BY term")
def tok_inverted_index_df(spark, sf_dir):
    return search.document_frequencies(search.terms_of(articles(spark, sf_dir)))


@query("TX2", sql=f"WITH {DOCS}, {POSTINGS} SELECT zim_id, path, term, tf, len(toks) AS dl FROM post JOIN docs USING (zim_id, path)")
def inverted_index_postings(spark, sf_dir):
    return search.postings(articles(spark, sf_dir)).withColumn("dl", F.col("dl").cast("bigint"))


@query("TX1", "TX3", "FI12", "QP1", sql=rf"""
WITH raws AS (SELECT item_id, {RAW} AS raw FROM benchmark),
words AS (SELECT item_id, raw, list_filter(regexp_split_to_array(translate(lower(trim(raw)), '?"''', '   '), '\s+'), lambda w: w <> '') AS ws FROM raws),
less AS (SELECT *, list_filter(ws, lambda t: t NOT IN ({STOPS})) AS s FROM words),
one AS (SELECT *, CASE WHEN len(s) > 0 THEN s ELSE ws END AS t1 FROM less),
two AS (SELECT *, list_filter(t1, lambda t: t NOT IN ({INERT})) AS t2 FROM one)
SELECT item_id, array_to_string(CASE WHEN len(t2) > 0 THEN t2 ELSE t1 END, '|') AS terms,
  NOT (raw LIKE '%?' OR lower(regexp_split_to_array(trim(raw), '\s+')[1]) IN ({", ".join(repr(w) for w in T.QUESTION_WORDS)})) AS is_keyword FROM two""")
def query_normalize_terms(spark, sf_dir):
    raw = F.col("raw")
    return questions(spark, sf_dir).select("item_id", F.array_join(T.query_terms(raw), "|").alias("terms"), (~T.is_question(raw)).alias("is_keyword"))


@query("TX4", sql=f"""
WITH {ITEMS}, rungs AS (
  SELECT item_id, 0 AS no, 'all_terms' AS name, array_to_string(lterms, '|') AS terms, CAST(NULL AS VARCHAR) AS prefix FROM items WHERE len(sterms) > 0
  UNION ALL SELECT item_id, 1, 'stopword_stripped', array_to_string(sterms, '|'), NULL FROM items WHERE len(sterms) > 0 AND len(sterms) < len(lterms)
  UNION ALL SELECT item_id, 2, 'or_of_terms', array_to_string(sterms, '|'), NULL FROM items WHERE len(sterms) > 0
  UNION ALL SELECT item_id, 3, 'title', '', trim(raw) FROM items)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY no) - 1 AS rung_no, name, terms, prefix FROM rungs""")
def query_ladder_rungs(spark, sf_dir):
    rungs = questions(spark, sf_dir).select("item_id", F.posexplode(search.ladder(F.col("raw"))).alias("rung_no", "r"))
    return rungs.select("item_id", F.col("rung_no").cast("bigint").alias("rung_no"), "r.name", F.array_join("r.terms", "|").alias("terms"), "r.prefix")


@query("SC11", "CS1", "WN1", sql=f"{BASE}, {CANDIDATES} SELECT f.item_id, f.zim_id, f.path, rank, round(score, 6) AS score FROM fts f JOIN scored USING (item_id, zim_id, path) WHERE rank < 40")
def fts_and_match_bm25(spark, sf_dir):
    found = search.ranked(search.matches(asked(spark, sf_dir), articles(spark, sf_dir)), 40, "item_id", "zim_id")
    return found.select("item_id", "zim_id", "path", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("SE5", sql=f"""
WITH {DOCS}, {POSTINGS}, {ITEMS}, {SIZES}, asked AS (SELECT item_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS term_no FROM items),
frequent AS (SELECT zim_id, term, count(*) AS df FROM post GROUP BY ALL), lens AS (SELECT zim_id, path, len(toks) AS dl FROM docs),
hits AS (
  SELECT item_id, term_no, zim_id, path, row_number() OVER (PARTITION BY item_id, term_no, zim_id ORDER BY
    round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) DESC, path) - 1 AS r
  FROM asked JOIN post USING (term) JOIN frequent USING (zim_id, term) JOIN sizes USING (zim_id) JOIN lens USING (zim_id, path)),
firsts AS (SELECT item_id, zim_id, path, min(term_no * 1000 + r) AS f FROM hits WHERE r < 20 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, zim_id ORDER BY f, path) - 1 AS rank FROM firsts)
SELECT item_id, zim_id, path, rank FROM placed WHERE rank < 20""")
def fts_or_of_terms_union(spark, sf_dir):
    found = search.any_term(asked(spark, sf_dir), articles(spark, sf_dir), 20)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query("TX4", "SC11", "CS1", sql=f"""
{BASE}, hits AS (
  SELECT item_id, 0 AS rung_no, count(*) AS n FROM scored WHERE n_met = n_terms GROUP BY item_id
  UNION ALL SELECT item_id, 1, count(*) FROM scored GROUP BY item_id)
SELECT item_id, CASE min(rung_no) WHEN 0 THEN 'all_terms' ELSE 'or_of_terms' END AS rung, CAST(arg_min(n, rung_no) AS BIGINT) AS n_hits FROM hits GROUP BY item_id""")
def ladder_first_nonempty(spark, sf_dir):
    """Each query's first rung with any hit: the second counts only for queries without rows from the first."""
    found = search.matches(asked(spark, sf_dir), articles(spark, sf_dir), every=False)
    by_item = found.groupBy("item_id").agg(F.count_if(F.col("n_met") == F.col("n_terms")).alias("full"), F.count("*").alias("some"))
    return by_item.select(
        "item_id", F.when(F.col("full") > 0, "all_terms").otherwise("or_of_terms").alias("rung"), F.when(F.col("full") > 0, F.col("full")).otherwise(F.col("some")).alias("n_hits")
    )


@query("SC12", "CS2", sql=rf"""
WITH {DOCS}, raws AS (SELECT item_id, lower(regexp_split_to_array(trim(text), '\s+')[1]) AS prefix FROM benchmark),
hits AS (SELECT item_id, zim_id, path, row_number() OVER (PARTITION BY item_id, zim_id ORDER BY lower(title), path) - 1 AS rank
  FROM raws JOIN docs ON starts_with(lower(title), prefix) WHERE prefix <> '')
SELECT * FROM hits WHERE rank < 36""")
def title_prefix_suggest(spark, sf_dir):
    asked_titles = questions(spark, sf_dir).select("item_id", F.split(F.trim("raw"), r"\s+")[0].alias("prefix"))
    return search.titles_with_prefix(asked_titles, articles(spark, sf_dir), 36).withColumn("rank", F.col("rank").cast("bigint"))


ALIASES = "aliases AS (SELECT DISTINCT toks[1] AS source, toks[2] AS target FROM docs WHERE len(toks) >= 2)"


def alias_table(spark, sf_dir):
    """Aliases read off the articles: the first token of a text stands for the second."""
    toks = T.tokens(F.col("text"))
    return articles(spark, sf_dir).where(F.size(toks) >= 2).select(toks[0].alias("source"), toks[1].alias("target")).distinct()


@query("JN3", "QP2", sql=f"""
WITH {DOCS}, {ITEMS}, {ALIASES},
hit AS (SELECT DISTINCT item_id, target FROM (SELECT item_id, terms, unnest(terms) AS source FROM items) JOIN aliases USING (source) WHERE NOT list_contains(terms, target)),
top AS (SELECT item_id, target FROM hit QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY target) <= 3),
added AS (SELECT item_id, string_agg(target, '|' ORDER BY target) AS added FROM top GROUP BY item_id)
SELECT item_id, array_to_string(terms, '|') || coalesce('|' || added, '') AS terms, coalesce(added, '') AS added FROM items LEFT JOIN added USING (item_id)""")
def alias_expand_join(spark, sf_dir):
    out = search.expand_aliases(asked(spark, sf_dir), alias_table(spark, sf_dir))
    return out.select("item_id", F.array_join("terms", "|").alias("terms"), F.array_join("added", "|").alias("added"))


@query("JN4", "CS4", sql=f"""
WITH {DOCS}, {ITEMS}, {ALIASES},
hit AS (SELECT DISTINCT item_id, target FROM (SELECT item_id, unnest(terms) AS source FROM items) JOIN aliases USING (source)),
top AS (SELECT item_id, target FROM hit QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY target) <= 5),
met AS (SELECT DISTINCT item_id, zim_id, path FROM top JOIN docs ON toks[1] = target)
SELECT item_id, zim_id, path, row_number() OVER (PARTITION BY item_id, zim_id ORDER BY path) - 1 AS rank FROM met""")
def alias_title_resolve(spark, sf_dir):
    terms = asked(spark, sf_dir).select("item_id", F.explode("terms").alias("source"))
    hit = terms.join(alias_table(spark, sf_dir), "source").select("item_id", "target").distinct()
    top = ranking.restart_ranks(hit, ["item_id"], ["target"]).where("rank < 5").select("item_id", "target")
    toks = T.tokens(F.col("text"))
    named = articles(spark, sf_dir).where(F.size(toks) > 0).select("zim_id", "path", toks[0].alias("target"))
    met = named.join(top, "target").select("item_id", "zim_id", "path").distinct()
    return ranking.restart_ranks(met, ["item_id", "zim_id"], ["path"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("WN5", sql=f"""
WITH {DOCS}, {ALIASES} SELECT target, source, CAST(n AS BIGINT) AS n FROM (
  SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM (SELECT source, min(target) AS target FROM aliases GROUP BY source)) WHERE n <= 30""")
def alias_cap_per_target(spark, sf_dir):
    first = alias_table(spark, sf_dir).groupBy("source").agg(F.min("target").alias("target"))
    return ranking.restart_ranks(first, ["target"], ["source"]).select("target", "source", (F.col("rank") + 1).cast("bigint").alias("n")).where("n <= 30")


@query("TX5")
def entity_spans(spark, sf_dir):
    return spans.with_entity_spans(questions(spark, sf_dir).select("item_id", "passage"), "passage").select("item_id", "spans")


@query("CS3", "TX6")
def title_entity_suggest(spark, sf_dir):
    asked_spans = spans.with_entity_spans(questions(spark, sf_dir).select("item_id", "passage"), "passage").select("item_id", "spans")
    return search.titles_of_spans(asked_spans, articles(spark, sf_dir))


@query("RC1", sql=f"""WITH {DOCS}, {POSTINGS}, {ITEMS}, forms AS (SELECT item_id, 0 AS v, terms FROM items UNION ALL SELECT item_id, 1, terms[1:3] FROM items WHERE len(terms) >= 4 UNION ALL SELECT item_id, 2, terms[1:2] FROM items WHERE len(terms) >= 4),
met AS (SELECT item_id, v, zim_id, path, count(*) / any_value(n) AS share FROM (SELECT item_id, v, len(terms) AS n, unnest(terms) AS term FROM forms) JOIN post USING (term) GROUP BY item_id, v, zim_id, path),
tops AS (SELECT item_id, coalesce(max(share) FILTER (WHERE v = 0), 0) AS a, coalesce(max(share) FILTER (WHERE v = 1), 0) AS b, coalesce(max(share) FILTER (WHERE v = 2), 0) AS c FROM forms LEFT JOIN met USING (item_id, v) GROUP BY item_id),
one AS (SELECT *, CASE WHEN a < 0.9 AND b > a THEN 1 ELSE 0 END AS v1, CASE WHEN a < 0.9 AND b > a THEN b ELSE a END AS t1 FROM tops)
SELECT item_id, CASE WHEN t1 < 0.9 AND c > t1 THEN 2 ELSE v1 END AS variant, CASE WHEN t1 < 0.9 AND c > t1 THEN c ELSE t1 END AS top FROM one""")
def prefix_shorten_retry(spark, sf_dir):
    return search.shortened(asked(spark, sf_dir), articles(spark, sf_dir), 0.9)


def _asked_runs(spark, sf_dir):
    """item_id and spans: the runs of three words of a question's text."""
    words = F.filter(F.split(F.trim("passage"), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3))
    return questions(spark, sf_dir).select("item_id", F.transform(starts, lambda i: F.array_join(F.slice(words, i, 3), " ")).alias("spans"))


@query("RC4", "AG28", sql=rf"""{BASE}, {CANDIDATES},
ws AS (SELECT item_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS w FROM benchmark),
runs AS (SELECT item_id, unnest(range(1, greatest(len(w) - 2, 1) + 1, 3)) AS i, w FROM ws),
spans AS (SELECT item_id, (i - 1) // 3 AS span_no, array_to_string(w[i:i + 2], ' ') AS span FROM runs),
texts AS (SELECT zim_id, path, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS t FROM docs SEMI JOIN cand USING (zim_id, path)),
held AS (SELECT DISTINCT item_id, span_no FROM spans JOIN (SELECT DISTINCT item_id, zim_id, path FROM cand) USING (item_id) JOIN texts USING (zim_id, path) WHERE contains(t, lower(span)))
SELECT item_id, CAST(span_no AS INTEGER) AS span_no, span FROM spans ANTI JOIN held USING (item_id, span_no)""")
def uncovered_spans(spark, sf_dir):
    """The runs of three words of a question's text that none of its candidates holds."""
    return search.uncovered(_asked_runs(spark, sf_dir), candidates(spark, sf_dir), articles(spark, sf_dir))


@query("RC4")
def coverage_search(spark, sf_dir):
    """Titles that start with the first span of a question (a name, or a word) that none of its candidates holds."""
    words = F.split(F.lower(F.trim("passage")), r"\s+")
    own = questions(spark, sf_dir).select("item_id", F.filter(words, lambda w: F.length(w) > 0).alias("spans"))
    first = search.uncovered(own, candidates(spark, sf_dir), articles(spark, sf_dir)).groupBy("item_id").agg(F.array(F.min(F.struct("span_no", "span"))["span"]).alias("spans"))
    return search.titles_of_spans(first, articles(spark, sf_dir))


@query("SC11", "TX2", "CS1", sql=f"{BASE}, {CANDIDATES} SELECT f.item_id, f.zim_id, f.path, rank, round(score, 6) AS score FROM fts f JOIN scored USING (item_id, zim_id, path) WHERE rank < 10")
def stored_index_topk(spark, sf_dir):
    """The ten best articles of each archive with all terms, from an index written to the shared folder."""
    path = f"{folder(spark)}/index"
    inverted.write_index(articles(spark, sf_dir), path)
    found = inverted.top_k(spark, path, asked(spark, sf_dir), 10).rows
    return found.select("item_id", "zim_id", "path", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("AG39", sql=f"""{BASE}, {CANDIDATES}, hit AS (SELECT DISTINCT item_id FROM fts), t AS (SELECT DISTINCT item_id FROM items JOIN docs ON lower(title) LIKE lower(split_part(raw, ' ', 1)) || '%')
SELECT count(*) AS n, count(*) FILTER (WHERE hit.item_id IS NULL) AS missed, count(*) FILTER (WHERE hit.item_id IS NULL AND t.item_id IS NOT NULL) AS missed_with_title
FROM items LEFT JOIN hit ON hit.item_id = items.item_id LEFT JOIN t ON t.item_id = items.item_id""")
def probe_partition(spark, sf_dir):
    """How many questions the all-terms search misses, and how many of these a title that starts like them could still reach."""
    items = asked(spark, sf_dir).select("item_id", F.lower(F.split("raw", " ")[0]).alias("word"))
    hit = candidates(spark, sf_dir).where("source = 'fts'").select("item_id").distinct().withColumn("hit", F.lit(True))
    starts = search.titles_with_prefix(items.select("item_id", F.col("word").alias("prefix")), articles(spark, sf_dir), 1)
    titled = starts.select("item_id").distinct().withColumn("titled", F.lit(True))
    rows = items.join(hit, "item_id", "left").join(titled, "item_id", "left")
    missed = F.col("hit").isNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(missed).alias("missed"), F.count_if(missed & F.col("titled").isNotNull()).alias("missed_with_title"))
