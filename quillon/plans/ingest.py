"""Queries over ingestion: entries, titles, text clean-up, enrichment, sections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import spans
from quillon.functions import text as T
from quillon.operators import ingest
from quillon.plans.registry import query
from quillon.plans.search import DOCS
from quillon.sources.tables import articles, questions, table

H1 = r"regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"


@query("TX16", "TX15", "FI3", sql=f"""WITH p AS (SELECT page_id, html, {H1} AS title FROM pages)
SELECT page_id, CASE WHEN octet_length(encode(html)) <= 600 AND regexp_matches(html, '(?i)<meta\\s+http-equiv\\s*=\\s*["'']?refresh') THEN 2 ELSE 0 END
  + CASE WHEN lower(trim(title)) LIKE '%(disambiguation)' OR contains(left(html, 4096), 'mw-disambig') OR contains(left(html, 4096), 'disambigbox') OR contains(left(html, 4096), 'dmbox') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(lower(trim(title)), '^(list|lists|timeline|index|glossary) of ') THEN 8 ELSE 0 END
  + CASE WHEN length(html) > 0 AND length(html) < 1200 THEN 16 ELSE 0 END AS flags FROM p""")
def entry_classify_flags(spark, sf_dir):
    html = F.col("html")
    pages = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract(html, r"<h1[^>]*>([^<]*)</h1>", 1))
    return pages.select("page_id", T.entry_flags(F.col("title"), html, F.lit(False), F.length(html)).alias("flags"))


@query("FI3", "FI4", sql="SELECT count(*) AS n FROM documents WHERE trim(text) <> ''")
def skip_flag_filter(spark, sf_dir):
    docs = articles(spark, sf_dir)
    flags = T.entry_flags(F.col("title"), F.lit(""), F.lit(False), F.col("n_chars"))
    return docs.where((flags.bitwiseAND(T.SKIPPED) == 0) & (F.trim("text") != "")).agg(F.count("*").alias("n"))


@query("SC1", sql=f"SELECT page_id, {H1} AS heading, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("bigint").alias("paragraphs"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("TX19", "TX21", sql=r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS clean FROM documents""")
def plain_text_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_text(F.col("text")).alias("clean"))


@query("TX19", sql=r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(trim(x), '^#{1,6}\s+', ''), '\*\*|__|`', '', 'g'),
  '\[([^\]]+)\]\([^)]*\)', '\1', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents""")
def plain_markdown_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_text(F.col("text")).alias("clean"))


@query("TX8", sql=r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> '')) AS n FROM documents""")
def sentence_split_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n"))


@query("SC16", sql="""SELECT event_type AS mime, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events) GROUP BY event_type""")
def mime_counter_histogram(spark, sf_dir):
    """Counters written as mime=n;mime=n, read back by the last equals sign and summed."""
    line = F.concat_ws("=", F.col("event_type"), F.get_json_object("props", "$.k"))
    written = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(line), ";").alias("counter"))
    return ingest.counters(written, "counter")


@query("JN5", "JN6", sql=r"""SELECT doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN 'Q' || doc_id ELSE '' END, ''), array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:4], ' ')) AS title, toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
def enrich_left_join_title_override(spark, sf_dir):
    manifest = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("Q"), F.col("doc_id").cast("string"))).otherwise("").alias("manifest_title"), "toxic")
    return ingest.enriched(articles(spark, sf_dir).select("doc_id", "title"), manifest, "doc_id")


@query("TX7", "TX34", "TX31", sql=r"""SELECT page_id, lower(trim(replace(list_last(string_split(regexp_replace(p, '^(\./|/)', ''), '/')), '_', ' '))) AS title_key, regexp_replace(trim(p), '^A/', '') AS match_path
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]+(.*)$', 1), '[?#].*$', '') AS p FROM pages)""")
def entry_title_keys(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", "://[^/]+(.*)$", 1), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", T.title_key(path).alias("title_key"), T.match_path(path).alias("match_path"))


@query(sql="SELECT page_id, regexp_replace(url, '#.*$', '') AS path, contains(url, '#') AS had_fragment FROM pages")
def point_read(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("path"), F.contains("url", F.lit("#")).alias("had_fragment"))


@query("JN11", "WN6", sql=r"""WITH s AS (SELECT doc_id, n_chars, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS line FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, n_chars, no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT doc_id, max(no) AS section, max(start) AS start FROM c WHERE start <= n_chars // 2 GROUP BY doc_id""")
def section_asof_offset(spark, sf_dir):
    """The section (line) at the middle of each document: the last one that starts at or before it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.split("text", "\n").alias("ls"))
    starts = F.aggregate(F.slice("ls", F.lit(1), F.size("ls") - 1), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
    reached = F.filter(starts, lambda s: s <= F.floor(F.col("n_chars") / 2))
    return lines.select("doc_id", (F.size(reached) - 1).cast("bigint").alias("section"), F.element_at(reached, -1).cast("bigint").alias("start"))


@query("JN12", sql="""SELECT a.conv_id, a.turn, count(*) AS neighbours FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND a.turn <> b.turn GROUP BY a.conv_id, a.turn""")
def section_neighbour_band_join(spark, sf_dir):
    return ingest.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 1)


@query("TX14", "FO2", "MA6", sql=f"""WITH {DOCS}, items AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({", ".join(repr(w) for w in T.STOPWORDS)}))) AS terms FROM benchmark),
c AS (SELECT zim_id, doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM docs), n AS (SELECT zim_id, count(*) AS n FROM c GROUP BY zim_id),
p AS (SELECT zim_id, doc_id, unnest(t) AS term FROM c), df AS (SELECT zim_id, term, count(*) AS df FROM p GROUP BY zim_id, term), q AS (SELECT item_id, unnest(terms) AS term FROM items)
SELECT item_id, zim_id, doc_id, round(sum(ln(1 + n / (1 + df))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (zim_id, term) JOIN n USING (zim_id) GROUP BY item_id, zim_id, doc_id""")
def idf_passage_scores(spark, sf_dir):
    """FO2 for every question over every archive, each archive a set of its own."""
    asked = questions(spark, sf_dir).select("item_id", F.explode(F.array_distinct(T.content_terms(F.col("passage")))).alias("term"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    docs = articles(spark, sf_dir)
    own = docs.select("zim_id", "doc_id", F.explode(found).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = own.groupBy("zim_id", "term").agg(F.count("*").alias("df"))
    sizes = docs.groupBy("zim_id").agg(F.count("*").alias("n"))
    idf = df.join(sizes, "zim_id").select("zim_id", "term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))
    rows = own.join(idf, ["zim_id", "term"]).join(asked, "term")
    return rows.groupBy("item_id", "zim_id", "doc_id").agg(F.round(F.sum("idf"), 6).alias("score"))


@query("TX10", "TX11", sql=r"""SELECT doc_id, CASE WHEN trim(lang) <> '' THEN array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:4], ' ') || ' > ' || lang || ' > ' || source END AS crumb FROM documents""")
def breadcrumbs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.breadcrumb(T.first_words(F.col("text"), 4), F.array("lang", F.lit(" "), "source")).alias("crumb"))


@query("MA9", sql="SELECT event_id, CASE WHEN event_id % 100 > 0 THEN CAST((event_id % 3) * 3600 + (event_id % 60) * 60 + event_id % 100 AS BIGINT) END AS seconds FROM events")
def iso_durations(spark, sf_dir):
    n = F.col("event_id")
    written = F.when(n % 100 > 0, F.concat(F.lit("PT"), (n % 3).cast("string"), F.lit("H"), (n % 60).cast("string"), F.lit("M"), (n % 100).cast("string"), F.lit("S"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", ingest.duration_seconds(written).alias("seconds"))


DRAWN = """media AS (SELECT DISTINCT page_id AS doc_id FROM pages WHERE html LIKE '%<li>%'),
d AS (SELECT doc_id, source, (length(trim(text)) >= 400 OR doc_id IN (SELECT doc_id FROM media)) AS good FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('11-' || doc_id), doc_id) AS nth FROM d)"""


def _good(spark, sf_dir):
    """Documents, and whether they are good to show: 400 characters, or a page of the same number with a list (for those with media)."""
    media = table(spark, sf_dir, "pages").where(F.contains("html", F.lit("<li>"))).select(F.col("page_id").alias("doc_id"), F.lit(True).alias("media")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length(F.trim("text")).alias("size")).join(media, "doc_id", "left")
    return docs.select("doc_id", "source", ((F.col("size") >= 400) | F.coalesce("media", F.lit(False))).alias("good"))


@query("SC6", sql=f"WITH {DRAWN} SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY nth) - 1 AS place FROM n WHERE good AND nth <= 48 QUALIFY place < 6")
def random_samples(spark, sf_dir):
    """Six different articles of each archive that are not empty, or have media, of 48 tried at most."""
    return ingest.samples(_good(spark, sf_dir), "source", "doc_id", F.col("good"), 6, 11).select("source", "doc_id", F.col("place").cast("bigint").alias("place"))


@query("SC5", sql=f"WITH {DRAWN} SELECT source, CASE WHEN bool_or(good) THEN arg_min(doc_id, nth) FILTER (WHERE good) ELSE arg_max(doc_id, nth) END AS doc_id FROM n WHERE nth <= 5 GROUP BY source")
def random_entry(spark, sf_dir):
    """An article of each archive: the first good one of five draws, else the last."""
    return ingest.random_entry(_good(spark, sf_dir), "source", "doc_id", F.col("good"), 11).select("source", "doc_id")


@query("TX28", sql=r"""SELECT event_id, json_extract_string(regexp_extract('```json ' || props || ' ``` done', '\{.*\}', 0), '$.k') AS k FROM events""")
def json_from_fences(spark, sf_dir):
    """A value out of JSON that stands in a fence among other text; null where it is malformed."""
    fenced = F.concat(F.lit("```json "), "props", F.lit(" ``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(F.regexp_extract(fenced, r"(?s)\{.*\}", 0), "$.k").alias("k"))


@query("TX24", sql=r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(\n\s*(\[[0-9]+\]\s*)+)+$', ''), '^(Here is|Based on)[^\n.]*[.:]\s*', '')) AS answer FROM conversations""")
def answer_cleanup(spark, sf_dir):
    bare = F.regexp_replace("text", r"(\n\s*(\[[0-9]+\]\s*)+)+$", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(bare, r"^(Here is|Based on)[^\n.]*[.:]\s*", "")).alias("answer"))


@query("MA4", sql="SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS chance FROM events")
def sigmoid_scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 10)), 6).alias("chance"))
