"""Queries over sections, citations, scopes and the retrieval pipeline with all its tools, from the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import answers, catalogue, sections
from quillon.operators import vectors as V
from quillon.plans import pipeline
from quillon.plans.registry import query
from quillon.sources.tables import articles, questions, table


BODY = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside", "form"):
    BODY = f"regexp_replace({BODY}, '(?s)<{_tag}[ >].*?</{_tag}>', '', 'g')"


@query("TX18", sql=f"""WITH p AS (SELECT page_id, {BODY} AS body FROM pages)
SELECT page_id, len(levels) AS n_sections, array_to_string(list_sort(levels), ',') AS levels FROM (SELECT page_id, list_transform(regexp_extract_all(body, '<h([1-6])[ >]', 1), lambda x: CAST(x AS INTEGER)) AS levels FROM p) WHERE len(levels) > 0""")
def html_sections(spark, sf_dir):
    """How many sections the headings of each page make, and of which levels."""
    pages = table(spark, sf_dir, "pages").select(F.lit(1).alias("zim_id"), F.col("page_id").cast("string").alias("path"), F.lit("").alias("title"), "html")
    found = sections.articles(pages).select(F.col("path").cast("bigint").alias("page_id"), F.array_sort(F.transform("sections", lambda s: s["level"])).alias("levels")).where("size(levels) > 0 and levels[size(levels) - 1] > 0")
    return found.select("page_id", F.size("levels").cast("bigint").alias("n_sections"), F.array_join(F.transform("levels", lambda n: n.cast("string")), ",").alias("levels"))


def _cited(spark, sf_dir):
    """Replies that cite two of their cards, or cards that are not there: id, answer and cards."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    marks = F.concat(F.lit(" ["), (F.col("turn") % 5 + 1).cast("string"), F.lit("]["), (F.col("turn") % 3 + 1).cast("string"), F.lit("]."))
    return turns.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), marks).alias("answer"), (F.col("conv_id") % 4).cast("int").alias("cards"))


@query("TX23", sql="""WITH a AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, conv_id % 4 AS cards, turn % 5 + 1 AS x, turn % 3 + 1 AS y FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(n + 1 AS INTEGER) AS answer_start, CAST(n + 4 AS INTEGER) AS answer_end, CAST(x - 1 AS INTEGER) AS source_index FROM a WHERE x <= cards
UNION ALL SELECT conv_id, turn, CAST(n + 4 AS INTEGER), CAST(n + 7 AS INTEGER), CAST(y - 1 AS INTEGER) FROM a WHERE y <= cards""")
def citation_spans(spark, sf_dir):
    """Where replies cite their cards; marks of cards that are not there are dropped."""
    return _cited(spark, sf_dir).select("conv_id", "turn", F.inline(answers.citations(F.col("answer"), F.col("cards"))))


@query("TX30", sql=r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM benchmark) SELECT item_id, length(array_to_string(ws[1:20], ' ')) AS n FROM w""")
def highlighted_lengths(spark, sf_dir):
    """The segments of each item's first words, marked by its question, put together again: nothing is lost by marking."""
    rows = questions(spark, sf_dir).select("item_id", F.array_join(F.slice(F.filter(F.split("passage", r"\s+"), lambda w: w != ""), 1, 20), " ").alias("text"), "raw")
    return rows.select("item_id", F.length(F.array_join(F.transform(answers.highlights(F.col("text"), F.col("raw")), lambda s: s["text"]), "")).cast("bigint").alias("n"))


@query("FI2", "SE3", "FI1", sql="""SELECT s_suppkey AS id, s_suppkey % 3 <> 2 AS scoped, CASE WHEN s_suppkey % 3 = 0 THEN array_to_string(list_sort(list_distinct([s_nationkey, (s_nationkey + 1) % 25])), ',') ELSE '' END AS zim_ids FROM supplier""")
def scope_tokens(spark, sf_dir):
    """Scopes asked for by name and number over archives named like the nations: two that are there, one that is not, none."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("zim_id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit("_2026.zim")).alias("filename"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("zim_id"))
    other = ((F.col("s_nationkey") + 1) % 25).cast("string")
    scope = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), F.lower("filename"), F.lit(","), other)).when(F.col("s_suppkey") % 3 == 1, F.concat("name", F.lit(", nowhere"))).otherwise(" , ")
    found = catalogue.scopes(supplier.select(F.col("s_suppkey").alias("id"), scope.alias("scope")), nation)
    return found.select("id", "scoped", F.array_join(F.transform("zim_ids", lambda i: i.cast("string")), ",").alias("zim_ids"))


@query("TX27", sql=r"""SELECT p_partkey, '"' || replace(p_name, ' ', '" "') || '" "' || p_brand || '"' AS expression FROM part""")
def catalogue_search_expression(spark, sf_dir):
    """Search expressions of names and brands with operators between them."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", catalogue.fts_query(F.concat_ws(" AND ", "p_name", F.concat(F.lit('"'), "p_brand", F.lit('" or')))).alias("expression"))


@query("TX32", sql="""SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_partkey % 5 = 0 THEN 'media' WHEN p_size % 4 = 1 THEN 'spa' WHEN p_partkey % 2 = 0 THEN 'documents' ELSE 'articles' END AS kind FROM part""")
def archive_kinds(spark, sf_dir):
    """The kind of archives by their tags, the kinds of their content, and whether they have a manifest."""
    tags = F.when(F.col("p_size") % 4 == 0, F.concat(F.lower("p_type"), F.lit(";_VIDEOS:yes"))).when(F.col("p_size") % 4 == 1, "_spa:yes")
    mimes = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("text/html"), F.lit("audio/ogg"))).otherwise(F.array(F.lit("text/html")))
    return table(spark, sf_dir, "part").select("p_partkey", catalogue.archive_kind(tags, mimes, F.col("p_partkey") % 2 == 0).alias("kind"))


@query("TX38", sql="""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'always' WHEN 2 THEN 'toggle' ELSE 'toggle' END AS mode FROM part""")
def model_thinking_modes(spark, sf_dir):
    """Whether models think aloud, by what their files are called."""
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("-Instruct-thinking", "-Thinking", "-lfm3", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select("p_partkey", catalogue.thinking_mode(F.concat(F.lit("m/"), F.translate("p_name", " ", "-"), kind, F.lit(".gguf"))).alias("mode"))


@query("QP2", "QP3", "CS4", "CS5", "SR2", "SR3", "UD3", "UD7")
def retrieve_with_tools(spark, sf_dir):
    """The hybrid profile with all its tools, so that no component drops out: aliases from each archive's titles, a hashing encoder for
    queries, passages and article vectors, a cross-encoder that counts shared words, and earlier questions to rewrite by."""
    docs, asked = articles(spark, sf_dir), questions(spark, sf_dir)
    first = F.row_number().over(W.partitionBy("source").orderBy("target"))
    aliases = docs.select(F.lower(F.split("title", " ")[0]).alias("source"), F.lower("title").alias("target")).where("source <> '' and source <> target").distinct().withColumn("nth", first).where("nth <= 3").drop("nth")
    held = docs.select(F.col("doc_id").alias("vec_id"), "zim_id", "path", V.hashed(F.col("text")).alias("embedding"))
    tools = pipeline.Tools(
        embed=V.hashed, vectors=held, aliases=aliases, cross=lambda raw, text: F.size(F.array_intersect(F.split(F.lower(raw), " "), F.split(F.lower(text), " "))).cast("double") - 2,
        rewrite=lambda raw, history: F.concat_ws(" ", F.element_at(history, -1), raw))
    with_history = asked.withColumn("history", F.when(F.col("item_id") % 4 == 0, F.array(F.substring_index("raw", " ", 2))).otherwise(F.array().cast("array<string>")))
    state = pipeline.run(spark, docs, with_history, pipeline.PROFILES["hybrid"], tools)
    if missing := [x for x in state.log if "missing" in x]:
        raise AssertionError(f"components dropped out: {missing}")
    return state.cards
