"""Cases over small inline tables, for what the given tables do not hold. Their SQL states the expected rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import spans
from quillon.functions import text as T
from quillon.operators import answers, assembly, catalogue, passages, sections
from quillon.operators import search as lexical
from quillon.plans import pipeline

#: name: (case, SQL)
CASES = {}


def query(*operators: str, sql: str):
    def add(function):
        CASES[function.__name__] = function, sql
        return function

    return add


def rows(columns: str, *values: tuple) -> str:
    """SQL for rows stated one by one."""
    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, list):
            return "[" + ", ".join(map(literal, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, v)) + ')' for v in values)}) t({columns})"


PAGES = [
    (1, "A/Tower", "", """<html><head><title>The  Tower</title><style>p{}</style></head><body><p>Lead of the tower.</p><div class="hatnote">See other</div><h2>History<span class="mw-editsection">[edit]</span></h2>
<p>Built in 1889.</p><h3>Works</h3><p>Iron.</p><h2>Works</h2><p>Art.</p><table class="navbox"><tr><td>links</td></tr></table><ol class="references"><li>ref</li></ol></body></html>"""),
    (1, "A/Plain", "Given", "<p>Only a text.</p><script>x</script>"),
    (2, "A/Deep", "", "<h1>Deep</h1><p>One.</p><h4>Far</h4><p>Two.</p><h3>Near</h3><p>Three &amp; four.</p>"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "zim_id int, path string, title string, html string")


@query("TX18", "JN11", sql=rows(
    "path, title, level, heading_path, body", ("A/Deep", "A/Deep", 1, "Deep", "Deep\nOne.\n"), ("A/Deep", "A/Deep", 3, "Deep > Near", "Near\nThree & four."), ("A/Deep", "A/Deep", 4, "Deep > Far", "Far\nTwo.\n"),
    ("A/Plain", "Given", 0, "", "Only a text."), ("A/Tower", "The Tower", 2, "History", "History\nBuilt in 1889.\n"), ("A/Tower", "The Tower", 2, "Works", "Works\nArt."),
    ("A/Tower", "The Tower", 3, "History > Works", "Works\nIron.\n")))
def html_sections(spark, sf_dir):
    """Articles of HTML pages cut into sections: boilerplate goes, headings nest, one that comes twice is two sections."""
    found = sections.articles(pages(spark)).select("path", "title", "text", F.explode("sections").alias("s"))
    body = F.substr("text", F.col("s.char_start") + 1, F.col("s.char_end") - F.col("s.char_start"))
    return found.select("path", "title", "s.level", F.array_join("s.heading_path", " > ").alias("heading_path"), body.alias("body"))


@query("PB2", "DP1", "TX10", "TX11", sql=rows(
    "depth, path, char_start, char_end, text", (1, "A/Tower", 0, 19, "The Tower > Lead of the tower.\n"), (2, "A/Tower", 0, 19, "The Tower > Lead of the tower.\n"), (2, "A/Tower", 19, 41, "The Tower > History\nBuilt in 1889."),
    (2, "A/Tower", 42, 53, "The Tower > Works\nIron."), (2, "A/Tower", 54, 64, "The Tower > Works\nArt."), (3, "A/Tower", 0, 64, "The Tower  Lead of the tower.\nHistory\nBuilt in 1889.\nWorks\nIron.\nWorks\nArt."),
    (1, "A/Plain", 0, 12, "Given > Only a text."), (2, "A/Plain", 0, 12, "Given > Only a text."), (3, "A/Plain", 0, 12, "Given  Only a text."),
    (1, "A/Deep", 0, 10, "A/Deep > Deep\nOne.\n"), (2, "A/Deep", 0, 10, "A/Deep > Deep\nOne.\n"), (2, "A/Deep", 10, 18, "A/Deep > Far\nTwo."), (2, "A/Deep", 19, 37, "A/Deep > Near\nThree & four."),
    (3, "A/Deep", 0, 37, "A/Deep > Deep  Deep\nOne.\nFar\nTwo.\nNear\nThree & four.")))
def index_chunks_of_sections(spark, sf_dir):
    """Chunks to embed of articles with sections, by depth: lead, sections, passages."""
    docs = sections.articles(pages(spark))
    depths = [passages.index_chunks(docs, d).withColumn("depth", F.lit(d)) for d in (1, 2, 3)]
    return depths[0].unionByName(depths[1]).unionByName(depths[2]).select("depth", "path", "char_start", "char_end", "text")


LONG = "alpha " * 200 + "end. " + "beta " * 150 + "end.\n" + "gamma " * 700 + "end. tail."


@query("PB2", "TX9", sql=rows("ordinal, char_start, char_end, n_words", (0, 0, 1205, 201), (1, 1205, 1960, 151), (2, 1960, 3957, 333), (3, 3957, 6165, 368), (4, 6165, 6170, 1)))
def passages_by_words(spark, sf_dir):
    """Passages of up to 307 words: whole sentences, and one cut within a sentence of over twice that."""
    docs = spark.createDataFrame([(1, "p", "T", LONG)], "zim_id int, path string, title string, text string")
    return passages.split(docs).select("ordinal", "char_start", "char_end", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_words"))


ENTRIES = [
    (1, "Plain", "<p>" + "text " * 300 + "</p>", False, 1500), (2, "Mercury (disambiguation)", "<p>x</p>", False, 2000), (3, "Planet", '<div class="dmbox">', False, 5000), (4, "List of planets", "", False, 9000),
    (5, "Old", "<meta http-equiv='refresh' content=\"0;url='../A/New_name#top'\">", False, 60), (6, "Gone", "", True, 0), (7, "Short", "<p>s</p>", False, 10),
]


@query("TX15", "TX16", "FI3", "FI4", sql=rows(
    "id, flags, target, kept", (1, 0, None, True), (2, 4, None, False), (3, 4, None, False), (4, 8, None, False), (5, 18, "A/New_name#top", False), (6, 1, None, False), (7, 16, None, True)))
def entry_flags_of_each_kind(spark, sf_dir):
    docs = spark.createDataFrame(ENTRIES, "id int, title string, html string, is_redirect boolean, n_chars int")
    flags = T.entry_flags(F.col("title"), F.col("html"), F.col("is_redirect"), F.col("n_chars"))
    return docs.select("id", flags.alias("flags"), T.soft_redirect_target(F.col("html")).alias("target"), (flags.bitwiseAND(T.SKIPPED) == 0).alias("kept"))


@query("TX19", sql=rows("kind, clean", ("vtt", "First cue\nsecond line\n2\nat 10:30 we met"), ("markdown", "Title\n\nBold text with a link"), ("plain", "a b\nc")))
def captions_and_markdown(spark, sf_dir):
    vtt = "WEBVTT - demo\r\n\r\nNOTE by hand\r\n\r\n00:01.000 --> 00:04.000\r\nFirst cue\r\n  second line\r\n\r\n2\r\n00:05.000 --> 00:06.000\r\n00:05:01\r\nat 10:30 we met\r\n"
    texts = [("vtt", vtt), ("markdown", "## Title\n\n\n\n**Bold** `text` with [a link](http://x)\n"), ("plain", " a \t b \n\n c\n")]
    docs = spark.createDataFrame(texts, "kind string, text string")
    t = F.col("text")
    return docs.select("kind", F.when(F.col("kind") == "vtt", T.vtt_text(t)).when(F.col("kind") == "markdown", T.markdown_text(t)).otherwise(T.plain_text(t)).alias("clean"))


QUESTIONS = [
    (1, "What was Eminem's first album?"), (2, "When did Elizabeth II meet the King of Spain in Madrid?"), (3, "How old is the German city?"), (4, 'Who wrote "the old man" and sang?'),
    (5, "In Paris. London fell"), (6, ""), (7, "After 'Round Midnight' came Ludwig van Beethoven"),
]


@query("TX5", sql=rows("id, spans", (1, "Eminem"), (2, "Elizabeth II|King of Spain"), (3, ""), (4, "the old man"), (5, "Paris|London"), (6, ""), (7, "Round Midnight|Ludwig van Beethoven")))
def entity_spans_of_questions(spark, sf_dir):
    own = spark.createDataFrame(QUESTIONS, "id int, question string")
    return spans.with_entity_spans(own, "question").select("id", F.array_join("spans", "|").alias("spans"))


ANSWERS = [
    (1, 7, "It rose [1] and fell [12][2].", 3, 1, True, "correct", 900, 1), (2, 7, "No marks at all", 3, 1, True, "incorrect", 20_000, None), (3, 7, "Same [1][1] again [0] [99999999999]", 2, 2, True, "partial", 12_000, 3),
    (4, 7, "", 5, 0, True, "unjudged", 10, 1), (5, 8, "Not by a tool [1]", 2, 0, False, "correct", 10, 2),
]


def answered(spark):
    return spark.createDataFrame(ANSWERS, "id int, run_id int, answer string, cards int, first_cards int, tool boolean, verdict string, input_tokens int, hit_rank int")


@query("TX23", sql=rows("id, answer_start, answer_end, source_index", (1, 8, 11, 0), (1, 25, 28, 1), (3, 5, 8, 0), (3, 8, 11, 0), (5, 14, 17, 0)))
def citation_spans(spark, sf_dir):
    """Where an answer cites its cards; marks of cards that are not there are dropped."""
    return answered(spark).select("id", F.inline(answers.citations(F.col("answer"), F.col("cards"))))


@query("AG30", sql=rows(
    "run_id, tool_questions, cite_tool_cards, no_citations, citations, tool_citations, correct_with, correct_without", (7, 4, 1, 2, 3, 1, 1.0, 0.0)))
def citation_shares(spark, sf_dir):
    return answers.citation_shares(answered(spark))


@query("AG30", sql=rows(
    "run_id, turn_size, n, gold_in_cards, mean_gold_rank, correct_given_gold", (7, "<10k", 1, 100.0, 1.0, 100.0), (7, ">=10k", 2, 50.0, 3.0, 0.0), (8, "<10k", 1, 100.0, 2.0, 100.0)))
def gold_by_turn_size(spark, sf_dir):
    return answers.by_turn_size(answered(spark))


@query("AG36", sql=rows("id, supported", ("a", True), ("b", False), ("c", True), ("d", True), ("e", False)))
def answers_supported(spark, sf_dir):
    """Whether every required source shares a word of four letters or more with the answer."""
    own = spark.createDataFrame([("a", "The Habenula, a nucleus"), ("b", "The Habenula"), ("c", "yes no"), ("d", "Nothing asked"), ("e", "Habenula")], "id string, answer string")
    sources = spark.createDataFrame(
        [("a", True, "about the habenula."), ("a", True, "a NUCLEUS of cells"), ("a", False, "x"), ("b", True, "habenula"), ("b", True, "other"), ("c", True, "zzzz"), ("d", False, "x"), ("e", True, None)],
        "id string, required boolean, text string")
    return answers.supported(own, sources)


@query("TX30", sql=rows("id, segments", (1, "The (Iron) (tower) was (iron)y: (iron)y"), (2, "No words here"), (3, "A+B (plus) C")))
def highlighted_segments(spark, sf_dir):
    """A snippet's segments, marked ones in brackets."""
    own = spark.createDataFrame([(1, "The Iron tower was irony: irony", "the iron TOWER?"), (2, "No words here", "the a I"), (3, "A+B plus C", "c++ plus")], "id int, text string, query string")
    shown = F.transform(answers.highlights(F.col("text"), F.col("query")), lambda s: F.when(s["mark"], F.concat(F.lit("("), s["text"], F.lit(")"))).otherwise(s["text"]))
    return own.select("id", F.array_join(shown, "").alias("segments"))


ARCHIVES = [(1, "wiki_en_top", "wiki_en_top_2026-06.zim", "Top articles"), (2, "wiki_fr", "wiki_fr_2026.zim", "Articles en français"), (3, "", "notes.ZIM", "Notes")]


def archives(spark):
    return spark.createDataFrame(ARCHIVES, "zim_id int, name string, filename string, title string")


@query("FI2", "SE3", sql=rows("id, scoped, zim_ids", (1, True, "1,3"), (2, True, "2"), (3, True, ""), (4, False, ""), (5, False, ""), (6, True, "1,9")))
def scope_tokens(spark, sf_dir):
    """Scopes as they are asked for; one unknown token leaves none, an empty text is no scope."""
    own = [(1, "3, WIKI_en_top"), (2, "wiki_fr_2026.zim,wiki_fr_2026"), (3, "1,wiki"), (4, " , "), (5, None), (6, "9,1")]
    found = catalogue.scopes(spark.createDataFrame(own, "id int, scope string"), archives(spark))
    return found.select("id", "scoped", F.array_join(F.transform("zim_ids", lambda i: i.cast("string")), ",").alias("zim_ids"))


@query("FI17", sql=rows("id, zim_id, matches", (1, 2, 1), (2, None, 2), (3, None, 0), (4, 3, 1), (5, None, 0), (6, 3, 1)))
def archive_by_part_of_name(spark, sf_dir):
    own = [(1, "FRAN"), (2, "wiki"), (3, "zzz"), (4, " 3"), (5, "7"), (6, "notes")]
    return catalogue.matched_archives(spark.createDataFrame(own, "id int, spec string"), archives(spark))


@query("TX27", sql=rows("id, expression", (1, '"wikipedia" "en*" "top"'), (2, ""), (3, '"orange"')))
def catalogue_search_expression(spark, sf_dir):
    own = spark.createDataFrame([(1, ' wikipedia "en*" AND top'), (2, "not OR"), (3, "orange near")], "id int, query string")
    return own.select("id", catalogue.fts_query(F.col("query")).alias("expression"))


@query("TX32", sql=rows("id, kind", (1, "media"), (2, "media"), (3, "spa"), (4, "documents"), (5, "articles"), (6, "media")))
def archive_kinds(spark, sf_dir):
    own = [(1, "", ["text/html", "video/webm"], False), (2, "x;_VIDEOS:yes", [], True), (3, "_spa:yes", ["text/html"], True), (4, None, ["text/html"], True), (5, "wikipedia", ["text/html", "image/png"], False), (6, "_spa:yes", ["audio/ogg"], False)]
    rows_ = spark.createDataFrame(own, "id int, tags string, mimes array<string>, manifest boolean")
    return rows_.select("id", catalogue.archive_kind(F.col("tags"), F.col("mimes"), F.col("manifest")).alias("kind"))


@query("TX38", sql=rows("id, mode", (1, "never"), (2, "always"), (3, "toggle"), (4, "always"), (5, "toggle")))
def model_thinking_modes(spark, sf_dir):
    own = [(1, "models/LFM2.5-1.2B-Instruct-Q4.gguf"), (2, "x-Thinking.gguf"), (3, "LFM3-1B.gguf"), (4, "lfm2-2.6b.gguf"), (5, "qwen3.5-4b.gguf")]
    return spark.createDataFrame(own, "id int, filename string").select("id", catalogue.thinking_mode(F.col("filename")).alias("mode"))


# A library of five articles in two archives.
LIBRARY = [
    (1, "a/tower", "Iron Tower", "The iron tower stands in Paris. It was built for a fair."), (1, "a/fair", "World Fair", "The fair of 1889 was in Paris."), (1, "a/stub", "Tower of Babel", " "),
    (2, "b/bridge", "Iron Bridge", "The bridge crosses the river. Iron parts were cast nearby."), (2, "b/river", "River", "The river runs to the sea."),
]
ASKED = [(1, "iron tower"), (2, "glass bridge"), (3, "tower of"), (4, "zebra")]


def library(spark):
    return spark.createDataFrame(LIBRARY, "zim_id int, path string, title string, text string")


def asked(spark):
    return spark.createDataFrame(ASKED, "item_id long, raw string")


def letters(text: Column) -> Column:
    """A stand-in for an encoder: shares of the letters r, i, o and t, at unit length."""
    counts = F.array(*[F.size(F.regexp_extract_all(F.lower(text), F.lit(c), F.lit(0))).cast("double") + 0.01 for c in "riot"])
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / norm)


def sources_of(spark, *parts, tools: pipeline.Tools = pipeline.Tools(), queries=None):
    plan = pipeline.profile("inline", ("query_preparer", "normalize", {}), *parts)
    return pipeline.run(spark, library(spark), asked(spark) if queries is None else queries, plan, tools, until="candidate_source")


@query("CS1", "TX4", "SC11", sql=rows("item_id, zim_id, path, rank", (1, 1, "a/tower", 0), (2, 2, "b/bridge", 0), (3, 1, "a/tower", 0)))
def fulltext_with_ladder(spark, sf_dir):
    """All terms in any archive; else the ladder, which ends at the first archive with something (query 2: any term, in archive 2)."""
    found = sources_of(spark, ("candidate_source", "fulltext", {})).candidates
    return found.select("item_id", "zim_id", "path", "rank")


@query("CS2", "SC12", sql=rows("item_id, path, rank", (1, "a/tower", 0), (3, "a/stub", 0)))
def title_suggest_component(spark, sf_dir):
    return sources_of(spark, ("candidate_source", "title_suggest", {"limit": 1})).candidates.select("item_id", "path", "rank")


@query("CS3", "TX6", sql=rows("item_id, path, rank", (1, "a/tower", 4), (2, "b/bridge", 4), (2, "b/river", 5)))
def title_entity_component(spark, sf_dir):
    own = spark.createDataFrame([(1, "Who built the Iron Tower?"), (2, "Who crossed the Iron Bridge by 'River'?")], "item_id long, raw string")
    return sources_of(spark, ("candidate_source", "title_entity_suggest", {}), queries=own).candidates.select("item_id", "path", "rank")


@query("QP2", "CS4", "JN4", sql=rows("item_id, source, zim_id, path, rank", (1, "alias_title_resolve", 1, "a/tower", 0), (4, "alias_title_resolve", 1, "a/fair", 0)))
def alias_components(spark, sf_dir):
    """Aliases of a query's terms name articles; so do the terms themselves."""
    tools = pipeline.Tools(aliases=spark.createDataFrame([("zebra", "World Fair"), ("zebra", "zoo")], "source string, target string"))
    plan = (("query_preparer", "alias_expand", {"mode": "title_hints"}), ("candidate_source", "alias_title_resolve", {}))
    return sources_of(spark, *plan, tools=tools).candidates.select("item_id", "source", "zim_id", "path", "rank")


@query("QP3", sql=rows("item_id, raw", (1, "and then?|who built the tower?|why"), (2, "alone?"), (3, "kept")))
def rewritten_questions(spark, sf_dir):
    """A rewriter sees the last turns; without turns, or without an answer of its own, the question stays."""
    own = spark.createDataFrame([(1, "why", ["dropped", "and then?", "who built the tower?"]), (2, "alone?", []), (3, "kept", ["no answer"])], "item_id long, raw string, history array<string>")

    def rewrite(raw: Column, turns: Column) -> Column:
        return F.when(F.array_contains(turns, "no answer"), " ").otherwise(F.array_join(F.concat(turns, F.array(raw)), "|"))

    plan = pipeline.profile("inline", ("query_preparer", "conversational_rewrite", {"max_history_turns": 2}))
    return pipeline.run(spark, library(spark), own, plan, pipeline.Tools(rewrite=rewrite)).queries.select("item_id", "raw")


@query("CS5", "UD3", "WN2", sql=rows("item_id, zim_id, path, rank", (1, 1, "a/tower", 0), (1, 1, "a/fair", 1), (2, 2, "b/river", 0), (2, 2, "b/bridge", 1)))
def vector_component(spark, sf_dir):
    """The two nearest articles by an encoder that is handed in, ranked within their archives."""
    docs = library(spark).where("trim(text) <> ''").select(F.crc32("path").alias("vec_id"), "zim_id", "path", letters(F.col("title")).alias("embedding"))
    tools = pipeline.Tools(embed=letters, vectors=docs)
    found = sources_of(spark, ("candidate_source", "vector_knn", {"k": 2}), tools=tools).candidates
    return found.where("item_id <= 2").select("item_id", "zim_id", "path", "rank")


def scored(spark, *scorers, tools: pipeline.Tools):
    parts = [("query_preparer", "normalize", {}), ("candidate_source", "fulltext", {}), ("candidate_source", "title_suggest", {}), ("fuser", "rrf", {}), ("passage_builder", "candidate_articles", {}), *scorers]
    return pipeline.run(spark, library(spark), asked(spark), pipeline.profile("inline", *parts), tools, until="passage_scorer").passages


@query("PB1", sql=rows("item_id, path, ordinal, char_end, breadcrumb, text", (1, "a/tower", 0, 56, "Iron Tower", LIBRARY[0][3]), (2, "b/bridge", 0, 58, "Iron Bridge", LIBRARY[3][3]), (3, "a/tower", 0, 56, "Iron Tower", LIBRARY[0][3]), (3, "a/stub", 0, 0, "Tower of Babel", "Tower of Babel")))
def passages_of_candidates(spark, sf_dir):
    """Passages of fused articles; one without a text has its title."""
    return scored(spark, tools=pipeline.Tools()).select("item_id", "path", "ordinal", "char_end", "breadcrumb", "text")


@query("SR2", "SO1", "SR4", sql=rows("item_id, path, place", (1, "a/tower", 1), (2, "b/bridge", 1), (3, "a/stub", 1)))
def static_pass_component(spark, sf_dir):
    """The passage most like the query by an encoder that is handed in."""
    return scored(spark, ("passage_scorer", "static_pass", {"shortlist": 1}), tools=pipeline.Tools(embed=letters)).select("item_id", "path", "place")


@query("SR3", "MA4", "UD3", sql=rows("item_id, path, place, score", (1, "a/tower", 1, 0.5), (2, "b/bridge", 1, 0.880797), (3, "a/stub", 1, 0.5)))
def cross_encoder_component(spark, sf_dir):
    """The first passage of each query by a cross-encoder that is handed in, here one that likes rivers."""
    def logit(asked_: Column, text: Column) -> Column:
        return F.when(F.contains(text, F.lit("river")), 2.0).otherwise(0.0)

    found = scored(spark, ("passage_scorer", "cross_encoder", {"candidates_max": 1}), tools=pipeline.Tools(cross=logit))
    return found.select("item_id", "path", "place", F.round("score", 6).alias("score"))


def candidate(i: int, path: str, ordinal: int, crumb: str, text: str, lead: bool, score: float, archive: int = 1) -> tuple:
    return (i, "Iron", archive, path, ordinal, crumb, text, lead, score)


POOL = [
    candidate(1, "a", 0, "Iron", "one two three four five", True, 0.2), candidate(1, "a", 1, "Iron > Use", "six seven eight nine ten", False, 0.9), candidate(1, "a", 2, "Iron > Use", "eleven twelve", False, 0.1),
    candidate(1, "a", 3, "Iron > Use", "thirteen fourteen", False, 0.85), candidate(1, "b", 0, "Tin", "six seven eight nine ten", False, 0.8, 2), candidate(1, "b", 1, "Tin", "fifteen sixteen seventeen", True, 0.5, 2),
    candidate(1, "c", 0, "Lead", "eighteen", True, 0.01, 2), candidate(1, "d", 0, "Zinc", "nineteen twenty twenty-one twenty-two", False, 0.4, 3), candidate(1, "d", 1, "Zinc", "x", False, 0.3, 3),
]


def chosen(spark, name: str, **limits):
    pool = spark.createDataFrame(POOL, "item_id long, raw string, zim_id int, path string, ordinal int, breadcrumb string, text string, is_lead boolean, score double")
    return assembly.assemble(pool, name, assembly.Limits(**limits)).select("place", "path", "ordinal", "tokens")


@query("AS1", "AS2", "FI11", "JN13", sql=rows("place, path, ordinal, tokens", (0, "a", 1, 5), (1, "a", 3, 2), (2, "b", 1, 3), (3, "d", 0, 4), (4, "d", 1, 1)))
def assembled_within_budget(spark, sf_dir):
    """Two of an article, no near-duplicate (b 0 repeats a 1), nothing weak from a further article once there are three."""
    return chosen(spark, "topk_budget", budget=15, per_article=2, floor_rel=0.5, least_articles=3)


@query("AS1", sql=rows("place, path, ordinal, tokens", (0, "a", 1, 5), (1, "a", 3, 2)))
def assembly_ends_at_the_budget(spark, sf_dir):
    """What does not fit ends the selection, though later ones would fit."""
    return chosen(spark, "topk_budget", budget=8, per_article=2)


@query("AS3", "JN12", sql=rows("place, path, ordinal, tokens", (0, "a", 1, 5), (1, "a", 2, 2), (2, "a", 3, 2), (3, "b", 0, 5), (4, "b", 1, 3)))
def assembled_with_neighbours(spark, sf_dir):
    """Winners with the passages beside them in their section; what is in already costs nothing."""
    return chosen(spark, "section_window", budget=17, per_article=2, near=None)


@query("AS4", "SR4", sql=rows("place, path, ordinal, tokens", (0, "a", 0, 5), (1, "a", 1, 5), (2, "a", 3, 2), (3, "b", 1, 3), (4, "d", 0, 4)))
def assembled_with_leads(spark, sf_dir):
    """Leads gain, leads of the best articles are put in, and that of the article named like the query comes first."""
    return chosen(spark, "lead_boost", budget=14, per_article=2, lead_k=2)


@query("AS5", sql=rows("place, path, ordinal, tokens", (0, "a", 1, 5), (1, "a", 3, 2), (2, "b", 1, 3), (3, "d", 0, 4), (4, "d", 1, 1), (5, "c", 0, 1)))
def assembled_for_diversity(spark, sf_dir):
    return chosen(spark, "diverse", budget=20, per_article=2, per_archive=2)


@query("FO1", "AG33", sql=rows("id, view", (1, "Iron\n" + "filler " * 306 + "end.\n\n[...]\n\nIron\nThe needle is here. " + "straw " * 302 + "end."), (2, "short"), (3, "Iron\nmust")))
def focused_views_of_long_texts(spark, sf_dir):
    """The first chunk and the one with the rare word; what must be in is whole though it leaves no budget for more."""
    text = "filler " * 306 + "end. " + "more " * 306 + "end. " + "The needle is here. " + "straw " * 302 + "end."
    none, must = [], [(0, 4)]
    own = [(1, 1, "p", "Iron", text, ["needle"], none), (2, 1, "p", "Iron", "short", ["needle"], none), (3, 1, "p", "Iron", "must", ["needle"], must)]
    schema = "item_id long, zim_id int, path string, title string, text string, terms array<string>, must array<struct<char_start:int,char_end:int>>"
    made = spark.createDataFrame(own, schema)
    wide, narrow = passages.focused_views(made.where("item_id < 3"), 4000), passages.focused_views(made.where("item_id = 3"), 2)
    return wide.unionByName(narrow).select(F.col("item_id").cast("int").alias("id"), "view")


@query("RC2", "TX25", sql=rows("item_id, term_no, term, path", (1, 1, "Paris", "a/fair"), (1, 3, "river", "b/river")))
def term_surface_of_library(spark, sf_dir):
    """The best article of each distinctive word searched by itself, less those that are known."""
    own = spark.createDataFrame([(1, "(iron) Paris, rivers? river the River")], "item_id long, raw string")
    known = spark.createDataFrame([(1, "a/tower")], "item_id long, path string")
    return lexical.term_surface(own, library(spark), known).select("item_id", "term_no", "term", "path")
