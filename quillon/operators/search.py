"""Lexical candidate generation: inverted index, all-terms match with BM25, any-term union, query ladder, titles, aliases."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import patterns
from quillon.sources.tables import kept, small, spread

K1, B = 1.2, 0.75


def _runs(rows: DataFrame, every: bool = False, own: tuple[str, ...] = ()) -> DataFrame:
    """zim_id, path, dl, term and tf from rows with sorted tokens t, counted by where their runs end: nothing is shuffled. With `every`, a row
    without a term for each article as well; with `own`, further columns of the article."""
    places = F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)))
    last = F.filter(places, lambda i: F.get("t", i).isNotNull() & F.coalesce(F.get("t", i + 1) != F.get("t", i), F.lit(True)))
    ends = rows.withColumn("ends", last)
    runs = F.transform("ends", lambda e, j: F.struct(F.get("t", e).alias("term"), (e - F.coalesce(F.get("ends", j - 1), F.lit(-1))).cast("bigint").alias("tf")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf")))
    return ends.select("zim_id", "path", *own, "dl", F.inline(F.concat(none, runs) if every else runs))


def postings(articles: DataFrame, *own: str) -> DataFrame:
    """zim_id, path, further columns of the article, term, tf and dl (the article's tokens): an inverted index, one row for each term of an article."""
    sorted_ = articles.select("zim_id", "path", *own, F.sort_array(T.tokens(F.col("text"))).alias("t"))
    return _runs(sorted_.withColumn("dl", F.size("t")), own=own).select("zim_id", "path", *own, "term", "tf", "dl")


#: Terms of a batch of queries that are told apart as tokens are read; more are joined to the tokens.
MAX_TERMS = 20_000


class Index:
    """The part of an inverted index that a batch of queries asks for: rows (zim_id, path, dl, term, tf) and sizes of the archives
    (zim_id, n, avgdl).

    Texts are read and cut into tokens once, in as many tasks as there are cores at least. Tokens that no query asks for are
    dropped in the array, before anything is exploded; what is left is written out once for both tables, and for further queries with the
    same terms over the same articles."""

    def __init__(self, articles: DataFrame, terms: DataFrame):
        wanted = sorted(r["term"] for r in terms.select("term").where("term is not null").distinct().limit(MAX_TERMS + 1).collect())  # of queries, not of texts
        toks = spread(articles.select("zim_id", "path", "text")).select("zim_id", "path", T.tokens(F.col("text")).alias("t"))
        few = len(wanted) <= MAX_TERMS
        asked = F.filter("t", lambda t: t.isin(wanted)) if few else F.col("t")
        docs = toks.select("zim_id", "path", F.size("t").alias("dl"), F.sort_array(asked).alias("t"))
        every = kept(_runs(docs, every=True).select("zim_id", "path", "term", "dl", "tf"))
        rows = every.where("term is not null")
        self.rows = rows if few else rows.join(terms.select("term").distinct(), "term", "left_semi")
        self.sizes = kept(every.where("term is null").groupBy("zim_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def asked_postings(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """zim_id, path, term, dl and tf: the rows of the index for some terms only."""
    return Index(articles, terms).rows


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def terms_of(articles: DataFrame) -> DataFrame:
    """zim_id, path and term: each term of an article once."""
    return articles.select("zim_id", "path", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's rarity is multiplied by, up to rounding."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    return rarity(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


#: Scores (a query's with an article) that one task works out, about.
SCORES = 2_000_000


def term_statistics(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """zim_id, term, df, n and avgdl: what a term's score needs of each archive that holds it. Joined to queries' terms before
    postings, as archives are few: joined by them alone, all postings of one would meet in one task."""
    return kept(rows.groupBy("zim_id", "term").agg(F.count("*").alias("df")).join(sizes, "zim_id"))


def matches(queries: DataFrame, articles: DataFrame, every: bool = True, index: Index | None = None) -> DataFrame:
    """item_id, zim_id, path, score, n_terms and n_met for queries (item_id, terms): articles with all terms, or with any.

    Only terms that some query asks for leave the index, here made on the way unless one is given. With all terms asked for, only
    articles that hold a query's rarest term (over all archives) are looked at for the others. With any, postings are dealt by article, in parts
    of about SCORES scores, and each part is scored where it lies."""
    asked = queries.select("item_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    index = index or Index(articles, asked)
    frequent = term_statistics(index.rows, index.sizes)
    weighed = small(asked.join(frequent, "term"))
    if every:
        least = asked.join(frequent.groupBy("term").agg(F.sum("df").alias("df")), "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
        held = index.rows.select("zim_id", "path", "term").join(small(least), "term").select("item_id", "zim_id", "path")
        rows = held.join(weighed, ["item_id", "zim_id"]).join(index.rows, ["zim_id", "path", "term"])
    else:
        scores = queries.count() * (index.sizes.agg(F.sum("n")).first()[0] or 0)
        parts = min(max(articles.sparkSession.sparkContext.defaultParallelism, -(-scores // SCORES)), 20_000)
        rows = index.rows.repartition(parts, "zim_id", "path").join(weighed, ["zim_id", "term"])
    found = rows.groupBy("item_id", "n_terms", "zim_id", "path").agg(
        F.count("*").alias("n_met"), F.sum(bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))).alias("score")
    )
    return found.where("n_met = n_terms") if every else found


def ranked(found: DataFrame, limit: int, *within: str) -> DataFrame:
    """The best `limit` rows of each group by score, with 0-based ranks; ties by path. The limit is on the row number itself, so
    that each task cuts its own rows before they are shuffled."""
    order = W.partitionBy(*within).orderBy(F.desc(F.round("score", 9)), "path")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def any_term(queries: DataFrame, articles: DataFrame, limit: int, index: Index | None = None, only: DataFrame | None = None) -> DataFrame:
    """Union of single-term searches in the order of the terms: a path counts for its first term, then by rank there;
    terms are taken until a query has `limit` paths in an archive, and the last one taken is cut.

    Each term is searched once, however many queries have it; with `only` (item_id, zim_id), in those archives alone."""
    asked = queries.select("item_id", F.posexplode("terms").alias("term_no", "term"))
    wanted = asked if only is None else asked.join(only, "item_id")
    single = wanted.select(*[c for c in ("zim_id", "term") if c in wanted.columns]).distinct()
    index = index or Index(articles, asked)
    rows = index.rows.join(single, single.columns)
    score = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))
    scored = rows.join(small(term_statistics(rows, index.sizes)), ["zim_id", "term"]).select("zim_id", "path", "term", score.alias("score"))
    hits = ranked(scored, limit, "zim_id", "term").select("zim_id", "path", "term", "rank").join(wanted, single.columns)
    first = hits.groupBy("item_id", "zim_id", "path").agg(F.min(F.struct("term_no", "rank")).alias("first"))
    place = F.row_number().over(W.partitionBy("item_id", "zim_id").orderBy("first", "path")) - 1
    return first.withColumn("rank", place).where(F.col("rank") < limit).select("item_id", "zim_id", "path", "rank")


def ladder(raw: Column) -> Column:
    """Rungs of a query: all terms, without stopwords (if that differs), any term, title prefix."""
    terms = T.ladder_terms(raw)
    left = F.filter(terms, lambda t: ~t.isin(T.STOPWORDS))
    none = F.array().cast("array<string>")

    def rung(name: str, chosen: Column, prefix: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), chosen.alias("terms"), prefix.alias("prefix"))

    title = rung("title", none, F.trim(raw))
    no_prefix = F.lit(None).cast("string")
    full = F.array(rung("all_terms", terms, no_prefix))
    less = F.when(F.size(left) < F.size(terms), F.array(rung("stopword_stripped", left, no_prefix))).otherwise(F.array().cast(
        "array<struct<name:string,terms:array<string>,prefix:string>>"))
    return F.when(F.size(left) == 0, F.array(title)).otherwise(F.concat(full, less, F.array(rung("or_of_terms", left, no_prefix), title)))


#: Titles of a range of the sorted index, about.
RANGE = 100_000


class Titles:
    """A sorted index of titles: rows (range, title_key, zim_id, path) in order of title, archive and path, and the first and last title of
    each range. Ranges go by all three, so that a title that many articles share is split as well."""

    def __init__(self, articles: DataFrame):
        rows = kept(articles.select(F.lower("title").alias("title_key"), "zim_id", "path").where("title_key is not null"))  # texts are read once
        cores = articles.sparkSession.sparkContext.defaultParallelism
        ranges = max(cores, -(-rows.count() // RANGE))
        self.rows = kept(rows.repartitionByRange(ranges, "title_key", "zim_id", "path").select(F.spark_partition_id().alias("range"), "title_key", "zim_id", "path"))
        self.bounds = kept(self.rows.groupBy("range").agg(F.min("title_key").alias("first"), F.max("title_key").alias("last")))

    def starting_with(self, prefixes: DataFrame, limit: int) -> DataFrame:
        """item_id, zim_id, path and rank of the first `limit` titles in each archive that start with a prefix (item_id, prefix).

        A prefix goes to the ranges that hold such titles, one or two unless it is short, and is searched for there by halving."""
        asked = prefixes.where("prefix <> ''")
        within = (F.col("last") >= F.col("prefix")) & (F.col("first") < F.concat("prefix", F.lit(LAST)))
        sent = asked.join(F.broadcast(self.bounds), within).select(F.col("range").alias("sent_to"), "item_id", "prefix")  # a row for each range
        key = prefixes.schema["item_id"].dataType.simpleString()
        found = self.rows.groupBy("range").cogroup(sent.groupBy("sent_to")).applyInPandas(_starting(limit), f"item_id {key}, zim_id int, path string, title_key string")
        place = F.row_number().over(W.partitionBy("item_id", "zim_id").orderBy("title_key", "path")) - 1
        return found.withColumn("rank", place).where(F.col("rank") < limit).select("item_id", "zim_id", "path", "rank")


#: What stands behind all that follows a prefix.
LAST = "\U0010ffff"


def _starting(limit: int):
    def search(titles: pd.DataFrame, prefixes: pd.DataFrame) -> pd.DataFrame:
        titles = titles.sort_values(["title_key", "path"], kind="stable")
        keys = titles["title_key"].tolist()
        parts = []
        for item, prefix in zip(prefixes["item_id"], prefixes["prefix"], strict=True):
            own = titles.iloc[bisect_left(keys, prefix) : bisect_left(keys, prefix + LAST)]
            first = own if len(own) <= limit else own[own.groupby("zim_id").cumcount() < limit]
            parts.append(first.assign(item_id=item))
        out = pd.concat(parts) if parts else titles.iloc[:0].assign(item_id=prefixes["item_id"].iloc[:0])
        return out[["item_id", "zim_id", "path", "title_key"]]

    return search


def titles_with_prefix(queries: DataFrame, articles: DataFrame, limit: int, titles: Titles | None = None) -> DataFrame:
    """item_id, zim_id, path, rank: articles whose title starts with the query's `prefix`, by title and path; from the sorted index of
    their titles, here made on the way unless it is given."""
    asked = queries.select("item_id", F.lower(F.trim("prefix")).alias("prefix"))
    return (titles or Titles(articles)).starting_with(asked, limit)


def expand_aliases(queries: DataFrame, aliases: DataFrame, most: int = 3) -> DataFrame:
    """item_id, terms and added: the first `most` distinct targets (by name) of aliases (source, target) that are terms."""
    asked = queries.select("item_id", "terms", F.explode("terms").alias("source"))
    hit = asked.join(aliases.select(F.lower("source").alias("source"), F.lower("target").alias("target")).distinct(), "source")
    new = hit.where(~F.array_contains("terms", F.col("target"))).select("item_id", "target").distinct()
    nth = F.row_number().over(W.partitionBy("item_id").orderBy("target"))
    first = new.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("item_id").agg(F.array_sort(F.collect_list("target")).alias("added"))
    out = queries.select("item_id", "terms").join(first, "item_id", "left")
    none = F.array().cast("array<string>")
    return out.select("item_id", F.concat("terms", F.coalesce("added", none)).alias("terms"), F.coalesce("added", none).alias("added"))


def titles_of_spans(queries: DataFrame, articles: DataFrame, each: int = 3, start: int = 4, titles: Titles | None = None) -> DataFrame:
    """item_id, zim_id, path and rank for queries (item_id, spans): up to `each` titles that start with a span, the exact one
    instead where there is one; an article counts once, and ranks go on from `start`."""
    asked = queries.select("item_id", F.posexplode("spans").alias("span_no", "prefix"))
    keyed = asked.withColumn("own", F.concat_ws("/", "item_id", "span_no"))
    found = titles_with_prefix(keyed.select(F.col("own").alias("item_id"), "prefix"), articles, each, titles).withColumnRenamed("item_id", "own")
    rows = found.join(keyed, "own").join(articles.select("zim_id", "path", F.lower("title").alias("title_key")), ["zim_id", "path"])
    exact = rows.withColumn("exact", F.col("title_key") == F.lower("prefix")).withColumn("any_exact", F.max("exact").over(W.partitionBy("own", "zim_id")))
    first = exact.where("exact or not any_exact").groupBy("item_id", "zim_id", "path").agg(F.min(F.struct("span_no", "rank")).alias("first"))
    place = F.row_number().over(W.partitionBy("item_id", "zim_id").orderBy("first", "path")) - 1 + start
    return first.select("item_id", "zim_id", "path", place.cast("bigint").alias("rank"))


def shortened(queries: DataFrame, articles: DataFrame, enough: float, least_terms: int = 4) -> DataFrame:
    """item_id, variant and top: a query whose best share of terms found is below `enough` is tried again with its first three,
    then its first two terms; a shorter form is taken when it does strictly better, and the search ends once it is enough."""
    long = F.size("terms") >= least_terms
    forms = F.array(F.struct(F.lit(0).alias("variant"), F.col("terms").alias("terms")), *[
        F.struct(F.lit(v).alias("variant"), F.slice("terms", 1, n).alias("terms")) for v, n in ((1, 3), (2, 2))
    ])
    own = queries.select("item_id", F.inline(F.when(long, forms).otherwise(F.slice(forms, 1, 1))))
    keyed = own.withColumn("own", F.col("item_id") * 4 + F.col("variant"))
    found = matches(keyed.select(F.col("own").alias("item_id"), "terms"), articles, every=False)
    top = found.groupBy("item_id").agg(F.max(F.col("n_met") / F.col("n_terms")).alias("top"))
    scored = keyed.select("item_id", "variant", "own").join(top.withColumnRenamed("item_id", "own"), "own", "left")
    tops = scored.groupBy("item_id").pivot("variant", [0, 1, 2]).agg(F.first(F.coalesce("top", F.lit(0.0))))
    first = F.struct(F.lit(0).alias("variant"), F.col("0").alias("top"))

    def better(now, variant: int):
        value = F.coalesce(F.col(str(variant)), F.lit(0.0))
        return F.when((now["top"] < enough) & (value > now["top"]), F.struct(F.lit(variant).alias("variant"), value.alias("top"))).otherwise(now)

    chosen = tops.withColumn("c", first).withColumn("c", better(F.col("c"), 1)).withColumn("c", better(F.col("c"), 2))
    return chosen.select("item_id", "c.variant", "c.top")


def ladder_hits(missed: DataFrame, articles: DataFrame, limit: int, index: Index | None = None, titles: Titles | None = None) -> DataFrame:
    """item_id, zim_id, path and rank for queries (item_id, raw, terms) that no archive has all terms of: the first archive, by number,
    that has articles with any term, or else titles that start with the query; in it, the former before the latter."""
    asked = missed.select("item_id", F.explode("terms").alias("term"))
    index = index or Index(articles, asked)
    held = index.rows.groupBy("term").agg(F.min("zim_id").alias("zim_id")).join(asked, "term").groupBy("item_id").agg(F.min("zim_id").alias("zim_id"))
    some = any_term(missed, articles, limit, index, held).withColumn("rung", F.lit(0))
    titled = titles_with_prefix(missed.select("item_id", F.col("raw").alias("prefix")), articles, limit, titles).withColumn("rung", F.lit(1))
    both = some.unionByName(titled)
    first = both.groupBy("item_id").agg(F.min(F.struct("zim_id", "rung")).alias("first")).select("item_id", "first.zim_id", "first.rung")
    return both.join(first, ["item_id", "zim_id", "rung"]).select("item_id", "zim_id", "path", "rank")


def exact_titles(queries: DataFrame, articles: DataFrame, limit: int = 3, titles: Titles | None = None) -> DataFrame:
    """item_id, zim_id, path and rank: of the first `limit` titles that start with a query's terms, those that are the same."""
    asked = queries.select("item_id", F.array_join("terms", " ").alias("prefix"))
    found = titles_with_prefix(asked, articles, limit, titles).join(asked, "item_id")
    named = found.join(articles.select("zim_id", "path", "title"), ["zim_id", "path"])
    return named.where(F.lower(F.trim("title")) == F.lower("prefix")).select("item_id", "zim_id", "path", "rank")


def distinctive_terms(raw: Column, most: int = 5) -> Column:
    """Up to `most` words of four characters or more, punctuation at their ends taken off, less stopwords; each once."""
    bare = F.transform(F.split(F.trim(raw), r"\s+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    long = F.filter(bare, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(T.STOPWORDS))
    return F.slice(F.filter(long, lambda w, i: F.array_position(F.transform(long, lambda x: F.lower(x)), F.lower(w)) == i + 1), 1, most)


def term_surface(queries: DataFrame, articles: DataFrame, known: DataFrame) -> DataFrame:
    """item_id, term_no, term, zim_id and path: for each distinctive term of a query, searched by itself, its best article, if it is not
    among the `known` ones (item_id, path) of the query; an article counts for its first term."""
    asked = queries.select("item_id", F.posexplode(distinctive_terms(F.col("raw"))).alias("term_no", "word"))
    keyed = asked.withColumn("own", F.concat_ws("/", "item_id", "term_no"))
    found = matches(keyed.select(F.col("own").alias("item_id"), T.tokens(F.col("word")).alias("terms")), articles)
    order = W.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "zim_id", "path")
    best = found.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("item_id").alias("own"), "zim_id", "path")
    new = best.join(keyed, "own").join(known.select("item_id", "path").distinct(), ["item_id", "path"], "left_anti")
    nth = F.row_number().over(W.partitionBy("item_id", "path").orderBy("term_no"))
    return new.withColumn("nth", nth).where("nth = 1").select("item_id", "term_no", F.col("word").alias("term"), "zim_id", "path")


def uncovered(spans: DataFrame, candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """item_id, span_no and span of spans (item_id, spans) that no candidate (item_id, zim_id, path) of the query holds, case and white
    space aside. Each article is read once for the spans of all queries."""
    rows = spans.select("item_id", F.posexplode("spans").alias("span_no", "span")).withColumn("pattern", patterns.folded(F.col("span")))
    wanted = articles.join(small(candidates.select("zim_id", "path").distinct()), ["zim_id", "path"], "left_semi")
    texts = wanted.select("zim_id", "path", patterns.folded(F.col("text")).alias("text"))
    hits = patterns.held(texts, rows.select("pattern"))
    held = candidates.select("item_id", "zim_id", "path").distinct().join(hits, ["zim_id", "path"]).select("item_id", "pattern").distinct()
    return rows.join(held, ["item_id", "pattern"], "left_anti").select("item_id", "span_no", "span")
