"""Catalogue operators: pages with totals, facets, missing-last sorts, discovery, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import ranks

VECTOR_BYTES = 1632
VECTORS_PER_ARTICLE = {1: 0.98, 2: 5.92, 3: 4.94}


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of `rows` with the number of all rows in `total`; only offset + limit rows are sorted out."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def missing_last(rows: DataFrame, missing: Column, by: str, key: str) -> DataFrame:
    """key with its place in rising (`up`) and falling (`down`) order of `by`, a number; rows where it is missing come last in both."""
    last = F.lit(float("inf"))
    up = F.when(missing, last).otherwise(F.col(by).cast("double"))
    down = F.when(missing, last).otherwise(-F.col(by).cast("double"))
    placed = ranks.numbered(rows, up, [F.col(by), F.col(key)], "up")
    return ranks.numbered(placed, down, [F.desc(by), F.col(key)], "down").select(key, "up", "down")


def facets(rows: DataFrame, column: str, separator: str) -> DataFrame:
    """facet and n: how many rows have each member of a separated list."""
    members = rows.select(F.explode(F.split(column, separator)).alias("facet")).select(F.trim("facet").alias("facet")).where("facet <> ''")
    return members.groupBy("facet").agg(F.count("*").alias("n"))


def discovered(files: DataFrame, known: DataFrame) -> DataFrame:
    """id and change (added, missing, updated, same) of files against known rows (id, v)."""
    both = files.select("id", F.col("v").alias("new"), F.lit(1).alias("is_file")).join(known.select("id", F.col("v").alias("old"), F.lit(1).alias("is_row")), "id", "full_outer")
    change = F.when(F.col("is_row").isNull(), "added").when(F.col("is_file").isNull(), "missing").when(F.col("new") != F.col("old"), "updated").otherwise("same")
    return both.select("id", change.alias("change"))


def disk_estimates(sums: DataFrame) -> DataFrame:
    """source, depth, chars and bytes of an index of each depth, from rows (source, chars, n)."""
    by_depth = F.array(*[F.struct(F.lit(d).alias("depth"), (F.round(F.col("n") * v).cast("bigint") * VECTOR_BYTES).alias("bytes")) for d, v in VECTORS_PER_ARTICLE.items()])
    return sums.select("source", "chars", F.inline(by_depth))


def scopes(asked: DataFrame, archives: DataFrame) -> DataFrame:
    """id, scoped and zim_ids for asked scopes (id, scope) over archives (zim_id, name, filename): each token of the comma-separated text
    is a number, or the name, filename or its stem of an archive in any case. A token that is none of these leaves no archive at
    all; a scope without tokens is none (scoped false: every archive)."""
    known = archives.select(F.col("zim_id").alias("found"), F.explode(F.array(F.lower("name"), F.lower("filename"), F.regexp_replace(F.lower("filename"), r"\.zim$", ""))).alias("token"))
    first = known.where("token <> ''").groupBy("token").agg(F.min("found").alias("found"))
    tokens = asked.select("id", F.explode(F.split(F.coalesce("scope", F.lit("")), ",")).alias("token")).select("id", F.lower(F.trim("token")).alias("token")).where("token <> ''")
    own = tokens.withColumn("number", F.when(F.col("token").rlike("^[+-]?[0-9]+$"), F.col("token").try_cast("int"))).join(first, "token", "left")
    resolved = own.groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("number", "found"))).alias("ids"), F.bool_and(F.coalesce("number", "found").isNotNull()).alias("whole"))
    none = F.array().cast("array<int>")
    rows = asked.select("id").join(resolved, "id", "left")
    return rows.select("id", F.col("whole").isNotNull().alias("scoped"), F.when(F.col("whole"), F.col("ids")).otherwise(none).alias("zim_ids"))


def matched_archives(asked: DataFrame, archives: DataFrame) -> DataFrame:
    """id, zim_id and matches for asked texts (id, spec) over archives (zim_id, name, filename, title): a number is an archive's own; any
    other text must stand in the names of one archive alone, in any case; else zim_id is null. `archives` is a short list."""
    hay = F.lower(F.concat_ws("\n", "filename", "name", "title"))
    spec = F.lower("spec")
    number = F.when(F.trim("spec").rlike("^[0-9]+$"), F.trim("spec").try_cast("int"))
    listed = archives.select(F.collect_list(F.struct("zim_id", hay.alias("hay"))).alias("archives"))
    hit = F.filter("archives", lambda a: F.when(number.isNotNull(), a["zim_id"] == number).otherwise(F.contains(a["hay"], spec)))
    rows = asked.crossJoin(F.broadcast(listed)).withColumn("hit", hit)  # one row, of all archives
    return rows.select("id", F.when(F.size("hit") == 1, F.get("hit", F.lit(0))["zim_id"]).alias("zim_id"), F.size("hit").alias("matches"))


def fts_terms(query: Column) -> Column:
    """Words of a catalogue search: no quotation marks, no operators."""
    words = F.filter(F.split(F.translate(query, '"', " "), r"\s+"), lambda w: w != "")
    return F.filter(words, lambda w: ~F.upper(w).isin("AND", "OR", "NOT", "NEAR"))


def fts_query(query: Column) -> Column:
    """The same as a search expression: each word quoted, all of them wanted."""
    return F.array_join(F.transform(fts_terms(query), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def catalogue_matches(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """id and entry_id: the entries (entry_id, text) that have all words asked for (id, query), by an inverted index of their words."""
    words = asked.select("id", F.array_distinct(F.flatten(F.transform(fts_terms(F.col("query")), T.tokens))).alias("words"))
    wanted = words.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    index = entries.select("entry_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return index.join(wanted, "word").groupBy("id", "entry_id", "n").agg(F.count("*").alias("met")).where("met = n").select("id", "entry_id")


def archive_kind(tags: Column, mimes: Column, manifest: Column) -> Column:
    """media, spa, documents or articles, from an archive's tags, its kinds of content (an array) and whether it has a manifest of documents."""
    low = F.lower(F.coalesce(tags, F.lit("")))
    plays = F.exists(mimes, lambda m: F.startswith(m, F.lit("video/")) | F.startswith(m, F.lit("audio/"))) | F.contains(low, F.lit("_videos:yes"))
    return F.when(plays, "media").when(F.contains(low, F.lit("_spa:yes")), "spa").when(manifest, "documents").otherwise("articles")


#: What a model's file name says of whether it thinks aloud, first match wins.
THINKING = [("instruct", "never"), ("thinking", "always"), ("lfm3", "toggle"), ("lfm", "always")]


def thinking_mode(filename: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[^.]*$", ""))
    return F.coalesce(*[F.when(F.contains(stem, F.lit(part)), mode) for part, mode in THINKING], F.lit("toggle"))
