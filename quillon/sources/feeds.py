"""Feeds and files: Atom catalogues, metalinks, manifests, benchmark sets, golden sets, ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillon.sources import snapshots

LINK = "array<struct<_rel:string,_type:string,_href:string,_length:string>>"
FIELDS = ("id", "name", "title", "summary", "subtitle", "language", "flavour", "tags", "articleCount", "issued", "updated")
ENTRY = ", ".join([*(f"{f} string" for f in FIELDS), f"link {LINK}"])
TEXT_TYPES = ("text/html", "text/vtt", "text/plain", "text/markdown")


def _absolute(href: Column, base_url: str) -> Column:
    """A link as found from `base_url`: as it stands, by scheme, from the root, or from beside the feed."""
    origin, beside = re.match(r"(\w+://[^/]*)?", base_url)[0], re.sub(r"(?<=[^/:])/[^/]*$", "/", base_url)
    return (
        F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(origin), href))
        .when(href != "", F.concat(F.lit(beside if beside.endswith("/") else beside + "/"), href))
    )


def atom_feed(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Catalogue rows of Atom feeds, a document to a file: entries with an id, a name and a link to be had from.

    Open-access links and those to archives count, the first of them, but for open-access ones, of which the last counts; the size is that
    of the last such link that has one. A title is the name where there is none, a summary the subtitle, an issue date that of the update; other
    missing fields are '' or 0. Malformed XML raises."""
    entries = spark.read.format("xml").option("rowTag", "entry").option("mode", "FAILFAST").schema(ENTRY).load(path)

    def has(attribute: Column, part: str) -> Column:
        return F.contains(F.coalesce(attribute, F.lit("")), F.lit(part))

    usable = F.filter("link", lambda x: has(x["_rel"], "open-access") | has(x["_type"], "application/x-zim"))
    counting = F.filter(usable, lambda x, i: (i == 0) | has(x["_rel"], "open-access"))
    sized = F.filter(counting, lambda x: F.coalesce(x["_length"], F.lit("")).rlike(r"^\d+$"))
    picture = F.get(F.filter("link", lambda x: has(x["_rel"], "image") & ~has(x["_rel"], "open-access") & ~has(x["_type"], "application/x-zim")), 0)["_href"]
    said = {f: F.coalesce(F.trim(f), F.lit("")) for f in FIELDS}

    def either(first: str, second: str) -> Column:
        return F.coalesce(F.nullif(said[first], F.lit("")), said[second])

    rows = entries.select(
        said["id"].alias("id"), said["name"].alias("name"), either("title", "name").alias("title"), either("summary", "subtitle").alias("summary"),
        *[said[f].alias(f) for f in ("language", "flavour", "tags")], either("issued", "updated").alias("issued"), F.coalesce(said["articleCount"].try_cast("bigint"), F.lit(0)).alias("article_count"),
        _absolute(F.try_element_at(counting, F.lit(-1))["_href"], base_url).alias("url"), F.coalesce(F.try_element_at(sized, F.lit(-1))["_length"].try_cast("bigint"), F.lit(0)).alias("size"),
        F.coalesce(_absolute(picture, base_url), F.lit("")).alias("illustration"),
    )
    return rows.where("id <> '' and name <> '' and url is not null")


def metalink(spark: SparkSession, path: str) -> DataFrame:
    """name, size, sha256 and mirrors of metalinks, a document to a file; mirrors by rising priority (999 without one), then in file order.
    Malformed XML raises."""
    schema = "_name string, size long, hash array<struct<_type:string,_VALUE:string>>, url array<struct<_priority:string,_VALUE:string>>"
    files = spark.read.format("xml").option("rowTag", "file").option("mode", "FAILFAST").schema(schema).load(path)
    numbered = F.transform("url", lambda u, i: F.struct(F.coalesce(u["_priority"].try_cast("int"), F.lit(999)).alias("p"), i.alias("i"), u["_VALUE"].alias("url")))
    sha = F.get(F.filter("hash", lambda h: h["_type"] == "sha-256"), 0)["_VALUE"]
    return files.select(F.col("_name").alias("name"), "size", sha.alias("sha256"), F.transform(F.array_sort(numbered), lambda u: u["url"]).alias("mirrors"))


def text_entries(entries: DataFrame) -> DataFrame:
    """Entries to be read as text, in path order within an archive: no redirects, text types only."""
    wanted = F.lit(False)
    for kind in TEXT_TYPES:
        wanted = wanted | F.col("mimetype").startswith(kind)
    return entries.where(~F.col("is_redirect") & wanted)


def read_entry(entries: DataFrame, path: Column) -> DataFrame:
    """Entries at a path less its fragment; redirects are given, not followed."""
    return entries.where(F.col("path") == F.split(path, "#")[0])


def main_entry(entries: DataFrame, main: str) -> DataFrame:
    """The main entry's path per archive, one redirect followed."""
    own = entries.where(F.col("path") == main).select("zim_id", "path", "redirect_target")
    return own.select("zim_id", F.coalesce("redirect_target", "path").alias("path"))


def media_sidecars(entries: DataFrame) -> DataFrame:
    """zim_id, path, video, poster and duration of JSON sidecars whose stub index/<slug> is an entry."""
    parsed = F.from_json(F.col("content").cast("string"), "videoPath string, thumbnailPath string, duration string")
    slug = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    rows = entries.where("mimetype = 'application/json'").select("zim_id", F.concat(F.lit("index/"), slug).alias("path"), parsed.alias("j"))
    rows = rows.where(F.col("j.videoPath").isNotNull())
    return rows.join(entries.select("zim_id", "path"), ["zim_id", "path"], "left_semi").select(
        "zim_id", "path", F.col("j.videoPath").alias("video"), F.col("j.thumbnailPath").alias("poster"), F.col("j.duration").alias("duration"))


def document_manifest(scripts: DataFrame, entries: DataFrame) -> DataFrame:
    """zim_id, doc_path, title, description and author of records in a script's DATABASE literal whose file is an entry."""
    body = F.regexp_extract(F.col("content").cast("string"), r"(?s)DATABASE\s*=\s*(.*)", 1)
    records = scripts.select("zim_id", F.explode(F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("r"))

    def field(name: str) -> Column:
        return F.regexp_extract("r", rf"""["']?\b{name}["']?\s*:\s*\[?\s*(?:"([^"]*)"|'([^']*)')""", 1)

    def either(name: str) -> Column:
        return F.coalesce(F.nullif(field(name), F.lit("")), F.regexp_extract("r", rf"""["']?\b{name}["']?\s*:\s*\[?\s*'([^']*)'""", 1))

    bare = either("fp")
    path = F.when(F.contains(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("files/"), bare))
    rows = records.select("zim_id", path.alias("path"), either("ti").alias("title"), either("dsc").alias("description"), either("aut").alias("author")).where("path <> 'files/'")
    return rows.join(entries.select("zim_id", "path"), ["zim_id", "path"], "left_semi").withColumnRenamed("path", "doc_path")


SOURCE = "array<struct<zim:string,article_title:string,article_path:string,required:boolean>>"
QUESTION = (
    f"id string, question string, capability string, difficulty string, slice string, expected_behavior string, answer string, sources {SOURCE},"
    " sub_facts array<struct<fact:string,source_index:int>>, level int, closed_book map<string,string>, oracle map<string,string>, status string"
)


def bench_questions(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions of a JSON file {questions: [...]}; level 3 where none is given. Invalid sets raise when read."""
    rows = spark.read.schema(S.StructType([S.StructField("questions", S.ArrayType(S.StructType.fromDDL(QUESTION)))])).option("multiLine", True).json(path)
    own = rows.select(F.explode("questions").alias("q")).select("q.*").withColumn("level", F.coalesce("level", F.lit(3)))
    bad = (
        F.when(F.col("id").isNull() | F.col("question").isNull(), "a question without id or text").when(~F.col("level").isin(1, 2, 3), "level is not 1 to 3")
        .when((F.col("expected_behavior") == "answer") & (F.coalesce(F.size("sources"), F.lit(0)) < 1), "an answer without a source")
    )
    copies = F.count("*").over(W.partitionBy("id"))
    checked = own.withColumn("__bad", F.coalesce(bad, F.when(copies > 1, "an id that comes twice")))
    return checked.withColumn("id", F.when(F.col("__bad").isNull(), F.col("id")).otherwise(F.raise_error(F.col("__bad")))).drop("__bad")


def golden_slices(spark: SparkSession, path: str) -> DataFrame:
    """Golden entries of a folder of YAML slices, or of one: id, query, slice (an entry's own wins), expected_paths, expected_fact, provenance."""
    snapshots.register(spark)
    return spark.read.format("slices").load(path)


def byte_range(header: str, size: int) -> tuple[int, int] | None:
    """First and last byte of a Range header; None when it cannot be met."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", header.strip())
    if not m or m[1] == m[2] == "" or size == 0:
        return None
    if m[1] == "":
        n = int(m[2])
        return (max(0, size - n), size - 1) if n else None
    first, last = int(m[1]), min(int(m[2]), size - 1) if m[2] else size - 1
    return (first, last) if first <= last else None
