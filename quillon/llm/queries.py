"""The numbered queries: thin wrappers that derive their columns from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, clustering, collisions, decontaminate, extract, fingerprints, language, lexical, mixing, quality, secrets, sharding, simhash, sql
from quillon.llm._common import table


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.prefix_targets(turns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.RULES
    found = secrets.found_spans(table(spark, sf_dir, "documents"), rules)
    base = F.filter("spans", lambda s: s["rule"].isin([i for i, r in enumerate(rules) if r.base]))

    def count(kind: str):
        number = [r.kind for r in rules].index(kind)
        return F.size(F.filter("spans", lambda s: s["rule"] == number)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.size("hits").cast("bigint")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_edit_fingerprints, op2_chat_prefix_targets, op3_secret_scan, op4_decontaminate, op5_quality, op6_html_extract, op7_simhash, op8_mixing, op9_language_id,
    op10_sharding, op11_embedding_dedup, op12_lexical_search, op13_centroid_clustering,
)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES) | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
