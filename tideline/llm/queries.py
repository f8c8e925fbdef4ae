"""The corpus queries: thin digests of their operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import exact, fingerprints, langid, lines, manifest, mixing, neardup, packing, paritysketch, pii, prefixtrie, sharding, toxicity
from tideline.llm.common import crc_of_id, documents


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "n_found", "kinds")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    shards = F.array_sort(F.transform("pieces", lambda p: p["shard"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at(shards, F.lit(1)).alias("first_shard"))


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(documents(spark, sf_dir))


def op6_shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_evenly(documents(spark, sf_dir).select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.learn(docs, labels, crc_of_id() % 5 != 0)
    rows = toxicity.scored(docs, scorer, "doc_id", "text")
    return rows.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), F.col("_score").alias("score"),
                       toxicity.predicted().alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.filter(crc_of_id() % 4 != 2))
    return langid.identify(docs, model).select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(documents(spark, sf_dir))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paritysketch.jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_pii_pseudonyms, op2_mix_sources, op3_pack_sequences, op4_fingerprints, op5_near_dedup, op6_shard_groups,
    op7_exact_dedup, op8_line_dedup, op9_toxicity, op10_language_id, op11_merkle_manifest,
    op12_jaccard_join, op13_prefix_trie)}

ORACLE_SQL = {
    "op5_near_dedup": neardup.SQL,
    "op7_exact_dedup": exact.SQL,
    "op8_line_dedup": lines.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op12_jaccard_join": paritysketch.SQL,
    "op13_prefix_trie": prefixtrie.SQL,
}
