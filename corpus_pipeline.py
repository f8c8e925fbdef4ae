"""The training-corpus pipeline: toxicity, exact duplicates, near duplicates, mixing, packing.

Each stage takes what its predecessor kept. ``run`` writes every stage as Parquet to the shared folder and
reads it back. All stages but the last return the columns of ``documents``; the last returns a row per piece
of packed text. Rows of a document that the mix takes twice are packed twice. The stages handle null columns,
empty tables and further columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact, mixing, neardup, packing, toxicity
from tideline.llm.common import crc_of_id, documents, saved, shielded


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go. Labels teach the scorer; no label is an input of a score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.learn(docs, labels, crc_of_id() % 5 != 0)
    own, restore = shielded(docs, ("doc_id", "text"))
    return restore(toxicity.scored(own, scorer, *own.columns).filter(toxicity.predicted() == 0))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the smallest doc_id stays."""
    return exact.exact_survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return neardup.near_survivors(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in shards."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, sketches and draws have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
