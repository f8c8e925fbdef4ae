"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of the digests, one per partition and merged by addition, name every digest that may
hold ``1/share`` of all rows. Their exact counts and first ids are verified in one aggregation; the winners
are few by construction and are broadcast, so copies of the hottest texts are settled where they lie. All
other digests go through an ordinary shuffle.

Texts are equal when identical after each run of white space became one space. Null counts as empty. The
row with the smallest ``doc_id`` stays; a null id comes after all others. Rows that repeat a ``doc_id`` with
an equal text count in ``group_size`` and are flagged alike, and ``exact_survivors`` returns one of them. An
empty table gives an empty result; further columns are carried by ``exact_survivors``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import SPACE, saved, shielded

#: A digest is heavy when it holds more than 1/SHARE of all rows.
SHARE = 256
#: Counters of one summary; its error is below rows / COUNTERS.
COUNTERS = 1024


def digest(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").cast("binary"), 256)


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(Counter(batch.column(0).to_pylist()))
            if len(held) > counters:  # merge of two summaries: take the (k+1)-th largest count from all
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - cut for k, v in held.items() if v > cut})
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    return run


def heavy_hitters(digests: DataFrame, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """Digest, first id and exact count of every digest above ``rows / share``.

    A summary with k counters is low by at most rows / (k + 1), over all partitions together, so a digest
    above rows / share keeps at least rows * (1/share - 1/(k+1)); counts add up to rows at most, which bounds
    how many can: below 2 * share for k >= 2 * share - 1."""
    if counters < 2 * share - 1:
        raise ValueError("counters must be at least 2 * share - 1")
    rows = digests.count()
    least = rows / share - rows / (counters + 1)
    named = (digests.select("digest").mapInArrow(_summary(counters), "digest string, n long")
             .groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(least)))
    named = saved(named.select("digest"), "named")
    exact = (digests.join(F.broadcast(named), "digest", "left_semi")
             .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return saved(exact.filter(F.col("group_size") > F.lit(rows / share)), "heavy")


def exact_groups(docs: DataFrame, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, heavy; one row per row of ``docs``."""
    slim = saved(docs.select("doc_id", digest().alias("digest")), "digests")
    heavy = heavy_hitters(slim, share, counters)
    winners = F.broadcast(heavy)
    settled = slim.join(winners, "digest").withColumn("heavy", F.lit(True))
    light = slim.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    shuffled = light.join(groups, "digest").withColumn("heavy", F.lit(False))
    return settled.unionByName(shuffled).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "heavy")


def exact_survivors(docs: DataFrame, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Copies of heavy digests leave before any text
    is shuffled; the rest meets the slim list of ids that stay."""
    own, restore = shielded(docs, ("doc_id", "text"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))
    stay = exact_groups(own, share, counters).filter("kept").select(
        F.col("text_sha256").alias("_digest"), ident.alias("_ident"), "heavy").distinct()
    stay = saved(stay, "stay")
    heavy = stay.filter("heavy").select("_digest", F.col("_ident").alias("_first"))
    told = own.withColumn("_digest", digest()).withColumn("_ident", ident).join(F.broadcast(heavy), "_digest", "left")
    told = told.filter(F.col("_first").isNull() | (F.col("_first") == F.col("_ident"))).drop("_first")
    kept = told.join(stay.select("_digest", "_ident"), ["_digest", "_ident"], "left_semi")
    return restore(kept.dropDuplicates(["_digest", "_ident"]))  # the join's keys: no further shuffle


#: DuckDB twin of the query.
SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
