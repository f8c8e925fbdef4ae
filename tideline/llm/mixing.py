"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share ``budget`` times all words.
   A target stops at ``ceiling`` times its source's words; the excess is shared again by weight.
2. Every source's documents are laid out in a keyed order, once per epoch, and cut into blocks of nearly
   ``block_words`` words at document starts. The mix takes the words before the target, so a source gives
   whole documents and at most one cut one.
3. The blocks of each source, an exact quota, are divided among the output shards by a splitting tree: the
   slots of a node are halved and the quotas of the left half are drawn from the multivariate hypergeometric
   law. Levels run as Spark jobs over (node, source) rows.
4. A shard draws its quota from the source's permuted blocks, disjoint from all other shards, and shuffles
   its documents locally.

Positions come from two-level prefix sums over hashed cells, so a source with a third of all rows is spread
over its cells. Every random draw is keyed by ``seed``: reruns agree. Null and empty texts have no words: they
are never taken. Rows that repeat a document lie side by side as documents of their own. Null sources form
one source. An empty table gives an empty result. ``mixed_documents`` carries
further columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.common import WORD, saved, shielded
from tideline.operators.ranking import rank_all

#: Words of a cell of the layout; a cell is the unit of one window task.
CELL_WORDS = 1 << 18
#: Levels of the splitting tree that one task draws before its children go to other tasks.
LEVELS_AT_ONCE = 6


@dataclass(frozen=True)
class Recipe:
    weights: tuple[int, ...] = (5, 2, 1)
    budget: float = 1.5
    ceiling: float = 2.0
    block_words: int = 1 << 16
    shard_blocks: int = 64
    seed: int = 20


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """A key that tells null from every text and sorts it last."""
    c = F.col(source)
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def source_targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """_s, source_size, weight, target from rows (_s, size). One row per source; the driver sees two sums a
    round. With level L, a source gets min(ceiling * size, L * weight); L rises until the shares are spent."""
    totals = sizes.groupBy("_s").agg(F.sum("size").alias("source_size"))
    ranked = rank_all(saved(totals, "source-totals"), ["_s"], "_r")
    weight = F.element_at(F.array(*map(F.lit, recipe.weights)), ((F.col("_r") - 1) % len(recipe.weights) + 1).cast("int"))
    ranked = saved(ranked.withColumn("weight", weight.cast("double")).withColumn("_cap", recipe.ceiling * F.col("source_size"))
                   .select("_s", "source_size", "weight", "_cap"), "sources")
    whole = recipe.budget * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, open_ = 0.0, -1.0
    while True:
        free = F.col("_cap") > F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, F.col("_cap"))).alias("c")).first()
        if row.w is None or row.w == open_:
            break
        open_ = row.w
        level = (whole - (row.c or 0.0)) / open_
    target = F.least(F.col("_cap"), F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target).drop("_cap")


def _identity() -> Column:
    """Equal for rows of equal id and text; also the keyed order of a source's documents."""
    return F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text"))


def lay_out(docs: DataFrame, recipe: Recipe, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """doc_id, size, _key, _s, source_size, target and _at, a document's word position in its source's keyed
    order; and the sources with their targets. Texts are read once, for their sizes."""
    slim = saved(docs.select("doc_id", _source_key(source).alias("_s"), words().alias("size"), _identity().alias("_key")), "mix-sizes")
    targets = saved(source_targets(slim, recipe), "targets")
    cells = F.ceil(F.col("source_size") / CELL_WORDS) + 1
    placed = slim.join(targets, "_s").withColumn("_order", F.xxhash64(F.lit(recipe.seed), "_key"))
    placed = placed.withColumn("_c", F.pmod(F.xxhash64("_order"), cells))
    sums = placed.groupBy("_s", "_c").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.select("_s", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "mix-cells")
    inside = Window.partitionBy("_s", "_c").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["_s", "_c"])
    return placed.withColumn("_at", F.col("_start") + F.col("_in")).drop("_c", "_in", "_start", "_order", "weight"), targets


def _halve(colors: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of the left half's ``slots``: one draw of the multivariate hypergeometric law."""
    return rng.multivariate_hypergeometric(colors, slots, method="marginals")


def _split(node: int, depth: int, first: int, last: int, quotas: np.ndarray, levels: int, capacity: int, seed: int):
    """Nodes ``levels`` further down: (node, first shard, last shard, quotas)."""
    if levels == 0 or last - first == 1:
        yield node, depth, first, last, quotas
        return
    middle = (first + last) // 2
    slots = min(int(quotas.sum()), (middle - first) * capacity)
    left = _halve(quotas, slots, np.random.default_rng([seed, depth, node]))
    yield from _split(2 * node, depth + 1, first, middle, left, levels - 1, capacity, seed)
    yield from _split(2 * node + 1, depth + 1, middle, last, quotas - left, levels - 1, capacity, seed)


_NODE = "node long, depth int, first long, last long, _s string, quota long"


def shard_quotas(blocks: DataFrame, shards: int, recipe: Recipe) -> DataFrame:
    """shard, _s, quota from rows (_s, blocks). Every shard but the last gets ``shard_blocks`` blocks."""
    tree = blocks.select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("first"),
                         F.lit(shards).cast("long").alias("last"), "_s", F.col("blocks").alias("quota"))

    def step(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_s")
        head = group.iloc[0]
        out = []
        for node, depth, first, last, quotas in _split(int(head.node), int(head.depth), int(head["first"]), int(head["last"]),
                                                       group.quota.to_numpy(np.int64), LEVELS_AT_ONCE, recipe.shard_blocks, recipe.seed):
            some = quotas > 0
            out.append(pd.DataFrame({"node": node, "depth": depth, "first": first, "last": last,
                                     "_s": group._s.to_numpy()[some], "quota": quotas[some]}))
        return pd.concat(out)

    reach = 1
    while reach < shards:
        tree = tree.groupBy("node", "depth", "first", "last").applyInPandas(step, _NODE)
        reach <<= LEVELS_AT_ONCE
    return tree.select(F.col("first").alias("shard"), "_s", "quota")


def _block_ranks(blocks: DataFrame, recipe: Recipe) -> DataFrame:
    """A keyed permutation of every source's block numbers: _s, block, _rank."""
    listed = blocks.select("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    listed = listed.withColumn("_h", F.xxhash64(F.lit(recipe.seed), "_s", "block"))
    listed = rank_all(listed, ["_s", "_h", "block"], "_g")
    start = blocks.select("_s", "blocks")
    start = rank_all(start, ["_s"], "_r")
    start = start.select("_s", F.coalesce(F.sum("blocks").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias("_base"))
    return listed.join(start, "_s").select("_s", "block", (F.col("_g") - 1 - F.col("_base")).alias("_rank"))


def mix(docs: DataFrame, recipe: Recipe = Recipe(), source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), pieces
    (array of shard, words, block; one for each time that the mix takes words of the document), _key."""
    placed, targets = lay_out(docs, recipe, source)
    limit = F.round("target").cast("long")
    blocks = saved(targets.select("_s", F.ceil(limit / recipe.block_words).alias("blocks")).filter("blocks > 0"), "mix-blocks")
    shards = max(1, -(-(blocks.agg(F.sum("blocks")).first()[0] or 0) // recipe.shard_blocks))
    quotas = saved(shard_quotas(blocks, shards, recipe), "quotas")
    upto = Window.partitionBy("_s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    # a shard draws, of each source, the permuted ranks of one interval
    spans = quotas.withColumn("_hi", F.sum("quota").over(upto)).select(
        "_s", "shard", F.explode(F.sequence(F.col("_hi") - F.col("quota"), F.col("_hi") - 1)).alias("_rank"))
    owner = saved(_block_ranks(blocks, recipe).join(spans, ["_s", "_rank"]).select("_s", "block", "shard"), "owners")
    times = range(math.ceil(recipe.ceiling))
    pieces = []
    for e in times:
        start = e * F.col("source_size") + F.col("_at")
        got = F.greatest(F.lit(0), F.least(F.col("size"), limit - start)).cast("long")
        # rows that get nothing this time look for blocks that don't exist, spread over many keys
        block = F.when(got > 0, F.floor(start / recipe.block_words)).otherwise(-1 - F.pmod("_key", F.lit(4096)))
        placed = placed.withColumn(f"_w{e}", got).withColumn("_b", block)
        found = owner.select("_s", F.col("block").alias("_b"), F.col("shard").alias(f"_o{e}"))
        placed = placed.join(found, ["_s", "_b"], "left").withColumnRenamed("_b", f"_b{e}")
        pieces.append(F.when(F.col(f"_w{e}") > 0, F.struct(F.col(f"_o{e}").alias("shard"), F.col(f"_w{e}").alias("words"),
                                                           F.col(f"_b{e}").alias("block"))))
    return placed.select("doc_id", "size", "source_size", "target", sum(F.col(f"_w{e}") for e in times).alias("taken"),
                         F.array_compact(F.array(*pieces)).alias("pieces"), "_key")


def mixed_documents(docs: DataFrame, recipe: Recipe = Recipe(), source: str = "source") -> DataFrame:
    """The mix itself: a row of ``docs`` for each piece, its text cut behind the last taken word and n_chars,
    if there, brought up to date; in shards, each in a keyed local order. Of rows with equal id and text, the
    pieces of all are given with the columns of one."""
    own, restore = shielded(docs, ("doc_id", "text", "n_chars"))
    chosen = mix(docs, recipe, source).filter("taken > 0")
    chosen = chosen.groupBy("_key").agg(F.flatten(F.collect_list("pieces")).alias("_pieces"), F.first("size").alias("_size"))
    out = own.withColumn("_key", _identity()).join(chosen, "_key").dropDuplicates(["_key"]).withColumn("_p", F.explode("_pieces"))
    # whole texts pass untouched; the one cut text of a source is rebuilt from its first words with their spaces
    runs = F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), 1)
    cut = F.when(F.col("_p")["words"] == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(runs, F.lit(1), F.col("_p")["words"].cast("int")), ""))
    out = out.withColumn("text", cut).withColumn("_shard", F.col("_p")["shard"])
    out = out.withColumn("_o", F.xxhash64(F.lit(recipe.seed), "_shard", "_key", F.col("_p")["block"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(out.repartition("_shard").sortWithinPartitions("_shard", "_o"))
