"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group that is never divided (null counts as empty). Groups that are small against a
shard's capacity are bundled by hash, so that packing sees at most ``GRAIN`` bundles and ``GRAIN`` large
groups per expected shard, whatever the table's size. Items sorted by size enter the bin with the tightest
remaining capacity that holds them, found in a balanced tree; an item larger than the capacity gets a bin of
its own. Many shards are packed in regions of ``REGION_SHARDS`` shards, one Spark task each.

``shard_by_capacity`` opens as few shards of a fixed capacity as it can. ``shard_evenly`` has a fixed number
of shards and looks for the least capacity with which they suffice, so that their sizes come out near equal.
A document's size is its UTF-8 bytes plus one; rows that repeat a document count again and share its shard;
ties go by group key. Slots number the rows of a shard without gaps. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.common import saved, shielded

#: Bundles, and large groups, per expected shard; the packing's grain is capacity / GRAIN.
GRAIN = 512
#: Shards that one task packs.
REGION_SHARDS = 64
#: Rows of a shard that one task numbers.
CELL_ROWS = 50_000


class CapacityTree:
    """Open bins ordered by remaining capacity: a two-level B-tree. Best fit, insertion and removal search a
    short list of leaves and one leaf of at most 2 * LEAF entries."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # smallest entry of every leaf but the first

    def _leaf(self, key: tuple[int, int]) -> int:
        return bisect_right(self.tops, key)

    def add(self, remaining: int, number: int) -> None:
        at = self._leaf((remaining, number))
        leaf = self.leaves[at]
        insort(leaf, (remaining, number))
        if len(leaf) > 2 * self.LEAF:
            self.leaves[at : at + 1] = [leaf[: self.LEAF], leaf[self.LEAF :]]
            self.tops.insert(at, leaf[self.LEAF])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        at = self._leaf((size, -1))
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                found = leaf.pop(i)
                if not leaf and len(self.leaves) > 1:
                    del self.leaves[at]
                    del self.tops[max(0, at - 1)]
                return found
            at += 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size, in the order given (largest first). None when more than ``most`` bins are needed."""
    tree, bins, opened = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if opened == most:
                return None
            remaining, number = max(capacity, size), opened
            opened += 1
        else:
            remaining, number = found
        bins.append(number)
        tree.add(remaining - size, number)
    return bins


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Bins of the least capacity with which ``shards`` bins suffice, by bisection. A size above an even share
    fills a bin of its own, and the rest is evened out over the others."""
    total = sum(sizes)
    if shards > 1 and sizes and sizes[0] * shards > total:
        return [0, *(b + 1 for b in even_bins(sizes[1:], shards - 1))]
    low = -(-total // shards)
    high = low + max(sizes, default=0)  # then a full set of bins has no item left
    best = best_fit_decreasing(sizes, high, shards)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle, shards)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return best


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32 and the group key of its text."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", (F.octet_length(plain) + 1).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"),
                       F.struct(F.xxhash64(plain), F.xxhash64(F.lit(1), plain)).alias("_group"))


def _items(rows: DataFrame, unit: Column, bundles: int) -> DataFrame:
    """Rows with their item: the group itself where it exceeds ``unit``, else its bundle."""
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    large = saved(groups.filter(F.col("_bytes") > unit).select("_group", F.lit(True).alias("_large")), "large-groups")
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles))
    joined = rows.join(large, "_group", "left")
    key = F.when(F.col("_large"), F.concat(F.lit("g"), F.hex(F.col("_group.col1")), F.hex(F.col("_group.col2")))).otherwise(
        F.concat(F.lit("b"), bundle.cast("string")))
    return joined.withColumn("_item", key).drop("_large")


def _pack(rows: DataFrame, regions: int, packer) -> DataFrame:
    """_item, shard. ``packer`` maps sizes, largest first, to bins; regions get shard numbers one after another."""
    items = rows.groupBy("_item").agg(F.sum("size").alias("_size"))
    items = items.withColumn("_region", F.pmod(F.xxhash64(F.lit(3), "_item"), F.lit(regions)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_size", "_item"], ascending=[False, True])
        return group.assign(_bin=packer([int(x) for x in group._size]))[["_region", "_item", "_bin"]]

    packed = saved(items.groupBy("_region").applyInPandas(run, "_region long, _item string, _bin long"), "packed")
    used = packed.groupBy("_region").agg((F.max("_bin") + 1).alias("_n"))
    first = used.select("_region", F.coalesce(F.sum("_n").over(Window.orderBy("_region").rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)).alias("_first"))
    return packed.join(first, "_region").select("_item", (F.col("_first") + F.col("_bin")).cast("int").alias("shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Gapless slot in every shard: numbered inside hashed cells, shifted by the cells before."""
    n = rows.count()
    cell = F.pmod(F.xxhash64(F.lit(5), "doc_id", "size", "text_crc32"), F.lit(max(1, n // CELL_ROWS + 1) * 8))
    rows = rows.withColumn("_cell", cell)
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32"))
    return (rows.withColumn("_k", inside).join(counts, ["shard", "_cell"])
            .withColumn("slot", (F.col("_first") + F.col("_k") - 1).cast("long")).drop("_cell", "_k", "_first"))


def _place(docs: DataFrame, text: str, plan) -> DataFrame:
    """``plan`` maps the bytes of all texts to (capacity, expected shards, regions, packer)."""
    own, restore = shielded(docs, ("doc_id", text))
    slim = saved(sized(own, text).withColumn(text, F.lit(None).cast("string")), "sized")
    capacity, shards, regions, packer = plan(slim.agg(F.sum("size")).first()[0] or 0)
    items = saved(_items(slim, F.lit(capacity / GRAIN), GRAIN * shards), "shard-items")
    placed = saved(items.join(_pack(items, regions, packer), "_item").drop("_item", "_group"), "placed")
    return restore(with_slots(placed), "size", "text_crc32", "shard", "slot").drop(text)


def shard_evenly(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """``docs`` without the text, with size, text_crc32, shard, slot; sizes of shards near equal. One task packs
    all shards; it sees GRAIN * shards bundles and at most GRAIN * shards large groups."""
    return _place(docs, text, lambda total: (max(1, -(-total // shards)), shards, 1, lambda sizes: even_bins(sizes, shards)))


def shard_by_capacity(docs: DataFrame, capacity: int, text: str = "text") -> DataFrame:
    """The same columns with as few shards of ``capacity`` bytes as best fit decreasing needs."""
    def plan(total: int):
        shards = max(1, -(-total // capacity))
        return capacity, shards, -(-shards // REGION_SHARDS), lambda sizes: best_fit_decreasing(sizes, capacity)

    return _place(docs, text, plan)
