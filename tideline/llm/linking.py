"""From shared keys to verified components, without all pairs of a bucket.

Nodes that share a key are candidates. In a bucket every node is first compared with one centre; nodes that
linked to it, directly or through other buckets, are one component and need no comparison among themselves. A
second round takes other centres for what is still apart. At last every pair of nodes that share a bucket, lie
in different components and were not compared yet is taken once; so no candidate link between components is
missed. A bucket of many nodes is cut into blocks then, and every pair of blocks is a task's worth of its own.

No pair goes to the texts that its nodes' sizes or parity bits rule out: every element flips one of 1,024 bits, so
that the bits in which two sets differ bound their symmetric difference from below, whatever their sizes. Links
are confirmed on full shingle sets. Buckets are aggregated with partial results and joined back, never gathered in
one task. Components are found by minimum labels with pointer jumping over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import WordHashes, arrow_by_bytes, bytes_of, mix, saved, shingle_hashes, slices, word_hashes

#: Rounds with one centre a bucket before the remaining pairs across components are listed.
CENTRE_ROUNDS = 2
#: Words of 64 parity bits a node has.
PARITY_WORDS = 16
#: Nodes of a block of a bucket; two blocks meet in one place.
BLOCK_NODES = 256


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY_WORDS) parity sketches: each element flips one of 64 * PARITY_WORDS bits."""
    width = 64 * PARITY_WORDS
    bits = np.zeros((len(sets), width), dtype=np.uint8)
    for i, s in enumerate(sets):
        bits[i] = np.bincount((mix(s) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def may_link(percent: int) -> Column:
    """Whether sizes and parity bits of a pair (columns n, bits; and the same with a 2) allow a link. With intersection
    i, union u and symmetric difference d = u - i, percent * u <= 100 * i means d * (100 + percent) <= (n + n2) * (100 - percent)."""
    apart = F.aggregate(F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    sizes = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    return sizes & (apart * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent))


def connected(edges: DataFrame, rows: int) -> DataFrame:
    """(v, root) with the smallest node reachable, from at most ``rows`` edges (a, b) in any direction."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, "edges", 2 * rows)
    labels = saved(both.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v")), "labels", 2 * rows)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("low"))
        step = saved(labels.join(near, "v").select("v", "root", F.least("root", "low").alias("next")), "labels", 2 * rows)
        jump = step.select(F.col("v").alias("next"), F.col("next").alias("far"))
        root = F.least("next", "far")
        labels = saved(step.join(jump, "next").select("v", root.alias("root"), (F.col("root") != root).alias("moved")), "labels", 2 * rows)
        if labels.filter("moved").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")


def shingle_set(text: bytes, width: int, cache: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text, cache), width))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    arrow_by_bytes(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known, known_set = WordHashes(), None, None
        for batch in slices(batches, "text_b"):
            left, right, good = bytes_of(batch, "text_a"), bytes_of(batch, "text_b"), []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if x != known:
                    known, known_set = x, shingle_set(x, width, cache)
                other = shingle_set(y, width, cache)
                inside = len(np.intersect1d(known_set, other, assume_unique=True))
                if inside and 100 * inside >= percent * (len(known_set) + len(other) - inside):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    # the side with many partners, a, is joined last: its rows arrive together and its set is built once
    wide = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    wide = wide.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return saved(wide.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def _merge(labels: DataFrame, links: DataFrame, nodes: int) -> DataFrame:
    at = lambda name: labels.select(F.col("node").alias(name), F.col("comp").alias(f"c{name}"))
    edges = links.join(at("a"), "a").join(at("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    rows = links.count()
    if not rows:
        return labels
    roots = connected(saved(edges.distinct(), "merges", rows), rows).withColumnRenamed("v", "comp")
    return saved(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components", nodes)


def _ordered(rows: DataFrame, one: str, two: str) -> DataFrame:
    return rows.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose facts allow a link."""
    one = facts.withColumnRenamed("node", "a")
    two = facts.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return pairs.join(one, "a").join(two, "b").filter(may_link(percent)).select("a", "b")


def _across(told: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of told (key, node, comp, n, bits, m: nodes of the key) with a common key and different
    components that may link. A key's nodes lie in blocks; a pair meets in the place (key, its blocks)."""
    blocks = F.ceil(F.col("m") / BLOCK_NODES).cast("int")
    told = told.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = told.select("key", "node", "comp", "n", "bits", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    right = told.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "comp", "n", "bits")],
                        F.col("at").alias("j"), F.explode(F.sequence(F.lit(0), "at")).alias("i"))
    met = left.join(right, ["key", "i", "j"]).filter((F.col("comp") != F.col("comp2")) & ((F.col("i") < F.col("j")) | (F.col("node") < F.col("node2"))))
    return _ordered(met.filter(may_link(percent)), "node", "node2")


def components(bands: DataFrame, facts: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, comp) for every node that shares a key with another. ``bands``: node, key; ``facts``: node, n (size),
    bits (parity); ``docs``: doc_id, text of at least these nodes."""
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    meets = saved(bands.join(shared.select("key", "low"), "key"), "meets")
    met = meets.count()
    nodes = saved(meets.select("node").distinct(), "nodes", met)
    many = nodes.count()
    facts = saved(facts.join(nodes, "node").dropDuplicates(["node", "n", "bits"]), "facts")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node")
    texts = saved(texts, "texts")
    labels = nodes.withColumn("comp", F.col("node"))
    seen = None
    for number in range(CENTRE_ROUNDS + 1):
        if number == 0:
            pairs = _possible(_ordered(meets.filter("node <> low"), "node", "low"), facts, percent)
        else:
            told = meets.select("key", "node").join(labels, "node")
            apart = told.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"))
            apart = apart.filter("c0 <> c1 and m > 2").select("key", "m")  # two nodes of a bucket were compared already
            told = saved(told.join(apart, "key"), "apart", met)
            if number < CENTRE_ROUNDS:
                order = F.xxhash64(F.lit(number), "key", "node")  # other centres in every bucket
                centre = told.groupBy("key").agg(F.min_by(F.struct("node", "comp"), order).alias("c"))
                pairs = told.join(centre, "key").filter("comp <> c.comp").select("node", F.col("c.node").alias("centre"))
                pairs = _possible(_ordered(pairs, "node", "centre"), facts, percent)
            else:
                pairs = _across(told.join(facts, "node"), percent)
            pairs = pairs.join(seen, ["a", "b"], "left_anti") if seen is not None else pairs
        pairs = saved(pairs, "pairs", met)
        if pairs.isEmpty():
            continue  # centres may repeat or say nothing; the last round still compares all that remain apart
        seen = pairs if seen is None else saved(seen.unionByName(pairs), "seen", 2 * met)
        labels = _merge(labels, confirmed(pairs, texts, width, percent), many)
    return labels


def class_components(slim: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of slim (doc_id, hi, lo, n_shingles), from the classes
    (hi, lo, node) of equal sets and the labels (node, comp) of linked ones. Classes with a common ``doc_id`` are linked:
    rows that repeat an id are one document, whatever their texts."""
    own = slim.select("doc_id", "hi", "lo", "n_shingles")
    mine = own.filter("n_shingles > 0 and doc_id is not null").join(classes, ["hi", "lo"])
    twice = mine.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    twice = saved(mine.join(twice, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "twice")
    if not twice.isEmpty():
        every = classes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        labels = _merge(saved(every, "components"), twice, classes.count())
    named = classes.join(labels, "node", "left").select("hi", "lo", F.coalesce("comp", "node").alias("comp"))
    out = own.join(named, ["hi", "lo"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
