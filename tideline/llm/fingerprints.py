"""Document fingerprints: MinHash over word shingles.

A text's shingles, runs of ``WIDTH`` words with A-Z lower-cased (the whole sequence where words are fewer), are
hashed and sent through ``PERMUTATIONS`` universal hash permutations, all at once in numpy; the signature holds
the minimum of each. The fingerprint is the signature as hexadecimal text, the low 16 bits of each minimum: a minimum
over n shingles lies near 2^32 / n, so the high bits of long texts say little. The likeness of two fingerprints is the
share of equal places, an estimate of the shingle sets' Jaccard similarity.
``near_components`` joins bands of the signatures in Spark and verifies Jaccard on the full sets.

Null counts as empty. Texts without words share one fingerprint, which is like itself only. Equal texts have
equal fingerprints. Documents follow one another by ascending doc_id (a null id first, equal ids by text); the
document after the last is the first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import WordHashes, arrow_by_bytes, mix, odd_constants, saved, shingle_hashes, slices, texts_of, word_hashes
from tideline.llm.linking import components, parity_bits

WIDTH = 5
PERMUTATIONS = 128
#: Signature places of a band, for ``near_components``: 25 bands of 5 miss a pair of similarity 0.8 with 5e-5.
BAND_ROWS = 5
_A = odd_constants(21, PERMUTATIONS).astype(np.uint32)[:, None]  # odd: x -> a x + b permutes 32-bit numbers
_B = odd_constants(22, PERMUTATIONS).astype(np.uint32)[:, None]
_A |= np.uint32(1)
#: Shingles sent through all permutations at a time.
_CHUNK = 2048


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of a shingle collection (repeats change nothing); all ones for none."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), _CHUNK):
        values = _A * x[None, at : at + _CHUNK]
        values += _B
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _kept(places: np.ndarray) -> np.ndarray:
    return places & np.uint32(0xFFFF)


def fingerprint(places: np.ndarray) -> str:
    return _kept(places).astype(">u2").tobytes().hex()


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    return float((_kept(one) == _kept(two)).mean())


def text_signature(text: str, cache: WordHashes) -> np.ndarray:
    return signature(shingle_hashes(word_hashes(text.encode(), cache), WIDTH))


def _bucket(ids: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id, by binary search; null lies below all."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(ids < F.lit(bounds[middle]), search(lo, middle)).otherwise(search(middle + 1, hi))

    return F.when(ids.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, ahead: range partitions in ascending doc_id order, each followed by a copy of the first
    document of the next one (ahead = 1), the last by the first of all. One shuffle, no global window."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = [k / parts for k in range(1, parts)] or [0.5]
    row = ids.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls"),
                  F.percentile_approx("doc_id", share, 20 * parts).alias("cuts")).first()
    # bounds are ids that occur, so the row that opens a partition is known by its id
    bounds = sorted(set(row.cuts or []) - {row.low}) if parts > 1 else []
    first = F.col("doc_id").isNull() if row.nulls else F.col("doc_id") == F.lit(row.low)
    at = _bucket(F.col("doc_id"), bounds)
    opens = F.col("doc_id").isin(bounds) if len(bounds) < 200 else F.array_contains(F.lit(bounds), F.col("doc_id"))
    places = F.array_compact(F.array(
        F.struct(at.alias("part"), F.lit(0).alias("ahead")),
        F.when(opens, F.struct((at - 1).alias("part"), F.lit(1).alias("ahead"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("part"), F.lit(1).alias("ahead")))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.explode(places).alias("p"))
    rows = rows.select("doc_id", "text", F.col("p.ahead").alias("ahead"), F.col("p.part").alias("part"))
    return (rows.repartitionById(len(bounds) + 1, F.col("part"))
            .sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), "text").select("doc_id", "text", "ahead"))


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``_SCHEMA``; one row per row of ``docs``."""
    arrow_by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, over = WordHashes(), None, False
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc_id, text, ahead in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                if over:  # more than one document ahead has the same id
                    continue
                places = text_signature(text, cache)
                if last is not None:
                    before, before_text, before_places = last
                    changed = edited(before_text, text)
                    changed_places = text_signature(changed, cache)
                    out.append((before, len(before_text), sha256(changed.encode()).hexdigest(), fingerprint(before_places),
                                fingerprint(changed_places), likeness(before_places, changed_places), likeness(before_places, places)))
                last, over = (doc_id, text, places), bool(ahead)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return in_order(docs).mapInArrow(run, _SCHEMA)


def near_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, component_id: documents linked by signature bands, Jaccard of the full shingle sets verified.
    Documents without words, or without id, link with nothing and are not listed."""
    arrow_by_bytes(docs.sparkSession)
    bands = PERMUTATIONS // BAND_ROWS
    steps = odd_constants(23, BAND_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, "text"):
            ids, prints, keys, bits, n = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                shingles = shingle_hashes(word_hashes(text.encode(), cache), WIDTH)
                if len(shingles):
                    places = signature(shingles)
                    rows = places[: bands * BAND_ROWS].astype(np.uint64).reshape(bands, BAND_ROWS)
                    ids.append(doc_id)
                    distinct = np.unique(shingles)
                    bits.append(parity_bits([distinct])[0])
                    n.append(len(distinct))
                    prints.append(sha256(distinct.tobytes()).hexdigest())
                    keys.append(mix((mix(rows) * steps).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.string()), *lists,
                                              pa.array(n, pa.int64())], ["doc_id", "set", "keys", "bits", "n"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    slim = saved(plain.mapInArrow(run, "doc_id long, set string, keys array<long>, bits array<long>, n long"), "signatures")
    classes = saved(slim.groupBy("set").agg(F.min("doc_id").alias("node")), "classes")
    reps = saved(slim.join(classes, "set").filter("doc_id = node").select("node", "keys", "bits", "n"), "representatives")
    labels = components(reps.select("node", F.explode("keys").alias("key")), reps.select("node", "n", "bits"), plain, WIDTH, percent)
    named = classes.join(labels, "node", "left").select("set", F.coalesce("comp", "node").alias("component_id"))
    return slim.join(named, "set").select("doc_id", "component_id")
