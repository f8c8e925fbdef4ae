"""Near duplicates by fast similarity sketching, banding and exact verification.

A set's sketch has ``BINS`` coordinates. In round i < BINS every element is thrown into one bin with the value
(i, hash); a bin keeps its smallest value. In round BINS + j all elements go to bin j, so every coordinate is
filled whatever the set's size; most sets are full after a few rounds, and their rounds end there. Two sets
agree in a coordinate with probability equal to their Jaccard similarity, with concentration as if coordinates
were independent. ``ROWS`` coordinates make a band; with 42 bands of 6 a pair of similarity 0.8 shares no
band with probability 3e-6, and then other links of its group remain.

Texts lower-case A-Z; words are runs of anything but space and U+0009 to U+000D. A set is the distinct runs of
``width`` words, as 64-bit hashes; with fewer words the whole sequence is one. Null, empty and blank texts
have empty sets and link with nothing. Equal sets are one class before any comparison. Rows that repeat a
``doc_id`` are one document, also where their texts differ: it links what either text links. Rows without id link with nothing and stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import WordHashes, arrow_by_bytes, bytes_of, mix, odd_constants, saved, shielded, slices
from tideline.llm.linking import class_components, components, parity_bits, shingle_set

ROWS = 6
BANDS = 42
BINS = ROWS * BANDS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_A = odd_constants(5, 2 * BINS)
_B = odd_constants(6, 2 * BINS)
_R = odd_constants(7, ROWS)
_BAND = odd_constants(8, BANDS)


def similarity_sketch(x: np.ndarray, owner: np.ndarray, sets: int, bins: int = BINS) -> np.ndarray:
    """Sketches (sets, bins) of ``sets`` sets given as elements ``x`` with the number of their set. Empty sets
    keep empty coordinates."""
    out = np.full(sets * bins, _EMPTY)
    table = out.reshape(sets, bins)
    open_ = np.unique(owner)
    t = np.uint64(bins)

    def closed(x: np.ndarray, owner: np.ndarray, open_: np.ndarray):
        still = (table[open_] == _EMPTY).any(axis=1)
        if still.all():
            return x, owner, open_
        alive = np.zeros(sets, dtype=bool)
        alive[open_[still]] = True
        mine = alive[owner]
        return x[mine], owner[mine], open_[still]

    for i in range(bins):
        if not len(open_):
            break
        h = mix(x * _A[i] + _B[i])
        place = owner * bins + (((h >> _HALF) * t) >> _HALF).astype(np.int64)
        free = out[place] == _EMPTY
        np.minimum.at(out, place[free], (h[free] & _LOW) | (np.uint64(i) << _HALF))
        x, owner, open_ = closed(x, owner, open_)
    for j in range(bins):
        if not len(open_):
            break
        need = np.zeros(sets, dtype=bool)
        need[open_] = table[open_, j] == _EMPTY
        mine = need[owner]
        h = mix(x[mine] * _A[bins + j] + _B[bins + j])
        np.minimum.at(out, owner[mine] * bins + j, (h & _LOW) | (np.uint64(bins + j) << _HALF))
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys of the bands."""
    parts = table.reshape(len(table), BANDS, ROWS)
    return mix((mix(parts) * _R).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, hi, lo (digest of the set), n_shingles; keys and parity bits, empty where only an equal set can link."""
    arrow_by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, "text"):
            sets = [shingle_set(b, width, cache) for b in bytes_of(batch, "text")]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            digests = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64)
            banded = np.flatnonzero(100 * n >= percent * (n + 1))
            many = [sets[k] for k in banded]
            owner = np.repeat(np.arange(len(many)), n[banded])
            table = similarity_sketch(np.concatenate(many) if many else np.zeros(0, np.uint64), owner, len(many))
            found: list[list] = [[[]] * len(sets), [[]] * len(sets)]
            for column, part in zip(found, (band_keys(table), parity_bits(many)), strict=True):
                for k, row in zip(banded, part, strict=True):
                    column[k] = row
            lists = [pa.array(column, pa.list_(pa.int64())) for column in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests[0::2]), pa.array(digests[1::2]), pa.array(n), *lists],
                ["doc_id", "hi", "lo", "n_shingles", "keys", "bits"])

    schema = "doc_id long, hi long, lo long, n_shingles long, keys array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def near_groups(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    slim = saved(sketches(docs, width, percent), "sketches")
    rows = slim.count()
    classes = saved(slim.filter("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "classes", rows)
    first = slim.filter(F.size("keys") > 0).join(classes, ["hi", "lo"]).filter("doc_id = node")
    reps = saved(first.select("node", "keys", "bits", F.col("n_shingles").alias("n")), "representatives", rows)
    bands = reps.select("node", F.explode("keys").alias("key"))
    labels = components(bands, reps.select("node", "n", "bits"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    return class_components(slim, classes, labels)


def near_survivors(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays: of each group the one with the smallest id."""
    gone = saved(near_groups(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone", docs.count())
    own, restore = shielded(docs, ("doc_id",))
    return restore(own.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"))


#: DuckDB twin of the query: every pair that shares a shingle is counted, then links are followed to the end.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
