"""Jaccard self-join on word shingles by parity sketches and the pigeonhole principle.

Sets whose size has the same highest bit form a band. A band's sketch has a number of pieces fixed by the largest
symmetric difference d that two linked sets of the band can have, and some more. Every token (shingle) falls into
one piece and is XORed into it, so a piece of two sets differs only if a token of their symmetric difference falls
there: two linked sets agree in at least pieces - d pieces. A set whose partners may lie in the band below has the
sketch of that band too. Equal pieces meet in an equi-join.

A set must agree with some partner in ``need`` pieces, its own bound on pieces - d less its empty pieces. So it drops
out where fewer than ``need`` of its pieces occur in another document, and may drop its ``need - 1`` most frequent
ones: by the prefix principle over one global order, the rarest common piece of two linked sets is kept by both. This
takes passages that very many documents share out of the join. Empty pieces are left out, but for a set that has
``need`` or more of them: it keeps all pieces, empty ones too, and meets any other such set there. No link is lost;
nothing is capped. Candidates are pruned by size and by 1,024 parity bits, a lower bound on the symmetric difference,
then confirmed on their full sets (``linking``).

Texts lower-case A-Z; words are runs of anything but space and U+0009 to U+000D. A set is the distinct runs of
``width`` words, as 64-bit hashes; with fewer words the whole sequence is one. Null, empty and blank texts have
empty sets and link with nothing. Equal sets are one class before any comparison. Rows that repeat a ``doc_id`` are
one document, also where their texts differ. Rows without id link with nothing. Texts of any length are read whole.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import arrow_by_bytes, mix, odd_constants, saved, slices
from tideline.llm.linking import class_components, components, parity_bits
from tideline.llm.tokens import shingle_sets

#: Pieces beyond the largest difference of a band, as a share of it.
SPARE = 8
_PIECE = odd_constants(31, 64)
_VALUE = odd_constants(32, 64)
#: Digests that a task remembers, so that copies in its rows are sketched once.
_REMEMBERED = 250_000


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets with a and b elements."""
    return (a + b) * (100 - percent) // (100 + percent)


def pieces_of(band: int, percent: int) -> int:
    """Pieces of the sketch of sets with 2^band to 2^(band + 1) - 1 elements."""
    largest = (2 << band) - 1
    d = most_apart(largest, 100 * largest // percent, percent)
    return d + d // SPARE + 1


def sketches_of(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, pieces, pieces in which a set of n elements agrees with any partner there); none where only equal sets link."""
    if 100 * n < percent * (n + 1):
        return []
    band = n.bit_length() - 1
    out = [(band, pieces_of(band, percent), pieces_of(band, percent) - most_apart(n, 100 * n // percent, percent))]
    if -(-percent * n // 100) < 1 << band:  # partners in the band below
        pieces = pieces_of(band - 1, percent)
        out.append((band - 1, pieces, pieces - most_apart(n, (1 << band) - 1, percent)))
    return out


def piece_keys(tokens: np.ndarray, band: int, pieces: int, need: int) -> tuple[np.ndarray, int]:
    """Keys of a set's pieces, and in how many of them it must agree with a partner."""
    at = (tokens * _PIECE[band] >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)
    order = np.argsort(at.astype(np.uint16 if pieces < 1 << 16 else np.uint32), kind="stable")
    at, values = at[order], tokens[order] * _VALUE[band]
    new = np.empty(len(at), dtype=bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    filled = at[starts]
    keys = mix(np.bitwise_xor.reduceat(values, starts) + mix(filled * np.uint64(64) + np.uint64(band)))
    empty = pieces - len(filled)
    if empty < need:
        return keys, need - empty
    rest = np.setdiff1d(np.arange(pieces, dtype=np.uint64), filled, assume_unique=True)
    return np.concatenate([keys, mix(mix(rest * np.uint64(64) + np.uint64(band)))]), 1


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hi, lo (digest of the set), n_shingles, parity bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), width)
            digests = np.frombuffer(b"".join(_digest(s) for s in sets), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests[0::2]), pa.array(digests[1::2]), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(list(parity_bits(sets)), pa.list_(pa.int64()))], ["doc_id", "hi", "lo", "n_shingles", "bits"])

    return docs.mapInArrow(run, "doc_id long, hi long, lo long, n_shingles long, bits array<long>")


def _digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def pieces(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """hi (half of the set's digest), band, need, keys; sets that a task has met before are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for tokens in shingle_sets(batch.column(0), width):
                digest = _digest(tokens)
                if digest in met:
                    continue
                if len(met) >= _REMEMBERED:
                    met.clear()
                met.add(digest)
                hi = int(np.frombuffer(digest, dtype=np.int64)[0])
                for band, count, need in sketches_of(len(tokens), percent):
                    keys, need = piece_keys(tokens, band, count, need)
                    rows.append((hi, band, need, keys.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["hi", "band", "need", "keys"])

    return docs.select("text").mapInArrow(run, "hi long, band int, need long, keys array<long>")


def kept_pieces(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """hi, key: the pieces in which a set may meet a partner, by the prefix principle."""
    sketched = pieces(docs, width, percent)
    counts = sketched.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    shared = saved(counts, "pieces")
    rows = sketched.select("hi", "band", "need", F.explode("keys").alias("key")).join(shared, "key")
    mine = rows.groupBy("hi", "band").agg(F.max("need").alias("need"), F.sort_array(F.collect_set(F.struct("f", "key"))).alias("found"))
    mine = mine.filter(F.size("found") >= F.col("need"))
    return saved(mine.select("hi", F.explode(F.slice("found", F.lit(1), F.size("found") - F.col("need").cast("int") + 1)).alias("p")).select("hi", "p.key"), "kept")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    arrow_by_bytes(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = saved(described(docs, width), "sets")
    rows = slim.count()
    classes = saved(slim.filter("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "classes", rows)
    bands = kept_pieces(docs.filter("doc_id is not null"), width, percent).join(classes.select("hi", "node"), "hi").select("node", "key").distinct()
    facts = slim.join(classes, ["hi", "lo"]).filter("doc_id = node").select("node", F.col("n_shingles").alias("n"), "bits")
    return class_components(slim, classes, components(bands, facts, docs, width, percent))


#: DuckDB twin of the query: every pair that shares a shingle is counted, then links are followed to the end.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
