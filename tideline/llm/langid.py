"""Language identification with language-bitmask n-gram filters.

Training counts the n-grams of all texts with a known language. A language contains an n-gram when its
relative frequency there is at least ``SHARE`` of the highest over all languages and it was seen ``LEAST``
times. The bit-sliced Bloom filter has ``SLOTS`` slots of one bit per language; an n-gram sets the bits of its
languages in ``PROBES`` slots, and the AND of these slots returns all languages that contain it at once. A
text's per-language popcounts are corrected for the filter's false positives, by the fill of each language's
slice, and the largest corrected share decides; ties go to the first language by name.

N-grams are runs of 2 to 4 code points of the lower-cased letters of a text, any run of other characters being
one blank, with a blank at both ends. Null texts and texts without a letter are ``und`` with score 0; so is
everything when no language was learned. Letters are what Python calls alphabetic: number signs such as ``½`` are none.
Null or empty languages teach nothing. Rows that repeat a document count again; further columns are not read. The
number of slots doubles from ``SLOTS`` until the language with the most n-grams fills at most ``FILL`` of its slice
(``PROBES`` * n-grams / slots bounds the fill), so a language's false positives stay at most ``FILL ** PROBES``.

The filter is a model of bounded size, ``FILTER_BYTES``, so that every task can hold it. Counts cover all rows; a
language with more n-grams than ``most_grams`` (1.3 million for up to 62 languages) keeps its most frequent ones.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm.common import arrow_by_bytes, mix, odd_constants, saved, slices, texts_of

SIZES = (2, 3, 4)
SHARE = 0.2
LEAST = 5
SLOTS = 1 << 21
PROBES = 3
#: Bound on the part of a language's slice that is set, and on the filter's bytes (8 a slot for every WORD_BITS languages).
FILL = 0.5
FILTER_BYTES = 1 << 26
#: Languages whose bits share one 64-bit integer.
WORD_BITS = 62

_OTHER = re.compile(r"[\W\d_]+")
#: Word characters that are no letters and no decimal digits, such as fractions; none is ASCII.
_SIGNS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_STEP = odd_constants(31, 8)
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 2_000_000


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts and the number of the text each is from."""
    # a class of characters that joins both kinds is searched six times as slowly
    plain = [t if t.isascii() or _SIGNS.isdisjoint(t) else "".join(" " if c in _SIGNS else c for c in t) for t in texts]
    plain = [f" {_OTHER.sub(' ', t.lower()).strip()} " for t in plain]
    lengths = np.array([len(p) for p in plain], dtype=np.int64)
    points = np.frombuffer("".join(plain).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # code points to the text's end
    found, owners = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        total = np.full(len(points) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total = (total + points[i : len(points) - n + 1 + i]) * _STEP[i]
        inside = left[: len(total)] >= n
        found.append(total[inside])
        owners.append(owner[: len(total)][inside])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(found)), np.concatenate(owners)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language; counted inside tasks first."""
    arrow_by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches, "text"):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = texts_of(batch, "text")
            for lang in sorted(set(langs)):
                grams, n = np.unique(gram_hashes([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((grams, n.astype(np.int64)))
                size += len(grams)
                if len(parts) == 16:
                    before = sum(len(p[0]) for p in parts)
                    parts[:] = [merged(parts)]
                    size -= before - len(parts[0][0])
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    known = docs.filter("lang is not null and lang <> ''").select("text", F.col("lang").cast("string").alias("lang"))
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    slots: np.ndarray  # (words, slots): one bit per language
    false_rate: np.ndarray  # per language

    def masks(self, grams: np.ndarray, word: int) -> np.ndarray:
        """The languages, of one word of the masks, that contain each n-gram."""
        size = self.slots.shape[1]
        out = self.slots[word][_slot(grams, 0, size)]
        for k in range(1, PROBES):
            out = out & self.slots[word][_slot(grams, k, size)]
        return out


def _slot(grams: np.ndarray, k: int, size: int) -> np.ndarray:
    return ((grams * _STEP[4 + k]) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def most_grams(words: int) -> int:
    """N-grams of a language that a filter with so many words of languages holds within ``FILTER_BYTES``."""
    size = 1 << (FILTER_BYTES // (8 * words)).bit_length() - 1
    return int(size * FILL) // PROBES


def slots_for(most: int, words: int) -> int:
    """Slots, a power of two, of which ``most`` n-grams of one language set at most ``FILL``."""
    size = min(SLOTS, 1 << (FILTER_BYTES // (8 * words)).bit_length() - 1)
    while PROBES * most > FILL * size:
        size *= 2
    return size


def kept_grams(counts: DataFrame, most: int) -> DataFrame:
    """lang, gram: what each language contains. Of more than ``most``, the most frequent counts that fit."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rate.filter(F.col("n") >= LEAST).join(top, "gram").filter(F.col("rate") >= SHARE * F.col("top"))
    kept = saved(kept.select("lang", "gram", "n"), "kept")
    sizes = kept.groupBy("lang", "n").agg(F.count("*").alias("c"))  # a row a language and count
    held = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    cut = sizes.withColumn("held", held).filter(F.col("held") <= most).groupBy("lang").agg(F.min("n").alias("cut"))
    return kept.join(cut, "lang").filter("n >= cut").select("lang", "gram")


def learn(docs: DataFrame) -> LanguageFilter:
    """Count, choose, and gather the filter: at most one row a slot and word of the masks reaches the driver."""
    counts = saved(gram_counts(docs), "grams")
    languages = tuple(r.lang for r in counts.select("lang").distinct().orderBy("lang").collect())  # one row per language
    number = {name: i for i, name in enumerate(languages)}
    words = max(1, -(-len(languages) // WORD_BITS))
    slots = np.zeros((words, 1), dtype=np.int64)
    if languages:
        kept = saved(kept_grams(counts, most_grams(words)), "kept")
        size = slots_for(kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0, words)
        index = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.col("lang"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                i = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.concatenate([_slot(grams, k, size) for k in range(PROBES)])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(i // WORD_BITS, PROBES)),
                                                  pa.array(np.left_shift(np.int64(1), np.tile(i % WORD_BITS, PROBES)))], ["slot", "word", "bits"])

        placed = kept.select("gram", index.cast("long").alias("i")).mapInArrow(place, "slot long, word long, bits long")
        slots = np.zeros((words, size), dtype=np.int64)
        rows = placed.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
        slots[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    fill = np.array([((slots[i // WORD_BITS] >> np.int64(i % WORD_BITS)) & 1).mean() for i in range(len(languages))])
    return LanguageFilter(languages, slots, fill**PROBES)


def shares(model: LanguageFilter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language the corrected share of n-grams that the language contains; and n-grams per text."""
    grams, owner = gram_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), len(model.languages)))
    for word in range(len(model.slots)):
        masks = model.masks(grams, word)
        for i in range(word * WORD_BITS, min(len(model.languages), (word + 1) * WORD_BITS)):
            hits = np.bincount(owner, weights=(masks >> np.int64(i % WORD_BITS)) & 1, minlength=len(texts))
            false = model.false_rate[i]
            out[:, i] = (hits / np.maximum(n, 1) - false) / max(1e-9, 1 - false)
    return np.clip(out, 0, 1), n


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score (the language's part of all corrected shares); one row per row of ``docs``."""
    spark = docs.sparkSession
    arrow_by_bytes(spark)
    shared = spark.sparkContext.broadcast(model)  # FILTER_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, "text", 1 << 18):
            texts = texts_of(batch, "text")
            part, n = shares(held, texts)
            letters = n > 2  # a text without letters is two blanks: one n-gram
            if held.languages:
                best = part.argmax(axis=1)
                total = part.sum(axis=1)
                score = np.where(letters & (total > 0), part[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
                name = [held.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                score, name = np.zeros(len(texts)), ["und"] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
