"""Toxicity of texts after noisy-channel deobfuscation.

1. A character language model: counts of letter trigrams and their contexts over all texts, in hashed tables of
   fixed size; the counts cover the whole corpus and grow with it.
2. Channel: a written character may stand for itself, for the letters that it looks like (leetspeak), for a
   masked letter, or for nothing (separators inside a word); a run of one letter may be a shorter run. Suspicious
   words and runs of single letters become character lattices, and Viterbi decoding finds the likeliest letters.
   Words of letters only are their own decoding, unless a letter stands three times in a row or several are doubled.
3. Score: logistic regression on words and their boundary-marked letter n-grams, as written and as restored;
   it is fitted on at most ``SAMPLE`` labelled rows, chosen by hash, and its ``FEATURES`` most telling features.

Only text is an input of a score. Null and empty texts get the score of a text without features. Rows that
repeat a document are scored alike. Null labels, and labels without a document, teach nothing; with one class or
none the score is the same for all. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import arrow_by_bytes, mix, odd_constants, saved, slices, texts_of

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 16_000
#: Hash slots of n-grams, chosen among 2**HASH_BITS by chi-squared, whose n-grams are the classifier's features.
FEATURES = 2048
HASH_BITS = 20
#: Slots of the hashed trigram and context counts.
LM_SLOTS = 1 << 18
_STEP = odd_constants(41, 4)
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER = re.compile(r"[\W\d_]+")

# Letters that a character is commonly written for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
#: Marks that hide a letter; any of these may be meant.
MASKS = {"*": "aeioustr", "#": "aeioustr"}
SEPARATORS = frozenset(".-_*~'`^,:;/\\ ")
#: Costs in nats: a look-alike, a masked letter, a separator or repeat dropped, a sign kept as a break.
LOOK, MASK, DROP, KEEP = 0.7, 2.5, 0.5, 6.0

#: Letters in runs: one three times, or three doubled letters close by, or a doubled one at both ends of a word.
_DOUBLED = r"([^\W\d_])\1[^\W\d_]?([^\W\d_])\2.*([^\W\d_])\3|^([^\W\d_])\4.*([^\W\d_])\5$"
_SUSPECT = re.compile(r"([^\W\d_])\1\1|[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]\d|\d[^\W\d_]|^[$@€£¡!|+(<{][^\W\d_]|[^\W\d_][$@€£+|!]{1,2}$|"
                      + re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + 1}", _DOUBLED))
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ .\-_*]{1,3}[^\W\d_]){2,}(?!\S)")
#: A text that none of these finds has nothing to restore: a letter three times or two doubled ones close by, a sign or
#: digit, punctuation before a letter, an exclamation mark after one, single letters in a row. Plain searches are much
#: faster than one with alternatives.
_RUNS = re.compile(r"([^\W\d_])\1(?:\1|[^\W\d_]?([^\W\d_])\2)")
_HINTS = (_RUNS, re.compile(r"[^\w\s.,;:!?]|\d"), re.compile(r"[.,;:!?][^\W\d_]"), re.compile(r"[^\W\d_]!"),
          re.compile(r"(?<!\S)[^\W\d_][ .\-_*]{1,3}[^\W\d_][ .\-_*]{1,3}[^\W\d_](?!\S)"))
_ENDS = re.compile(r"^([^\W\d_])\1.*([^\W\d_])\2$")
_EDGES = ".,;:?!\"')]}&%#*"
#: A sign three or more times at a word's end is ornament, no letter.
_ORNAMENT = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")


def may_hide(low: str) -> bool:
    """Whether a lower-cased text may hold anything to restore."""
    return any(p.search(low) for p in _HINTS)


def core(written: str) -> str:
    """A written word without ornaments and punctuation at its ends."""
    return _ORNAMENT.sub("", written.rstrip(".,;:?!")).rstrip(_EDGES).lstrip("\"'([{.,;:&%#*")


def cores(written: str) -> list[str]:
    """What of a lower-cased word may be meant: its core, and the core with an opening bracket or an exclamation mark that
    may stand for a letter."""
    inner = core(written)
    if not any(map(str.isalpha, inner)):
        return []
    out = [inner] if suspicious(inner) else []
    if written[0] in "({<" and written[1:2].isalpha() and not any(c in ")}>" for c in written):
        out.append(written[0] + inner)
    if written.endswith("!") and written[-2:-1].isalpha():
        out.append(inner + "!")
    return out


def _hash(points: np.ndarray, n: int) -> np.ndarray:
    total = np.full(max(0, len(points) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        total = (total + points[i : len(points) - n + 1 + i]) * _STEP[i]
    return (mix(total) % np.uint64(LM_SLOTS)).astype(np.int64)


@dataclass
class LetterModel:
    """Smoothed trigram probabilities; ``trigrams`` and ``contexts`` are hashed counts."""

    trigrams: np.ndarray
    contexts: np.ndarray
    seen: dict = field(default_factory=dict, repr=False)

    def cost(self, context: str, letter: str) -> float:
        key = context + letter
        value = self.seen.get(key)
        if value is None:
            if len(self.seen) > 30_000:
                self.seen.clear()
            points = np.array([ord(c) for c in key], dtype=np.uint64)
            n, of = self.trigrams[_hash(points, 3)[0]], self.contexts[_hash(points[:2], 2)[0]]
            value = self.seen[key] = -float(np.log((n + 0.05) / (of + 0.05 * 64)))
        return value


def letter_counts(docs: DataFrame) -> DataFrame:
    """kind (3 for trigrams, 2 for contexts), slot, n over all texts."""
    arrow_by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {3: np.zeros(LM_SLOTS, dtype=np.int64), 2: np.zeros(LM_SLOTS, dtype=np.int64)}
        for batch in slices(batches, "text", 1 << 18):
            plain = "  ".join(_OTHER.sub(" ", t.lower()) for t in texts_of(batch, "text"))
            points = np.frombuffer(f"  {plain}  ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            for n, held in counts.items():
                held += np.bincount(_hash(points, n), minlength=LM_SLOTS)
        for n, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(at), pa.array(held[at])], ["kind", "slot", "n"])

    return docs.select("text").mapInArrow(run, "kind int, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))


def letter_model(docs: DataFrame) -> LetterModel:
    """At most 2 * LM_SLOTS sums reach the driver, whatever the corpus."""
    rows = letter_counts(docs).toArrow()
    kind, slot, n = (rows[c].to_numpy() for c in ("kind", "slot", "n"))
    tables = {k: np.zeros(LM_SLOTS, dtype=np.int64) for k in (2, 3)}
    for k, table in tables.items():
        table[slot[kind == k]] = n[kind == k]
    return LetterModel(tables[3], tables[2])


def _options(written: str) -> list[list[tuple[str, float]]]:
    """The lattice: for every run of a written character, what may have been meant and at which cost."""
    out = []
    for c, group in itertools.groupby(written):
        run = len(list(group))
        letters = c.isalpha()
        means = [(c, 0.0)] if letters else [(x, LOOK) for x in LOOKS.get(c, "")] + [(x, MASK) for x in MASKS.get(c, "")]
        choices = [(x * k, cost * k + DROP * (run > k) * (1 if run > 2 else 2)) for x, cost in means for k in range(1, min(run, 2) + 1)]
        if c in SEPARATORS or c in MASKS:
            choices.append(("", DROP))
        if not letters:
            choices.append((" ", KEEP))
        out.append(choices)
    return out


def decode(written: str, model: LetterModel) -> str:
    """The likeliest letters of a lower-cased word: Viterbi over states of the last two letters."""
    states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    for choices in _options(written):
        after: dict[str, tuple[float, str]] = {}
        for context, (cost, text) in states.items():
            for letters, extra in choices:
                now, total = context, cost + extra
                for x in letters:
                    total += model.cost(now, x)
                    now = now[1] + x
                if now not in after or (total, text + letters) < after[now]:
                    after[now] = (total, text + letters)
        states = after
    return min((cost + model.cost(context, " "), text) for context, (cost, text) in states.items())[1].strip()


def suspicious(word: str) -> bool:
    return _SUSPECT.search(word) is not None


class Restorer:
    """Decodings of suspicious words, remembered by written word."""

    def __init__(self, model: LetterModel, most: int = 100_000):
        self.model, self.most, self.seen = model, most, {}

    def word(self, written: str) -> str:
        """What a suspicious word may mean, as words with a blank between; empty for all others."""
        found = self.seen.get(written)
        if found is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            found = self.seen[written] = " ".join(decode(x, self.model) for x in cores(written))
        return found

    def marked(self, text: str) -> str:
        """``^word$^word$...``: the words of a text, lower-cased letters only, and behind them the restored ones.
        Runs of single letters are tried as one word."""
        low = text.lower()
        parts = [low]
        if may_hide(low):
            odd = (w for w in set(low.split()) if not w.rstrip(".,;:?").isalpha() or _RUNS.search(w) or _ENDS.search(w.rstrip(".,;:?")))
            parts += filter(None, map(self.word, sorted(odd)))
            parts += [decode(m[0], self.model) for m in _SPACED.finditer(low)]
        return "^" + _OTHER.sub("$^", " ".join(parts)) + "$"


def restored_text(text: str, model: LetterModel) -> str:
    """The text with its suspicious words and spaced runs replaced by their decodings."""
    text = _SPACED.sub(lambda m: decode(m[0].lower(), model), text)

    def one(m: re.Match) -> str:
        low = m[0].lower()
        inner = next(iter(cores(low)), "")
        at = low.find(inner) if inner and len(low) == len(m[0]) else -1
        return m[0] if at < 0 else m[0][:at] + decode(inner, model) + m[0][at + len(inner) :]

    return _SPLIT.sub(one, text)


def grams_of(word: str) -> set[str]:
    """Features of a word: itself and its n-grams of 4 to 6 letters, word ends marked."""
    marked = f"^{word}$"
    return {marked} | {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << HASH_BITS) - 1)


class Matcher:
    """The features of a marked text, all found in one walk of an automaton."""

    def __init__(self, grams: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, gram in enumerate(grams):
            self.automaton.add_word(gram, k)
        self.automaton.make_automaton()
        self.empty = not grams

    def __call__(self, marked: str) -> list[int]:
        return [] if self.empty else sorted({k for _, k in self.automaton.iter(marked)})


@dataclass
class Scorer:
    letters: LetterModel
    grams: list[str]
    weights: np.ndarray
    bias: float

    def reader(self):
        """A function from text to score."""
        restorer, matcher = Restorer(self.letters), Matcher(self.grams)

        def score(text: str) -> float:
            z = self.bias + float(self.weights[matcher(restorer.marked(text))].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def _labelled(docs: DataFrame, labels: DataFrame, teaches: Column) -> DataFrame:
    """doc_id, toxic, text of at most about SAMPLE labelled rows, chosen by a hash of the id."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.filter("toxic in (0, 1) and doc_id is not null").filter(teaches).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = min(1.0, SAMPLE / max(1, told.count()))
    chosen = saved(told.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))), "labelled")
    if chosen.count() > 1.2 * SAMPLE:
        raise ValueError("more labelled rows than the bound of the sample")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def _fit(rows: list[np.ndarray], y: np.ndarray, n: int, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; both classes weigh alike."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    w, b, v, vb = np.zeros(n), 0.0, np.zeros(n), 0.0
    share = y.mean()
    importance = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(y)
    scale = np.sqrt(np.bincount(col, weights=importance[at], minlength=n) + 1e-3)
    for _ in range(steps):
        z = np.bincount(at, weights=w[col], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * importance
        grad = np.bincount(col, weights=g[at], minlength=n) + l2 * w
        v, vb = 0.9 * v - 0.3 * grad / scale, 0.9 * vb - 0.3 * g.sum()
        w, b = w + v, b + vb
    return w, b


def _words(marked: str) -> set[str]:
    return {w for w in marked[1:-1].split("$^") if w}


def _telling_grams(seen: DataFrame, one: float, zero: float) -> list[str]:
    """N-grams of the FEATURES hash slots that tell the classes apart best, from rows (toxic, marked)."""
    size = 1 << HASH_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size), dtype=np.int64)
        slots = lru_cache(100_000)(lambda word: np.fromiter({_slot(g) for g in grams_of(word)}, np.int32))
        for batch in slices(batches, "marked"):
            for y, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y, np.unique(np.concatenate([np.zeros(0, np.int32), *map(slots, _words(marked))]))] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], ["slot", "a", "b"])

    a, b = F.col("a"), F.col("b")  # texts of class 1 and 0 that have the feature
    found = seen.mapInArrow(counted, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    gap = a * F.lit(zero) - b * F.lit(one)
    chi = gap * gap * F.lit(one + zero) / (F.lit(one * zero) * (a + b) * (F.lit(one + zero) - a - b + 1e-9))
    best = found.filter(a + b >= 3).withColumn("chi", chi).orderBy(F.desc("chi"), "slot").limit(FEATURES).toArrow()
    chosen = frozenset(best["slot"].to_pylist())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in slices(batches, "marked"):
            fresh: set[str] = set()
            if len(known) > 200_000:
                known.clear()
            for marked in batch.column(1).to_pylist():
                for word in _words(marked) - known:
                    known.add(word)
                    fresh |= {g for g in grams_of(word) if _slot(g) in chosen}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh), pa.string())], ["gram"])

    return sorted(seen.mapInArrow(named, "gram string").distinct().toArrow()["gram"].to_pylist())


def learn(docs: DataFrame, labels: DataFrame, teaches: Column) -> Scorer:
    """Fit on the labelled rows for which ``teaches`` holds; the letter model reads every row of ``docs``."""
    spark = docs.sparkSession
    arrow_by_bytes(spark)
    letters = letter_model(docs)
    shared = spark.sparkContext.broadcast(letters)  # 2 * LM_SLOTS counts

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in slices(batches, "text"):
            marked = [restorer.marked(text) for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(marked, pa.string())], ["toxic", "marked"])

    sample = _labelled(docs, labels, teaches)
    seen = saved(sample.select("text", "toxic").mapInArrow(restored, "toxic int, marked string"), "restored")
    n = {r.toxic: float(r["count"]) for r in seen.groupBy("toxic").count().collect()}  # two rows
    if len(n) < 2:
        # one class or none: a constant, on the side of the class that was seen
        return Scorer(letters, [], np.zeros(0), {(): -2.0, (0,): -2.0, (1,): 2.0}[tuple(n)])
    grams = _telling_grams(seen, n[1], n[0])
    chosen = spark.sparkContext.broadcast(grams)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chosen.value)
        for batch in slices(batches, "marked"):
            hits = [matcher(marked) for marked in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["toxic", "hits"])

    rows = seen.mapInArrow(matched, "toxic int, hits array<int>").toArrow()  # SAMPLE rows of a few features
    w, bias = _fit([np.asarray(x, dtype=np.int64) for x in rows["hits"].to_pylist()], rows["toxic"].to_numpy().astype(float), len(grams))
    return Scorer(letters, grams, w, float(bias))


def scored(docs: DataFrame, scorer: Scorer, *columns: str) -> DataFrame:
    """The given columns of ``docs`` (the text must be one of them), and _score."""
    spark = docs.sparkSession
    arrow_by_bytes(spark)
    shared = spark.sparkContext.broadcast(scorer)
    rows = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in slices(batches, "text"):
            scores = [read(text) for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "_score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, _score double")


def predicted(score: str = "_score") -> Column:
    return F.when(F.col(score) >= 0.5, 1).otherwise(0).cast("int")
