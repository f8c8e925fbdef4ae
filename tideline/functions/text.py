"""Text and event scoring as column expressions over whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

from tideline.functions.numeric import bind, clip, num

# Lexicon weights, event vocabularies and source grades must equal the published ones.
POSITIVE_WEIGHTS = {
    "beat": 2.0, "beats": 2.0, "raise": 1.5, "raises": 1.5, "upgrade": 1.5, "upgraded": 1.5, "bullish": 1.2,
    "strong demand": 1.8, "record": 1.0, "surge": 1.0, "jumps": 0.8, "rally": 0.8, "partnership": 0.8, "wins": 1.0,
    "outperform": 1.2, "buy rating": 1.2, "price target raised": 1.8, "growth": 0.6, "data center": 0.5}
NEGATIVE_WEIGHTS = {
    "miss": -2.0, "misses": -2.0, "cut": -1.2, "cuts": -1.2, "downgrade": -1.6, "downgraded": -1.6, "bearish": -1.2,
    "weak": -1.0, "delay": -1.3, "delayed": -1.3, "probe": -1.4, "investigation": -1.4, "lawsuit": -1.5, "ban": -1.5,
    "export controls": -1.7, "restrictions": -1.4, "tariff": -1.0, "slump": -1.0, "falls": -0.8, "sell rating": -1.3,
    "price target cut": -1.8, "competition": -0.5}
TOPIC_TERMS = {
    "earnings": ["earnings", "revenue", "guidance", "margin", "eps", "quarter"],
    "analyst": ["upgrade", "downgrade", "price target", "rating", "outperform", "buy rating", "sell rating"],
    "regulatory": ["export controls", "china", "ban", "restriction", "regulation", "probe", "investigation", "tariff"],
    "product": ["blackwell", "gpu", "chip", "data center", "cuda", "ai server", "supply"],
    "competition": ["amd", "broadcom", "avgo", "tsmc", "intel", "asic", "competition"]}
EVENT_KEYWORDS = {
    "earnings": ["earnings", "eps", "quarter", "revenue", "margin", "results"],
    "guidance": ["guidance", "forecast", "outlook", "raised outlook", "lowered outlook", "guide"],
    "analyst": ["upgrade", "downgrade", "price target", "rating", "initiated", "outperform", "underperform"],
    "product": ["blackwell", "gpu", "h100", "h200", "b200", "cuda", "launch", "chip", "server"],
    "supply_chain": ["tsmc", "asml", "cowos", "supply", "shipment", "lead time", "capacity", "supplier"],
    "export_control": ["export control", "china", "restriction", "ban", "license", "commerce department"],
    "competition": ["amd", "broadcom", "intel", "asic", "competitive", "competition"],
    "customer_capex": ["capex", "capital expenditure", "microsoft", "meta", "amazon", "google", "oracle", "data center spend"],
    "valuation": ["valuation", "multiple", "p/e", "price-to-sales", "expensive", "bubble"],
    "macro_ai_trade": ["ai trade", "nasdaq", "rates", "treasury", "risk appetite", "semiconductor rally"],
    "legal_regulatory": ["lawsuit", "probe", "investigation", "regulator", "antitrust", "subpoena"]}
SENTIMENT_POSITIVE = ["beat", "beats", "raise", "raises", "upgrade", "strong demand", "record", "accelerating", "wins",
                      "outperform", "price target raised"]
SENTIMENT_NEGATIVE = ["miss", "misses", "cut", "cuts", "downgrade", "delay", "delayed", "restriction", "export control",
                      "probe", "lawsuit", "margin pressure", "price target cut"]
RELEVANCE_TERMS = ["blackwell", "cuda", "h100", "h200", "gb200", "gpu", "data center", "ai chip"]
SOURCE_GRADES = {
    "reuters": 0.95, "bloomberg": 0.95, "wall street journal": 0.93, "the wall street journal": 0.93, "sec": 0.92, "cnbc": 0.86,
    "marketwatch": 0.78, "barron's": 0.80, "yahoo finance": 0.72, "zacks": 0.68, "seeking alpha": 0.62}
SOURCE_WEIGHTS = {
    "reuters": 1.15, "bloomberg": 1.15, "cnbc": 1.05, "wall street journal": 1.15, "the wall street journal": 1.15,
    "barron's": 1.05, "marketwatch": 0.95, "yahoo finance": 0.95, "investing.com": 0.90,
    "seeking alpha": 0.85}
ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def clean_text(c) -> Column:
    """Tags to blanks, listed entities to characters, white space to single blanks."""
    out = F.regexp_replace(num(c), "<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def article_id(title, link) -> Column:
    norm = F.trim(F.regexp_replace(F.lower(num(title)), r"[^\p{L}\p{N}_]+", " "))
    return F.substring(F.sha1(F.concat_ws("|", norm, num(link)).cast("binary")), 1, 16)


def story_hash(day, headline) -> Column:
    """Date and lower-case headline as one key: copies of a story share it."""
    return F.substring(F.sha2(F.concat_ws("|", num(day).cast("string"), F.lower(num(headline))).cast("binary"), 256), 1, 20)


#: Every term that a score below asks for.
TERMS = sorted({*POSITIVE_WEIGHTS, *NEGATIVE_WEIGHTS, *SENTIMENT_POSITIVE, *SENTIMENT_NEGATIVE, *RELEVANCE_TERMS,
                *(t for terms in (*TOPIC_TERMS.values(), *EVENT_KEYWORDS.values()) for t in terms)})


def _one_of(chars) -> str:
    return f"[{''.join(re.escape(c) for c in sorted(set(chars)))}]"


def _any_of(terms, few: int = 5) -> str:
    """Pattern of the longest of the terms at a place, by shared first letters; many letters are tried in groups."""
    tails: dict[str, list[str]] = {}
    for t in terms:
        if t:
            tails.setdefault(t[0], []).append(t[1:])
    heads = sorted(tails)
    parts = [re.escape(head) + _any_of(tails[head]) for head in heads]
    if len(parts) > 2 * few:
        parts = [f"(?={_one_of(heads[k:k + few])})(?:{'|'.join(parts[k:k + few])})" for k in range(0, len(parts), few)]
    one = f"(?:{'|'.join(parts)})" if len(parts) > 1 else "".join(parts)
    return f"(?:{one})?" if parts and "" in terms else one


def mentions(lowered, terms: list[str] = TERMS) -> Column:
    """The listed terms of a text as one short text, read in a single pass instead of one search a term. It has the
    longest term of every place, one a line; shorter terms there begin it, so a listed term is contained in the result
    exactly if it is contained in the text. Texts without any are told apart first, at a fraction of the cost."""
    anywhere = "|".join(re.escape(t) for t in sorted(terms))

    def found_any(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, anywhere)

    some = F.arrow_udf(found_any, BooleanType())(num(lowered))
    begins = "".join(_one_of(t[k] for t in terms) for k in range(min(map(len, terms))))  # most places fail here
    found = F.regexp_extract_all(num(lowered), F.lit(f"(?={begins})(?=({_any_of(terms)}))"), F.lit(1))
    return F.when(~some, F.lit("")).otherwise(F.array_join(F.array_distinct(found), "\n"))


def hits(lowered, terms: list[str]) -> Column:
    """How many of the terms occur in the text, each counted once."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(num(lowered), t)))


def lexicon_score(lowered, weight=1.0) -> Column:
    """Weights of the contained terms, times the source weight, squashed by tanh(x / 4)."""
    terms = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in {**POSITIVE_WEIGHTS, **NEGATIVE_WEIGHTS}.items()])
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.when(F.contains(num(lowered), x["t"]), x["w"]).otherwise(F.lit(0.0)))
    return F.tanh(total * num(weight) / 4.0)


def topic_scores(lowered) -> Column:
    return F.create_map(*[x for k, terms in TOPIC_TERMS.items() for x in (F.lit(k), F.least(hits(lowered, terms) / 3.0, F.lit(1.0)))])


def event_type(lowered) -> Column:
    """Type with the most keyword hits; ties go to the larger name, no hit is neutral."""
    scored = F.array(*[F.struct(hits(lowered, t).alias("h"), F.lit(k).alias("k")) for k, t in EVENT_KEYWORDS.items()])
    return bind(F.array_max(scored), lambda b: F.when(b["h"] > 0, b["k"]).otherwise(F.lit("neutral")))


def keyword_sentiment(lowered) -> Column:
    return F.tanh((hits(lowered, SENTIMENT_POSITIVE) - hits(lowered, SENTIMENT_NEGATIVE)) / 3.0)


def source_quality(source, default: float = 0.55) -> Column:
    """Grade of the first listed source whose name is contained."""
    s = F.lower(F.trim(num(source)))
    out = F.lit(default)
    for name, grade in reversed(SOURCE_GRADES.items()):
        out = F.when(F.contains(s, F.lit(name)), grade).otherwise(out)
    return out


def relevance(lowered, in_scope, terms: list[str] | None = None) -> Column:
    base = F.lit(0.25) + F.when(in_scope, 0.35).otherwise(0.0)
    return clip(base + F.least(hits(lowered, terms or RELEVANCE_TERMS) * 0.12, F.lit(0.40)), 0.0, 1.0)


def word_count(c) -> Column:
    return F.size(F.regexp_extract_all(num(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def importance(kind, rel, quality, sentiment, words) -> Column:
    boost = F.when(num(kind).isin("earnings", "guidance", "export_control", "customer_capex"), 0.20).otherwise(0.10)
    long_text = F.least(num(words) / 500.0, F.lit(0.20))
    return clip(F.lit(0.25) + 0.30 * num(rel) + 0.20 * num(quality) + 0.20 * F.abs(num(sentiment)) + boost + long_text, 0.0, 1.0)


#: SQL for a text's lower-case words, with one blank between two.
WORDS = r"trim(regexp_replace(lower({0}), r'[^\p{{L}}\p{{N}}]+', ' '))"
#: Texts whose words are looked up at once: bounds the arrays in memory, not the work.
TEXTS_AT_ONCE = 256


def _numbered(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number) of every known word of blank-separated texts, and which of these are followed by the next one."""
    words = pc.split_pattern(texts, " ")
    number = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=known), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(number >= 0)
    text, number = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)[at], number[at].astype(np.int64)
    return text, number, np.flatnonzero((np.diff(at) == 1) & (np.diff(text) == 0))


def pair_counts(batches: Iterator[pa.RecordBatch], known: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, n): neighbours among the known words of a column of blank-separated texts, counted piece by piece."""
    names = pa.array(known, pa.string())
    for b in batches:
        for k in range(0, b.num_rows, TEXTS_AT_ONCE):
            _, number, first = _numbered(b.column(0).slice(k, TEXTS_AT_ONCE), names)
            pairs, n = np.unique(number[first] * len(known) + number[first + 1], return_counts=True)
            a, b_ = (names.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(known))))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(a, b_, " "), pa.array(n, pa.int64())], ["term", "n"])


def count_vectors(texts: pa.Array, vocabulary: list[str]) -> pa.Array:
    """Sparse vectors of how often blank-separated texts hold the one- and two-word terms; a pair's words are terms too."""
    place = {t: k for k, t in enumerate(vocabulary)}
    singles = [t for t in vocabulary if " " not in t]
    number = {t: k for k, t in enumerate(singles)}
    places = np.array([place[t] for t in singles], np.int64)
    pairs = sorted((number[a] * len(singles) + number[b], k) for t, k in place.items() if " " in t for a, b in [t.split(" ")])
    keys, columns = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.array([-1], np.int64), np.array([0], np.int64))
    width, pieces = max(1, len(vocabulary)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(texts), TEXTS_AT_ONCE):
        text, known, first = _numbered(texts.slice(k, TEXTS_AT_ONCE), pa.array(singles, pa.string()))
        pair = known[first] * len(singles) + known[first + 1]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[at] == pair
        cells = np.concatenate([text * width + places[known], text[first[hit]] * width + columns[at[hit]]])
        cells, n = np.unique(cells, return_counts=True)
        pieces.append((cells + k * width, n))
    cells, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
    ends = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1, dtype=np.int64) * width), pa.int32())
    indices = pa.ListArray.from_arrays(ends, pa.array(cells % width, pa.int32()))
    values = pa.ListArray.from_arrays(ends, pa.array(n, pa.float64()))
    sparse, size = pa.array(np.zeros(len(texts)), pa.int8()), pa.array(np.full(len(texts), len(vocabulary)), pa.int32())
    return pa.StructArray.from_arrays([sparse, size, indices, values], ["type", "size", "indices", "values"], mask=pc.is_null(texts))


def string_set(c) -> Column:
    """Upper-case distinct sorted members of a list written with commas, bars, semicolons or blanks."""
    parts = F.split(F.upper(num(c)), r"[,|;\s]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
