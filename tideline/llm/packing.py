"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

A document is its token ids and one closing id 0. Documents above ``limit`` tokens are cut into pieces of
``limit``; only the first piece may be shorter. Full pieces are sequences of their own, all others are items.
Items are dealt into blocks of about ``BLOCK_ITEMS`` by hash. Each block is evolved on several islands: an
individual is a grouping of the block's items into sequences; crossover injects well-filled sequences of one
parent into the other, drops sequences that would repeat an item and puts the displaced items back by best
fit, largest first. After each round the elite of an island migrates to the next one. An island rests once it
has met the lower bound. Sequences that stayed loose in their blocks are pooled and packed once more.

Null text counts as empty: one piece of length 1. Rows that repeat a document are packed as documents of their
own. Ties go by id, piece and checksum; draws are keyed, so reruns agree. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import arrow_by_bytes, saved, slices, texts_of

LIMIT = 2048
BLOCK_ITEMS = 2048
ISLANDS = 2
ROUNDS = 2
POPULATION = 6
OFFSPRING = 6
#: States of islands in a file of the table between two rounds.
STATES_A_FILE = 128
#: A sequence is loose, and its items are packed again with others', below this fill.
LOOSE = 0.98

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth int"


# Two encoders for one vocabulary: its own library's, and one that is faster on plain letters. Both split by the
# same pattern, but their tables of letters and digits belong to different Unicode versions; texts beyond Latin
# script, and texts that hold the literal of an added token, are left to the first, which is loaded only where there
# are any.


@cache
def _own(vocabulary: str):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(vocabulary))


@cache
def _literals(vocabulary: str) -> tuple[str, ...]:
    """Texts that the vocabulary's library encodes as one added token."""
    from public_tokenizers import path

    with open(path(vocabulary), encoding="utf-8") as lines:
        return tuple(x["content"] for x in json.load(lines).get("added_tokens") or ())


@cache
def _fast(vocabulary: str):
    import tiktoken
    from public_tokenizers import PATTERN, path

    with open(path(vocabulary.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = "byte_bpe_50k.json") -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers, without special tokens."""
    if (text.isascii() or max(text) < "ɐ") and not any(x in text for x in _literals(vocabulary)):
        return np.asarray(_fast(vocabulary).encode_ordinary(text), dtype="<u4")
    return np.asarray(_own(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, nth (number of the document among its task's) and, on demand, ids of
    every piece of every document."""
    arrow_by_bytes(docs.sparkSession)
    schema = _PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                nth = (nth + 1) % (1 << 30)
                ids = np.append(token_ids(text, vocabulary), np.uint32(0)).astype("<u4")
                first = len(ids) - (len(ids) - 1) // limit * limit
                for k, stop in enumerate(range(first, len(ids) + 1, limit)):
                    start = stop - (limit if k else first)
                    row = (doc_id, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), nth)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    if with_ids:
                        out[6].append(ids[start:stop].astype(np.int64))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids"]
            n = 6 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names[:n])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _best_fit(items: np.ndarray, lengths: np.ndarray, room: list[tuple[int, int]], bins: list[list[int]], limit: int) -> None:
    """Put items, largest first, into the tightest bin; ``room`` lists (remaining, bin) of the open bins."""
    for i in items[np.argsort(-lengths[items], kind="stable")]:
        size = int(lengths[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
            bins[number].append(int(i))
        else:
            left, number = limit, len(bins)
            bins.append([int(i)])
        if left > size:
            insort(room, (left - size, number))


def _pack(items: np.ndarray, lengths: np.ndarray, kept: list[list[int]], limit: int) -> list[list[int]]:
    bins = [list(b) for b in kept]
    room = sorted((limit - int(lengths[b].sum()), k) for k, b in enumerate(bins))
    _best_fit(items, lengths, [x for x in room if x[0] > 0], bins, limit)
    return bins


def fitness(bins: list[list[int]], lengths: np.ndarray, limit: int) -> float:
    """Fewer sequences first; among as many, fuller ones."""
    fill = np.array([lengths[b].sum() for b in bins]) / limit
    return -len(bins) + float((fill**2).mean()) if bins else 0.0


def crossover(one: list[list[int]], two: list[list[int]], lengths: np.ndarray, limit: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled bins of ``two`` enter ``one``; its bins that share an item with them are taken apart."""
    fill = np.array([lengths[b].sum() for b in two])
    order = np.argsort(-fill, kind="stable")
    well = order[: max(1, int(len(order) * rng.uniform(0.2, 0.7)))]
    injected = [two[k] for k in well[rng.random(len(well)) < 0.7]]
    inside = np.zeros(len(lengths), dtype=bool)
    for b in injected:
        inside[b] = True
    kept, displaced = [], []
    for b in one:
        if inside[b].any():
            displaced += [i for i in b if not inside[i]]
        else:
            kept.append(b)
    # the loosest bins that are left go too: their items find new places
    kept.sort(key=lambda b: -int(lengths[b].sum()))
    loose = max(1, len(kept) // 20)
    for b in kept[-loose:]:
        displaced += b
    return _pack(np.array(displaced, dtype=np.int64), lengths, injected + kept[:-loose], limit)


def evolve(lengths: np.ndarray, guests: list[list[list[int]]], limit: int, seed: tuple[int, ...]) -> list[list[list[int]]]:
    """One round on one island: the population, best first. ``guests`` are groupings from before."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // limit)
    every = np.arange(len(lengths))
    population = guests or [_pack(every, lengths, [], limit)]
    best = max(population, key=lambda x: fitness(x, lengths, limit))
    if len(best) <= bound:
        return [best]
    while len(population) < POPULATION:  # a random part first, the rest by best fit
        some = rng.random(len(lengths)) < rng.uniform(0.1, 0.5)
        head: list[list[int]] = []
        for i in rng.permutation(every[some]):
            if head and lengths[head[-1]].sum() + lengths[i] <= limit:
                head[-1].append(int(i))
            else:
                head.append([int(i)])
        population.append(_pack(every[~some], lengths, head, limit))
    for _ in range(OFFSPRING):
        population.sort(key=lambda x: -fitness(x, lengths, limit))
        a, b = rng.choice(min(4, len(population)), 2, replace=False)
        population[-1] = crossover(population[a], population[b], lengths, limit, rng)
        if len(population[-1]) <= bound:
            return [population[-1]]
    return sorted(population, key=lambda x: -fitness(x, lengths, limit))


def _bins_of(assignment: np.ndarray) -> list[list[int]]:
    order = np.argsort(assignment, kind="stable")
    cuts = np.flatnonzero(np.diff(assignment[order])) + 1
    return [list(map(int, x)) for x in np.split(order, cuts)] if len(order) else []


def _assignment(bins: list[list[int]], n: int) -> list[int]:
    out = np.zeros(n, dtype=np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tolist()


def _round(limit: int, number: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for block, island, lengths, guests in zip(frame.block, frame.island, frame.lengths, frame.guests, strict=True):
                sizes = np.asarray(lengths, dtype=np.int64)
                came = [_bins_of(np.asarray(g, dtype=np.int64)) for g in guests]
                found = evolve(sizes, came, limit, (int(block), int(island), number))[:2]
                rows.append((block, island, sizes, [_assignment(b, len(sizes)) for b in found], fitness(found[0], sizes, limit)))
            yield pd.DataFrame(rows, columns=["block", "island", "lengths", "guests", "fitness"])

    return run


_STATE = "block long, island int, lengths array<long>, guests array<array<long>>, fitness double"


def _grouped(items: DataFrame, limit: int, islands: int, rounds: int, seed: int) -> DataFrame:
    """Items with block and bin: blocks by hash, islands by rows, elites by a join of neighbouring islands."""
    n = items.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32", "nth"), F.lit(blocks)))
    item = F.struct((-F.col("length")).alias("less"), "doc_id", "piece", "start", "length", "ids_crc32", "nth")
    world = saved(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")), "blocks")
    state = world.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.transform("items", lambda x: x["length"]).alias("lengths"),
                         F.array().cast("array<array<long>>").alias("guests"), F.lit(0.0).alias("fitness"))
    # few bytes, much work: a stated number of partitions is not coalesced
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, blocks * islands // STATES_A_FILE)
    for number in range(rounds):
        evolved = state.repartition(tasks, F.xxhash64("block", "island")).mapInPandas(_round(limit, number), _STATE)
        state = saved(evolved.repartition(files), "islands")
        if number + 1 < rounds:
            elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.slice("guests", 1, 1).alias("came"))
            state = state.join(elite, ["block", "island"]).select("block", "island", "lengths", F.concat("guests", "came").alias("guests"), "fitness")
    best = state.groupBy("block").agg(F.max_by(F.col("guests")[0], F.struct("fitness", -F.col("island"))).alias("bins"))
    joined = world.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("z"))
    return joined.select("z.items.doc_id", "z.items.piece", "z.items.start", "z.items.length", "z.items.ids_crc32", "z.items.nth",
                         "block", F.col("z.bins").alias("bin"))


def _numbered(grouped: DataFrame, level: int) -> DataFrame:
    """sequence_id and gapless offset: a bin's items are few, one window per bin."""
    number = ((F.col("block") * F.lit(1 << 20) + F.col("bin")) * 4 + level).cast("long")
    rows = grouped.withColumn("sequence_id", number)
    before = ("sum(length) OVER (PARTITION BY sequence_id ORDER BY length DESC, doc_id, piece, ids_crc32, nth "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return rows.withColumn("offset", F.coalesce(F.expr(before), F.lit(0)).cast("long")).drop("block", "bin")


def pack(cut: DataFrame, limit: int = LIMIT, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset, in as few sequences of ``limit`` as found."""
    cut = saved(cut, "pieces")
    full = cut.filter(F.col("length") == limit).withColumn("sequence_id", (F.monotonically_increasing_id() * 4 + 3).cast("long"))
    full = full.withColumn("offset", F.lit(0).cast("long"))
    grouped = saved(_grouped(cut.filter(F.col("length") < limit), limit, islands, rounds, 1), "grouped")
    fill = grouped.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    loose = saved(fill.filter(F.col("fill") < F.lit(LOOSE * limit)).select("block", "bin"), "loose")
    firm = grouped.join(loose, ["block", "bin"], "left_anti")
    again = _grouped(grouped.join(loose, ["block", "bin"], "left_semi").drop("block", "bin"), limit, islands, rounds, 2)
    return full.unionByName(_numbered(firm, 0)).unionByName(_numbered(again, 1)).drop("nth")


def pack_documents(docs: DataFrame, limit: int = LIMIT, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    return pack(pieces(docs, limit, vocabulary), limit)


def lower_bound(lengths: Column, limit: int = LIMIT) -> Column:
    """No packing has fewer sequences."""
    return F.ceil(F.sum(lengths) / limit)
