"""The prefix trie against a plain version: shared prefixes, copies, turnless and very long conversations, small shards."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(table) -> Counter:
    turns = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + s[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(built.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = Counter()
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha] += 1
    return out


def conversations(seed: int, convs: int, longest: int, words: int):
    rng = random.Random(seed)
    table = []
    for c in range(convs):
        conv = c if c % 7 else c * 3
        n = rng.randrange(1, longest)
        for t in range(n):
            table.append((conv, t if c % 7 else t + 1000 * c, rng.choice(["user", "assistant", None]), rng.choice(["", "é", None, "hello", *[f"w{k}" for k in range(words)]])))
    return table


def check(spark, table, parts=5):
    got = prefixtrie.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(parts)).collect()
    assert Counter(tuple(r) for r in got) == brute(table)


@pytest.fixture
def small_shards(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shared_prefixes(spark, small_shards):
    check(spark, conversations(1, 400, 9, 1))


def test_hot_conversation_lies_in_many_shards(spark, small_shards):
    copies = [(1000 + c, t, "user", f"turn {t}") for c in range(150) for t in range(7)]
    check(spark, conversations(2, 60, 6, 3) + copies)


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_long_conversations_go_on_in_chunks(spark, small_shards, monkeypatch, chunk):
    monkeypatch.setattr(prefixtrie, "CHUNK", chunk)
    copies = [(1000 + c, t, "user", f"turn {t}" if t < 8 or c % 3 else f"own {c} {t}") for c in range(12) for t in range(11)]
    check(spark, conversations(3, 120, 7, 0) + copies)


def test_hard_rows(spark):
    table = [(None, 1, "user", "x"), (100, None, None, None), (100, 1, "user", "b"), (100, None, "a", "a"), (101, 5, "user", "only"), (-5, 1, "user", "n"),
             (250, 1, "user", "a"), (250, 1, "user", "a"), (251, 1, "user", "x" * 300_000), (251, 2, None, "")]
    extra = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit("own") for c in ("rank", "conv", "k", "depth", "path", "a", "b", "chars")})
    want = brute([r for r in table if r != (100, None, "a", "a")])
    got = prefixtrie.prefix_trie(extra.filter("role is null or role <> 'a'")).collect()
    assert Counter(tuple(r) for r in got) == want
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixtrie.prefix_trie(extra).count() > 0
