"""The Merkle manifest against a plain version, on small tables, ties, nulls and trees of several rounds."""

import hashlib
import os
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import SCHEMA, clashing, empty, hard, rows  # noqa: E402
from tideline.llm import manifest, ranks  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    parts = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)]
    return sha("".join(parts))


def tree(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and of every leaf what stands before and after it on each level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]
    nodes, over = digests, [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        up, up_over = [], []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j in range(len(run)):
                for i in over[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            up_over.append([i for o in over[k : k + 8] for i in o])
        nodes, over = up, up_over
    return nodes[0], paths


def brute(table) -> Counter:
    by_lang = defaultdict(list)
    for r in table:
        lower = r[1] if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 3 else r[1].translate(LOWER)
        t = leaf((r[0], lower, *r[2:]))
        by_lang[r[2]].append((r[0], leaf(r), t))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[lang] = tree([x[1] for x in by_lang[lang]])
    root, tops = tree([trees[lang][0] for lang in langs])
    out = Counter()
    for lang, top in zip(langs, tops, strict=True):
        sub, paths = trees[lang]
        for (doc_id, h, t), path in zip(by_lang[lang], paths, strict=True):
            steps = path + top
            own = t
            for before, after in steps:
                own = sha(before + own + after)
            out[doc_id, h, sub, root, sha("".join(b + a for b, a in steps)), own, own == root] += 1
    return out


def check(spark, table):
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in manifest.verified(df).collect()) == brute(table)


def test_hard_rows(spark):
    check(spark, rows())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_a_run(spark, n):
    check(spark, [(i, f"Text {i}", "en", None, i) for i in range(n)])


def test_several_rounds_of_blocks(spark):
    table = [(i * 3, f"TEXT number {i}", None if i % 3 == 0 else "en", "s", None) for i in range(9000)]
    table += [(i, "x", f"l{i % 11}", "s", 1) for i in range(40)]
    check(spark, table)


def test_blocks_of_one_digit_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    check(spark, [(i, f"Text {i}", ("en", "de", None)[i % 3], None, i) for i in range(700)])


def test_further_columns_and_empty(spark):
    assert Counter(tuple(r) for r in manifest.verified(clashing(spark)).collect()) == brute(rows())
    assert manifest.verified(empty(spark)).collect() == []


def test_ranks_over_many_partitions(spark):
    table = [(None if i % 4 == 0 else ("hot" if i % 4 < 3 else f"k{i % 50}"), i * 37 % 1000) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ranks.ranked(spark.createDataFrame(table, "k string, v long").repartition(7), "k", ["v"], "t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.k].append((r["rank"], r.v))
    want = defaultdict(list)
    for k, v in table:
        want[k].append(v)
    assert {k: [v for _, v in x] for k, x in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert all([i for i, _ in x] == list(range(len(x))) for x in by.values())


def test_proof_sizes_follow_depth(spark):
    df = manifest.manifest(spark.createDataFrame([(i, "t", "en", None, 1) for i in range(65)], SCHEMA))
    assert df.select(F.min(F.size("path")), F.max(F.size("path"))).first() == (3, 3)
