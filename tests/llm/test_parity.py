"""The parity-sketch join against brute force, and its bounds on random sets."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import hard, prose, rows  # noqa: E402
from test_brute_force import brute_components, families, family  # noqa: E402
from tideline.llm import paritysketch as parity, tokens  # noqa: E402


@pytest.mark.parametrize("width", [2, 5])
def test_join_matches_brute_force(spark, width):
    texts = families()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    got = parity.jaccard_join(df, width, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(texts, width)


def test_join_near_the_threshold_and_across_bands(spark):
    """Sets of sizes around powers of two, cut and edited so that similarities fall on both sides of 0.8."""
    texts: list[str] = []
    for k, n in enumerate((4, 5, 6, 8, 9, 12, 16, 17, 33, 64, 70, 127, 128, 140, 300)):
        words = prose(200 + k, n + 4).split()
        for cut in (0, n // 12, n // 9, n // 6, n // 5, n // 4, n // 3):
            texts += [" ".join(words[cut:]), " ".join(words[: len(words) - cut])]
        texts += family(300 + k, n + 4, 3, 1)
    texts = dict(enumerate(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = parity.jaccard_join(df, 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 5)


def test_frequent_passage_links_nothing(spark):
    passage = prose(77, 90)
    texts = {i: f"{prose(1000 + i, 100 + i % 60)} {passage}" for i in range(120)}
    texts |= {200 + i: t for i, t in enumerate(f"{t} {passage}" for t in family(78, 120, 6, 2))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = parity.jaccard_join(df, 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 5)


def test_linked_sets_agree_in_enough_pieces():
    rng = np.random.default_rng(2)
    for percent in (60, 80, 90):
        for n in (4, 5, 7, 8, 10, 15, 16, 31, 32, 63, 64, 100, 500, 1023, 1024, 1300, 5000):
            for _ in range(6):
                b = int(rng.integers(n, 100 * n // percent + 1))
                least = -(-percent * (n + b) // (100 + percent))  # smallest linked intersection
                common = min(n, max(least, 0))
                x = rng.integers(0, 2**63, n + b - common, dtype=np.uint64)
                one, two = x[:n], x[n - common :]
                assert 100 * common >= percent * (n + b - common) or common == n
                if 100 * common < percent * (n + b - common):
                    continue
                mine = {s[0]: parity.piece_keys(one, *s) for s in parity.sketches_of(n, percent)}
                other = {s[0]: parity.piece_keys(two, *s) for s in parity.sketches_of(b, percent)}
                agree = [(len(np.intersect1d(mine[k][0], other[k][0])), mine[k][1], other[k][1]) for k in mine.keys() & other.keys()]
                if 100 * n < percent * (n + 1):
                    continue
                assert any(shared >= max(p, q) for shared, p, q in agree if min(p, q) > 1) or any(shared >= 1 for shared, p, q in agree if min(p, q) == 1), (percent, n, b)


def test_shingle_sets_tell_what_bytes_tell(monkeypatch):
    texts = [None, "", "  \n ", "one", "One two", "a B c D e f G", "a b c d e f g", "x" * 50 + " y", "é ü ß É", "tail", "no  space\tat\x0bend", prose(3, 400), prose(3, 400).upper(),
             "a\x1cb c", "a b\x1c c", "long " * 3000]
    texts += [prose(i, 1 + i % 9) for i in range(60)]
    column = pa.array(["cut", *texts, "cut"]).slice(1, len(texts))
    for block in (7, 100, 1 << 20):
        monkeypatch.setattr(tokens, "BLOCK", block)
        for width in (1, 2, 5):
            got = tokens.shingle_sets(column, width)
            words = [(t or "").encode().lower().split() for t in texts]
            want = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]
            assert [len(x) for x in got] == [len(x) for x in want]
            for i in range(len(texts)):
                for j in range(i):
                    assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_hard_rows(spark):
    got = parity.jaccard_join(hard(spark)).collect()
    texts = {}
    for r in rows():
        texts.setdefault(r[0], r[1] or "")
    want = brute_components({i: t for i, t in texts.items() if i is not None}, 5)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert len(got) == len(rows())
