"""Every stage of the pipeline on what the stage before it kept, against plain versions."""

import os
import re
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from test_brute_force import brute_components, water_level  # noqa: E402
from tideline.llm import queries  # noqa: E402

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, data):
    """The rows after every stage, by name."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, data).toArrow())
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_toxicity_goes(spark, data, kept):
    rejected = {r.doc_id for r in queries.op9_toxicity(spark, data).filter("predicted = 1").collect()}
    assert rejected and ids(kept["toxicity"]) == ids(kept["documents"]) - rejected


def test_exact_copies_go(kept):
    first = {}
    for r in sorted(kept["toxicity"], key=lambda r: r.doc_id):
        first.setdefault(SPACE.sub(" ", r.text), r.doc_id)
    assert Counter(r.doc_id for r in kept["exact_dedup"]) == Counter(first.values())


def test_near_copies_go(kept):
    found = brute_components({r.doc_id: r.text for r in kept["exact_dedup"]}, 5)
    assert ids(kept["near_dedup"]) == set(found.values())


def test_sources_meet_their_targets(kept):
    words, taken, text = Counter(), Counter(), {}
    for r in kept["near_dedup"]:
        words[r.source] += len(WORD.findall(r.text))
        text[r.doc_id] = r.text
    for r in kept["mixing"]:
        taken[r.source] += len(WORD.findall(r.text))
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    want = water_level(dict(words))
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 2


def test_sequences_hold_everything(kept):
    assert ids(kept["packing"]) == ids(kept["mixing"])
    fill = defaultdict(list)
    for r in kept["packing"]:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in kept["packing"])
    assert len(fill) <= -(-total // 2048) * 1.02 + 1


def test_run_gives_the_last_stage(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None
