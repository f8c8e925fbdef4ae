"""Every operator and pipeline stage on the hard tables."""

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from fixtures import clashing, empty, hard, rows  # noqa: E402
from tideline.llm import exact, fingerprints, langid, lines, manifest, mixing, neardup, packing, paritysketch, pii, sharding, toxicity  # noqa: E402
from tideline.llm.common import crc_of_id  # noqa: E402

N = len(rows())
FRAMES = {"hard": hard, "clashing": clashing, "empty": empty}
LABELS = [(i, i % 3 % 2, int(i % 5 == 1)) for i in range(60)] + [(61, None, None), (None, 1, 1), (999, 0, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d, s: pii.pseudonymise(d),
    "mix": lambda d, s: mixing.mix(d),
    "pack": lambda d, s: packing.pack_documents(d),
    "fingerprints": lambda d, s: fingerprints.fingerprints(d),
    "near": lambda d, s: neardup.near_groups(d),
    "shard": lambda d, s: sharding.shard_evenly(d, 8),
    "shard_capacity": lambda d, s: sharding.shard_by_capacity(d, 5000),
    "exact": lambda d, s: exact.exact_groups(d),
    "lines": lambda d, s: lines.clean_lines(d, min_sites=2),
    "toxicity": lambda d, s: toxicity.scored(d, toxicity.learn(d, labels(s), crc_of_id() % 5 != 0), "doc_id", "text"),
    "manifest": lambda d, s: manifest.verified(d),
    "jaccard": lambda d, s: paritysketch.jaccard_join(d),
    "langid": lambda d, s: langid.identify(d, langid.learn(d.filter(crc_of_id() % 4 != 2))),
}
PER_PIECE = {"pack"}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_hard_tables(spark, name, frame):
    docs = FRAMES[frame](spark)
    found = OPERATORS[name](docs, spark).collect()
    want = 0 if frame == "empty" else N
    assert len(found) >= want if name in PER_PIECE else len(found) == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("hard"))
    labels(spark).write.parquet(f"{base}/labels.parquet")
    return base


@pytest.mark.parametrize("frame", FRAMES)
def test_stages_take_hard_tables(spark, folder, frame):
    docs = FRAMES[frame](spark)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, folder).toArrow())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            if frame == "clashing" and docs.count():
                assert {json.dumps(r.asDict()) for r in docs.select("size", "kept", "_key").distinct().collect()} == {
                    '{"size": "own", "kept": "own", "_key": "own"}'}
    assert (docs.count() == 0) == (frame == "empty")
