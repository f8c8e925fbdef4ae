"""Sizes of the registered model fits."""

import inspect
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tideline.functions.text import TEXTS_AT_ONCE, count_vectors
from tideline.operators import models as md, trees
from tideline.plans import CATALOG, learning


class Caught(Exception):
    pass


def sized(e) -> tuple:
    if hasattr(e, "getNumTrees"):
        return "trees", e.getNumTrees()
    return "iterations", (e.getClassifier() if hasattr(e, "getClassifier") else e).getMaxIter()


@pytest.mark.parametrize("name, want", [
    ("m01_fold_models", {("iterations", 100), ("iterations", 180)}), ("m02_nested_calibration", {("iterations", 100)}),
    ("m03_weighted_ensemble", {("iterations", 100), ("trees", 300)}),
    ("m05_candidate_estimators", {("iterations", 100), ("iterations", 180), ("trees", 300)})])
def test_registered_fits_have_full_sizes(spark, monkeypatch, name, want):
    def caught(jobs, train):
        raise Caught({sized(e) for e in jobs.values()})

    d = spark.createDataFrame([(0.1, 0.2, 1.0)], "t double, t_end double, label double")
    monkeypatch.setattr(learning, "research", lambda *_: d)
    monkeypatch.setattr(md, "fit_many", caught)
    with pytest.raises(Caught) as e:
        CATALOG[name].build(spark, "")
    assert e.value.args[0] == want


@pytest.mark.parametrize("name, want", [("m07_text_models", ("iterations", 100)), ("m08_model_comparison", ("iterations", 100))])
def test_registered_text_fits_have_full_sizes(spark, monkeypatch, name, want):
    plain = md.text_pipeline

    def caught(*args, **more):
        raise Caught(sized(plain(*args, **more).getStages()[-1]))

    monkeypatch.setattr(learning, "labelled_news", lambda *_: spark.createDataFrame([(k, k - 1, "up") for k in range(9)], "t long, t_end long, target string"))
    monkeypatch.setattr(md, "text_pipeline", caught)
    with pytest.raises(Caught) as e:
        CATALOG[name].build(spark, "")
    assert e.value.args[0] == want
    assert sized(plain("forest").getStages()[-1]) == ("trees", 200)


def test_random_search_tries_every_family(spark):
    trials = md.random_trials()
    assert Counter(t["model"] for t in trials) == {"logistic": 20, "forest": 20, "boosting": 20}
    assert len({tuple(sorted((k, v) for k, v in t.items() if k != "trial")) for t in trials}) == 60
    assert all(t[k] in md.SPACES[t["model"]][k] for t in trials for k in md.SPACES[t["model"]])
    assert len(md.random_trials(10**6)) == 5 * 4 * 3 * 4 + 4**7 + 4**7
    classifier, regressor = md.trial_estimators({"model": "forest", **{k: v[-1] for k, v in md.SPACES["forest"].items()}}, 100)
    assert (classifier.getNumTrees(), classifier.getMaxDepth(), regressor.getMinInstancesPerNode()) == (420, 6, 18)


def test_random_search_scores_and_best_rows(spark):
    """A learnable frame: scores follow from accuracy, loss and weight of every block, one best row a family."""
    small = [{"trial": 0, "model": "logistic", "c": 0.5, "r_alpha": 0.001, "r_l1": 0.5, "top_k": 8},
             {"trial": 1, "model": "forest", "trees": 3, "depth": 2, "min_rows": 1, "r_trees": 3, "r_depth": 2, "r_min_rows": 1, "top_k": 8},
             {"trial": 2, "model": "boosting", "rounds": 2, "step": 0.1, "leaves": 5, "r_rounds": 2, "r_step": 0.1, "r_leaves": 5, "top_k": 16},
             {"trial": 3, "model": "logistic", "c": 0.0001, "r_alpha": 0.001, "r_l1": 0.5, "top_k": 8}]
    d = spark.createDataFrame([(k / 80, k / 80, float(k % 2), k % 2 - 0.5, *[float((k * 7 + i) % 11 + 20 * (k % 2)) for i in range(len(md.FEATURES))]) for k in range(80)],
                              ", ".join(f"{c} double" for c in ["t", "t_end", "label", "research_target", *md.FEATURES]))
    got = md.random_search(d, small)
    assert sorted(r["trial"] for r in got) == [0, 1, 2, 3] and all(r["folds"] == 4 for r in got)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert Counter(r["model"] for r in got if r["best"]) == {"logistic": 1, "forest": 1, "boosting": 1}
    assert {r["trial"]: r["best"] for r in got}[3] == 0  # so strong a penalty learns nothing
    best = next(r for r in got if r["trial"] == 0)
    assert best["accuracy_mean"] == 1 and best["accuracy_std"] == 0 and best["rmse_mean"] < 0.2
    assert md.fold_score(0.4, 1.0) == (0.05, 0.4 + 0.004 - 0.12) and md.fold_score(1.0, 0.0)[0] == 5.75


def test_registered_search_has_full_size(spark, monkeypatch):
    """Twenty trials a family over four calendar blocks."""
    def caught(d, trials, *args):
        bound = inspect.signature(plain).bind(d, trials, *args)
        bound.apply_defaults()
        raise Caught((Counter(t["model"] for t in trials), bound.arguments["splits"]))

    plain = md.random_search
    monkeypatch.setattr(learning, "research", lambda *_: None)
    monkeypatch.setattr(md, "random_search", caught)
    with pytest.raises(Caught) as e:
        CATALOG["m06_random_search"].build(spark, "")
    assert e.value.args[0] == ({"logistic": 20, "forest": 20, "boosting": 20}, 4)


@pytest.fixture(scope="module")
def vectors(spark):
    """(train, test) of `random_search`, with a feature of few values and one that is the same everywhere."""
    rng = random.Random(5)
    rows = []
    for k in range(700):
        x = [rng.gauss(0, 1), float(rng.randrange(4)), rng.random() ** 3, 2.5, rng.gauss(3, 9)]
        y = 0.5 * x[0] - 0.3 * x[1] + x[2] * (x[4] > 3) + rng.gauss(0, 0.7)
        rows.append((Vectors.dense(x), float(y > 0), y))
    d = [spark.createDataFrame(r, ["features", "label", "research_target"]).coalesce(1) for r in (rows[:500], rows[500:])]
    return md.balanced(d[0], "label").persist(), d[1].withColumn("weight", F.lit(1.0)).persist()


def held(vectors, width=5):
    train, test = vectors
    cuts = trees.feature_splits(train, width, train.count())
    return trees.binned(train, cuts), trees.binned(test, cuts)


def test_boosted_trees_are_those_of_spark(vectors):
    a, b = held(vectors)
    for estimator in (GBTClassifier(maxIter=12, stepSize=0.1, maxDepth=3, minInstancesPerNode=8), GBTRegressor(maxIter=12, stepSize=0.1, maxDepth=4, minInstancesPerNode=8, labelCol="research_target")):
        scored = estimator.fit(vectors[0]).transform(vectors[1])
        classify = isinstance(estimator, GBTClassifier)
        want = [r[0] for r in scored.select(vector_to_array("probability").getItem(1) if classify else "prediction").collect()]
        got = trees.boosted([md._tree_fit(estimator, 5)], a, b)[0]
        assert sorted(got) == pytest.approx(sorted(want), abs=1e-6), estimator


def test_a_tree_of_classes_is_that_of_spark(vectors):
    """Weighted gini, the least rows of a leaf, and leaves beside each other that name one class. Features are of few
    values: between many, Spark ML places its splits by the rows' weights."""
    few = F.udf(lambda x: Vectors.dense([round(3 * v) % 25 for v in x]), VectorUDT())
    vectors = [d.withColumn("features", few("features")).persist() for d in vectors]
    a, b = held(vectors)
    scale = np.array([a.weight[a.label == c].max() for c in (0, 1)])
    for depth, least in ((3, 1), (5, 12)):
        model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, weightCol="weight").fit(vectors[0])
        want = [r[0] for r in model.transform(vectors[1]).select(vector_to_array("probability").getItem(1)).collect()]
        counts = [(a.label == c).astype(float) for c in (0, 1)]
        levels, sums, _ = trees.grow(a.bins, a.columns, np.arange(len(a.label)), counts, scale, depth, least)
        got = trees.shares(levels, sums, scale)[trees.place_of(b.bins, levels)]
        assert sorted(got) == pytest.approx(sorted(want), abs=1e-9)


def test_forests_score_as_those_of_spark(vectors):
    a, b = held(vectors)
    c = {"featuresCol": "features", "numTrees": 150, "maxDepth": 4, "minInstancesPerNode": 6}
    for estimator in (RandomForestClassifier(weightCol="weight", **c), RandomForestRegressor(labelCol="research_target", **c)):
        scored = estimator.fit(vectors[0]).transform(vectors[1])
        classify = isinstance(estimator, RandomForestClassifier)
        want = [r[0] for r in scored.select(vector_to_array("probability").getItem(1) if classify else "prediction").collect()]
        got = trees.forest([md._tree_fit(estimator, 5)], a, b)[0]
        # Bags and drawn features are left to chance; both are a mean of many trees.
        assert np.mean(np.abs(np.sort(got) - np.sort(want))) < 0.03
        assert np.corrcoef(got, b.label if classify else b.research_target)[0, 1] > 0.5


def test_fits_of_one_family_are_those_made_alone(vectors):
    a, b = held(vectors)
    for classify in (True, False):
        forests = [trees.Fit(count, depth, 5, classify, least=4) for count, depth in ((9, 3), (4, 5), (9, 5), (1, 2))]
        assert len({f.family for f in forests[:3]}) == 1 and forests[3].family != forests[0].family  # one tree may use all features
        rounds = [trees.Fit(count, 3, 5, classify, step=0.1, least=4) for count in (7, 2, 7)]
        for found, fits in ((trees.forest, forests[:3]), (trees.boosted, rounds)):
            for got, f in zip(found(fits, a, b), fits, strict=True):
                assert got == pytest.approx(found([f], a, b)[0], abs=1e-12)
        assert trees.Fit(2, 4, 5, classify, step=0.1).family != trees.Fit(2, 3, 5, classify, step=0.1).family


def test_rows_are_binned_in_one_order(vectors):
    a, b = held(vectors)
    c, _ = held((vectors[0].repartition(7), vectors[1]))
    assert len(a.label) == 500 and len(b.label) == 200 and a.bins.max(0).tolist() == [31, 3, 31, 0, 31]
    assert (a.bins == c.bins).all() and (a.research_target == c.research_target).all() and (a.weight == c.weight).all()
    assert [len(x) for x in (trees.splits([1.0] * 9, 31), trees.splits([0.0] * 1024 + [1.0], 31), trees.splits([float(k) for k in range(1025)], 31))] == [0, 1, 31]


def test_large_blocks_are_fitted_by_spark(spark, monkeypatch):
    """Above ``ROWS_A_TASK`` rows the same boosted trees come from Spark ML, over all partitions."""
    rng = random.Random(2)
    rows = [(k / 900, k / 900, float(k % 2), k % 2 - 0.5 + rng.gauss(0, 1), *[rng.gauss(0, 1) + k % 2 for _ in md.FEATURES]) for k in range(900)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["t", "t_end", "label", "research_target", *md.FEATURES]))
    trial = {"trial": 0, "model": "boosting", "rounds": 3, "step": 0.1, "leaves": 4, "r_rounds": 3, "r_step": 0.1, "r_leaves": 4, "top_k": 8}
    in_tasks = md.random_search(d, [trial], splits=2)
    monkeypatch.setattr(md, "ROWS_A_TASK", 0)
    monkeypatch.setattr(trees, "scores", None)
    monkeypatch.setattr(trees, "binned", None)
    for got, want in zip(md.random_search(d, [trial], splits=2), in_tasks, strict=True):
        assert got == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()}


def test_best_quote_and_stories_need_no_sort_aggregate(spark, data):
    for name in ("p39_best_quote", "w31_story_dedupe"):
        assert "SortAggregate" not in CATALOG[name].build(spark, data)._jdf.queryExecution().executedPlan().toString(), name


def test_balanced_rows_are_weighted_where_they_lie(spark):
    rows = [(0.0, 1), (0.0, 2), (0.0, 3), (1.0, 4), (None, 5), (2.0, 6), (2.0, 7), (0.0, 8)]
    got = md.balanced(spark.createDataFrame(rows, "y double, k int").repartition(3))
    counts = {0.0: 4, 1.0: 1, 2.0: 2}
    assert sorted((r.y, r.k, round(r.weight, 12)) for r in got.collect()) == sorted((y, k, round(7 / (3 * counts[y]), 12)) for y, k in rows if y is not None)
    plan = md.balanced(spark.range(20).selectExpr("double(id % 2) y", "id")).coalesce(1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # under coalesce, each partition's table would be held until the task ends
    assert md.balanced(spark.createDataFrame([], "y double, k int")).count() == 0


def test_vocabulary_counts_words_and_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "d1", "e", "f", "gg"][:rng.choice([3, 7])]) + rng.choice(["", ",", " -"]) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "...", "lone"]
    counts = Counter()
    for x in texts:
        tok = [t for t in re.split(r"[\W_]+", x.lower()) if t]
        counts.update(tok)
        counts.update(" ".join(p) for p in zip(tok, tok[1:]))
    d = spark.createDataFrame([(x,) for x in texts], "body string").repartition(3)
    for size in (2, 5, 12, 500):
        want = sorted(counts, key=lambda t: (-counts[t], t.count(" "), t))[:size]
        model = Pipeline(stages=md.term_counts(size)).fit(d)
        assert model.stages[-1].vocabulary == want
        got = model.transform(d).select("body", vector_to_array("terms_c").alias("c")).collect()
        total = [sum(c) for c in zip(*(r.c for r in got))]
        assert total == [counts[t] for t in want]


@pytest.mark.parametrize("name", ["m07_text_models", "m08_model_comparison"])
def test_text_models_share_one_vocabulary(spark, monkeypatch, name):
    """Both pipelines of a query read the same counts, learned once, from rows whose labels are known."""
    plain, fits = md.TopTerms._fit, []

    def counted(self, d):
        fits.append(sorted(r.t for r in d.select("t").collect()))
        return plain(self, d)

    rows = [(k, k + 1, ["up", "down"][k % 2], f"{['good', 'bad'][k % 2]} news {k % 7}", *[float((k * 3 + i) % 5) for i in range(5)]) for k in range(60)]
    d = spark.createDataFrame(rows, "t long, t_end long, target string, body string, sentiment double, quality double, rel double, importance double, words double")
    monkeypatch.setattr(learning, "labelled_news", lambda *_: d)
    monkeypatch.setattr(md.TopTerms, "_fit", counted)
    got = {r.model: r for r in CATALOG[name].build(spark, "").collect()}
    cut = sorted(r[0] for r in rows)[41]
    assert fits == [[k for k in range(60) if k + 1 < cut]]
    assert {r.n for r in got.values()} == {60 - cut}
    assert all(r.accuracy == 1 for m, r in got.items() if m != "numeric_only")


@pytest.mark.parametrize("name", ["m07_text_models", "m08_model_comparison"])
def test_texts_are_taken_apart_once(spark, monkeypatch, name):
    """What the vocabulary is learned from holds stored words: no text, and no pattern to run over it again."""
    def caught(self, d):
        raise Caught(d)

    rows = [(k, k + 1, ["up", "down"][k % 2], f"Good, news {k % 7}...") for k in range(60)]
    monkeypatch.setattr(learning, "labelled_news", lambda *_: spark.createDataFrame(rows, "t long, t_end long, target string, body string"))
    monkeypatch.setattr(md.TopTerms, "_fit", caught)
    with pytest.raises(Caught) as e:
        CATALOG[name].build(spark, "")
    d = e.value.args[0]
    assert "body" not in d.columns and {r.tok for r in d.select("tok").collect()} == {f"good news {k}" for k in range(7)}
    plan = d.select("tok")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("lower(", "split(", "regexp_"))


def test_count_vectors_of_many_null_and_empty_texts():
    texts = ["a b a b", None, "", "c", "b a c"] * TEXTS_AT_ONCE
    want = [{0: 2.0, 1: 2.0, 2: 2.0, 3: 1.0}, None, {}, {}, {0: 1.0, 1: 1.0, 3: 1.0}] * TEXTS_AT_ONCE
    got = count_vectors(pa.array(texts), ["a", "b", "a b", "b a"]).to_pylist()
    assert [v and dict(zip(v["indices"], v["values"], strict=True)) for v in got] == want
    assert all(v["size"] == 4 and v["type"] == 0 for v in got if v)
    assert count_vectors(pa.array([], pa.string()), ["a"]).to_pylist() == []
    assert [v["indices"] for v in count_vectors(pa.array(["a", ""]), []).to_pylist()] == [[], []]
