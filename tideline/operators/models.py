"""Model fitting on the feature table with Spark ML. Folds are calendar blocks over all symbols, so
a fit sees many partitions; only fold and parameter lists are driver-side."""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import mean, pstdev

import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import (IDF, Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tideline.functions.numeric import clip, logit
from tideline.functions.text import WORDS, count_vectors, pair_counts
from tideline.operators import trees
from tideline.session import ensure_checkpoint_dir

FEATURES = ["ret1", "ret5", "ret20", "ret60", "vol20", "vol60", "day_range", "overnight", "volume_ratio", "price_ma20", "price_ma60", "volume_change"]


def model_frame(block: DataFrame) -> DataFrame:
    """Research rows with a mature target; ``t`` orders the calendar between 0 and 1 and ``t_end`` is the place of
    the session on which the label is known."""
    d = block.filter("research_target IS NOT NULL").withColumn("label", (F.col("research_target") > 0).cast("double"))
    day = F.datediff("session", F.lit("1970-01-01").cast("date"))
    span = d.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()  # two numbers of the calendar
    width = F.lit(max(1, (span.b or 1) - (span.a or 0)))
    end = F.datediff("label_end_at", F.lit("1970-01-01").cast("date"))
    return d.withColumn("t", (day - F.lit(span.a)) / width).withColumn("t_end", (end - F.lit(span.a)) / width)


def mature(d: DataFrame, cut: float) -> DataFrame:
    """Rows that may teach a model whose first decision is at ``cut``: their labels are known before it."""
    return d.filter(F.col("t_end") < cut)


@dataclass(frozen=True)
class Sizes:
    """Effort of the iterative fits. The defaults are those of a full research run, and of the registered queries;
    ``trials`` counts for each family of a random search."""

    boosting_rounds: int = 180
    trees: int = 300
    text_trees: int = 200
    text_depth: int = 8
    iterations: int = 100
    trials: int = 20


def _stages(estimator):
    filled = [f"{c}_f" for c in FEATURES]
    return Pipeline(stages=[Imputer(inputCols=FEATURES, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw_v"),
                            StandardScaler(inputCol="raw_v", outputCol="features", withMean=True), estimator])


def estimators(sizes: Sizes = Sizes(), seed: int = 42) -> dict[str, object]:
    return {"logistic_0.2": LogisticRegression(regParam=0.05, maxIter=sizes.iterations), "logistic_1.0": LogisticRegression(regParam=0.01, maxIter=sizes.iterations),
            "boosting_2": GBTClassifier(maxDepth=2, maxIter=sizes.boosting_rounds, stepSize=0.2, seed=seed),
            "forest": RandomForestClassifier(maxDepth=4, numTrees=sizes.trees, seed=seed)}


def probability(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, clip(vector_to_array("probability").getItem(1), 0.001, 0.999))


def fit_many(jobs: dict, train: DataFrame) -> dict:
    """Fit independent pipelines at the same time; Spark schedules their tasks together."""
    train = train.persist()
    try:
        with ThreadPoolExecutor(4) as pool:
            return dict(zip(jobs, pool.map(lambda e: _stages(e).fit(train), jobs.values())))
    finally:
        train.unpersist()


def brier(df: DataFrame, p: str = "p") -> float:
    return df.agg(F.avg(F.pow(F.col(p) - F.col("label"), 2))).first()[0]


def fold_predictions(d: DataFrame, cuts: list[float], names: list[str], sizes: Sizes = Sizes()) -> DataFrame:
    """Expanding calendar folds: each cut trains on all labels known before it and predicts up to the next."""
    out = None
    est = estimators(sizes)
    for k, cut in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else 1.01
        train, test = mature(d, cut), d.filter((F.col("t") >= cut) & (F.col("t") < end))
        for name, m in fit_many({n: est[n] for n in names}, train).items():
            p = probability(m, test, "p").select("symbol", "session", "label", "research_target", "p", F.lit(name).alias("model"), F.lit(k).alias("fold"))
            out = p if out is None else out.unionByName(p)
    return out


def nested_calibration(d: DataFrame, cut: float = 0.7, sizes: Sizes = Sizes()) -> DataFrame:
    """60/20/20 inside the training span: tune by Brier, choose a calibrator on a later block, refit."""
    a, b = cut * 0.6, cut * 0.8
    core, train, test = mature(d, a), mature(d, cut), d.filter(F.col("t") >= cut)
    tune, cal = mature(d.filter(F.col("t") >= a), b), mature(d.filter(F.col("t") >= b), cut)
    grid = {n: e for n, e in estimators(sizes).items() if n.startswith("logistic")}
    models = fit_many(grid, core)
    best = min(models, key=lambda n: brier(probability(models[n], tune, "p")))
    calib = fit_many({best: grid[best]}, mature(d, b))[best]
    base = mature(d, b).agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("r")).first().r
    mid = b + (cut - b) / 2
    cp = probability(calib, cal, "p")

    def sigmoid(fit_on: DataFrame):
        one = VectorAssembler(inputCols=["z"], outputCol="zv")
        return Pipeline(stages=[one, LogisticRegression(featuresCol="zv", regParam=0.01, maxIter=50, probabilityCol="sp", rawPredictionCol="sr", predictionCol="spred")]).fit(
            fit_on.withColumn("z", logit("p")))

    early = sigmoid(mature(cp, mid))
    late = early.transform(cp.filter(F.col("t") >= mid).withColumn("z", logit("p"))).withColumn("s", vector_to_array("sp").getItem(1))
    late = late.withColumn("k", F.col("p") * 0.5 + 0.5 * base)
    scores = late.agg(*[F.avg(F.pow(F.col(c) - F.col("label"), 2)).alias(n) for n, c in (("raw", "p"), ("shrink", "k"), ("sigmoid", "s"))]).first().asDict()
    chosen = min(scores, key=scores.get)
    final = fit_many({best: grid[best]}, train)[best]
    out = sigmoid(cp).transform(probability(final, test, "p").withColumn("z", logit("p"))).withColumn("sigmoid", vector_to_array("sp").getItem(1))
    out = out.withColumn("raw", F.col("p")).withColumn("shrink", F.col("p") * 0.5 + 0.5 * base)
    return out.select("symbol", "session", "label", "raw", "shrink", "sigmoid", F.col(chosen).alias("calibrated"), F.lit(base).alias("base_rate"),
                      F.lit(best).alias("parameter"), F.lit(chosen).alias("calibrator"))


# The searched parameters of each family, for the classifier and the regressor beside it.
SPACES = {
    "logistic": {"c": (0.15, 0.25, 0.5, 0.8, 1.2), "r_alpha": (0.0002, 0.0005, 0.001, 0.002), "r_l1": (0.25, 0.5, 0.75), "top_k": (8, 10, 12, 16)},
    "forest": {"trees": (160, 240, 320, 420), "depth": (3, 4, 5, 6), "min_rows": (6, 10, 14, 18),
               "r_trees": (160, 240, 320, 420), "r_depth": (3, 4, 5, 6), "r_min_rows": (6, 10, 14, 18), "top_k": (8, 10, 12, 16)},
    "boosting": {"rounds": (80, 120, 160, 220), "step": (0.02, 0.035, 0.05, 0.08), "leaves": (5, 8, 12, 16),
                 "r_rounds": (80, 120, 160, 220), "r_step": (0.02, 0.035, 0.05, 0.08), "r_leaves": (5, 8, 12, 16), "top_k": (8, 10, 12, 16)}}


def random_trials(trials: int = Sizes().trials, seed: int = 42) -> list[dict]:
    """``trials`` different draws from each family's product of values; all of it where it has fewer. A draw is a rank in
    the product, read in mixed radix, so the product itself is never listed."""
    out = []
    for model, space in SPACES.items():
        size = math.prod(map(len, space.values()))
        for rank in random.Random(f"{seed} {model}").sample(range(size), min(trials, size)):
            drawn = {"trial": len(out), "model": model}
            for name, values in space.items():
                rank, at = divmod(rank, len(values))
                drawn[name] = values[at]
            out.append(drawn)
    return out


def trial_estimators(t: dict, rows: int, sizes: Sizes = Sizes(), seed: int = 42) -> tuple:
    """(classifier, regressor) of a trial over a training block of so many rows. Leaves are bounded by depth; an L1
    penalty's inverse strength counts all rows."""
    c = {"featuresCol": "chosen", "labelCol": "label", "weightCol": "weight"}
    r = {"featuresCol": "chosen", "labelCol": "research_target"}
    if t["model"] == "logistic":
        return (LogisticRegression(regParam=1 / (t["c"] * max(1, rows)), elasticNetParam=1.0, maxIter=sizes.iterations, featuresCol="chosen"),
                LinearRegression(regParam=t["r_alpha"], elasticNetParam=t["r_l1"], maxIter=sizes.iterations, **r))
    if t["model"] == "forest":
        return (RandomForestClassifier(numTrees=t["trees"], maxDepth=t["depth"], minInstancesPerNode=t["min_rows"], seed=seed, **c),
                RandomForestRegressor(numTrees=t["r_trees"], maxDepth=t["r_depth"], minInstancesPerNode=t["r_min_rows"], seed=seed, **r))
    return (GBTClassifier(maxIter=t["rounds"], stepSize=t["step"], maxDepth=math.ceil(math.log2(t["leaves"])), checkpointInterval=25, seed=seed, featuresCol="chosen"),
            GBTRegressor(maxIter=t["r_rounds"], stepSize=t["r_step"], maxDepth=math.ceil(math.log2(t["r_leaves"])), checkpointInterval=25, seed=seed, **r))


def fold_score(accuracy: float, log_loss: float) -> tuple[float, float]:
    """(weight, score) of a fold."""
    weight = max(0.05, 10 * max(0.0, accuracy - 0.5) + max(0.0, 0.75 - log_loss))
    return weight, accuracy + 0.08 * weight - 0.12 * log_loss


#: Rows of a partition of the tables that all trials share.
ROWS_A_PART = 100_000
#: Rows of a partition of the counted texts, each some hundred numbers wide.
TEXTS_A_PART = 25_000


#: Train and test rows up to which a block's trees are fitted inside one task each, some 200 bytes a row.
ROWS_A_TASK = 1_000_000


@dataclass(frozen=True)
class Block:
    """A calendar block's vector tables, the rows it trains on, its features and, up to ``ROWS_A_TASK``, its binned rows."""

    cut: float
    train: DataFrame
    test: DataFrame
    rows: int
    width: int
    held: Broadcast | None


def _search_tables(d: DataFrame, k: int, splits: int) -> Block | None:
    """A calendar block, imputed, ordered by relevance and scaled once for all trials."""
    cut, stop = k / (splits + 1), (k + 1) / (splits + 1) if k < splits else 1.01
    train, test = mature(d, cut), d.filter((F.col("t") >= cut) & (F.col("t") < stop))
    if train.isEmpty() or test.isEmpty():
        return None
    named = [c for c, _ in select_features(train, len(FEATURES))]
    filled = [f"{c}_f" for c in named]
    prepared = Pipeline(stages=[Imputer(inputCols=named, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw_v"),
                                StandardScaler(inputCol="raw_v", outputCol="features", withMean=True)]).fit(train)
    keep = ["features", "label", "research_target"]
    rows = train.count()
    parts = 1 + rows // ROWS_A_PART  # a fit runs hundreds of short jobs: few tasks each, many fits at once
    train = balanced(prepared.transform(train).select(*keep), "label").coalesce(parts).persist()
    test = prepared.transform(test).select(*keep).coalesce(parts).persist()
    held = None
    if train.count() + test.count() <= ROWS_A_TASK:
        cuts = trees.feature_splits(train, len(named), rows)
        held = d.sparkSession.sparkContext.broadcast((trees.binned(train, cuts), trees.binned(test.withColumn("weight", F.lit(1.0)), cuts)))
    return Block(cut, train, test, rows, len(named), held)


def _tree_fit(e: Estimator, width: int) -> trees.Fit:
    """What an estimator of `trial_estimators` asks for, over its first features."""
    boosting = isinstance(e, (GBTClassifier, GBTRegressor))
    return trees.Fit(e.getMaxIter() if boosting else e.getNumTrees(), e.getMaxDepth(), width, isinstance(e, (GBTClassifier, RandomForestClassifier)),
                     e.getStepSize() if boosting else None, e.getMinInstancesPerNode(), e.getSeed())


def random_search(d: DataFrame, trials: list[dict], splits: int = 4, sizes: Sizes = Sizes(), at_once: int = 8) -> list[dict]:
    """The trials with their scores over expanding calendar blocks, best first, ``best`` marking the first of each family.

    Each block is prepared once; all trials share its two vector tables, and the fits of all blocks, trials and kinds run
    side by side, ``at_once`` at a time. Trees of a block of up to ``ROWS_A_TASK`` rows are fitted by `trees`, a task for
    those that grow the same ones; those of a larger one by Spark ML, over all its partitions. There boosting checkpoints its residuals in the
    shared folder, as the lineage of hundreds of rounds would grow with every job. The driver keeps three numbers a trial
    and block."""
    ensure_checkpoint_dir(d.sparkSession)
    sc = d.sparkSession.sparkContext
    d = d.select(*FEATURES, "label", "research_target", "t", "t_end").persist()
    try:
        with ThreadPoolExecutor(splits) as pool:
            blocks = [x for x in pool.map(lambda k: _search_tables(d, k, splits), range(1, splits + 1)) if x]
    finally:
        d.unpersist()

    def fit(t: dict, block: Block, kind: str) -> tuple:
        chosen = VectorSlicer(inputCol="features", outputCol="chosen", indices=list(range(min(t["top_k"], block.width))))
        estimator = trial_estimators(t, block.rows, sizes)[kind == "target"]
        scored = estimator.fit(chosen.transform(block.train)).transform(chosen.transform(block.test))
        if kind != "label":
            return tuple(scored.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("research_target"), 2)))).first())
        up = vector_to_array("probability").getItem(1)
        p = clip(up, 0.01, 0.99)
        return tuple(scored.agg(F.avg(((up >= 0.5) == (F.col("label") > 0)).cast("int")),
                                F.avg(-(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p)))).first())

    def fit_held(fits: list[trees.Fit], held: Broadcast) -> list[tuple]:
        return sc.parallelize([fits], 1).map(lambda x: trees.scores(x, *held.value)).first()

    jobs = [(t, x, kind) for t in trials for x in blocks for kind in ("label", "target")]
    families: dict[tuple, dict[int, trees.Fit]] = {}
    by_spark = []
    for i, (t, x, kind) in enumerate(jobs):
        if x.held and t["model"] != "logistic":
            asked = _tree_fit(trial_estimators(t, x.rows, sizes)[kind == "target"], min(t["top_k"], x.width))
            families.setdefault((x.cut, *asked.family), {})[i] = asked
        else:
            by_spark.append(i)
    # The longest fits start first, so that none is left alone at the end; those of Spark ML, of many short jobs, are dealt between.
    by_spark.sort(key=lambda i: -(jobs[i][0].get("rounds", 0) + jobs[i][0].get("trees", 0)) * jobs[i][1].rows)
    own = sorted(families.values(), key=lambda fits: -max(f.count for f in fits.values()) * max(f.depth for f in fits.values()) * jobs[min(fits)][1].rows)
    work = sorted([(k / len(own), 0, fits) for k, fits in enumerate(own)] + [(k / len(by_spark), 1, i) for k, i in enumerate(by_spark)], key=lambda x: x[:2])

    def run(one: tuple) -> dict[int, tuple]:
        _, spark_ml, x = one
        return {x: fit(*jobs[x])} if spark_ml else dict(zip(x, fit_held([*x.values()], jobs[min(x)][1].held), strict=True))

    done: dict[int, tuple] = {}
    try:
        with ThreadPoolExecutor(at_once) as pool:
            for scores in pool.map(run, work):
                done |= scores
    finally:
        for x in blocks:
            x.train.unpersist()
            x.test.unpersist()
            if x.held:
                x.held.unpersist()
    found: dict[int, list[tuple]] = {t["trial"]: [] for t in trials}
    for i in range(0, len(jobs), 2):
        found[jobs[i][0]["trial"]].append(done[i] + done[i + 1])
    out = []
    for t in trials:
        folds = found[t["trial"]]
        if folds:
            weights, scores = zip(*[fold_score(acc, loss) for acc, loss, _ in folds], strict=True)
            acc, loss, rmse = (mean(x) for x in zip(*folds, strict=True))
            out.append({"trial": t["trial"], "model": t["model"], "params": json.dumps({k: v for k, v in t.items() if k not in ("trial", "model")}, sort_keys=True),
                        "folds": len(folds), "score": mean(scores) - 0.25 * pstdev(scores), "accuracy_mean": acc, "accuracy_std": pstdev([x[0] for x in folds]),
                        "log_loss_mean": loss, "weight_mean": mean(weights), "rmse_mean": rmse})
    out.sort(key=lambda r: (-r["score"], r["trial"]))
    first = {r["model"]: r["trial"] for r in reversed(out)}
    return [r | {"best": int(first[r["model"]] == r["trial"])} for r in out]


def select_features(d: DataFrame, k: int = 8, cap: float = 0.92) -> list[tuple[str, float]]:
    """Rank by |correlation with the target|, drop near-copies. One aggregation gives every
    correlation; the greedy pruning walks a features x features matrix."""
    cols = [F.corr(c, "label").alias(f"y_{c}") for c in FEATURES]
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
    r = d.agg(*cols, *[F.corr(a, b).alias(f"x_{a}_{b}") for a, b in pairs]).first().asDict()
    score = {c: abs(r[f"y_{c}"] or 0.0) for c in FEATURES}
    close = {frozenset(p): abs(r[f"x_{p[0]}_{p[1]}"] or 0.0) for p in pairs}
    kept: list[str] = []
    for c in sorted(FEATURES, key=lambda c: (-score[c], c)):
        if all(close[frozenset((c, o))] <= cap for o in kept) and len(kept) < k:
            kept.append(c)
    return [(c, score[c]) for c in kept]


def regressors(sizes: Sizes = Sizes(), seed: int = 42) -> dict[str, object]:
    kw = {"labelCol": "research_target"}
    return {"elastic": LinearRegression(regParam=0.001, elasticNetParam=0.5, maxIter=sizes.iterations, **kw), "forest_r": RandomForestRegressor(maxDepth=4, numTrees=sizes.trees, seed=seed, **kw),
            "boosting_r": GBTRegressor(maxDepth=2, maxIter=sizes.boosting_rounds, seed=seed, **kw)}


class TermCounts(Model):
    """Counts of the terms of ``vocabulary`` in the blank-separated words of a column."""

    def __init__(self, words: str, outputCol: str, vocabulary: list[str]):
        super().__init__()
        self.words, self.outputCol, self.vocabulary = words, outputCol, vocabulary

    def _transform(self, d: DataFrame) -> DataFrame:
        vocabulary = self.vocabulary

        def counted(texts: pa.Array) -> pa.Array:
            return count_vectors(texts, vocabulary)

        return d.withColumn(self.outputCol, F.arrow_udf(counted, VectorUDT())(F.col(self.words)))


class TopTerms(Estimator):
    """Counts of the most frequent one- and two-word terms of the rows it is fitted on; of equally frequent ones, single
    words come first, then names decide. Only the vocabulary, of fixed size, reaches the driver.

    A pair is at most as frequent as each of its words. So a word outside the most frequent ones, as many as the
    vocabulary has places, is in no pair that gets a place, and pairs of other words need not be counted."""

    def __init__(self, words: str, outputCol: str, vocabulary: int):
        super().__init__()
        self.words, self.outputCol, self.vocabulary = words, outputCol, vocabulary

    def _fit(self, d: DataFrame) -> TermCounts:
        def top(counts: DataFrame) -> list:
            return counts.orderBy(F.desc("n"), "term").limit(self.vocabulary).collect()

        each = d.select(F.explode(F.split(self.words, " ")).alias("term")).filter("term <> ''")
        words = top(each.groupBy("term").agg(F.count("*").alias("n")))
        known = [r.term for r in words]

        def neighbours(batches):
            return pair_counts(batches, known)

        pairs = top(d.select(self.words).mapInArrow(neighbours, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
        ranked = sorted([(-r.n, 1, r.term) for r in words] + [(-r.n, 2, r.term) for r in pairs])
        return TermCounts(self.words, self.outputCol, [t for _, _, t in ranked[:self.vocabulary]])


def term_counts(vocabulary: int = 256) -> list:
    """Stages from ``body`` to its words, ``tok``, and to ``terms_c``: counts of one- and two-word terms, ranked in one list."""
    return [SQLTransformer(statement=f"SELECT *, {WORDS.format('body')} AS tok FROM __THIS__"),
            TopTerms(words="tok", outputCol="terms_c", vocabulary=vocabulary)]


def text_pipeline(kind: str = "logistic", text: bool = True, vocabulary: int = 256, sizes: Sizes = Sizes(), counted: bool = False) -> Pipeline:
    """TF-IDF of one- and two-word terms beside scaled numerics; one class against the rest. Rows bring a ``weight``
    that makes classes count alike, and, where ``counted``, the ``terms_c`` of `term_counts`."""
    nums = ["sentiment", "quality", "rel", "importance", "words"]
    stages = [VectorAssembler(inputCols=nums, outputCol="nv"), StandardScaler(inputCol="nv", outputCol="ns")]
    parts = ["ns"]
    if text:
        stages += [*([] if counted else term_counts(vocabulary)), IDF(inputCol="terms_c", outputCol="terms_v")]
        parts.append("terms_v")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    base = LogisticRegression(regParam=0.05, maxIter=sizes.iterations, weightCol="weight")
    stages.append(OneVsRest(classifier=base, featuresCol="features", labelCol="y", weightCol="weight", parallelism=3) if kind == "logistic" else
                  RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxDepth=sizes.text_depth, numTrees=sizes.text_trees, seed=42))
    return Pipeline(stages=stages)


def balanced(train: DataFrame, label: str = "y") -> DataFrame:
    """``weight`` = rows / (classes * rows of the class). The counts, one a class, become one expression: a join would
    deal the rows by their class, and its table counts as a task's memory once for each partition that the task reads."""
    n = {r[label]: r["_n"] for r in train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")).collect()}
    weight = F.lit(None).cast("double")
    for value, rows in n.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(sum(n.values()) / (rows * len(n)))).otherwise(weight)
    return train.filter(F.col(label).isNotNull()).withColumn("weight", weight)


def class_index() -> StringIndexer:
    return StringIndexer(inputCol="target", outputCol="y", handleInvalid="keep")
