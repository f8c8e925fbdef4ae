"""Model-fitting queries. Rates are SQL-checked; iterative fits are rows-only."""

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import clip
from tideline.operators import features as feat, models as md
from tideline.operators.asof import asof_join
from tideline.operators.rolling import pct_change
from tideline.plans import signals as sg
from tideline.plans.catalog import query
from tideline.plans.sqlviews import add_view
from tideline.plans.records import news
from tideline.session import cut_lineage
from tideline.sources import views


def research(spark, d):
    f = feat.research_block(views.features(spark, d)).filter("rn > 60")
    # Every fit and score below reads this frame: compute it once, in reliable storage.
    return md.model_frame(cut_lineage(f.drop("rn")))


@query("m01_fold_rates", "symbol:s fold:i n:i base_rate:6 active_rate:6 inactive_rate:6",
       """WITH t AS (SELECT r.symbol, r.fold, quantile_cont(ret20, 0.55) AS mc, quantile_cont(vol_ratio, 0.55) AS vc FROM fold_rows r WHERE role = 'train' GROUP BY 1, 2)
          SELECT r.symbol, r.fold, count(*) AS n, (sum(target_direction) + 1) / (count(*) + 2.0) AS base_rate, (coalesce(sum(target_direction) FILTER (a), 0) + 1) / (count(*) FILTER (a) + 2.0) AS active_rate,
            (coalesce(sum(target_direction) FILTER (NOT a), 0) + 1) / (count(*) FILTER (NOT a) + 2.0) AS inactive_rate
          FROM (SELECT f.*, coalesce(f.ret20 > t.mc AND f.vol_ratio > t.vc, false) AS a FROM fold_rows f JOIN t ON t.symbol = f.symbol AND t.fold = f.fold WHERE role = 'train') r GROUP BY 1, 2""", "M01")
def _(spark, d):
    tr = sg.fold_rows(spark, d).filter("role = 'train'").select("symbol", "fold", "ret20", "vol_ratio", "target_direction")
    t = tr.groupBy("symbol", "fold").agg(F.percentile("ret20", 0.55).alias("mc"), F.percentile("vol_ratio", 0.55).alias("vc"))
    a = F.coalesce((F.col("ret20") > F.col("mc")) & (F.col("vol_ratio") > F.col("vc")), F.lit(False))
    y = F.col("target_direction")
    g = tr.join(t, ["symbol", "fold"]).withColumn("a", a).groupBy("symbol", "fold").agg(
        F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.when(F.col("a"), y).otherwise(0)).alias("sa"), F.sum(F.col("a").cast("int")).alias("na"))
    return g.select("symbol", "fold", "n", ((F.col("s") + 1) / (F.col("n") + 2)).alias("base_rate"), ((F.col("sa") + 1) / (F.col("na") + 2)).alias("active_rate"),
                    ((F.col("s") - F.col("sa") + 1) / (F.col("n") - F.col("na") + 2)).alias("inactive_rate"))


add_view("research_rows", """
SELECT *, CASE WHEN research_target > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
       (session - min(session) OVER ()) / greatest(max(session) OVER () - min(session) OVER (), 1)::DOUBLE AS t, (label_end_at - min(session) OVER ()) / greatest(max(session) OVER () - min(session) OVER (), 1)::DOUBLE AS t_end
FROM (SELECT symbol, session, rn, ret1, ret5, ret20, ret60, vol20, vol60, (high - low) / nullif(close, 0) AS day_range, open / nullif(lag(close) OVER w, 0) - 1 AS overnight, vol_ratio AS volume_ratio, p20 - 1 AS price_ma20, p60 - 1 AS price_ma60,
        CASE WHEN lag(volume) OVER w IS NOT NULL THEN least(greatest(volume / nullif(lag(volume) OVER w, 0) - 1, -0.99), 10.0) END AS volume_change,
        lead(session, 2) OVER w AS label_end_at, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS research_target FROM features WINDOW w AS (PARTITION BY symbol ORDER BY session))
WHERE rn > 60 AND research_target IS NOT NULL""")


@query("m01_mature_folds", "fold:i train:i train_up:i last_label_end:d test:i test_up:i",
       """SELECT fold, count(*) FILTER (t_end < cut) AS train, sum(label) FILTER (t_end < cut) AS train_up, max(label_end_at) FILTER (t_end < cut) AS last_label_end,
            count(*) FILTER (t >= cut AND t < stop) AS test, sum(label) FILTER (t >= cut AND t < stop) AS test_up
          FROM research_rows, (VALUES (0, 0.6, 0.8), (1, 0.8, 1.01)) f(fold, cut, stop) GROUP BY 1""", "M01")
def _(spark, d):
    f = research(spark, d)
    out = None
    for k, (cut, stop) in enumerate(((0.6, 0.8), (0.8, 1.01))):
        train = md.mature(f, cut).agg(F.count("*").alias("train"), F.sum("label").alias("train_up"), F.max("label_end_at").alias("last_label_end"))
        test = f.filter((F.col("t") >= cut) & (F.col("t") < stop)).agg(F.count("*").alias("test"), F.sum("label").alias("test_up"))
        one = train.withColumn("fold", F.lit(k)).join(test.withColumn("fold", F.lit(k)), "fold")
        out = one if out is None else out.unionByName(one)
    return out


def _greedy_sql(k: int = 8, cap: float = 0.92) -> str:
    """Features by |correlation with the label|, each kept while places are free and no kept one is a near copy."""
    names = md.FEATURES
    score = ", ".join(f"('{c}', coalesce(abs(corr({c}, label)), 0))" for c in names)
    pairs = ", ".join(f"('{a}', '{b}', coalesce(abs(corr({a}, {b})), 0))" for i, a in enumerate(names) for b in names[i + 1:])
    steps = "s0 AS (SELECT map_from_entries(list((i || '_' || j, x))) AS m, 0 AS n FROM c)"
    for i in range(1, len(names) + 1):
        near = " OR ".join(f"(k{j} AND m['{j}_{i}'] > {cap})" for j in range(1, i)) or "false"
        steps += f",\n s{i} AS (SELECT *, n + CASE WHEN k{i} THEN 1 ELSE 0 END AS n_ FROM (SELECT *, n < {k} AND NOT ({near}) AS k{i} FROM s{i - 1}))"
        steps += f",\n t{i} AS (SELECT * EXCLUDE (n, n_), n_ AS n FROM s{i})"
        steps = steps.replace(f"FROM s{i - 1}))", f"FROM {'t' + str(i - 1) if i > 1 else 's0'}))")
    flags = ", ".join(f"k{i}" for i in range(1, len(names) + 1))
    return f"""WITH r AS (SELECT * FROM research_rows WHERE t_end < 0.7),
 y AS (SELECT unnest([{score}]) AS u FROM r),
 o AS (SELECT u[1] AS feature, u[2] AS relevance, row_number() OVER (ORDER BY u[2] DESC, u[1]) AS i FROM y),
 p AS (SELECT unnest([{pairs}]) AS u FROM r),
 c AS (SELECT least(a.i, b.i) AS i, greatest(a.i, b.i) AS j, p.u[3] AS x FROM p JOIN o a ON a.feature = p.u[1] JOIN o b ON b.feature = p.u[2]),
 {steps}
SELECT row_number() OVER (ORDER BY o.i) AS place, feature, relevance FROM o, t{len(names)} WHERE [{flags}][o.i]"""


def _scores(p):
    return p.groupBy("model", "fold").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"),
                                          F.avg(-(F.col("label") * F.log("p") + (1 - F.col("label")) * F.log(1 - F.col("p")))).alias("log_loss"))


@query("m01_fold_models", "model:s fold:i n:i brier:5 log_loss:5", None, "M01")
def _(spark, d):
    return _scores(md.fold_predictions(research(spark, d), [0.6, 0.8], ["logistic_1.0", "boosting_2"]))


@query("m02_nested_calibration", "mapping:s parameter:s calibrator:s n:i brier:5", None, "M02")
def _(spark, d):
    p = md.nested_calibration(research(spark, d))
    u = p.unpivot(["label", "parameter", "calibrator"], ["raw", "shrink", "sigmoid", "calibrated", "base_rate"], "mapping", "p")
    return u.groupBy("mapping", "parameter", "calibrator").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))


@query("m03_weighted_ensemble", "symbol:s n:i brier:5 long_days:i", None, "M03")
def _(spark, d):
    p = md.fold_predictions(research(spark, d), [0.6, 0.8], ["logistic_1.0", "logistic_0.2", "forest"])
    # Weights from the first fold, predictions from the second.
    w = _scores(p.filter("fold = 0")).select("model", F.greatest(0.26 - F.col("brier"), F.lit(0.001)).alias("w"))
    e = p.filter("fold = 1").join(w, "model").groupBy("symbol", "session", "label").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))
    return e.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), F.sum((F.col("p") >= 0.52).cast("int")).alias("long_days"))


@query("m04_feature_selection", "place:i feature:s relevance:6", _greedy_sql(), "M04")
def _(spark, d):
    kept = md.select_features(md.mature(research(spark, d), 0.7))
    return spark.createDataFrame([(i + 1, c, s) for i, (c, s) in enumerate(kept)], "place int, feature string, relevance double")


@query("m05_candidate_estimators", "model:s kind:s n:i error:6", None, "M05")
def _(spark, d):
    f = research(spark, d)
    train, test = md.mature(f, 0.7), f.filter("t >= 0.7")
    out = None
    for name, m in md.fit_many(md.estimators(), train).items():
        r = md.probability(m, test, "p").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("error")).select(F.lit(name).alias("model"), F.lit("classifier").alias("kind"), "n", "error")
        out = r if out is None else out.unionByName(r)
    for name, m in md.fit_many(md.regressors(), train).items():
        r = m.transform(test).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("research_target"), 2))).alias("error")).select(F.lit(name).alias("model"), F.lit("regressor").alias("kind"), "n", "error")
        out = out.unionByName(r)
    return out


@query("m06_random_search", "trial:i model:s params:s folds:i score:5 accuracy_mean:5 accuracy_std:5 log_loss_mean:5 weight_mean:5 rmse_mean:6 best:i", None, "M06")
def _(spark, d):
    names = ("trial int, model string, params string, folds int, score double, accuracy_mean double, accuracy_std double, log_loss_mean double, "
             "weight_mean double, rmse_mean double, best int")
    rows = md.random_search(research(spark, d), md.random_trials())  # a row a trial
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in names.split(", ")) for r in rows], names)


def labelled_news(spark, d):
    """Articles with the direction of the index over five sessions from the deciding close."""
    w = Window.orderBy("session")
    m = views.market(spark, d).select((F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOUR")).alias("market_close"),
                                      (F.lead("idx", 5).over(w) / F.col("idx") - 1).alias("fwd5"),
                                      F.unix_timestamp(F.lead("session", 5).over(w).cast("timestamp") + F.expr("INTERVAL 21 HOUR")).alias("t_end"))
    n = news(spark, d).join(views.articles(spark, d).select("doc_id", "body"), "doc_id").select("doc_id", "body", "available_at", "sentiment", "quality", "rel", "importance", F.col("words").cast("double").alias("words"))
    j = asof_join(n, m, "available_at", "market_close", ["market_close", "fwd5", "t_end"], forward=True).filter("fwd5 IS NOT NULL")
    return j.withColumn("target", feat.direction_label("fwd5", 0.005)).withColumn("t", F.unix_timestamp("available_at"))


def _compare(spark, d, kinds):
    pipelines = {name: md.text_pipeline(kind, text, counted=True) for name, (kind, text) in kinds.items()}
    words, terms = md.term_counts()
    # Texts are taken apart once, before they are stored; the vocabulary and its counts are read from their words.
    n = cut_lineage(words.transform(labelled_news(spark, d)).drop("body"))
    cut = n.agg(F.percentile_approx("t", 0.7)).first()[0]
    n = md.class_index().fit(md.mature(n, cut)).transform(n)  # classes are learned from training rows too
    # Every fit and score below reads the counts.
    n = cut_lineage(terms.fit(md.mature(n, cut)).transform(n).drop("tok"))
    train, test = md.balanced(md.mature(n, cut)), n.filter(F.col("t") >= cut)
    train = train.coalesce(1 + train.count() // md.TEXTS_A_PART).persist()  # a fit runs hundreds of short jobs: few tasks each
    out = None
    try:
        for name, pipeline in pipelines.items():
            model = pipeline.fit(train)
            r = model.transform(test).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy")).select(F.lit(name).alias("model"), "n", "accuracy")
            out = r if out is None else out.unionByName(r)
    finally:
        train.unpersist()
    return out


@query("m07_text_models", "model:s n:i accuracy:5", None, "M07")
def _(spark, d):
    return _compare(spark, d, {"tfidf_logistic": ("logistic", True), "tfidf_forest": ("forest", True)})


@query("m08_model_comparison", "model:s n:i accuracy:5", None, "M08")
def _(spark, d):
    return _compare(spark, d, {"numeric_only": ("logistic", False), "text_and_numeric": ("logistic", True)})
