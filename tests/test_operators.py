"""Operators on hand-made rows against brute force."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import numeric as nm, text as tx
from tideline.operators import evaluate as evl, events as ev, features as feat, folds as fd, ranking as rk, returns as rt
from tideline.operators.asof import asof_join, backward_map, forward_map, interval_overlap_join
from tideline.operators.rolling import ewm_means, prior_quantile, rank_in_window, span
from tideline.session import shared_folder

DAY0 = dt.date(2020, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def series(spark, n=700, symbols=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(s, day(i), float(c[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, session date, close double")


# ------------------------------------------------------------------ as-of
def brute_asof(left, right, forward, exact):
    out = []
    for k, t in left:
        c = [(u, v) for kk, u, v in right if kk == k and ((u >= t if exact else u > t) if forward else (u <= t if exact else u < t))]
        out.append((k, t, (min(c)[1] if forward else max(c)[1]) if c else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_asof_edges_and_hot_key(spark, forward, exact):
    rnd = random.Random(5)
    left = [("hot", day(rnd.randrange(0, 400))) for _ in range(300)] + [("cold", day(rnd.randrange(0, 400))) for _ in range(20)] + [("none", day(3))]
    right = [("hot", day(i), float(i)) for i in range(10, 380, 7)] + [("cold", day(200), 1.0)]
    l = spark.createDataFrame(left, "k string, t date")
    r = spark.createDataFrame(right, "k string, u date, v double")
    got = asof_join(l, r, "t", "u", ["v"], ["k"], forward=forward, allow_exact=exact).select("k", "t", "v").collect()
    assert sorted([tuple(x) for x in got], key=str) == brute_asof(left, right, forward, exact)


def test_asof_takes_the_larger_tie(spark):
    l = spark.createDataFrame([(1, dt.datetime(2020, 1, 2))], "id int, t timestamp_ntz")
    r = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0), (dt.datetime(2020, 1, 1), 2.0)], "u timestamp_ntz, v double")
    assert asof_join(l, r, "t", "u", ["v"]).first().v == 2.0


def test_asof_spreads_a_hot_key_and_needs_no_window_over_facts(spark):
    left = [("hot" if i % 10 else "cold", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=17 * i)) for i in range(3000)]
    right = [(k, dt.datetime(2020, 1, 3) + dt.timedelta(hours=7 * i), i) for k in ("hot", "cold") for i in range(60)]
    l = spark.createDataFrame(left, "k string, t timestamp_ntz")
    r = spark.createDataFrame(right, "k string, u timestamp_ntz, v int")
    joined = asof_join(l, r, "t", "u", ["v"], ["k"], grain="hour")
    assert sorted([tuple(x) for x in joined.select("k", "t", "v").collect()], key=str) == brute_asof(left, right, False, True)
    facts = joined._jdf.queryExecution().executedPlan().toString()
    # only the calendar is windowed and gathered into cells; facts meet it by one equi-join
    assert facts.count("Window [") == 1 and facts.count("Join") == 1


def test_calendar_maps(spark):
    b = spark.createDataFrame([("A", day(2)), ("A", day(5))], "symbol string, session date")
    fwd = {r.date: r.anchor for r in forward_map(b, first_day=day(0)).collect()}
    assert fwd == {day(0): day(2), day(1): day(2), day(2): day(2), day(3): day(5), day(4): day(5), day(5): day(5)}
    bwd = {r.date: r.anchor for r in backward_map(b, str(day(6))).collect()}
    assert bwd == {day(2): day(2), day(3): day(2), day(4): day(2), day(5): day(5), day(6): day(5)}


def test_interval_overlap_has_no_duplicates(spark):
    rnd = random.Random(1)
    a = [(i, day(x := rnd.randrange(0, 300)), day(x + rnd.randrange(0, 90))) for i in range(40)]
    b = [(i, day(x := rnd.randrange(0, 300)), day(x + rnd.randrange(0, 90))) for i in range(25)]
    l = spark.createDataFrame(a, "i int, a date, b date")
    r = spark.createDataFrame(b, "j int, c date, d date")
    got = sorted((x.i, x.j) for x in interval_overlap_join(l, r, ("a", "b"), ("c", "d"), 30).select("i", "j").collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if u <= e and v >= s)


# ------------------------------------------------------------------ windows
def test_ewm_matches_pandas_over_many_blocks(spark):
    df = series(spark)
    got = ewm_means(df, {"fast": ("close", span(9), 9), "slow": ("close", span(50), 50)}).toPandas().sort_values(["symbol", "session"])
    for s, g in got.groupby("symbol"):
        for col, n in (("fast", 9), ("slow", 50)):
            want = g["close"].ewm(span=n, adjust=False, min_periods=n).mean()
            np.testing.assert_allclose(g[col].to_numpy(float), want.to_numpy(), rtol=1e-10)


def test_ewm_std_and_rsi_match_pandas(spark):
    p = series(spark, 200, ("A",)).withColumn("ret1", F.col("close") / F.lag("close").over(feat.by_symbol()) - 1)
    got = feat.ewm_std(p, "ret1", 60, "s").toPandas().sort_values("session")
    want = got["ret1"].ewm(span=60, adjust=False).std(bias=False)
    np.testing.assert_allclose(got["s"].to_numpy(float)[5:], want.to_numpy()[5:], rtol=1e-8)
    r = feat.rsi(p).toPandas().sort_values("session")
    d = r["close"].diff()
    g, l = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    np.testing.assert_allclose(r["rsi_wilder"].to_numpy(float)[20:], (100 - 100 / (1 + g / l)).to_numpy()[20:], rtol=1e-8)


def test_prior_quantile_and_rank(spark):
    p = series(spark, 120, ("A",)).select("symbol", "session", "close", prior_quantile("close", 0.7, 30, 10).alias("q"), rank_in_window("close", 20, 5).alias("r"))
    p = p.toPandas().sort_values("session")
    np.testing.assert_allclose(p["q"].to_numpy(float), p["close"].rolling(30, min_periods=10).quantile(0.7).shift(1).to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(p["r"].to_numpy(float), p["close"].rolling(20, min_periods=5).rank(pct=True).to_numpy(), rtol=1e-12)


def test_future_values_do_not_reach_back(spark):
    a = series(spark, 150)
    cut = day(100)
    b = a.withColumn("close", F.when(F.col("session") > F.lit(cut), F.col("close") * 3).otherwise(F.col("close")))

    def block(df):
        o = feat.macd(feat.rsi(df)).withColumn("q", prior_quantile("close", 0.9, 40, 10))
        return o.filter(F.col("session") <= F.lit(cut)).select("symbol", "session", *[F.round(c, 9).alias(c) for c in ("macd_hist", "rsi_wilder", "rsi_simple", "q")])

    assert block(a).exceptAll(block(b)).count() == 0


def test_calendar_block_counts_missing_weekdays(spark):
    days = [dt.date(2021, 7, 1), dt.date(2021, 7, 2), dt.date(2021, 7, 6), dt.date(2021, 7, 7)]  # Monday the 5th is a holiday
    f = spark.createDataFrame([("A", d, 0.01) for d in days], "symbol string, session date, ret5 double")
    got = {r.session: r for r in feat.calendar_block(f).collect()}
    assert got[days[1]].next_holiday == 1 and got[days[1]].pre_holiday == 1 and got[days[1]].pre_holiday_momentum == 0.01
    assert got[days[2]].post_holiday == 1 and got[days[0]].next_holiday == 0


# ------------------------------------------------------------------ event study
def test_market_model_matches_direct_regression(spark):
    rng = np.random.default_rng(2)
    n = 330
    m = rng.normal(0, 0.01, n)
    r = 0.0002 + 1.3 * m + rng.normal(0, 0.005, n)
    df = spark.createDataFrame([("A", "x", day(i), float(r[i]), float(m[i]), i) for i in range(n)], "symbol string, sector string, session date, r double, m double, p int")
    got = {row.p: row for row in ev.market_model(df).collect()}
    for p in (10, 45, 60, 200, 300):
        lo, hi = max(0, p - 250), p - 20
        y, x = (r[:p], m[:p]) if hi <= lo + 30 else (r[lo:hi], m[lo:hi])
        if len(y) < 30:
            assert got[p].fitted == 0 and got[p].beta == 0.0
            assert got[p].alpha == pytest.approx(r[max(0, p - 60):p].mean(), abs=1e-12)
            continue
        b = np.cov(x, y, ddof=1)[0, 1] / np.var(x, ddof=1)
        a = y.mean() - b * x.mean()
        assert got[p].beta == pytest.approx(b, rel=1e-8)
        assert got[p].alpha == pytest.approx(a, abs=1e-10)
        assert got[p].sigma == pytest.approx(np.std(y - a - b * x, ddof=1), rel=1e-7)
    w = {(x.p, x.window): x for x in ev.bar_windows(ev.market_model(df)).collect()}
    assert (n - 3, "post_1_5") not in w and (2, "pre_5") not in w
    assert w[(200, "post_1_5")].raw == pytest.approx(r[201:206].sum(), abs=1e-12)
    assert w[(5, "pre_5")].raw == pytest.approx(r[0:5].sum(), abs=1e-12)


def test_weighted_summary_equals_repeated_rows(spark):
    rows = [("c", "s", 0.01, 0.5, 3), ("c", "s", -0.02, -1.0, 1), ("c", "s", 0.03, 1.2, 2)]
    got = ev.weighted_summary(spark.createDataFrame(rows, "category string, symbol string, car double, scar double, k int"), ["category", "symbol"]).first()
    x = np.repeat([r[2] for r in rows], [r[4] for r in rows])
    assert got.n == 6 and got.mean == pytest.approx(x.mean()) and got["median"] == pytest.approx(np.median(x)) and got["std"] == pytest.approx(x.std(ddof=1))
    assert got.skew == pytest.approx(pd.Series(x).skew())


def test_holm_is_monotone(spark):
    p = [("g", s, v) for s, v in (("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5))]
    got = {r.symbol: r.p_value_holm for r in ev.holm(spark.createDataFrame(p, "g string, symbol string, p_value double"), ["g"]).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})


# ------------------------------------------------------------------ folds, returns, evaluation
def test_folds_cover_test_rows_once(spark):
    df = spark.createDataFrame([("A", day(i)) for i in range(100)], "symbol string, session date")
    b = fd.fold_bounds(df, 40, 25).orderBy("fold").collect()
    assert [(r.n_train, r.n_test) for r in b] == [(40, 25), (40, 25), (40, 10)]
    assert all(r.train_end < r.test_start for r in b)
    f = fd.with_folds(fd.number_rows(df), 40, 25).filter("role = 'test'")
    assert f.count() == f.select("session").distinct().count() == 60


def test_purge_fails_closed(spark):
    t = dt.datetime(2020, 1, 5)
    df = spark.createDataFrame([(t, t), (None, t), (t + dt.timedelta(1), t)], "label_end_at timestamp_ntz, available_at timestamp_ntz")
    assert fd.mature_only(df, F.lit(t).cast("timestamp_ntz")).count() == 1
    with pytest.raises(ValueError):
        fd.mature_only(df.drop("available_at"), F.lit(t))


def test_trades_ledger_and_cutoff(spark):
    close = [100.0, 110.0, 121.0, 60.0, 66.0, 70.0]
    target = [1.0, 1.0, 1.0, 0.0, 1.0, 1.0]
    ret = [0.0] + [close[i] / close[i - 1] - 1 for i in range(1, 6)]
    df = spark.createDataFrame([("s", day(i), close[i], target[i], ret[i]) for i in range(6)], "k string, session date, close double, target double, ret1 double")
    n = rt.net_of_costs(df, ["k"], "target", cost=0.001)
    t = rt.trades(n, ["k"]).orderBy("trade").collect()
    assert [(x.entry, x.exit, x.bars) for x in t] == [(day(1), day(3), 3), (day(5), day(5), 1)]
    led = rt.ledger(df, ["k"]).collect()
    assert max(abs(x.residual) for x in led) < 1e-6
    cut = rt.drawdown_cutoff(n, ["k"], 0.15).orderBy("session").collect()
    assert [x.halted for x in cut] == [0, 0, 0, 0, 1, 1] and cut[5].cut_net == 0.0


def test_barrier_gap_and_tie_rules(spark):
    bars = [(day(0), 100, 100, 100, 100, True), (day(1), 100, 106, 96, 100, False), (day(2), 90, 91, 89, 90, False)]
    df = spark.createDataFrame([("A", d, float(o), float(h), float(l), float(c), e) for d, o, h, l, c, e in bars], "symbol string, session date, open double, high double, low double, close double, entry_flag boolean")
    assert rt.barrier_touch(df, ["symbol"]).first().reason == "stop"
    assert rt.barrier_touch(df, ["symbol"], stop_first=False).first().reason == "take"
    gap = df.filter(F.col("session") != F.lit(day(1)))
    r = rt.barrier_touch(gap, ["symbol"]).first()
    assert r.reason == "gap_stop" and r.trade_return == pytest.approx(-0.1)


def test_block_bootstrap_matches_direct_resampling(spark):
    import hashlib

    rng = np.random.default_rng(8)
    n, reps, block = 50, 30, 7
    v = rng.normal(0, 1, n)
    df = spark.createDataFrame([("k", day(i), float(v[i])) for i in range(n)], "k string, session date, x double")
    got = evl.block_bootstrap(df, ["k"], "x", reps, block).first()
    means = []
    for rep in range(reps):
        idx = []
        for slot in range(math.ceil(n / block)):
            start = int(hashlib.md5(f"42:{rep}:{slot}".encode()).hexdigest()[:8], 16) % n
            idx += [(start + o) % n for o in range(block)]
        means.append(v[np.array(idx[:n])].mean())
    assert got.mean == pytest.approx(v.mean()) and got.low == pytest.approx(np.quantile(means, 0.025)) and got.high == pytest.approx(np.quantile(means, 0.975))


def test_auc_and_newey_west(spark):
    rows = [("g", 0.1, 0), ("g", 0.4, 1), ("g", 0.4, 0), ("g", 0.8, 1), ("g", 0.9, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for _, a, ya in rows if ya for _, b, yb in rows if not yb]
    assert evl.auc(df, ["g"], "p", "y").first().auc == pytest.approx(np.mean(pairs))
    v = np.array([1.0, 2.0, 0.5, 3.0, 2.5])
    s = spark.createDataFrame([("k", day(i), float(x)) for i, x in enumerate(v)], "k string, session date, x double")
    c = v - v.mean()
    lrv = c @ c / 5 + sum(2 * (1 - k / 3) * (c[k:] @ c[:-k]) / 5 for k in (1, 2))
    assert evl.newey_west(s, ["k"], "x", 2).first().hac_se == pytest.approx(math.sqrt(lrv / 5))


def test_right_closed_bins(spark):
    p = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.100001, 0.55, 1.0, 1.2)], "p double")
    assert [r.b for r in p.select(evl.right_closed_bin("p", 0.0, 0.1, 10).alias("b")).collect()] == [1, 1, 2, 6, 10, None]


# ------------------------------------------------------------------ ranking over large data
def test_rank_all_and_safe_cuts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(0, 60), rnd.randrange(0, 12)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t int, c int").repartition(7)
    got = {r.id: r.k for r in rk.rank_all(df, [F.col("t"), F.col("id")], "k").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    clusters = [(i, i // 9 if i % 9 < 4 else 100 + i) for i in range(90)]
    cuts = sorted(r.cut for r in rk.cluster_safe_boundaries(spark.createDataFrame(clusters, "t int, c int"), [F.col("t")], ["c"]).collect())
    want = [p for p in range(1, 91) if not any(a < p <= b for a, b in ((min(i for i, c in clusters if c == k), max(i for i, c in clusters if c == k)) for k in {c for _, c in clusters}))]
    assert cuts == want


# ------------------------------------------------------------------ scalars and text
def test_distribution_functions(spark):
    from statistics import NormalDist

    xs = [-3.0, -1.0, 0.0, 0.3, 2.2]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.c for r in df.select(nm.normal_cdf("x").alias("c")).collect()]
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], atol=2e-7)
    ps = [0.001, 0.2, 0.5, 0.975]
    q = spark.createDataFrame([(p,) for p in ps], "p double").select(nm.normal_quantile("p").alias("q")).collect()
    np.testing.assert_allclose([r.q for r in q], [NormalDist().inv_cdf(p) for p in ps], rtol=1e-7, atol=1e-8)
    t = spark.createDataFrame([(2.0, 10.0), (1.0, 200.0)], "t double, v double").select(nm.student_t_tail("t", "v").alias("p")).collect()
    np.testing.assert_allclose([r.p for r in t], [0.036694, 0.159261], atol=1e-3)


def test_packed_order_sorts_like_a_tuple(spark):
    rows = [(5, 3, 10 ** 10), (5, 3, 9), (4, 99, 10 ** 10), (10 ** 12, 0, 0)]
    df = spark.createDataFrame(rows, "a long, b int, c long").select("a", "b", "c", nm.packed_order(("a", 14), ("b", 2), ("c", 11)).alias("k"))
    assert [(r.a, r.b, r.c) for r in df.orderBy("k").collect()] == sorted(rows)


def test_text_scores(spark):
    df = spark.createDataFrame([("upgrade beats estimates, strong demand for gpu chip",), ("lawsuit and probe; tariff",), ("plain words",)], "t string")
    r = df.select(tx.event_type("t").alias("k"), tx.lexicon_score("t").alias("s"), tx.keyword_sentiment("t").alias("w"), tx.word_count("t").alias("n")).collect()
    assert [x.k for x in r] == ["product", "legal_regulatory", "neutral"]
    assert r[0].s == pytest.approx(math.tanh((1.5 + 2.0 + 2.0 + 1.8) / 4)) and r[1].s == pytest.approx(math.tanh((-1.5 - 1.4 - 1.0) / 4)) and r[2].s == 0.0
    assert r[2].n == 2
    c = spark.createDataFrame([("<p>a &amp; b</p>\n\n<b>c</b>",)], "h string").select(tx.clean_text("h").alias("c")).first().c
    assert c == "a & b c"
    s = spark.createDataFrame([("amd, NVX|amd;  tsm",)], "h string").select(tx.string_set("h").alias("c")).first().c
    assert s == ["AMD", "NVX", "TSM"]


@pytest.mark.parametrize("t,df,tail", [(12.706205, 1, 0.025), (4.302653, 2, 0.025), (2.228139, 10, 0.025), (1.812461, 10, 0.05),
                                       (2.580755, 1000, 0.005), (-2.228139, 10, 0.025), (0.0, 5, 0.5), (63.656741, 1, 0.005)])
def test_student_tail_matches_published_values(spark, t, df, tail):
    got = spark.createDataFrame([(t, df)], "t double, df int").select(nm.student_t_tail("t", "df").alias("p")).first().p
    assert abs(got - tail) < 2e-6


def test_short_series_have_a_mean_and_no_limits(spark):
    df = spark.createDataFrame([("s", day(i), float(i)) for i in range(10)], "k string, session date, x double")
    row = evl.block_bootstrap(df, ["k"], "x", reps=50, block=21).first()
    assert (row.n, row["mean"], row.low, row.high) == (10, 4.5, None, None)


def test_intermediate_tables_need_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://head:7077", "applicationId": "app"})()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_group_quantile_of_a_group_with_nearly_all_rows(spark):
    rnd = random.Random(6)
    rows = [("hot" if i % 50 else "cold", float(rnd.randrange(400))) for i in range(5000)] + [("cold", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r.k: r.v for r in rk.group_quantile(df, ["k"], "x", q, "v").collect()}
        for k in ("hot", "cold"):
            assert abs(got[k] - np.quantile([x for g, x in rows if g == k and x is not None], q)) < 1e-9


def test_running_total_restarts_with_every_key(spark):
    rows = [(i % 3, i, i % 5) for i in range(600)]
    got = rk.running_total(spark.createDataFrame(rows, "k int, o int, x int").repartition(5), ["k"], ["o"], "x", "s").collect()
    for r in got:
        assert r.s == sum(x for k, o, x in rows if k == r.k and o < r.o)


# ------------------------------------------------------------------ resampled paths
def test_path_bootstrap_matches_drawn_rows(spark):
    """Every path drawn row by row; keys of unlike length, a flat one, a total loss first, losses only, NULL keys and values."""
    rng = random.Random(11)
    kinds = {"long": [rng.gauss(0.001, 0.02) for _ in range(70)], "short": [0.01, -0.02, 0.005], "flat": [0.01] * 6, "one": [0.02],
             "lost": [-1.0, 0.1, 0.2, -0.1], "all_lost": [-1.5, -1.0], None: [0.1, 0.2, 0.3]}
    rows = [("s", k, day(i) if i else None, v) for k, vs in kinds.items() for i, v in enumerate(vs)] + [("s", "long", day(900), None), (None, "long", day(1), 0.5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "strategy string, symbol string, session date, net double").repartition(4)
    reps = 23
    out = evl.iid_bootstrap(df, ["strategy", "symbol"], "net", reps=reps)
    got = {(r[0], r[1]): tuple(r)[2:] for r in out.collect()}
    assert set(got) == {("s", k) for k in kinds if k}
    for k, vs in kinds.items():
        if k is None:
            continue
        ratios, falls = [], []
        for rep in range(reps):
            path = [vs[int(hashlib.md5(f"7:{rep}:{slot}".encode()).hexdigest()[:8], 16) % len(vs)] for slot in range(len(vs))]
            if np.std(path) > 1e-12:
                ratios.append(np.mean(path) / np.std(path) * math.sqrt(252))
            log, top, worst = None, None, []
            for v in path:
                if v > -1:
                    log = (log or 0.0) + math.log1p(v)
                if log is not None:
                    top = log if top is None else max(top, log)
                    worst.append(math.exp(log - max(top, 0.0)) - 1)
            if worst:
                falls.append(min(worst))
        want = (*((np.quantile(ratios, 0.05), np.quantile(ratios, 0.95)) if ratios else (None, None)), np.quantile(falls, 0.05) if falls else None)
        assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-9) for a, b in zip(got["s", k], want, strict=True)), k


def test_path_bootstrap_shuffles_no_drawn_row(spark):
    df = spark.createDataFrame([("s", "x", day(i), 0.01 * (i % 3 - 1)) for i in range(50)], "strategy string, symbol string, session date, net double")
    plan = evl.iid_bootstrap(df, ["strategy", "symbol"], "net", reps=9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Window" not in plan


# ------------------------------------------------------------------ one pass over a text
def test_mentions_keep_every_listed_term(spark):
    rng = random.Random(2)
    loose = ["", "a", "be", "ats", "price ", "target", "p/", "é", "\n", "ban", "export control", "asics", "revenues", "x"]
    texts = ["", "none of it", *tx.TERMS, "".join(tx.TERMS), "beatsurgebans"] + [rng.choice(["", " "]).join(rng.choice(loose + tx.TERMS) for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, None])], "k int, t string").withColumn("m", tx.mentions("t"))
    got = {r.k: r.m for r in df.collect()}
    assert got.pop(len(texts)) is None
    assert all({t for t in tx.TERMS if t in x} == {t for t in tx.TERMS if t in got[k]} for k, x in enumerate(texts))
    for score in (tx.lexicon_score, tx.event_type, tx.keyword_sentiment, lambda c: tx.relevance(c, F.lit(True)), *(lambda c, v=v: tx.hits(c, v) for v in tx.TOPIC_TERMS.values())):
        assert df.filter(~score("t").eqNullSafe(score("m"))).count() == 0


def test_texts_without_a_term_skip_the_search_of_places(spark):
    df = spark.createDataFrame([(0, "nothing of note"), (1, None), (2, ""), (3, "a p/e above it, a ban"), (4, "x" * 50 + "gpu" + "y" * 50)], "k int, t string")
    seen = df.select("k", tx.mentions("t").alias("m"))
    assert {r.k: r.m for r in seen.collect()} == {0: "", 1: None, 2: "", 3: "p/e\nban", 4: "gpu"}
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "CASE WHEN" in plan  # the pattern runs only where a term was found
