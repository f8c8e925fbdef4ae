"""Event-study queries."""

import math

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import clip, flag, prob_above, sdiv
from tideline.operators import events as ev
from tideline.operators.asof import asof_join, backward_map
from tideline.operators.rolling import by_symbol, full, pct_change, trailing
from tideline.plans.catalog import query
from tideline.plans.joins import noisy_days
from tideline.plans.sqlviews import add_view
from tideline.sources import views
from tideline.sources.stages import stage


def erf_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs({x})))"
    return (f"(sign({x}) * (1.0::DOUBLE - {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE "
            f"+ {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-({x}) * ({x}))))")


def cdf_sql(x: str) -> str:
    inner = f"(({x}) / {math.sqrt(2.0)!r}::DOUBLE)"
    return f"(0.5::DOUBLE * (1.0::DOUBLE + {erf_sql(inner)}))"


def t_tail_sql(t: str, df: str) -> str:
    """One-sided tail for whole degrees of freedom by the finite trigonometric series, which shares nothing with
    the continued fraction of the Spark side."""
    v = f"CAST({df} AS BIGINT)"
    angle = f"atan(abs({t}) / sqrt({v}))"
    even = (f"sin({angle}) * coalesce(list_sum(list_transform(range(0, {v} // 2), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({angle}), 2 * k))), 0)")
    odd = (f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), lambda k: "
           f"exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos({angle}), 2 * k + 1))), 0))")
    return f"((1 - CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END) / 2)"


add_view("ev_returns", "SELECT symbol, sector, session, ret1 AS r, idx_ret1 AS m, rn - 2 AS p FROM features WHERE ret1 IS NOT NULL")
add_view("model_fit", """
SELECT symbol, sector, session, r, m, p, beta, CASE WHEN n >= 30 THEN y - beta * x ELSE coalesce(mean60, 0) END AS alpha,
       CASE WHEN n >= 30 THEN sqrt(greatest(vy - beta * beta * vx, 0)) END AS sigma, CASE WHEN n >= 30 THEN 1 ELSE 0 END AS fitted
FROM (SELECT *, CASE WHEN n >= 30 THEN coalesce(c / nullif(vx, 0), 0) ELSE 0 END AS beta FROM (
 SELECT *, CASE WHEN p > 50 THEN count(r) OVER e ELSE count(r) OVER a END AS n, CASE WHEN p > 50 THEN avg(r) OVER e ELSE avg(r) OVER a END AS y,
   CASE WHEN p > 50 THEN avg(m) OVER e ELSE avg(m) OVER a END AS x, CASE WHEN p > 50 THEN var_samp(r) OVER e ELSE var_samp(r) OVER a END AS vy,
   CASE WHEN p > 50 THEN var_samp(m) OVER e ELSE var_samp(m) OVER a END AS vx,
   CASE WHEN p > 50 THEN covar_samp(r, m) OVER e ELSE covar_samp(r, m) OVER a END AS c,
   avg(r) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS mean60
 FROM ev_returns WINDOW e AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 250 PRECEDING AND 21 PRECEDING),
   a AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""")
add_view("event_windows", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in ev.WINDOWS.items()) + ") t(win, lo, hi)")
add_view("bar_windows", """
SELECT *, car / nullif(CASE WHEN sigma > 0 THEN sigma ELSE spread END * sqrt(n), 0) AS scar FROM (
 SELECT *, raw - expected AS car FROM (
  SELECT f.symbol, f.sector, f.session, e.win AS "window", f.alpha, f.beta, f.sigma, count(*) AS n, sum(x.r) AS raw,
         stddev_samp(x.r) AS spread, f.alpha * count(*) + f.beta * sum(x.m) AS expected
  FROM model_fit f JOIN event_windows e ON true JOIN ev_returns x ON x.symbol = f.symbol AND x.p BETWEEN f.p + e.lo AND f.p + e.hi
  GROUP BY f.symbol, f.sector, f.session, e.win, f.alpha, f.beta, f.sigma, e.lo, e.hi HAVING count(*) = e.hi - e.lo + 1))""")
add_view("anchors", """
SELECT e.symbol, e.event_date, b.session FROM (SELECT DISTINCT b.symbol, s.event_date FROM (SELECT DISTINCT symbol FROM bars) b, samples s) e
ASOF JOIN ev_returns b ON e.symbol = b.symbol AND e.event_date <= b.session""")
add_view("noisy", """
SELECT s.event_date, CASE WHEN count(p.name) > 0 THEN 1 ELSE 0 END AS excluded FROM (SELECT DISTINCT event_date FROM samples) s
LEFT JOIN noise_periods p ON p.start_day <= s.event_date + 10 AND p.end_day >= s.event_date - 10 GROUP BY 1""")
add_view("detail", """
SELECT s.sample_id, s.category, s.theme, s.importance, z.excluded, w.* FROM samples s JOIN anchors a USING (event_date)
JOIN noisy z USING (event_date) JOIN bar_windows w ON w.symbol = a.symbol AND w.session = a.session""")


def window_table(spark, d):
    """Market model and event windows of every bar, a stage table."""
    return stage(spark, d, "event_windows", views.BAR_TABLES,
                 lambda s, f: ev.window_arrays(ev.market_model(ev.aligned_returns(views.features(s, f)))))


def study(spark, d, by=("category",), samples=None, window=None):
    """Cells joined to their windows: one row per symbol, anchor, window and group, weight k. The
    windows travel through the join as one array and unfold behind it."""
    arrays = window_table(spark, d)
    cells = ev.event_cells(views.samples(spark, d) if samples is None else samples, arrays.select("symbol", "session"), list(by))
    if window:
        arrays = arrays.withColumn("v", F.filter("v", lambda x: x["window"].isin(window)))
    return ev.unfold(cells.join(arrays, ["symbol", "session"]))


@query("a01_market_model", "symbol:s session:d alpha:8 beta:6 sigma:8 fitted:i", "SELECT * FROM model_fit", "A01")
def _(spark, d):
    return ev.market_model(ev.aligned_returns(views.features(spark, d)))


@query("a02_event_car", "symbol:s session:d window:s n:i raw:8 expected:8 car:8 scar:5",
       "SELECT * FROM bar_windows", "A02 J13")
def _(spark, d):
    return ev.unfold(window_table(spark, d))


@query("j13_event_windows", "sample_id:i category:s window:s anchor:d raw:8",
       """SELECT s.sample_id, s.category, w.win AS "window", a.session AS anchor, sum(x.r) AS raw FROM samples s
          ASOF JOIN (SELECT * FROM (SELECT session, idx / lag(idx) OVER (ORDER BY session) - 1 AS r, pos FROM market) WHERE r IS NOT NULL) a ON s.event_date <= a.session
          JOIN event_windows w ON true JOIN (SELECT * FROM (SELECT pos, idx / lag(idx) OVER (ORDER BY session) - 1 AS r FROM market) WHERE r IS NOT NULL) x ON x.pos BETWEEN a.pos + w.lo AND a.pos + w.hi
          GROUP BY s.sample_id, s.category, w.win, a.session, w.lo, w.hi HAVING count(*) = w.hi - w.lo + 1""", "J13 J04")
def _(spark, d):
    m = views.market(spark, d).withColumn("symbol", F.lit("index"))
    m = m.select("symbol", "session", pct_change("idx", 1).alias("r")).filter("r IS NOT NULL")
    w = by_symbol()
    wide = m.select("symbol", "session", F.array(*[F.struct(
        F.lit(k).alias("window"), F.when(F.count("r").over(w.rowsBetween(a, b)) == b - a + 1, F.sum("r").over(w.rowsBetween(a, b))).alias("raw"))
        for k, (a, b) in ev.WINDOWS.items()]).alias("v"))
    from tideline.operators.asof import forward_map
    first = views.samples(spark, d).agg(F.min("event_date")).scalar()
    at = forward_map(wide, carry=("v",), first_day=first).select(F.col("date").alias("event_date"), "anchor", "v")
    return (views.samples(spark, d).join(at, "event_date")
            .select("sample_id", "category", "anchor", F.inline("v")).filter("raw IS NOT NULL"))


SUMMARY = "n:i mean:8 median:8 win_rate:6 std:8 skew:4 t_stat:5 patell_z:5 bmp_t:5 economic:i"
SUMMARY_SQL = """count(car) AS n, avg(car) AS mean, quantile_cont(car, 0.5) AS median, avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
 coalesce(stddev_samp(car), 0) AS std, CASE WHEN count(car) > 2 THEN skewness(car) END AS skew, avg(car) / nullif(stddev_samp(car) / sqrt(count(car)), 0) AS t_stat,
 sum(scar) / sqrt(count(scar)) AS patell_z, avg(scar) / nullif(stddev_samp(scar) / sqrt(count(scar)), 0) AS bmp_t, CASE WHEN abs(avg(car)) >= 0.005 THEN 1 ELSE 0 END AS economic"""


@query("a03_car_summary", "category:s symbol:s window:s " + SUMMARY,
       f'SELECT category, symbol, "window", {SUMMARY_SQL} FROM detail GROUP BY 1, 2, 3', "A03")
def _(spark, d):
    return ev.weighted_summary(study(spark, d), ["category", "symbol", "window"])


add_view("tested", f"""
SELECT *, 2.0::DOUBLE * {t_tail_sql('abs(t_stat)', 'greatest(n - 1, 1)')} AS p_value FROM (SELECT category, symbol, "window", {SUMMARY_SQL} FROM detail GROUP BY 1, 2, 3)""")


@query("a04_holm_adjust", "category:s window:s symbol:s p_value:5 p_value_holm:5 quality:s",
       """SELECT *, max(step) OVER (PARTITION BY category, "window" ORDER BY p_value, symbol ROWS UNBOUNDED PRECEDING) AS p_value_holm,
            CASE WHEN n <= 0 THEN 'BLACK' WHEN n < 10 THEN 'RED' WHEN n < 30 THEN 'YELLOW' WHEN p_value < 0.05 THEN 'GREEN' ELSE 'YELLOW' END AS quality
          FROM (SELECT *, least(1.0, (count(p_value) OVER (PARTITION BY category, "window") - row_number() OVER (PARTITION BY category, "window" ORDER BY p_value, symbol) + 1) * p_value) AS step FROM tested WHERE p_value IS NOT NULL)""", "A04 P23 F19")
def _(spark, d):
    s = ev.weighted_summary(study(spark, d), ["category", "symbol", "window"])
    return ev.holm(s, ["category", "window"]).withColumn("quality", ev.quality(F.col("n"), F.col("p_value")))


@query("a05_cross_asset", "category:s symbol:s n:i mean:8 corr_delta_mean:6",
       """WITH c AS (SELECT symbol, session, CASE WHEN count(*) OVER pre >= 10 AND count(*) OVER post >= 10 THEN corr(r, m) OVER post - corr(r, m) OVER pre END AS delta
            FROM ev_returns WINDOW pre AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
              post AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
          SELECT d.category, d.symbol, count(*) AS n, avg(d.raw) AS mean, avg(c.delta) AS corr_delta_mean
          FROM detail d JOIN c ON c.symbol = d.symbol AND c.session = d.session WHERE d."window" = 'post_1_5' GROUP BY 1, 2""", "A05")
def _(spark, d):
    f = views.features(spark, d)
    ret = ev.aligned_returns(f)
    w = by_symbol()
    pre, post = w.rowsBetween(-20, -1), w.rowsBetween(1, 20)
    delta = F.when((F.count("r").over(pre) >= 10) & (F.count("r").over(post) >= 10), F.corr("r", "m").over(post) - F.corr("r", "m").over(pre))
    c = ret.select("symbol", "session", delta.alias("delta"))
    j = study(spark, d, window=["post_1_5"]).join(c, ["symbol", "session"])
    k = F.col("k")
    return j.groupBy("category", "symbol").agg(
        F.sum("k").alias("n"), (F.sum(k * F.col("raw")) / F.sum("k")).alias("mean"),
        sdiv(F.sum(k * F.col("delta")), F.sum(F.when(F.col("delta").isNotNull(), k))).alias("corr_delta_mean"))


@query("a06_sector_rotation", "category:s sector:s n:i mean:8 excess_mean:8 excess_median:8",
       """SELECT d.category, d.sector, count(*) AS n, avg(raw) AS mean, avg(raw - bench) AS excess_mean, quantile_cont(raw - bench, 0.5) AS excess_median
          FROM detail d JOIN (SELECT symbol, session, sum(m) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS bench FROM ev_returns) b
            ON b.symbol = d.symbol AND b.session = d.session WHERE "window" = 'post_1_5' GROUP BY 1, 2""", "A06")
def _(spark, d):
    s = study(spark, d, window=["post_1_5"]).withColumn("excess", F.col("raw") - F.col("bench"))
    k = F.col("k")
    return s.groupBy("category", "sector").agg(
        F.sum("k").alias("n"), (F.sum(k * F.col("raw")) / F.sum("k")).alias("mean"),
        (F.sum(k * F.col("excess")) / F.sum("k")).alias("excess_mean"), F.percentile("excess", 0.5, k).alias("excess_median"))


@query("a07_signal_matrix", "category:s subset:s symbol:s window:s metric:s value:6",
       """WITH s AS (SELECT *, 'full' AS subset FROM detail UNION ALL SELECT *, 'clean' FROM detail WHERE excluded = 0 UNION ALL SELECT *, 'important' FROM detail WHERE importance <= 2),
          w AS (SELECT category, subset, symbol, "window", CAST(count(*) AS DOUBLE) AS n, avg(raw) AS mean, avg(CASE WHEN raw > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate FROM s GROUP BY 1, 2, 3, 4)
          SELECT * FROM (UNPIVOT w ON n, mean, win_rate INTO NAME metric VALUE value)""", "A07")
def _(spark, d):
    s = views.samples(spark, d).join(noisy_days(spark, d).select("event_date", F.col("noise_reason").isNotNull().alias("noisy")), "event_date")
    subset = F.explode(F.array_compact(F.array(F.lit("full"), F.when(~F.col("noisy"), "clean"), F.when(F.col("importance") <= 2, "important"))))
    s = s.select("event_date", "category", subset.alias("subset"))
    j = study(spark, d, ("category", "subset"), s)
    k = F.col("k")
    w = j.groupBy("category", "subset", "symbol", "window").agg(
        F.sum("k").cast("double").alias("n"), (F.sum(k * F.col("raw")) / F.sum("k")).alias("mean"),
        (F.sum(F.when(F.col("raw") > 0, k).otherwise(0)) / F.sum("k")).alias("win_rate"))
    return w.unpivot(["category", "subset", "symbol", "window"], ["n", "mean", "win_rate"], "metric", "value")


@query("a08_correlation_shift", "sector:s asset_a:s asset_b:s n:i corr_delta_mean:6",
       """WITH r AS (SELECT f.sector, f.symbol, f.pos, f.ret1 AS r FROM features f WHERE ret1 IS NOT NULL),
          pr AS (SELECT a.sector, a.symbol AS asset_a, b.symbol AS asset_b, a.pos, a.r AS ra, b.r AS rb FROM r a JOIN r b ON a.sector = b.sector AND a.pos = b.pos AND a.symbol < b.symbol),
          dn AS (SELECT s.sector, s.asset_a, s.asset_b, s.pos, p.ra, p.rb FROM (SELECT sector, asset_a, asset_b, unnest(range(min(pos), max(pos) + 1)) AS pos FROM pr GROUP BY 1, 2, 3) s
            LEFT JOIN pr p ON p.asset_a = s.asset_a AND p.asset_b = s.asset_b AND p.pos = s.pos),
          c AS (SELECT sector, asset_a, asset_b, pos, CASE WHEN count(ra) OVER a >= 20 AND count(ra) OVER b >= 10 THEN corr(ra, rb) OVER b - corr(ra, rb) OVER a END AS delta
            FROM dn WINDOW a AS (PARTITION BY asset_a, asset_b ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 21 PRECEDING), b AS (PARTITION BY asset_a, asset_b ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
          e AS (SELECT m.pos FROM samples s ASOF JOIN sessions m ON s.event_date <= m.session WHERE m.pos >= 65)
          SELECT sector, asset_a, asset_b, count(*) AS n, avg(delta) AS corr_delta_mean FROM e JOIN c USING (pos) WHERE delta IS NOT NULL GROUP BY 1, 2, 3""", "A08")
def _(spark, d):
    # Pairs live inside one sector of the asset dimension (a fixed handful), one array per session.
    f = views.features(spark, d).filter("ret1 IS NOT NULL")
    day = f.groupBy("sector", "pos").agg(F.array_sort(F.collect_list(F.struct("symbol", "ret1"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x: F.transform(
        F.filter("v", lambda y: y["symbol"] > x["symbol"]),
        lambda y: F.struct(x["symbol"].alias("asset_a"), y["symbol"].alias("asset_b"), x["ret1"].alias("ra"), y["ret1"].alias("rb")))))
    pr = day.select("sector", "pos", F.inline(pairs))
    key = ["sector", "asset_a", "asset_b"]
    grid = pr.groupBy(*key).agg(F.explode(F.sequence(F.min("pos"), F.max("pos"))).alias("pos"))
    dense = grid.join(pr, [*key, "pos"], "left")
    w = Window.partitionBy(*key).orderBy("pos")
    a, b = w.rowsBetween(-60, -21), w.rowsBetween(1, 20)
    c = dense.select(*key, "pos", F.when((F.count("ra").over(a) >= 20) & (F.count("ra").over(b) >= 10),
                                         F.corr("ra", "rb").over(b) - F.corr("ra", "rb").over(a)).alias("delta"))
    days = views.samples(spark, d).groupBy("event_date").agg(F.count("*").alias("k"))
    at = asof_join(days, views.sessions(spark, d), "event_date", "session", ["session", "pos"], forward=True)
    k = at.filter("pos >= 65").groupBy("pos").agg(F.sum("k").alias("k"))
    j = c.filter("delta IS NOT NULL").join(k, "pos")
    return j.groupBy(*key).agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("delta")) / F.sum("k")).alias("corr_delta_mean"))


@query("a08_first_component_share", "sector:s month:d n:i pc1_share:6", None, "A08")
def _(spark, d):
    import numpy as np
    import pandas as pd

    f = views.features(spark, d).filter("ret1 IS NOT NULL").select(
        "sector", F.trunc("session", "month").alias("month"), "symbol", "session", "ret1")

    def share(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="session", columns="symbol", values="ret1").dropna()
        value = None
        if wide.shape[0] >= 5 and wide.shape[1] >= 2:
            spread = wide.std(ddof=1)
            x = ((wide - wide.mean()) / spread.where(spread > 0)).dropna(axis=1)
            if x.shape[1] >= 2:
                vals = np.linalg.eigvalsh(np.cov(x.to_numpy(), rowvar=False))
                value = float(vals[-1] / vals.sum())
        return pd.DataFrame({"sector": [key[0]], "month": [key[1]], "n": [len(wide)], "pc1_share": [value]})

    # A group is one sector and one month: at most 31 sessions times the sector's symbols.
    return f.groupBy("sector", "month").applyInPandas(share, "sector string, month date, n long, pc1_share double")


@query("a09_channel_scores", "category:s channel:s score:8 evidence:i quality:s",
       """SELECT category, sector AS channel, avg(abs(mean)) AS score, count(*) AS evidence, CASE WHEN count(*) >= 3 THEN 'GREEN' ELSE 'YELLOW' END AS quality
          FROM (SELECT category, sector, symbol, avg(raw) AS mean FROM detail WHERE "window" = 'post_1_5' GROUP BY 1, 2, 3) GROUP BY 1, 2""", "A09")
def _(spark, d):
    k = F.col("k")
    s = study(spark, d, window=["post_1_5"]).groupBy("category", "sector", "symbol").agg(
        (F.sum(k * F.col("raw")) / F.sum("k")).alias("mean"))
    return s.groupBy("category", F.col("sector").alias("channel")).agg(
        F.avg(F.abs("mean")).alias("score"), F.count("*").alias("evidence"),
        F.when(F.count("*") >= 3, "GREEN").otherwise("YELLOW").alias("quality"))


add_view("drift_pairs", """
SELECT a.sample_id, a.category, a.symbol, a.raw AS x, b.car AS y FROM detail a JOIN detail b
  ON a.sample_id = b.sample_id AND a.symbol = b.symbol WHERE a."window" = 'pre_5' AND b."window" = 'post_1_5'""")


def drift_pairs(spark, d):
    """Pre-event return beside post-event abnormal return of the same anchor, weight k."""
    s = study(spark, d, window=["pre_5", "post_1_5"])
    g = s.groupBy("symbol", "session", "category", "k").agg(
        F.max(F.when(F.col("window") == "pre_5", F.col("raw"))).alias("x"), F.max(F.when(F.col("window") == "post_1_5", F.col("car"))).alias("y"))
    return g.filter("x IS NOT NULL AND y IS NOT NULL")


@query("j15_drift_car_merge", "category:s symbol:s n:i mean_x:8 mean_y:8 cross:10",
       "SELECT category, symbol, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, avg(x * y) AS cross FROM drift_pairs GROUP BY 1, 2", "J15")
def _(spark, d):
    k = F.col("k")
    return drift_pairs(spark, d).groupBy("category", "symbol").agg(
        F.sum("k").alias("n"), (F.sum(k * F.col("x")) / F.sum("k")).alias("mean_x"), (F.sum(k * F.col("y")) / F.sum("k")).alias("mean_y"),
        (F.sum(k * F.col("x") * F.col("y")) / F.sum("k")).alias("cross"))


add_view("posterior", f"""
WITH cur AS (SELECT symbol, arg_max(ret5, session) AS now FROM features GROUP BY 1),
 pri AS (SELECT category, symbol, count(*) AS n, avg(y) AS prior_mean, stddev_samp(y) AS prior_sd, greatest(stddev_samp(x) * 0.75, 1e-6) AS bw FROM drift_pairs GROUP BY 1, 2),
 wt AS (SELECT p.*, q.n, q.prior_mean, q.prior_sd, c.now, exp(-0.5 * pow((p.x - c.now) / q.bw, 2)) AS w FROM drift_pairs p JOIN pri q USING (category, symbol) JOIN cur c USING (symbol)),
 mom AS (SELECT category, symbol, any_value(n) AS n, any_value(prior_mean) AS prior_mean, any_value(prior_sd) AS prior_sd, any_value(now) AS current_drift,
    sum(w * y) / sum(w) AS posterior_mean, sqrt(greatest(sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2), 0)) AS posterior_sd, ceil(pow(sum(w), 2) / sum(w * w) - 1e-9) AS effective_n FROM wt GROUP BY 1, 2)
SELECT *, 1.0::DOUBLE - {cdf_sql('(0 - posterior_mean) / posterior_sd')} AS p_up, 1.0::DOUBLE - {cdf_sql('(0.01 - posterior_mean) / posterior_sd')} AS p_gt_1pct,
 {cdf_sql('(-0.01 - posterior_mean) / posterior_sd')} AS p_lt_minus_1pct,
 ln(posterior_sd / prior_sd) + (prior_sd * prior_sd + pow(prior_mean - posterior_mean, 2)) / (2 * posterior_sd * posterior_sd) - 0.5 AS kl FROM mom""")


def posterior(spark, d):
    """Kernel-conditioned posterior of the post-event abnormal return given today's drift."""
    p = drift_pairs(spark, d)
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    cur = views.features(spark, d).groupBy("symbol").agg(F.max_by("ret5", "session").alias("current_drift"))
    g = p.groupBy("category", "symbol").agg(
        F.sum("k").alias("n"), F.sum(k * y).alias("sy"), F.sum(k * y * y).alias("syy"), F.sum(k * x).alias("sx"), F.sum(k * x * x).alias("sxx"))
    n = F.col("n").cast("double")

    def sd(s, ss):
        return F.sqrt(F.greatest(F.col(ss) - F.col(s) * F.col(s) / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0)))

    g = g.select("category", "symbol", "n", (F.col("sy") / n).alias("prior_mean"), sd("sy", "syy").alias("prior_sd"),
                 F.greatest(sd("sx", "sxx") * 0.75, F.lit(1e-6)).alias("bw")).join(cur, "symbol")
    wt = p.join(g, ["category", "symbol"])
    u = (x - F.col("current_drift")) / F.col("bw")
    wt = wt.withColumn("w", k * F.exp(-0.5 * u * u)).withColumn("w2", k * F.exp(-u * u))
    keep = ["category", "symbol", "n", "prior_mean", "prior_sd", "current_drift"]
    m = wt.groupBy(*keep).agg(F.sum("w").alias("sw"), F.sum("w2").alias("sw2"), F.sum(F.col("w") * y).alias("swy"), F.sum(F.col("w") * y * y).alias("swyy"))
    mean = F.col("swy") / F.col("sw")
    m = m.select(*keep, mean.alias("posterior_mean"), F.sqrt(F.greatest(F.col("swyy") / F.col("sw") - mean * mean, F.lit(0.0))).alias("posterior_sd"),
                 F.ceil(F.col("sw") * F.col("sw") / F.col("sw2") - 1e-9).alias("effective_n"))
    a, b = F.col("prior_sd"), F.col("posterior_sd")
    gap = F.col("prior_mean") - F.col("posterior_mean")
    return m.select("*", prob_above(0.0, "posterior_mean", "posterior_sd").alias("p_up"), prob_above(0.01, "posterior_mean", "posterior_sd").alias("p_gt_1pct"),
                    (F.lit(1.0) - prob_above(-0.01, "posterior_mean", "posterior_sd")).alias("p_lt_minus_1pct"),
                    (F.log(b / a) + (a * a + gap * gap) / (2 * b * b) - 0.5).alias("kl"))


@query("a10_posterior", "category:s symbol:s n:i current_drift:8 prior_mean:8 prior_sd:8 posterior_mean:8 posterior_sd:7 effective_n:i p_up:5 p_gt_1pct:5 p_lt_minus_1pct:5",
       "SELECT * FROM posterior", "A10 F18")
def _(spark, d):
    return posterior(spark, d)


@query("a11_normal_kl", "category:s symbol:s kl:6", "SELECT * FROM posterior", "A11")
def _(spark, d):
    return posterior(spark, d)


add_view("weights_raw", f"""
SELECT e.*, p.posterior_mean, t.p_min, sqrt(n_clean) * greatest(0, 1 - least(1, coalesce(t.p_min, 1))) * greatest(least(abs(coalesce(p.posterior_mean, 0)), 0.05), 1e-6) * importance
   * CASE WHEN n_clean < 10 THEN 0.3 WHEN n_clean < 30 THEN 0.6 ELSE 1.0 END AS raw0
FROM (SELECT d.symbol, d.category, count(*) FILTER (excluded = 0) AS n_clean, avg(importance) AS importance FROM detail d WHERE "window" = 'post_1_5' GROUP BY 1, 2) e
LEFT JOIN posterior p USING (symbol, category)
LEFT JOIN (SELECT symbol, category, min(p_value) AS p_min FROM tested WHERE "window" IN ('post_1_5', 'post_1_20') GROUP BY 1, 2) t USING (symbol, category)""")


@query("a12_event_weights", "symbol:s category:s n_clean:i importance:6 weight_composite:4 weight_equal:6 weight_n:6",
       """WITH r AS (SELECT *, CASE WHEN category = 'P' THEN least(raw0, 0.05) ELSE raw0 END AS raw FROM weights_raw),
          n AS (SELECT *, raw / sum(raw) OVER (PARTITION BY symbol) AS w0, 1.0::DOUBLE / count(*) OVER (PARTITION BY symbol) AS weight_equal,
            sqrt(n_clean) / sum(sqrt(n_clean)) OVER (PARTITION BY symbol) AS weight_n FROM r)
          SELECT *, CASE WHEN category = 'P' AND w0 > 0.05 THEN 0.05 ELSE w0 + CASE WHEN category <> 'P' THEN w0 / nullif(sum(CASE WHEN category <> 'P' OR w0 <= 0.05 THEN w0 END) OVER (PARTITION BY symbol), 0)
              * coalesce(sum(CASE WHEN category = 'P' AND w0 > 0.05 THEN w0 - 0.05 END) OVER (PARTITION BY symbol), 0) ELSE 0 END END AS weight_composite FROM n""", "A12 J16")
def _(spark, d):
    noisy = noisy_days(spark, d).select("event_date", F.col("noise_reason").isNotNull().cast("int").alias("excluded"))
    s = views.samples(spark, d).join(noisy, "event_date")
    st = study(spark, d, ("category", "importance", "excluded"), s, ["post_1_5"])
    e = st.groupBy("symbol", "category").agg(F.sum(F.when(F.col("excluded") == 0, F.col("k")).otherwise(0)).alias("n_clean"),
                                             (F.sum(F.col("k") * F.col("importance")) / F.sum("k")).alias("importance"))
    t = ev.weighted_summary(study(spark, d, window=["post_1_5", "post_1_20"]), ["category", "symbol", "window"])
    t = t.groupBy("symbol", "category").agg(F.min("p_value").alias("p_min"))
    j = e.join(posterior(spark, d).select("symbol", "category", "posterior_mean"), ["symbol", "category"], "left").join(t, ["symbol", "category"], "left")
    penalty = F.when(F.col("n_clean") < 10, 0.3).when(F.col("n_clean") < 30, 0.6).otherwise(1.0)
    signal = F.greatest(F.least(F.abs(F.coalesce("posterior_mean", F.lit(0.0))), F.lit(0.05)), F.lit(1e-6))
    raw = F.sqrt("n_clean") * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.coalesce("p_min", F.lit(1.0)))) * signal * F.col("importance") * penalty
    capped = F.col("category") == "P"
    j = j.withColumn("raw", F.when(capped, F.least(raw, F.lit(0.05))).otherwise(raw))
    w = Window.partitionBy("symbol")
    j = j.select("*", sdiv("raw", F.sum("raw").over(w)).alias("w0"), (F.lit(1.0) / F.count("*").over(w)).alias("weight_equal"),
                 sdiv(F.sqrt("n_clean"), F.sum(F.sqrt("n_clean")).over(w)).alias("weight_n"))
    over = capped & (F.col("w0") > 0.05)
    excess = F.coalesce(F.sum(F.when(over, F.col("w0") - 0.05)).over(w), F.lit(0.0))
    others = F.sum(F.when(~over, F.col("w0"))).over(w)
    return j.withColumn("weight_composite", F.when(over, 0.05).when(capped, F.col("w0"))
                        .otherwise(F.col("w0") + sdiv("w0", others) * excess))


@query("a13_implied_vs_realized", "symbol:s implied_move:6 hist_median:8 hist_mean:8 ratio:5 signal:s skew_agrees:s",
       """WITH stra AS (SELECT symbol, session, expiry, strike, max(mid) FILTER (cp = 'C') + max(mid) FILTER (cp = 'P') AS straddle, any_value(spot) AS spot FROM option_bars GROUP BY 1, 2, 3, 4),
          im AS (SELECT symbol, quantile_cont(m, 0.5) AS implied_move FROM (SELECT symbol, session, arg_min(straddle / spot, (abs(strike - spot), expiry, strike)) AS m FROM stra WHERE straddle IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
          sk AS (SELECT symbol, avg(iv) FILTER (cp = 'P') - avg(iv) FILTER (cp = 'C') AS option_skew FROM option_bars GROUP BY 1),
          h AS (SELECT symbol, quantile_cont(abs(raw), 0.5) AS hist_median, avg(abs(raw)) AS hist_mean FROM detail WHERE "window" = 'option_realized' GROUP BY 1),
          cs AS (SELECT symbol, skewness(car) AS car_skew FROM detail WHERE "window" = 'post_1_5' GROUP BY 1)
          SELECT symbol, implied_move, hist_median, hist_mean, hist_median / nullif(implied_move, 0) AS ratio,
            CASE WHEN hist_median / nullif(implied_move, 0) > 1.2 THEN 'underpriced' WHEN hist_median / nullif(implied_move, 0) < 0.8 THEN 'overpriced' ELSE 'fair' END AS signal,
            CASE WHEN option_skew > 0 AND car_skew < 0 THEN 'left tail agreed' WHEN option_skew > 0 AND car_skew > 0 THEN 'left tail overpaid' WHEN option_skew <= 0 AND car_skew > 0 THEN 'right tail unpriced' ELSE 'broadly consistent' END AS skew_agrees
          FROM im JOIN sk USING (symbol) JOIN h USING (symbol) JOIN cs USING (symbol)""", "A13")
def _(spark, d):
    o = views.option_bars(spark, d)
    at = o.groupBy("symbol", "session", "expiry", "strike").agg(
        (F.max(F.when(F.col("cp") == "C", F.col("mid"))) + F.max(F.when(F.col("cp") == "P", F.col("mid")))).alias("straddle"), F.first("spot").alias("spot"))
    im = at.filter("straddle IS NOT NULL").groupBy("symbol", "session").agg(
        F.min_by(F.col("straddle") / F.col("spot"), F.struct(F.abs(F.col("strike") - F.col("spot")), "expiry", "strike")).alias("m"))
    im = im.groupBy("symbol").agg(F.percentile("m", 0.5).alias("implied_move"))
    sk = o.groupBy("symbol").agg((F.avg(F.when(F.col("cp") == "P", F.col("iv"))) - F.avg(F.when(F.col("cp") == "C", F.col("iv")))).alias("option_skew"))
    st = study(spark, d, ())
    k = F.col("k")
    h = st.filter("window = 'option_realized'").groupBy("symbol").agg(
        F.percentile(F.abs("raw"), 0.5, k).alias("hist_median"), (F.sum(k * F.abs("raw")) / F.sum("k")).alias("hist_mean"))
    cs = ev.weighted_summary(st.filter("window = 'post_1_5'"), ["symbol"]).select("symbol", F.col("skew").alias("car_skew"))
    j = im.join(sk, "symbol").join(h, "symbol").join(cs, "symbol").withColumn("ratio", sdiv("hist_median", "implied_move"))
    os_, c = F.col("option_skew"), F.col("car_skew")
    return j.select("*", F.when(F.col("ratio") > 1.2, "underpriced").when(F.col("ratio") < 0.8, "overpriced").otherwise("fair").alias("signal"),
                    F.when((os_ > 0) & (c < 0), "left tail agreed").when((os_ > 0) & (c > 0), "left tail overpaid")
                    .when((os_ <= 0) & (c > 0), "right tail unpriced").otherwise("broadly consistent").alias("skew_agrees"))


@query("j20_two_leg_spread", "category:s sector:s long_leg:s short_leg:s n:i mean_spread:8 win_rate:6",
       """WITH legs AS (SELECT sector, min(symbol) AS long_leg, max(symbol) AS short_leg FROM bars GROUP BY 1)
          SELECT a.category, l.sector, l.long_leg, l.short_leg, count(*) AS n, avg(a.raw - b.raw) AS mean_spread, avg(CASE WHEN a.raw > b.raw THEN 1.0 ELSE 0.0 END) AS win_rate
          FROM legs l JOIN detail a ON a.symbol = l.long_leg JOIN detail b ON b.symbol = l.short_leg AND b.sample_id = a.sample_id
          WHERE a."window" = 'post_1_5' AND b."window" = 'post_1_5' GROUP BY 1, 2, 3, 4""", "J20")
def _(spark, d):
    f = views.features(spark, d)
    ret = ev.aligned_returns(f)
    w5 = ev.unfold(window_table(spark, d)).filter("window = 'post_1_5'").select("symbol", "session", "raw")
    legs = views.bars(spark, d).groupBy("sector").agg(F.min("symbol").alias("long_leg"), F.max("symbol").alias("short_leg"))
    from tideline.operators.asof import forward_map
    first = views.samples(spark, d).agg(F.min("event_date")).scalar()
    at = forward_map(ret, first_day=first).join(w5.withColumnRenamed("session", "anchor"), ["symbol", "anchor"]).select("symbol", F.col("date").alias("event_date"), "raw")
    lg = legs.join(at.withColumnRenamed("symbol", "long_leg").withColumnRenamed("raw", "up"), "long_leg")
    both = lg.join(at.withColumnRenamed("symbol", "short_leg").withColumnRenamed("raw", "down"), ["short_leg", "event_date"])
    days = views.samples(spark, d).groupBy("event_date", "category").agg(F.count("*").alias("k"))
    j = both.join(days, "event_date")
    return j.groupBy("category", "sector", "long_leg", "short_leg").agg(
        F.sum("k").alias("n"), (F.sum(F.col("k") * (F.col("up") - F.col("down"))) / F.sum("k")).alias("mean_spread"),
        (F.sum(F.when(F.col("up") > F.col("down"), F.col("k")).otherwise(0)) / F.sum("k")).alias("win_rate"))


@query("w32_basket_drift", "sector:s event_date:d drift:8 members:i",
       """SELECT sector, event_date, avg(ret20) AS drift, count(ret20) AS members FROM (
            SELECT e.symbol, e.sector, e.event_date, f.ret20 FROM (SELECT DISTINCT b.symbol, b.sector, s.event_date FROM (SELECT DISTINCT symbol, sector FROM bars) b, samples s) e
            ASOF JOIN features f ON e.symbol = f.symbol AND e.event_date - 1 >= f.session) GROUP BY 1, 2""", "W32")
def _(spark, d):
    f = views.features(spark, d).select("symbol", "sector", "session", "ret20")
    s = views.samples(spark, d)
    last = s.agg(F.max("event_date")).scalar()
    at = backward_map(f, last, carry=("sector", "ret20")).withColumn("event_date", F.date_add("date", 1))
    j = at.join(s.select("event_date").distinct(), "event_date", "left_semi")
    return j.groupBy("sector", "event_date").agg(F.avg("ret20").alias("drift"), F.count("ret20").alias("members"))


@query("w33_context_vector", "doc_id:i session:d ret1:8 ret3:8 ret20:8 vol5:8 vol20:8 pct_b:6 bandwidth:8 high_vol:i uptrend:i vix:6",
       """WITH m AS (SELECT *, idx / lag(idx) OVER (ORDER BY session) - 1 AS r FROM market),
          c AS (SELECT session, CAST(session AS TIMESTAMP) + INTERVAL 21 HOUR AS market_close, r AS ret1, idx / lag(idx, 3) OVER o - 1 AS ret3, idx / lag(idx, 20) OVER o - 1 AS ret20, vix,
             stddev_pop(r) OVER (ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vol5, stddev_pop(r) OVER w AS vol20,
             stddev_pop(r) OVER (ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vol60,
             least(greatest((idx - avg(idx) OVER w + 2 * stddev_pop(idx) OVER w) / nullif(4 * stddev_pop(idx) OVER w, 0), -1), 2) AS pct_b, 4 * stddev_pop(idx) OVER w / idx AS bandwidth
            FROM m WINDOW o AS (ORDER BY session), w AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
          SELECT a.doc_id, c.*, CASE WHEN vol20 > greatest(vol60 * 1.2, 0.02) THEN 1 ELSE 0 END AS high_vol, CASE WHEN ret20 > 0 AND ret3 > 0 THEN 1 ELSE 0 END AS uptrend
          FROM articles a ASOF LEFT JOIN c ON a.available_at >= c.market_close""", "W33 J06")
def _(spark, d):
    w = Window.orderBy("session")
    m = views.market(spark, d).withColumn("r", pct_change("idx", 1, w))
    mid, sd = F.avg("idx").over(trailing(20, 0, w)), F.stddev_pop("idx").over(trailing(20, 0, w))
    c = m.select((F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOUR")).alias("market_close"), "session", F.col("r").alias("ret1"),
                 pct_change("idx", 3, w).alias("ret3"), pct_change("idx", 20, w).alias("ret20"), "vix",
                 F.stddev_pop("r").over(trailing(5, 0, w)).alias("vol5"), F.stddev_pop("r").over(trailing(20, 0, w)).alias("vol20"),
                 F.stddev_pop("r").over(trailing(60, 0, w)).alias("vol60"),
                 clip(sdiv(F.col("idx") - mid + 2 * sd, 4 * sd), -1.0, 2.0).alias("pct_b"), (4 * sd / F.col("idx")).alias("bandwidth"))
    c = c.withColumn("high_vol", flag(F.col("vol20") > F.greatest(F.col("vol60") * 1.2, F.lit(0.02)))).withColumn(
        "uptrend", flag((F.col("ret20") > 0) & (F.col("ret3") > 0)))
    j = asof_join(views.articles(spark, d).select("doc_id", "available_at"), c, "available_at", "market_close",
                  ["market_close", "session", "ret1", "ret3", "ret20", "vix", "vol5", "vol20", "pct_b", "bandwidth", "high_vol", "uptrend"])
    return j.withColumn("high_vol", F.coalesce("high_vol", F.lit(0))).withColumn("uptrend", F.coalesce("uptrend", F.lit(0)))


@query("a49_environment_distance", "event_date:d n:i distance:6 matched:i",
       """WITH h AS (SELECT session, vix, tnx, idx / lag(idx, 5) OVER (ORDER BY session) - 1 AS ret5 FROM market),
          s AS (SELECT avg(vix) mv, stddev_samp(vix) sv, avg(tnx) mt, stddev_samp(tnx) st, avg(ret5) mr, stddev_samp(ret5) sr, arg_max(vix, session) cv, arg_max(tnx, session) ct, arg_max(ret5, session) cr FROM h),
          e AS (SELECT s.sample_id, s.event_date, h.* FROM samples s ASOF JOIN h ON s.event_date - 1 >= h.session),
          x AS (SELECT e.*, sqrt((pow((vix - cv) / sv, 2) + pow((tnx - ct) / st, 2) + pow((ret5 - cr) / sr, 2)) / 3) AS distance FROM e, s),
          k AS (SELECT *, row_number() OVER (ORDER BY distance) AS rk, count(distance) OVER () AS nv FROM x WHERE distance IS NOT NULL),
          c AS (SELECT max(distance) AS cut FROM k WHERE rk <= ceil(nv * 0.5))
          SELECT event_date, count(*) AS n, any_value(distance) AS distance, max(CASE WHEN distance <= cut THEN 1 ELSE 0 END) AS matched FROM x, c WHERE distance IS NOT NULL GROUP BY 1""", "A49 L05 J08")
def _(spark, d):
    w = Window.orderBy("session")
    h = views.market(spark, d).select("session", "vix", "tnx", pct_change("idx", 5, w).alias("ret5"))
    dims = ["vix", "tnx", "ret5"]
    # The history is one row per session; its statistics ride along as constants of one partition.
    allr = Window.partitionBy(F.lit(1))
    zs = h.select("session", *[((F.col(c) - F.max_by(c, "session").over(allr)) / F.stddev_samp(c).over(allr)).alias(c) for c in dims])
    zs = zs.withColumn("distance", F.sqrt(sum((F.col(c) * F.col(c) for c in dims), F.lit(0.0)) / 3)).select("session", "distance")
    days = views.samples(spark, d).groupBy("event_date").agg(F.count("*").alias("n")).withColumn("limit_day", F.date_sub("event_date", 1))
    x = asof_join(days, zs, "limit_day", "session", ["session", "distance"]).filter("distance IS NOT NULL")
    # Cumulative sample counts over distinct dates find the cut-off of the nearest half.
    run = Window.partitionBy(F.lit(1)).orderBy("distance", "event_date").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("keep", F.ceil(F.sum("n").over(allr) * 0.5))
    cut = F.max(F.when(F.col("before") < F.col("keep"), F.col("distance"))).over(allr)
    return x.withColumn("matched", (F.col("distance") <= cut).cast("int"))
