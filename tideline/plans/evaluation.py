"""Performance, calibration, bootstrap and selection queries."""

import math

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import clip, flag, sdiv, student_t_tail, truth
from tideline.operators import evaluate as evl, returns as rt, rules as rl
from tideline.operators.ranking import group_quantile, rank_all
from tideline.operators.rolling import by_symbol, ewm_means, gated, pct_change, trailing
from tideline.plans import signals as sg
from tideline.plans.catalog import query
from tideline.plans.events import t_tail_sql
from tideline.plans.sqlviews import add_view, gated as sgated
from tideline.sources import views
from tideline.sources.stages import stage


def perf_sql(src: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY session ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT *, annualized_return / nullif(abs(max_drawdown), 0) AS calmar_ratio FROM (
  SELECT {keys}, count(net) AS days, exp(sum(ln(1 + net))) - 1 AS total_return, exp(sum(ln(1 + net)) * 252.0 / count(net)) - 1 AS annualized_return,
    coalesce(sqrt(252) * avg(net) / CASE WHEN stddev_pop(net) > 1e-12 THEN stddev_pop(net) END, 0) AS sharpe_ratio,
    coalesce(sqrt(252) * avg(net) / CASE WHEN stddev_pop(net) FILTER (net < 0) > 1e-12 THEN stddev_pop(net) FILTER (net < 0) END, 0) AS sortino_ratio,
    min(dd) AS max_drawdown, sqrt(avg(pow(dd * 100, 2))) AS ulcer_index
  FROM (SELECT *, exp(lg - greatest(max(lg) OVER {w}, 0)) - 1 AS dd FROM (SELECT *, sum(ln(1 + net)) OVER {w} AS lg FROM {src})) GROUP BY {keys})"""


def trades_sql(src: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY session"
    on = " AND ".join(f"1 = 1" for _ in [0])
    return f"""SELECT {keys}, count(*) AS num_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
    coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor,
    coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss
  FROM (SELECT {keys}, trade, exp(sum(ln(1 + net))) - 1 AS pnl
    FROM (SELECT *, sum(CASE WHEN held > 0 AND before <= 0 THEN 1 ELSE 0 END) OVER {w} ROWS UNBOUNDED PRECEDING) AS trade
      FROM (SELECT *, coalesce(lag(held) OVER {w}), 0) AS before FROM {src}))
    WHERE trade > 0 AND (held > 0 OR before > 0) GROUP BY {keys}, trade) GROUP BY {keys}"""


add_view("performance", perf_sql("net_returns", "strategy, symbol"))
add_view("trade_stats", trades_sql("net_returns", "strategy, symbol"))

PERF = "days:i total_return:4 annualized_return:5 sharpe_ratio:6 sortino_ratio:6 max_drawdown:7 calmar_ratio:4 ulcer_index:5"


@query("a19_performance", "strategy:s symbol:s " + PERF + " num_trades:i win_rate:6 profit_factor:5 avg_win:7 avg_loss:7",
       """SELECT p.*, coalesce(t.num_trades, 0) AS num_trades, coalesce(t.win_rate, 0) AS win_rate, t.profit_factor, t.avg_win, t.avg_loss
          FROM performance p LEFT JOIN trade_stats t USING (strategy, symbol)""", "A19 W20 W21")
def _(spark, d):
    return rt.full_performance(views.net_returns(spark, d), ["strategy", "symbol"])


@query("j21_benchmark_compare", "name:s symbol:s total_return:4 sharpe_ratio:6 max_drawdown:7",
       f"""WITH b AS (SELECT symbol, session, idx / lag(idx) OVER (PARTITION BY symbol ORDER BY session) - 1 AS net FROM panel),
          bp AS ({perf_sql('(SELECT symbol, session, coalesce(net, 0) AS net FROM b)', 'symbol')})
          SELECT strategy AS name, symbol, total_return, sharpe_ratio, max_drawdown FROM performance UNION ALL SELECT 'index', symbol, total_return, sharpe_ratio, max_drawdown FROM bp""", "J21 U01")
def _(spark, d):
    own = rt.performance(views.net_returns(spark, d), ["strategy", "symbol"]).withColumnRenamed("strategy", "name")
    b = views.panel(spark, d).select("symbol", "session", F.coalesce(pct_change("idx", 1), F.lit(0.0)).alias("net"))
    bench = rt.performance(b, ["symbol"]).withColumn("name", F.lit("index"))
    return own.unionByName(bench, allowMissingColumns=True)


@query("a14_reliability", "mapping:s bin:i n:i predicted:6 observed:6 error:6",
       """SELECT mapping, bin, count(*) AS n, avg(p) AS predicted, avg(target_direction) AS observed, avg(p) - avg(target_direction) AS error FROM (
            SELECT *, greatest(CAST(ceil(p / 0.1 - 1e-9) AS INT), 1) AS bin FROM (SELECT 'raw' AS mapping, prob_up AS p, target_direction FROM signals UNION ALL SELECT 'shrink', 0.5 * prob_up + 0.25, target_direction FROM signals)
            WHERE target_direction IS NOT NULL) GROUP BY 1, 2""", "A14")
def _(spark, d):
    s = views.signals(spark, d).filter("target_direction IS NOT NULL").select("target_direction", F.inline(F.array(
        F.struct(F.lit("raw").alias("mapping"), F.col("prob_up").alias("p")), F.struct(F.lit("shrink").alias("mapping"), (F.col("prob_up") * 0.5 + 0.25).alias("p")))))
    return s.withColumn("bin", evl.right_closed_bin("p", 0.0, 0.1, 10)).groupBy("mapping", "bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("target_direction").alias("observed"), (F.avg("p") - F.avg("target_direction")).alias("error"))


@query("a14_active_calibration", "symbol:s samples:i brier:6 calibration_error:6 mean_abs_bin_error:6 max_abs_bin_error:6",
       """WITH a AS (SELECT symbol, least(greatest(prob_up, 0.01), 0.99) AS p, target_direction AS y FROM signals WHERE position > 0 AND target_direction IS NOT NULL),
          b AS (SELECT symbol, greatest(CAST(ceil((p - 0.5) / 0.08 - 1e-9) AS INT), 1) AS bin, abs(avg(p) - avg(y)) AS e FROM a WHERE p >= 0.5 AND p <= 0.9 GROUP BY 1, 2)
          SELECT a.symbol, count(*) AS samples, avg(pow(p - y, 2)) AS brier, avg(p) - avg(y) AS calibration_error, any_value(m) AS mean_abs_bin_error, any_value(x) AS max_abs_bin_error
          FROM a LEFT JOIN (SELECT symbol, avg(e) AS m, max(e) AS x FROM b GROUP BY 1) USING (symbol) GROUP BY 1""", "A14")
def _(spark, d):
    a = views.signals(spark, d).filter("position > 0 AND target_direction IS NOT NULL").select(
        "symbol", clip("prob_up", 0.01, 0.99).alias("p"), F.col("target_direction").alias("y"))
    a = a.withColumn("bin", evl.right_closed_bin("p", 0.5, 0.08, 5))
    g = a.groupBy("symbol", "bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"))
    err = F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sy")) / F.col("n"))
    return g.groupBy("symbol").agg(F.sum("n").alias("samples"), (F.sum("sq") / F.sum("n")).alias("brier"), ((F.sum("sp") - F.sum("sy")) / F.sum("n")).alias("calibration_error"),
                                   F.avg(err).alias("mean_abs_bin_error"), F.max(err).alias("max_abs_bin_error"))


@query("a15_probability_scores", "symbol:s n:i brier:6 log_loss:6 active_n:i active_brier:6",
       """SELECT symbol, count(*) AS n, avg(pow(prob_up - target_direction, 2)) AS brier, avg(-(target_direction * ln(least(greatest(prob_up, 0.001), 0.999)) + (1 - target_direction) * ln(1 - least(greatest(prob_up, 0.001), 0.999)))) AS log_loss,
            count(*) FILTER (prob_up >= 0.55) AS active_n, avg(pow(prob_up - target_direction, 2)) FILTER (prob_up >= 0.55) AS active_brier
          FROM signals WHERE target_direction IS NOT NULL GROUP BY 1""", "A15")
def _(spark, d):
    s = views.signals(spark, d).filter("target_direction IS NOT NULL")
    p, y = clip("prob_up", 0.001, 0.999), F.col("target_direction")
    sq, on = F.pow(F.col("prob_up") - y, 2), F.col("prob_up") >= 0.55
    return s.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(sq).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
                                   F.sum(on.cast("int")).alias("active_n"), F.avg(F.when(on, sq)).alias("active_brier"))


def directional_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, sum(active) AS dir_active_days, sum(active) * 1.0 / sum(n) AS coverage, coalesce(sum(up) * 1.0 / nullif(sum(active), 0), 0) AS dir_precision,
  coalesce(sum(ret) / nullif(sum(active), 0), 0) AS avg_next_return, coalesce(stddev_pop(up * 1.0 / nullif(active, 0)), 0) AS year_std, coalesce(min(up * 1.0 / nullif(active, 0)), 0) AS worst_year,
  coalesce(string_agg(yr || '=' || up, ',' ORDER BY yr) FILTER (active > 0), '') AS year_hits
  FROM (SELECT {keys}, year(session) AS yr, count(*) AS n, count(*) FILTER (position > 0) AS active, count(*) FILTER (position > 0 AND target_return > 0) AS up, sum(target_return) FILTER (position > 0) AS ret
        FROM {src} WHERE target_return IS NOT NULL GROUP BY {keys}, yr) GROUP BY {keys}"""


@query("a16_directional", "symbol:s dir_active_days:i coverage:6 dir_precision:6 avg_next_return:8 year_std:6 worst_year:6 year_hits:s", directional_sql("signals", "symbol"), "A16 F16")
def _(spark, d):
    return evl.directional(views.signals(spark, d), ["symbol"])


@query("a17_regime_report", "regime:s regime_days:i active_days:i precision:6 avg_next:8 median_next:8 avg_prob:6",
       """SELECT regime, count(*) AS regime_days, count(*) FILTER (a) AS active_days, avg(CASE WHEN target_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (a) AS precision, coalesce(avg(target_return) FILTER (a), 0) AS avg_next,
            coalesce(quantile_cont(target_return, 0.5) FILTER (a), 0) AS median_next, avg(prob_up) FILTER (a) AS avg_prob FROM (SELECT *, position > 0 AND target_return IS NOT NULL AS a FROM regimes) GROUP BY 1""", "A17")
def _(spark, d):
    r = sg.regimes(spark, d)
    a = (F.col("position") > 0) & F.col("target_return").isNotNull()
    g = r.groupBy("regime").agg(
        F.count("*").alias("regime_days"), F.sum(a.cast("int")).alias("active_days"), F.avg(F.when(a, (F.col("target_return") > 0).cast("int"))).alias("precision"),
        F.coalesce(F.avg(F.when(a, F.col("target_return"))), F.lit(0.0)).alias("avg_next"), F.avg(F.when(a, F.col("prob_up"))).alias("avg_prob"))
    median = group_quantile(r.filter(a), ["regime"], "target_return", 0.5, "median")
    return g.join(median, "regime", "left").withColumn("median_next", F.coalesce("median", F.lit(0.0)))


@query("a20_monthly_returns", "strategy:s symbol:s year:i " + " ".join(f"m{k}:6" for k in range(1, 13)),
       "SELECT strategy, symbol, year(session) AS year, " + ", ".join(f"exp(sum(ln(1 + net)) FILTER (month(session) = {k})) - 1 AS m{k}" for k in range(1, 13)) + " FROM net_returns GROUP BY 1, 2, 3", "A20")
def _(spark, d):
    n = views.net_returns(spark, d).select("strategy", "symbol", F.year("session").alias("year"), F.month("session").alias("m"), F.log1p("net").alias("l"))
    p = n.groupBy("strategy", "symbol", "year").pivot("m", list(range(1, 13))).agg(F.exp(F.sum("l")) - 1)
    return p.select("strategy", "symbol", "year", *[F.col(str(k)).alias(f"m{k}") for k in range(1, 13)])


add_view("slices", """
SELECT r.*, s.slice FROM (SELECT *, row_number() OVER (PARTITION BY strategy, symbol ORDER BY session) - 1 AS i, max(session) OVER (PARTITION BY strategy, symbol) AS last_day FROM net_returns) r,
LATERAL (SELECT unnest(['Y' || year(r.session), 'Q' || year(r.session) || '-' || quarter(r.session)]
  || list_transform(list_filter([30, 45, 60, 90, 126], lambda n: r.session >= r.last_day - CAST(n AS INT)), lambda n: 'T' || n)
  || list_transform(range(CASE WHEN r.i < 63 THEN 0 ELSE (r.i - 63) // 21 + 1 END, r.i // 21 + 1), lambda k: 'W' || k)) AS slice) s""")


@query("a21_period_slices", "strategy:s symbol:s slice:s days:i total_return:5 sharpe_ratio:5 max_drawdown:7", perf_sql("slices", "strategy, symbol, slice"), "A21")
def _(spark, d):
    w = Window.partitionBy("strategy", "symbol")
    r = views.net_returns(spark, d).withColumn("i", F.row_number().over(w.orderBy("session")) - 1).withColumn("last_day", F.max("session").over(w))
    # Every row knows its slices: year, quarter, trailing spans and three overlapping 63-row windows.
    named = [F.concat(F.lit("Y"), F.year("session")), F.concat(F.lit("Q"), F.year("session"), F.lit("-"), F.quarter("session"))]
    named += [F.when(F.col("session") >= F.date_sub("last_day", n), f"T{n}") for n in (30, 45, 60, 90, 126)]
    first = F.when(F.col("i") < 63, F.lit(0)).otherwise(F.floor((F.col("i") - 63) / 21) + 1)
    rolling = F.transform(F.sequence(first, F.floor(F.col("i") / 21)), lambda k: F.concat(F.lit("W"), k.cast("string")))
    s = r.select("strategy", "symbol", "session", "net", F.explode(F.array_compact(F.concat(F.array(*named), rolling))).alias("slice"))
    return rt.performance(s, ["strategy", "symbol", "slice"])


ZQ = {80: 1.2815515655446004, 95: 1.959963984540054}  # fixed values: normal quantiles of the two-sided levels
add_view("intervals", f"""
SELECT *, fmean - {ZQ[80]!r}::DOUBLE * fsd AS low80, fmean + {ZQ[80]!r}::DOUBLE * fsd AS high80, fmean - {ZQ[95]!r}::DOUBLE * fsd AS low95, fmean + {ZQ[95]!r}::DOUBLE * fsd AS high95 FROM (
 SELECT symbol, session, ln(lead(close, 10) OVER w / close) AS actual, rn, avg(lr) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 10 AS fmean,
   CASE WHEN count(lr) OVER s >= 252 THEN stddev_samp(lr) OVER s END * sqrt(10) AS fsd
 FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS lr FROM features)
 WINDOW w AS (PARTITION BY symbol ORDER BY session), s AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
WHERE fsd IS NOT NULL AND actual IS NOT NULL AND (rn - 1 - 252) % 21 = 0""")


def intervals(spark, d):
    """Forecast intervals every 21 rows: 252-row deviation, 60-row mean, 10-row horizon."""
    f = views.features(spark, d).withColumn("lr", F.log(F.col("close") / F.lag("close").over(by_symbol())))
    f = f.select("symbol", "session", "rn", F.log(F.lead("close", 10).over(by_symbol()) / F.col("close")).alias("actual"),
                 (F.avg("lr").over(trailing(60)) * 10).alias("fmean"), (gated(F.stddev_samp, "lr", trailing(252), 252) * math.sqrt(10)).alias("fsd"))
    f = f.filter("fsd IS NOT NULL AND actual IS NOT NULL AND (rn - 1 - 252) % 21 = 0")
    return f.select("*", *[(F.col("fmean") + s * ZQ[k] * F.col("fsd")).alias(f"{n}{k}") for k in (80, 95) for s, n in ((-1, "low"), (1, "high"))])


@query("w30_interval_calibration", "symbol:s session:d actual:8 low80:8 high80:8 low95:8 high95:8", "SELECT * FROM intervals", "W30")
def _(spark, d):
    return intervals(spark, d)


def _levels(i):
    return i.select("symbol", "session", "actual", "fmean", "fsd", F.inline(F.array(*[F.struct(
        F.lit(k).alias("level"), F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high")) for k in (80, 95)])))


@query("a22_interval_scores", "symbol:s level:i n:i coverage:6 below:6 above:6 width:8 score:8",
       """SELECT symbol, level, count(*) AS n, avg(CASE WHEN actual BETWEEN low AND high THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN actual < low THEN 1.0 ELSE 0.0 END) AS below,
            avg(CASE WHEN actual > high THEN 1.0 ELSE 0.0 END) AS above, avg(high - low) AS width, avg(high - low + 2 / (1 - level / 100.0) * (greatest(low - actual, 0) + greatest(actual - high, 0))) AS score
          FROM (SELECT symbol, actual, 80 AS level, low80 AS low, high80 AS high FROM intervals UNION ALL SELECT symbol, actual, 95, low95, high95 FROM intervals) GROUP BY 1, 2""", "A22")
def _(spark, d):
    i = _levels(intervals(spark, d))
    a, lo, hi = F.col("actual"), F.col("low"), F.col("high")
    penalty = F.lit(2.0) / (1 - F.col("level") / 100.0) * (F.greatest(lo - a, F.lit(0.0)) + F.greatest(a - hi, F.lit(0.0)))
    return i.groupBy("symbol", "level").agg(
        F.count("*").alias("n"), F.avg(((a >= lo) & (a <= hi)).cast("int")).alias("coverage"), F.avg((a < lo).cast("int")).alias("below"),
        F.avg((a > hi).cast("int")).alias("above"), F.avg(hi - lo).alias("width"), F.avg(hi - lo + penalty).alias("score"))


@query("a23_pit_uniformity", "symbol:s n:i pit_mean:5 ks:5",
       """WITH d AS (SELECT i.symbol, i.session, avg(CASE WHEN h.lr10 <= i.actual THEN 1.0 ELSE 0.0 END) AS pit FROM intervals i JOIN
            (SELECT symbol, rn, ln(close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY session)) AS lr10 FROM features) h ON h.symbol = i.symbol AND h.rn BETWEEN i.rn - 251 AND i.rn AND h.lr10 IS NOT NULL GROUP BY 1, 2),
          r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pit, session) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM d)
          SELECT symbol, any_value(n) AS n, avg(pit) AS pit_mean, max(greatest(k * 1.0 / n - pit, pit - (k - 1) * 1.0 / n)) AS ks FROM r GROUP BY 1""", "A23")
def _(spark, d):
    f = views.features(spark, d).select("symbol", "session", F.log(F.col("close") / F.lag("close", 10).over(by_symbol())).alias("lr10"),
                                        F.row_number().over(by_symbol()).alias("i"))
    # few rows have an interval: only their windows are laid out, row by row
    need = intervals(spark, d).join(f.select("symbol", "session", "i"), ["symbol", "session"]).select(
        "symbol", "session", "actual", F.explode(F.sequence(F.greatest(F.col("i") - 251, F.lit(1)), F.col("i"))).alias("i"))
    drawn = need.join(f.select("symbol", "i", "lr10"), ["symbol", "i"])
    j = drawn.groupBy("symbol", "session").agg((F.sum((F.col("lr10") <= F.col("actual")).cast("int")) / F.count("lr10")).alias("pit"))
    w = Window.partitionBy("symbol")
    r = j.withColumn("k", F.row_number().over(w.orderBy("pit", "session"))).withColumn("n", F.count("*").over(w))
    return r.groupBy("symbol").agg(F.first("n").alias("n"), F.avg("pit").alias("pit_mean"),
                                   F.max(F.greatest(F.col("k") / F.col("n") - F.col("pit"), F.col("pit") - (F.col("k") - 1) / F.col("n"))).alias("ks"))


@query("a24_newey_west", "strategy:s symbol:s n:i mean:8 hac_se:8",
       "WITH c AS (SELECT *, net - avg(net) OVER (PARTITION BY strategy, symbol) AS c FROM net_returns), g AS (SELECT *, " + ", ".join(
           f"c * lag(c, {k}) OVER (PARTITION BY strategy, symbol ORDER BY session) AS g{k}" for k in range(1, 6))
       + " FROM c) SELECT strategy, symbol, count(*) AS n, avg(net) AS mean, sqrt(greatest((sum(c * c) + " + " + ".join(
           f"{2 * (1 - k / 6)!r}::DOUBLE * coalesce(sum(g{k}), 0)" for k in range(1, 6)) + ") / count(*), 0) / count(*)) AS hac_se FROM g GROUP BY 1, 2", "A24")
def _(spark, d):
    return evl.newey_west(views.net_returns(spark, d), ["strategy", "symbol"], "net", 5)


BLOCK_REPS = 1000  # repetitions of the interval
PATH_REPS = 200  # paths of the resampled ratio; each redraws the whole series


@query("a25_block_bootstrap", "strategy:s symbol:s n:i mean:8 low:7 high:7",
       f"""WITH v AS (SELECT strategy, symbol, net AS v, row_number() OVER (PARTITION BY strategy, symbol ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY strategy, symbol) AS n FROM net_returns),
          c AS (SELECT *, sum(v) OVER (PARTITION BY strategy, symbol ORDER BY i) - v AS before FROM v),
          k AS (SELECT strategy, symbol, any_value(n) AS n, avg(v) AS mean, sum(v) AS total FROM v GROUP BY 1, 2),
          s AS (SELECT k.*, rep.range AS rep, slot.range AS slot, ('0x' || substr(md5('42:' || rep.range || ':' || slot.range), 1, 8))::BIGINT % n AS i FROM k, range(0, {BLOCK_REPS}) rep, range(0, 2000) slot WHERE n > 21 AND slot.range < ceil(n / 21.0)),
          z AS (SELECT *, least(21, n - slot * 21) AS size FROM s),
          m AS (SELECT z.strategy, z.symbol, z.rep, sum(b.before - a.before + CASE WHEN z.i + size >= z.n THEN total ELSE 0 END) / any_value(z.n) AS m FROM z
            JOIN c a ON a.strategy = z.strategy AND a.symbol = z.symbol AND a.i = z.i JOIN c b ON b.strategy = z.strategy AND b.symbol = z.symbol AND b.i = (z.i + size) % z.n GROUP BY 1, 2, 3),
          q AS (SELECT strategy, symbol, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1, 2)
          SELECT k.strategy, k.symbol, k.n, k.mean, low, high FROM k LEFT JOIN q ON k.strategy = q.strategy AND k.symbol = q.symbol""", "A25")
def _(spark, d):
    return evl.block_bootstrap(views.net_returns(spark, d), ["strategy", "symbol"], "net", reps=BLOCK_REPS, block=21)


@query("a25_path_bootstrap", "strategy:s symbol:s sharpe_low:5 sharpe_high:5 drawdown_low:6",
       f"""WITH v AS (SELECT strategy, symbol, net AS v, row_number() OVER (PARTITION BY strategy, symbol ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY strategy, symbol) AS n FROM net_returns),
          k AS (SELECT strategy, symbol, any_value(n) AS n FROM v GROUP BY 1, 2),
          s AS (SELECT k.*, rep.range AS rep, slot.range AS slot, ('0x' || substr(md5('7:' || rep.range || ':' || slot.range), 1, 8))::BIGINT % n AS i FROM k, range(0, {PATH_REPS}) rep, range(0, 10000) slot WHERE slot.range < n),
          p AS (SELECT s.strategy, s.symbol, s.rep, s.slot, v.v, sum(ln(1 + v.v)) OVER (PARTITION BY s.strategy, s.symbol, s.rep ORDER BY s.slot ROWS UNBOUNDED PRECEDING) AS lg FROM s JOIN v ON v.strategy = s.strategy AND v.symbol = s.symbol AND v.i = s.i),
          o AS (SELECT strategy, symbol, rep, avg(v) / CASE WHEN stddev_pop(v) > 1e-12 THEN stddev_pop(v) END * sqrt(252) AS s, min(dd) AS d FROM (SELECT *, exp(lg - greatest(max(lg) OVER (PARTITION BY strategy, symbol, rep ORDER BY slot ROWS UNBOUNDED PRECEDING), 0)) - 1 AS dd FROM p) GROUP BY 1, 2, 3)
          SELECT strategy, symbol, quantile_cont(s, 0.05) AS sharpe_low, quantile_cont(s, 0.95) AS sharpe_high, quantile_cont(d, 0.05) AS drawdown_low FROM o GROUP BY 1, 2""", "A25")
def _(spark, d):
    return evl.iid_bootstrap(views.net_returns(spark, d), ["strategy", "symbol"], "net", reps=PATH_REPS)


@query("a26_placebo", "symbol:s n:i mean:8 t_stat:5",
       """SELECT symbol, count(*) AS n, avg(f5) AS mean, avg(f5) / nullif(stddev_samp(f5) / sqrt(count(*)), 0) AS t_stat FROM (
            SELECT symbol, f5, row_number() OVER (PARTITION BY symbol ORDER BY md5('placebo:' || symbol || ':' || session), session) AS k FROM (
              SELECT r.symbol, r.session, CASE WHEN count(*) OVER w = 5 THEN sum(r.r) OVER w END AS f5, p.name FROM ev_returns r LEFT JOIN noise_periods p ON r.session BETWEEN p.start_day AND p.end_day
              WINDOW w AS (PARTITION BY r.symbol ORDER BY r.session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE f5 IS NOT NULL AND name IS NULL) WHERE k <= 250 GROUP BY 1""", "A26")
def _(spark, d):
    # The sample size is the feature: 250 hash-ordered non-event rows per symbol.
    from tideline.plans.joins import noise_periods
    f = views.features(spark, d).filter("ret1 IS NOT NULL")
    w = by_symbol().rowsBetween(1, 5)
    f = f.select("symbol", "session", F.when(F.count("ret1").over(w) == 5, F.sum("ret1").over(w)).alias("f5")).filter("f5 IS NOT NULL")
    busy = noise_periods(spark, d).select(F.explode(F.sequence("start_day", "end_day")).alias("session"))
    f = f.join(busy, "session", "left_anti")
    order = F.md5(F.concat(F.lit("placebo:"), "symbol", F.lit(":"), F.col("session").cast("string")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(order, "session"))
    return f.withColumn("k", k).filter("k <= 250").groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg("f5").alias("mean"), sdiv(F.avg("f5"), F.stddev_samp("f5") / F.sqrt(F.count("*"))).alias("t_stat"))


@query("a27_return_tests", "strategy:s symbol:s n:i excess_t:5 positive_t:5 positive_p:5 active_t:5 sharpe:6 bench_sharpe:6 durbin_watson:6",
       f"""SELECT *, CASE WHEN positive_t >= 0 THEN {t_tail_sql('positive_t', 'greatest(n - 1, 1)')} ELSE 1 - {t_tail_sql('positive_t', 'greatest(n - 1, 1)')} END AS positive_p FROM (
            SELECT strategy, symbol, count(*) AS n, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) AS excess_t, avg(net) / nullif(stddev_samp(net) / sqrt(count(*)), 0) AS positive_t,
              CASE WHEN count(*) FILTER (held > 0) >= 3 THEN avg(x) FILTER (held > 0) / nullif(stddev_samp(x) FILTER (held > 0) / sqrt(count(*) FILTER (held > 0)), 0) END AS active_t,
              sqrt(252) * avg(net) / nullif(stddev_pop(net), 0) AS sharpe, sqrt(252) * avg(ret1) / nullif(stddev_pop(ret1), 0) AS bench_sharpe, sum(pow(x - px, 2)) / nullif(sum(x * x), 0) AS durbin_watson
            FROM (SELECT *, net - 0.5 * ret1 AS x, lag(net - 0.5 * ret1) OVER (PARTITION BY strategy, symbol ORDER BY session) AS px FROM net_returns) GROUP BY 1, 2)""", "A27 F19")
def _(spark, d):
    w = Window.partitionBy("strategy", "symbol").orderBy("session")
    n = views.net_returns(spark, d).withColumn("x", F.col("net") - 0.5 * F.col("ret1"))
    n = n.withColumn("px", F.lag("x").over(w))
    on = F.col("held") > 0

    def t(c, k):
        return sdiv(F.avg(c), F.stddev_samp(c) / F.sqrt(k))

    ax = F.when(on, F.col("x"))
    g = n.groupBy("strategy", "symbol").agg(
        F.count("*").alias("n"), t(F.col("x"), F.count("*")).alias("excess_t"), t(F.col("net"), F.count("*")).alias("positive_t"),
        F.when(F.count(ax) >= 3, t(ax, F.count(ax))).alias("active_t"), sdiv(F.avg("net") * math.sqrt(252), F.stddev_pop("net")).alias("sharpe"),
        sdiv(F.avg("ret1") * math.sqrt(252), F.stddev_pop("ret1")).alias("bench_sharpe"),
        sdiv(F.sum(F.pow(F.col("x") - F.col("px"), 2)), F.sum(F.col("x") * F.col("x"))).alias("durbin_watson"))
    tail = student_t_tail("positive_t", F.greatest(F.col("n") - 1, F.lit(1)))
    return g.withColumn("_tail", tail).withColumn("positive_p", F.when(F.col("positive_t") >= 0, F.col("_tail")).otherwise(1 - F.col("_tail")))


@query("a33_stratified_returns", "strategy:s stratum:s n:i mean_return:8 mean_exposure:6",
       """SELECT strategy, stratum, count(*) AS n, avg(net) AS mean_return, avg(abs(held)) AS mean_exposure FROM (
            SELECT r.strategy, r.net, r.held, unnest([CAST(year(r.session) AS VARCHAR), CASE WHEN v.pv > v.med THEN 'high_vol' WHEN v.pv <= v.med THEN 'low_vol' END]) AS stratum FROM net_returns r JOIN (
              SELECT symbol, session, lag(vol20) OVER (PARTITION BY symbol ORDER BY session) AS pv, """ + sgated("quantile_cont({x}, 0.5)", "vol20", -253, -2, 60) + """ AS med FROM features) v
            ON v.symbol = r.symbol AND v.session = r.session) WHERE stratum IS NOT NULL GROUP BY 1, 2""", "A33")
def _(spark, d):
    w = by_symbol()
    fr = w.rowsBetween(-253, -2)
    v = views.features(spark, d).select("symbol", "session", F.lag("vol20").over(w).alias("pv"), F.when(F.count("vol20").over(fr) >= 60, F.percentile("vol20", 0.5).over(fr)).alias("med"))
    j = views.net_returns(spark, d).join(v, ["symbol", "session"])
    state = F.when(F.col("pv") > F.col("med"), "high_vol").when(F.col("pv") <= F.col("med"), "low_vol")
    s = j.select("strategy", "net", "held", F.explode(F.array_compact(F.array(F.year("session").cast("string"), state))).alias("stratum"))
    return s.groupBy("strategy", "stratum").agg(F.count("*").alias("n"), F.avg("net").alias("mean_return"), F.avg(F.abs("held")).alias("mean_exposure"))


# Candidate results: one row per symbol, rule and look-back.
add_view("cand_net", """
SELECT *, held * ret1 - turn * 0.0015::DOUBLE AS net FROM (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol, label ORDER BY session), 0)) AS turn
 FROM (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol, label ORDER BY session), 0) AS held, max(session) OVER (PARTITION BY symbol) AS last_day FROM rule_signals))""")
add_view("cand_rows", """
SELECT c.*, m.months FROM cand_net c, (VALUES (24), (36), (60)) m(months) WHERE c.session > CAST(c.last_day - to_months(m.months) AS DATE)""")
add_view("cand_perf", perf_sql("cand_rows", "symbol, label, months"))
add_view("cand_trades", trades_sql("cand_rows", "symbol, label, months"))
add_view("cand_dir", directional_sql("cand_rows", "symbol, label, months"))
add_view("candidates", """
SELECT p.*, coalesce(t.num_trades, 0) AS num_trades, coalesce(t.win_rate, 0) AS win_rate, least(coalesce(t.profit_factor, 0), 99) AS profit_factor, d.dir_active_days, d.coverage, d.dir_precision, d.avg_next_return, d.year_std, d.worst_year
FROM cand_perf p LEFT JOIN cand_trades t USING (symbol, label, months) JOIN cand_dir d USING (symbol, label, months)""")
KEYS = ["symbol", "label", "months"]


def candidate_rows(spark, d):
    n = rt.net_of_costs(sg.rule_signals(spark, d), ["symbol", "label"])
    n = n.withColumn("last_day", F.max("session").over(Window.partitionBy("symbol")))
    months = F.explode(F.array_compact(F.array(*[F.when(F.col("session") > F.add_months("last_day", -m), m) for m in (24, 36, 60)])))
    return n.select("symbol", "label", "session", "held", "net", "position", "target_return", "fold", months.alias("months"))


def candidates(spark, d):
    return stage(spark, d, "candidates", views.BAR_TABLES, build_candidates)


def build_candidates(spark, d):
    rows = candidate_rows(spark, d)
    c = rt.full_performance(rows, KEYS).join(evl.directional(rows, KEYS), KEYS)
    return c.withColumn("profit_factor", F.least(F.coalesce("profit_factor", F.lit(0.0)), F.lit(99.0)))


CAND = "annualized_return:5 sharpe_ratio:5 max_drawdown:7 win_rate:6 profit_factor:4 num_trades:i dir_active_days:i dir_precision:6 worst_year:6"


@query("a55_candidate_windows", "symbol:s label:s months:i " + CAND, "SELECT * FROM candidates", "A55 A50")
def _(spark, d):
    return candidates(spark, d)


@query("a50_fold_periods", "symbol:s label:s fold:i active_days:i precision:6 avg_next_return:8",
       """SELECT symbol, label, fold, count(*) FILTER (active) AS active_days, avg(CASE WHEN target_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (active) AS precision, coalesce(avg(target_return) FILTER (active), 0) AS avg_next_return
          FROM rule_signals GROUP BY 1, 2, 3""", "A50")
def _(spark, d):
    a = F.col("active")
    return sg.rule_signals(spark, d).groupBy("symbol", "label", "fold").agg(
        F.sum(a.cast("int")).alias("active_days"), F.avg(F.when(a, (F.col("target_return") > 0).cast("int"))).alias("precision"),
        F.coalesce(F.avg(F.when(a, F.col("target_return"))), F.lit(0.0)).alias("avg_next_return"))


@query("a50_cost_stress", "strategy:s symbol:s cost_multiple:i total_return:4 sharpe_ratio:5",
       f"""WITH x AS (SELECT strategy, symbol, session, m.k AS cost_multiple, held * ret1 - turn * 0.0015::DOUBLE * m.k AS net FROM net_returns, (VALUES (1), (2), (4)) m(k)) {perf_sql('x', 'strategy, symbol, cost_multiple')}""", "A50 R01")
def _(spark, d):
    n = views.net_returns(spark, d).select("strategy", "symbol", "session", "held", "ret1", "turn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("cost_multiple"))
    n = n.withColumn("net", F.col("held") * F.col("ret1") - F.col("turn") * 0.0015 * F.col("cost_multiple"))
    return rt.performance(n, ["strategy", "symbol", "cost_multiple"])


SCORE_SQL = """dir_precision * 5 + least(profit_factor, 5) * 0.45 + sharpe_ratio * 0.55 + annualized_return * 0.75 + coalesce(calmar_ratio, 0) * 0.2 + avg_next_return * 50
 - greatest(0, abs(max_drawdown) - 0.18) * 8 - greatest(0, coverage - 0.25) * 3 - year_std * 1.5"""
ROBUST_SQL = """dir_precision * 6 + worst_year * 2 + sharpe_ratio * 0.9 + annualized_return * 1.25 + least(profit_factor, 8) * 0.3 + least(dir_active_days, 80) * 0.015
 - (greatest(0, 25 - dir_active_days) * 0.15 + greatest(0, 18 - num_trades) * 0.2) - greatest(0, abs(max_drawdown) - 0.12) * 10 - (year_std * 2 + greatest(0, 0.58 - worst_year) * 4)"""
add_view("scored", f"SELECT *, CASE WHEN dir_active_days < 25 OR num_trades < 5 THEN -100 - (greatest(0, 25 - dir_active_days) + 2 * greatest(0, 5 - num_trades)) ELSE {SCORE_SQL} END AS score, {ROBUST_SQL} AS long_score FROM candidates")


def scored(spark, d):
    """Search score with a sample floor, and the robust score used for ranking."""
    c = candidates(spark, d)
    z = F.lit(0.0)
    dd = F.abs("max_drawdown")
    score = (F.col("dir_precision") * 5 + F.least("profit_factor", F.lit(5.0)) * 0.45 + F.col("sharpe_ratio") * 0.55 + F.col("annualized_return") * 0.75
             + F.coalesce("calmar_ratio", z) * 0.2 + F.col("avg_next_return") * 50 - F.greatest(z, dd - 0.18) * 8
             - F.greatest(z, F.col("coverage") - 0.25) * 3 - F.col("year_std") * 1.5)
    short = F.greatest(F.lit(0), 25 - F.col("dir_active_days")) + 2 * F.greatest(F.lit(0), 5 - F.col("num_trades"))
    robust = (F.col("dir_precision") * 6 + F.col("worst_year") * 2 + F.col("sharpe_ratio") * 0.9 + F.col("annualized_return") * 1.25 + F.least("profit_factor", F.lit(8.0)) * 0.3
              + F.least("dir_active_days", F.lit(80)) * 0.015 - F.greatest(F.lit(0), 25 - F.col("dir_active_days")) * 0.15 - F.greatest(F.lit(0), 18 - F.col("num_trades")) * 0.2
              - F.greatest(z, dd - 0.12) * 10 - F.col("year_std") * 2 - F.greatest(z, 0.58 - F.col("worst_year")) * 4)
    return c.select("*", F.when((F.col("dir_active_days") < 25) | (F.col("num_trades") < 5), -100.0 - short).otherwise(score).alias("score"), robust.alias("long_score"))


@query("p30_candidate_scores", "symbol:s label:s months:i score:4 long_score:4", "SELECT * FROM scored", "P30")
def _(spark, d):
    return scored(spark, d)


STRICT = "num_trades >= 5 AND abs(max_drawdown) <= 0.9 AND win_rate >= 0.2 AND dir_precision >= 0.2"


@query("p10_strict_filter", "place:i symbol:s label:s long_score:4",
       f"SELECT row_number() OVER (ORDER BY round(long_score, 6) DESC, round(dir_precision, 6) DESC, symbol, label) AS place, symbol, label, long_score FROM scored WHERE months = 24 AND {STRICT}", "P10 L01")
def _(spark, d):
    s = scored(spark, d).filter(f"months = 24 AND {STRICT}")
    return rank_all(s.withColumn("_s", F.round("long_score", 6)).withColumn("_d", F.round("dir_precision", 6)),
                    [F.col("_s").desc(), F.col("_d").desc(), "symbol", "label"], "place")


@query("l02_top_per_bucket", "symbol:s label:s roles:s",
       f"""WITH s AS (SELECT * FROM scored WHERE months = 24),
          r AS (SELECT symbol, label, 'best_score' AS role, row_number() OVER (PARTITION BY symbol ORDER BY round(long_score, 6) DESC, label) AS k FROM s UNION ALL SELECT symbol, label, 'best_return', row_number() OVER (PARTITION BY symbol ORDER BY round(annualized_return, 6) DESC, label) FROM s
            UNION ALL SELECT symbol, label, 'best_sharpe', row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe_ratio, 6) DESC, label) FROM s UNION ALL SELECT symbol, label, 'current_baseline', 1 FROM s WHERE label = '{rl.rule_grid()[0]["label"]}')
          SELECT symbol, label, string_agg(role, '+' ORDER BY role) AS roles FROM r WHERE k <= 3 GROUP BY 1, 2""", "L02")
def _(spark, d):
    s = scored(spark, d).filter("months = 24")
    base = rl.rule_grid()[0]["label"]
    m = s.select("symbol", "label", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.round(c, 6).alias("v")) for r, c in
                 (("best_score", "long_score"), ("best_return", "annualized_return"), ("best_sharpe", "sharpe_ratio"))])))
    top = m.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "role").orderBy(F.desc("v"), "label"))).filter("k <= 3").select("symbol", "label", "role")
    keep = s.filter(F.col("label") == base).select("symbol", "label", F.lit("current_baseline").alias("role"))
    return top.unionByName(keep).groupBy("symbol", "label").agg(F.array_join(F.array_sort(F.collect_list("role")), "+").alias("roles"))


@query("l03_probe_set", "symbol:s label:s role:s",
       f"""SELECT symbol, label, min_by(role, pri) AS role FROM (
            SELECT symbol, label, 'baseline' AS role, 1 AS pri FROM scored WHERE months = 60 AND label = '{rl.rule_grid()[0]["label"]}' UNION ALL
            SELECT symbol, label, 'top_score', 2 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(long_score, 6) DESC, label) AS k FROM scored WHERE months = 60) WHERE k <= 4 UNION ALL
            SELECT symbol, label, 'top_trades', 3 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY num_trades DESC, label) AS k FROM scored WHERE months = 60) WHERE k <= 2) GROUP BY 1, 2""", "L03")
def _(spark, d):
    s = scored(spark, d).filter("months = 60")
    w = Window.partitionBy("symbol")
    a = s.filter(F.col("label") == rl.rule_grid()[0]["label"]).select("symbol", "label", F.lit("baseline").alias("role"), F.lit(1).alias("pri"))
    b = s.withColumn("k", F.row_number().over(w.orderBy(F.round("long_score", 6).desc(), "label"))).filter("k <= 4").select("symbol", "label", F.lit("top_score").alias("role"), F.lit(2).alias("pri"))
    c = s.withColumn("k", F.row_number().over(w.orderBy(F.desc("num_trades"), "label"))).filter("k <= 2").select("symbol", "label", F.lit("top_trades").alias("role"), F.lit(3).alias("pri"))
    return a.unionByName(b).unionByName(c).groupBy("symbol", "label").agg(F.min_by("role", "pri").alias("role"))


@query("l04_high_sample", "symbol:s label:s num_trades:i dir_active_days:i",
       "SELECT symbol, label, num_trades, dir_active_days FROM scored WHERE months = 60 AND num_trades >= 20 AND dir_precision >= 0.45 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY num_trades DESC, round(long_score, 6) DESC, label) <= 5", "L04")
def _(spark, d):
    s = scored(spark, d).filter("months = 60 AND num_trades >= 20 AND dir_precision >= 0.45")
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("num_trades"), F.round("long_score", 6).desc(), "label"))
    return s.withColumn("k", k).filter("k <= 5")


@query("l07_arg_best", "symbol:s best_label:s best_score:4",
       "SELECT symbol, arg_max(label, row(round(long_score, 6), label)) AS best_label, max(round(long_score, 6)) AS best_score FROM scored WHERE months = 36 GROUP BY 1", "L07")
def _(spark, d):
    s = scored(spark, d).filter("months = 36").withColumn("v", F.round("long_score", 6))
    return s.groupBy("symbol").agg(F.max_by("label", F.struct("v", "label")).alias("best_label"), F.max("v").alias("best_score"))


# Hard gates of a production rule.
GATES = {"annualized_return": ("annualized_return < 0.12", lambda: F.col("annualized_return") < 0.12), "sharpe_ratio": ("sharpe_ratio < 1.0", lambda: F.col("sharpe_ratio") < 1.0),
         "max_drawdown": ("abs(max_drawdown) > 0.15", lambda: F.abs("max_drawdown") > 0.15), "win_rate": ("win_rate < 0.55", lambda: F.col("win_rate") < 0.55),
         "profit_factor": ("profit_factor < 1.5", lambda: F.col("profit_factor") < 1.5)}
add_view("gated_candidates", "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, (c, _) in GATES.items())
         + ", CASE WHEN months = 60 AND num_trades < 20 THEN 'num_trades' END, CASE WHEN months = 60 AND dir_active_days < 60 THEN 'dir_active_days' END], lambda x: x IS NOT NULL) AS fails FROM scored")


def gated_candidates(spark, d):
    fails = [F.when(c(), k) for k, (_, c) in GATES.items()]
    fails += [F.when((F.col("months") == 60) & (F.col("num_trades") < 20), "num_trades"), F.when((F.col("months") == 60) & (F.col("dir_active_days") < 60), "dir_active_days")]
    return scored(spark, d).withColumn("fails", F.array_compact(F.array(*fails)))


@query("p27_hard_gates", "symbol:s label:s months:i n_fail:i failures:s", "SELECT symbol, label, months, len(fails) AS n_fail, array_to_string(fails, ',') AS failures FROM gated_candidates", "P27")
def _(spark, d):
    return gated_candidates(spark, d).select("symbol", "label", "months", F.size("fails").alias("n_fail"), F.array_join("fails", ",").alias("failures"))


PROMO = ["annualized_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor", "num_trades"]
add_view("promotion", f"""
WITH w AS (SELECT symbol, label, {', '.join(f"max({c}) FILTER (months = {m}) AS m{m}_{c}" for m in (24, 36, 60) for c in PROMO)}, {', '.join(f"max(len(fails)) FILTER (months = {m}) AS f{m}" for m in (24, 36, 60))} FROM gated_candidates GROUP BY 1, 2)
SELECT w.*, CASE WHEN w.f24 IS NULL OR w.f36 IS NULL OR w.f60 IS NULL THEN 'reject_missing_window' WHEN w.f60 > 1 THEN 'reject_long_window_failure' WHEN w.f24 > 1 OR w.f36 > 1 THEN 'reject_weak_metrics'
   WHEN w.m24_annualized_return >= b.m24_annualized_return AND w.m24_sharpe_ratio >= b.m24_sharpe_ratio AND abs(w.m24_max_drawdown) <= abs(b.m24_max_drawdown) * 1.25 AND w.m24_profit_factor >= b.m24_profit_factor * 0.9 THEN 'promote_candidate' ELSE 'watchlist_strong_recent_mid' END AS status
FROM w LEFT JOIN w b ON b.symbol = w.symbol AND b.label = '{rl.rule_grid()[0]["label"]}'""")


def promotion(spark, d):
    """Three look-backs side by side, gates tolerated once, compared with the baseline rule."""
    g = gated_candidates(spark, d).withColumn("f", F.size("fails"))
    w = g.groupBy("symbol", "label").pivot("months", [24, 36, 60]).agg(*[F.max(c).alias(c) for c in [*PROMO, "f"]])
    w = w.select("symbol", "label", *[F.col(f"`{m}_{c}`").alias(f"m{m}_{c}") for m in (24, 36, 60) for c in PROMO], *[F.col(f"`{m}_f`").alias(f"f{m}") for m in (24, 36, 60)])
    base = w.filter(F.col("label") == rl.rule_grid()[0]["label"]).select("symbol", *[F.col(f"m24_{c}").alias(f"b_{c}") for c in PROMO])
    j = w.join(base, "symbol", "left")
    better = ((F.col("m24_annualized_return") >= F.col("b_annualized_return")) & (F.col("m24_sharpe_ratio") >= F.col("b_sharpe_ratio"))
              & (F.abs("m24_max_drawdown") <= F.abs("b_max_drawdown") * 1.25) & (F.col("m24_profit_factor") >= F.col("b_profit_factor") * 0.9))
    return j.withColumn("status", F.when(F.col("f24").isNull() | F.col("f36").isNull() | F.col("f60").isNull(), "reject_missing_window")
                        .when(F.col("f60") > 1, "reject_long_window_failure").when((F.col("f24") > 1) | (F.col("f36") > 1), "reject_weak_metrics")
                        .when(truth(better), "promote_candidate").otherwise("watchlist_strong_recent_mid"))


@query("p28_candidate_status", "symbol:s label:s status:s", "SELECT * FROM promotion", "P28")
def _(spark, d):
    return promotion(spark, d)


@query("a34_promotion_summary", "symbol:s label:s status:s m24_annualized_return:5 m24_sharpe_ratio:5 m36_sharpe_ratio:5 m60_sharpe_ratio:5 m60_max_drawdown:6 m60_num_trades:i", "SELECT * FROM promotion", "A34")
def _(spark, d):
    return promotion(spark, d)


@query("j26_ranked_sources", "symbol:s label:s status:s long_score:4 k:i",
       """SELECT s.symbol, s.label, p.status, s.long_score, row_number() OVER (PARTITION BY s.symbol ORDER BY CASE p.status WHEN 'promote_candidate' THEN 0 WHEN 'watchlist_strong_recent_mid' THEN 1 ELSE 2 END, round(s.long_score, 6) DESC, s.label) AS k
          FROM scored s LEFT JOIN promotion p ON p.symbol = s.symbol AND p.label = s.label WHERE s.months = 24 QUALIFY k <= 6""", "J26")
def _(spark, d):
    p = promotion(spark, d).select("symbol", "label", "status")
    s = scored(spark, d).filter("months = 24").join(p, ["symbol", "label"], "left")
    rank = F.when(F.col("status") == "promote_candidate", 0).when(F.col("status") == "watchlist_strong_recent_mid", 1).otherwise(2)
    return s.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(rank, F.round("long_score", 6).desc(), "label"))).filter("k <= 6")


LAYERS_SQL = """SELECT symbol, session, l.layer, ret1, target_return, n, i, CASE l.layer WHEN 'baseline' THEN baseline_position WHEN 'meta' THEN meta_position ELSE shadow_position END AS position
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM meta), (VALUES ('baseline'), ('meta'), ('reaction')) l(layer)"""
add_view("layer_rows", f"""
WITH x AS ({LAYERS_SQL}), h AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol, layer ORDER BY session), 0) AS held FROM x),
 t AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol, layer ORDER BY session), 0)) AS turn FROM h)
SELECT t.*, held * ret1 - turn * 0.0015::DOUBLE AS net, s.segment FROM t, (VALUES ('train'), ('validation'), ('full')) s(segment) WHERE s.segment = 'full' OR (s.segment = 'train') = (t.i <= t.n * 7 // 10)""")
add_view("layer_metrics", f"WITH p AS ({perf_sql('layer_rows', 'symbol, layer, segment')}), q AS ({directional_sql('layer_rows', 'symbol, layer, segment')}) SELECT * FROM p JOIN q USING (symbol, layer, segment)")


def layer_metrics(spark, d):
    """Baseline, shadow and combined layers over train, validation and full segments."""
    m = sg.meta(spark, d)
    w = Window.partitionBy("symbol")
    m = m.withColumn("i", F.row_number().over(w.orderBy("session"))).withColumn("n", F.count("*").over(w))
    layers = {"baseline": "baseline_position", "meta": "meta_position", "reaction": "shadow_position"}
    x = m.select("symbol", "session", "ret1", "target_return", "i", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("layer"), F.col(c).alias("position")) for k, c in layers.items()])))
    x = rt.net_of_costs(x, ["symbol", "layer"])
    part = F.when(F.col("i") <= F.floor(F.col("n") * 7 / 10), "train").otherwise("validation")
    x = x.withColumn("segment", F.explode(F.array(F.lit("full"), part)))
    keys = ["symbol", "layer", "segment"]
    return rt.performance(x, keys).join(evl.directional(x, keys), keys)


@query("a53_segmented_layers", "symbol:s layer:s segment:s days:i annualized_return:5 sharpe_ratio:5 max_drawdown:7 dir_active_days:i dir_precision:6", "SELECT * FROM layer_metrics", "A53")
def _(spark, d):
    return layer_metrics(spark, d)


add_view("guard_grid", f"""
WITH x AS (SELECT g.symbol, g.session, g.ret1, v.k AS min_votes, CASE WHEN position > 0 AND votes >= v.k THEN 0 ELSE position END AS position, row_number() OVER (PARTITION BY symbol, v.k ORDER BY session) AS i, count(*) OVER (PARTITION BY symbol, v.k) AS n FROM guarded g, (VALUES (2), (3), (4), (5)) v(k)),
 h AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol, min_votes ORDER BY session), 0) AS held FROM x),
 t AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol, min_votes ORDER BY session), 0)) AS turn, CASE WHEN i <= n * 7 // 10 THEN 'train' ELSE 'validation' END AS segment FROM h),
 r AS (SELECT *, held * ret1 - turn * 0.0015::DOUBLE AS net FROM t) {perf_sql('r', 'symbol, min_votes, segment')}""")


@query("a53_train_selected_guard", "symbol:s min_votes:i train_score:5 validation_sharpe:5 validation_drawdown:6",
       """WITH s AS (SELECT *, round(sharpe_ratio + 2 * annualized_return - abs(max_drawdown), 7) AS score FROM guard_grid)
          SELECT t.symbol, t.min_votes, t.score AS train_score, v.sharpe_ratio AS validation_sharpe, v.max_drawdown AS validation_drawdown
          FROM (SELECT * FROM s WHERE segment = 'train' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, min_votes) = 1) t JOIN s v ON v.symbol = t.symbol AND v.min_votes = t.min_votes AND v.segment = 'validation'""", "A53 P16")
def _(spark, d):
    # The grid is scored on the training rows only; its winner meets the validation rows once.
    g = sg.guarded(spark, d).select("symbol", "session", "ret1", "position", "votes")
    w = Window.partitionBy("symbol")
    g = g.withColumn("i", F.row_number().over(w.orderBy("session"))).withColumn("n", F.count("*").over(w))
    g = g.withColumn("segment", F.when(F.col("i") <= F.floor(F.col("n") * 7 / 10), "train").otherwise("validation"))
    g = g.withColumn("min_votes", F.explode(F.sequence(F.lit(2), F.lit(5))))
    g = g.withColumn("position", F.when((F.col("position") > 0) & (F.col("votes") >= F.col("min_votes")), 0.0).otherwise(F.col("position")))
    p = rt.performance(rt.net_of_costs(g, ["symbol", "min_votes"]), ["symbol", "min_votes", "segment"])
    p = p.withColumn("score", F.round(F.col("sharpe_ratio") + 2 * F.col("annualized_return") - F.abs("max_drawdown"), 7))
    best = p.filter("segment = 'train'").groupBy("symbol").agg(F.max_by(F.struct("min_votes", "score"), F.struct("score", -F.col("min_votes"))).alias("b")).select("symbol", "b.*")
    v = p.filter("segment = 'validation'").select("symbol", "min_votes", F.col("sharpe_ratio").alias("validation_sharpe"), F.col("max_drawdown").alias("validation_drawdown"))
    return best.join(v, ["symbol", "min_votes"]).withColumnRenamed("score", "train_score")


@query("p29_degradation_gates", "symbol:s segment:s n_fail:i failures:s",
       """SELECT b.symbol, b.segment, len(f) AS n_fail, array_to_string(f, ',') AS failures FROM layer_metrics b JOIN layer_metrics m ON m.symbol = b.symbol AND m.segment = b.segment,
            LATERAL (SELECT list_filter([CASE WHEN m.annualized_return < b.annualized_return - 1e-9 THEN 'annualized_return' END, CASE WHEN m.sharpe_ratio < b.sharpe_ratio - 1e-9 THEN 'sharpe_ratio' END,
              CASE WHEN m.dir_precision < b.dir_precision - 1e-9 THEN 'dir_precision' END, CASE WHEN abs(m.max_drawdown) > abs(b.max_drawdown) + 0.005 THEN 'max_drawdown' END], lambda x: x IS NOT NULL) AS f) WHERE b.layer = 'baseline' AND m.layer = 'meta'""", "P29")
def _(spark, d):
    m = layer_metrics(spark, d)
    cols = ["annualized_return", "sharpe_ratio", "dir_precision", "max_drawdown"]
    g = m.filter("layer IN ('baseline', 'meta')").groupBy("symbol", "segment").pivot("layer", ["baseline", "meta"]).agg(*[F.max(c).alias(c) for c in cols])
    fails = [F.when(F.col(f"meta_{c}") < F.col(f"baseline_{c}") - 1e-9, c) for c in cols[:3]]
    fails.append(F.when(F.abs("meta_max_drawdown") > F.abs("baseline_max_drawdown") + 0.005, "max_drawdown"))
    g = g.withColumn("f", F.array_compact(F.array(*fails)))
    return g.select("symbol", "segment", F.size("f").alias("n_fail"), F.array_join("f", ",").alias("failures"))


@query("a35_rolling_degradation", "symbol:s label:s full_sharpe:5 worst_degradation:4 median_degradation:4 stable:i",
       """WITH f AS (SELECT symbol, label, coalesce(sqrt(252) * avg(net) / CASE WHEN stddev_pop(net) > 1e-12 THEN stddev_pop(net) END, 0) AS fs FROM cand_net GROUP BY 1, 2),
          o AS (SELECT c.symbol, c.label, w.k, sqrt(252) * avg(net) / CASE WHEN stddev_pop(net) > 1e-12 THEN stddev_pop(net) END AS os FROM (SELECT *, row_number() OVER (PARTITION BY symbol, label ORDER BY session DESC) AS r FROM cand_net) c, (VALUES (63), (126), (252)) w(k) WHERE c.r <= w.k GROUP BY 1, 2, 3),
          g AS (SELECT f.symbol, f.label, fs, (fs - os) / nullif(abs(fs), 0) AS deg FROM f JOIN o USING (symbol, label))
          SELECT symbol, label, any_value(fs) AS full_sharpe, max(deg) AS worst_degradation, quantile_cont(deg, 0.5) AS median_degradation, CASE WHEN max(deg) <= 0.2 THEN 1 ELSE 0 END AS stable FROM g GROUP BY 1, 2""", "A35")
def _(spark, d):
    n = rt.net_of_costs(sg.rule_signals(spark, d), ["symbol", "label"])

    def sharpe(c):
        sd = F.stddev_pop(c)
        return F.avg(c) * math.sqrt(252) / F.when(sd > 1e-12, sd)

    r = n.withColumn("r", F.row_number().over(Window.partitionBy("symbol", "label").orderBy(F.desc("session"))))
    g = r.groupBy("symbol", "label").agg(F.coalesce(sharpe(F.col("net")), F.lit(0.0)).alias("full_sharpe"),
                                         *[sharpe(F.when(F.col("r") <= k, F.col("net"))).alias(f"s{k}") for k in (63, 126, 252)])
    deg = [sdiv(F.col("full_sharpe") - F.col(f"s{k}"), F.abs("full_sharpe")) for k in (63, 126, 252)]
    x = g.select("symbol", "label", "full_sharpe", F.explode(F.array(*deg)).alias("deg"))
    return x.groupBy("symbol", "label", "full_sharpe").agg(F.max("deg").alias("worst_degradation"), F.percentile("deg", 0.5).alias("median_degradation"),
                                                           flag(F.max("deg") <= 0.2).alias("stable"))


# Limits of the high-sample search, looked-back tails and sample floors of the stable selection.
HIGH = {"min_trades": 60, "target_trades": 90, "min_active_days": 90, "target_active_days": 130, "min_precision": 0.58, "min_worst_year": 0.52,
        "min_sharpe": 1.0, "min_annualized": 0.10, "max_drawdown": 0.20, "min_win_rate": 0.55, "min_profit_factor": 1.5}
TAILS, MIN_TAIL_TRADES, MIN_TAIL_ROWS, MIN_REGIME_DAYS = (45, 63, 84, 126), 3, 10, 3
REGIMES = {"high_vol_downtrend": "p60 < 1 AND vol20 > vol60", "uptrend": "p60 > 1 AND ret20 > 0", "holiday": "pre_holiday = 1"}
DRAWDOWN_SLACK = 0.001
MORE_CONSTRAINTS = ("annualized_return", "sharpe_ratio", "win_rate", "profit_factor")

# Spread of precision over walk-forward folds, and the scores of a look-back that need it.
add_view("cand_folds", """
SELECT symbol, label, months, count(*) FILTER (precision < 0.5) AS weak_folds, coalesce(stddev_pop(precision), 0) AS fold_std, count(precision) AS folds FROM (
  SELECT symbol, label, months, fold, avg(CASE WHEN target_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (active) AS precision FROM cand_rows GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
_SAMPLE_GATE = f"num_trades >= {HIGH['min_trades']} AND dir_active_days >= {HIGH['min_active_days']}"
_QUALITY_GATE = (f"dir_precision >= {HIGH['min_precision']} AND worst_year >= {HIGH['min_worst_year']} AND sharpe_ratio >= {HIGH['min_sharpe']} AND annualized_return >= {HIGH['min_annualized']}"
                 f" AND abs(max_drawdown) <= {HIGH['max_drawdown']} AND win_rate >= {HIGH['min_win_rate']} AND profit_factor >= {HIGH['min_profit_factor']}")
add_view("window_scores", f"""
SELECT c.*, fold_std, CASE WHEN folds = 0 THEN 99 ELSE weak_folds END AS losing,
  CASE WHEN {_SAMPLE_GATE} THEN 1 ELSE 0 END AS sample_ok, CASE WHEN {_QUALITY_GATE} THEN 1 ELSE 0 END AS quality_ok,
  CASE WHEN dir_active_days < 25 OR num_trades < 5 THEN -100 - (greatest(0, 25 - dir_active_days) + 2 * greatest(0, 5 - num_trades))
   ELSE dir_precision * 5 + least(profit_factor, 5) * 0.45 + sharpe_ratio * 0.55 + annualized_return * 0.75 + coalesce(calmar_ratio, 0) * 0.2 + avg_next_return * 50
    - greatest(0, abs(max_drawdown) - 0.18) * 8 - greatest(0, coverage - 0.25) * 3 - fold_std * 1.5 - (CASE WHEN folds = 0 THEN 99 ELSE weak_folds END) * 0.15 END AS precision_score,
  dir_precision * 6 + worst_year * 2 + sharpe_ratio * 0.9 + annualized_return * 1.25 + least(profit_factor, 8) * 0.3 + least(dir_active_days, 80) * 0.015
    - greatest(0, 25 - dir_active_days) * 0.15 - greatest(0, 18 - num_trades) * 0.2 - greatest(0, abs(max_drawdown) - 0.12) * 10
    - (CASE WHEN folds = 0 THEN 9 ELSE weak_folds END) * 0.35 - fold_std * 2 - greatest(0, 0.58 - worst_year) * 4 AS robust_score,
  dir_precision * 4 + worst_year * 1.5 + win_rate * 1.5 + sharpe_ratio * 0.75 + annualized_return + least(profit_factor, 6) * 0.35
    + least(num_trades, {HIGH['target_trades']}) / {HIGH['target_trades']}.0 * 1.4 + least(dir_active_days, {HIGH['target_active_days']}) / {HIGH['target_active_days']}.0 * 0.8
    + CASE WHEN {_SAMPLE_GATE} AND {_QUALITY_GATE} THEN 2 ELSE 0 END
    - greatest(0, {HIGH['min_trades']} - num_trades) * 0.18 - greatest(0, {HIGH['min_active_days']} - dir_active_days) * 0.08
    - greatest(0, abs(max_drawdown) - {HIGH['max_drawdown']}) * 12 - greatest(0, abs(max_drawdown) - 0.12) * 3
    - (CASE WHEN folds = 0 THEN 9 ELSE weak_folds END) * 0.25 - fold_std * 1.75 - greatest(0, {HIGH['min_worst_year']} - worst_year) * 3 AS high_sample_score
FROM candidates c JOIN cand_folds USING (symbol, label, months)""")


def short_of(limit, c):
    """How far a value stays below a limit, 0 above it."""
    return F.greatest(F.lit(0.0), F.lit(float(limit)) - F.col(c))


def fold_spread(spark, d):
    """Weak folds and the deviation of fold precision of every candidate and look-back."""
    f = candidate_rows(spark, d).groupBy(*KEYS, "fold").agg(F.avg(F.when(F.col("position") > 0, (F.col("target_return") > 0).cast("int"))).alias("precision"))
    return f.groupBy(*KEYS).agg(F.sum(F.coalesce((F.col("precision") < 0.5).cast("int"), F.lit(0))).alias("weak_folds"),
                                F.coalesce(F.stddev_pop("precision"), F.lit(0.0)).alias("fold_std"), F.count("precision").alias("folds"))


def window_scores(spark, d):
    """The scores of precision, long-run and high-sample search of each candidate and look-back."""
    c = candidates(spark, d).join(fold_spread(spark, d), KEYS)
    c = c.withColumn("losing", F.when(F.col("folds") == 0, 99).otherwise(F.col("weak_folds")))
    weak = F.least("losing", F.when(F.col("folds") == 0, 9).otherwise(F.col("losing")))
    dd = F.abs("max_drawdown")

    def over(limit):
        return F.greatest(F.lit(0.0), dd - limit)

    def capped(col, top):
        return F.least(F.col(col), F.lit(float(top)))

    sample = (F.col("num_trades") >= HIGH["min_trades"]) & (F.col("dir_active_days") >= HIGH["min_active_days"])
    floors = {"dir_precision": "min_precision", "worst_year": "min_worst_year", "sharpe_ratio": "min_sharpe", "annualized_return": "min_annualized",
              "win_rate": "min_win_rate", "profit_factor": "min_profit_factor"}
    quality = dd <= HIGH["max_drawdown"]
    for metric, limit in floors.items():
        quality = quality & (F.col(metric) >= HIGH[limit])
    precision = (F.col("dir_precision") * 5 + capped("profit_factor", 5) * 0.45 + F.col("sharpe_ratio") * 0.55 + F.col("annualized_return") * 0.75
                 + F.coalesce("calmar_ratio", F.lit(0.0)) * 0.2 + F.col("avg_next_return") * 50 - over(0.18) * 8
                 - F.greatest(F.lit(0.0), F.col("coverage") - 0.25) * 3 - F.col("fold_std") * 1.5 - F.col("losing") * 0.15)
    few = -100 - short_of(25, "dir_active_days") - short_of(5, "num_trades") * 2
    robust = (F.col("dir_precision") * 6 + F.col("worst_year") * 2 + F.col("sharpe_ratio") * 0.9 + F.col("annualized_return") * 1.25 + capped("profit_factor", 8) * 0.3
              + capped("dir_active_days", 80) * 0.015 - short_of(25, "dir_active_days") * 0.15 - short_of(18, "num_trades") * 0.2 - over(0.12) * 10
              - weak * 0.35 - F.col("fold_std") * 2 - short_of(0.58, "worst_year") * 4)
    high = (F.col("dir_precision") * 4 + F.col("worst_year") * 1.5 + F.col("win_rate") * 1.5 + F.col("sharpe_ratio") * 0.75 + F.col("annualized_return") + capped("profit_factor", 6) * 0.35
            + capped("num_trades", HIGH["target_trades"]) / HIGH["target_trades"] * 1.4 + capped("dir_active_days", HIGH["target_active_days"]) / HIGH["target_active_days"] * 0.8
            + flag(sample & quality) * 2 - short_of(HIGH["min_trades"], "num_trades") * 0.18 - short_of(HIGH["min_active_days"], "dir_active_days") * 0.08
            - over(HIGH["max_drawdown"]) * 12 - over(0.12) * 3 - weak * 0.25 - F.col("fold_std") * 1.75 - short_of(HIGH["min_worst_year"], "worst_year") * 3)
    return c.select("*", flag(sample).alias("sample_ok"), flag(quality).alias("quality_ok"),
                    F.when((F.col("dir_active_days") < 25) | (F.col("num_trades") < 5), few).otherwise(precision).alias("precision_score"),
                    robust.alias("robust_score"), high.alias("high_sample_score"))


@query("p30_window_scores", "symbol:s label:s months:i fold_std:6 losing:i sample_ok:i quality_ok:i precision_score:3 robust_score:3 high_sample_score:3",
       "SELECT * FROM window_scores", "P30 L04")
def _(spark, d):
    return window_scores(spark, d)


# Trailing tails of a candidate: the ledger is cut to the last rows, as if the rule had started there.
add_view("tail_rows", f"""
SELECT symbol, label, k, session, target_return, active, position, h AS held, h * ret1 - abs(h - coalesce(lag(h) OVER (PARTITION BY symbol, label, k ORDER BY session), 0)) * 0.0015::DOUBLE AS net
FROM (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol, label, k ORDER BY session), 0) AS h FROM (
  SELECT r.*, w.k FROM (SELECT *, row_number() OVER (PARTITION BY symbol, label ORDER BY session DESC) AS back FROM rule_signals) r, (VALUES {', '.join(f'({k})' for k in TAILS)}) w(k) WHERE back <= w.k))""")
add_view("tail_trades", trades_sql("tail_rows", "symbol, label, k"))
add_view("tails", f"""
WITH s AS (SELECT symbol, label, k, count(*) AS days, count(*) FILTER (active) AS active_days, sqrt(252) * avg(net) / CASE WHEN stddev_pop(net) > 1e-12 THEN stddev_pop(net) END AS tail_sharpe FROM tail_rows GROUP BY 1, 2, 3),
 f AS (SELECT symbol, label, coalesce(sqrt(252) * avg(net) / CASE WHEN stddev_pop(net) > 1e-12 THEN stddev_pop(net) END, 0) AS full_sharpe FROM cand_net GROUP BY 1, 2),
 j AS (SELECT s.*, full_sharpe, coalesce(t.num_trades, 0) AS tail_trades, round((full_sharpe - coalesce(tail_sharpe, 0)) / nullif(abs(full_sharpe), 0), 9) AS degradation
       FROM s JOIN f USING (symbol, label) LEFT JOIN tail_trades t USING (symbol, label, k))
SELECT *, CASE WHEN days < {MIN_TAIL_ROWS} OR tail_trades < {MIN_TAIL_TRADES} THEN 'oos_insufficient_sample' WHEN coalesce(degradation <= 0.2, false) THEN 'pass' ELSE 'reject_oos_degradation' END AS tail_status FROM j""")


def _sharpe(c="net"):
    sd = F.stddev_pop(c)
    return F.avg(c) * math.sqrt(252) / F.when(sd > 1e-12, sd)


def tails(spark, d):
    """Degradation of the Sharpe ratio over the last rows of each candidate; a bounded number of rows a candidate."""
    r = sg.rule_signals(spark, d).select("symbol", "label", "session", "position", "active", "ret1", "target_return")
    keys = ["symbol", "label"]
    full = rt.net_of_costs(r, keys).groupBy(*keys).agg(F.coalesce(_sharpe(), F.lit(0.0)).alias("full_sharpe"))
    last = r.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("session")))).filter(F.col("back") <= max(TAILS))
    cut = last.withColumn("k", F.explode(F.array_compact(F.array(*[F.when(F.col("back") <= k, k) for k in TAILS]))))
    cut = rt.net_of_costs(cut, [*keys, "k"])
    t = cut.groupBy(*keys, "k").agg(F.count("*").alias("days"), F.sum(F.col("active").cast("int")).alias("active_days"), _sharpe().alias("tail_sharpe"))
    n = rt.trade_stats(rt.trades(cut, [*keys, "k"]), [*keys, "k"]).select(*keys, "k", F.col("num_trades").alias("tail_trades"))
    t = t.join(n, [*keys, "k"], "left").join(full, keys).withColumn("tail_trades", F.coalesce("tail_trades", F.lit(0)))
    t = t.withColumn("degradation", F.round(sdiv(F.col("full_sharpe") - F.coalesce("tail_sharpe", F.lit(0.0)), F.abs("full_sharpe")), 9))
    few = (F.col("days") < MIN_TAIL_ROWS) | (F.col("tail_trades") < MIN_TAIL_TRADES)
    return t.withColumn("tail_status", F.when(few, "oos_insufficient_sample").when(truth(F.col("degradation") <= 0.2), "pass").otherwise("reject_oos_degradation"))


@query("a35_trailing_tails", "symbol:s label:s k:i days:i active_days:i tail_trades:i full_sharpe:5 tail_sharpe:5 degradation:4 tail_status:s", "SELECT * FROM tails", "A35")
def _(spark, d):
    return tails(spark, d)


add_view("regime_rows", "SELECT symbol, label, regime, active_days, hit, mean_next, CASE WHEN active_days < " + str(MIN_REGIME_DAYS) + " THEN 'regime_insufficient_sample' WHEN hit < 0.5 THEN 'watchlist_regime_weakness' ELSE 'pass' END AS regime_status FROM ("
         + " UNION ALL ".join(f"SELECT r.symbol, r.label, '{n}' AS regime, count(*) FILTER (r.active AND {m}) AS active_days, avg(CASE WHEN r.target_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (r.active AND {m}) AS hit,"
                              f" avg(r.target_return) FILTER (r.active AND {m}) AS mean_next FROM rule_signals r JOIN (SELECT symbol, session, p60, vol20, vol60, ret20, pre_holiday FROM rule_frame) x ON x.symbol = r.symbol AND x.session = r.session GROUP BY 1, 2"
                              for n, m in REGIMES.items()) + ")")


def regimes(spark, d):
    """Active days and precision of each candidate in each regime; regimes overlap, so one pass counts them side by side."""
    x = sg.rule_frame(spark, d).select("symbol", "session", F.array(*[F.when(F.expr(m), n) for n, m in REGIMES.items()]).alias("in"))
    x = x.withColumn("in", F.array_compact("in"))
    r = sg.rule_signals(spark, d).select("symbol", "label", "session", "active", "target_return").join(x, ["symbol", "session"])
    parts = [F.struct(F.lit(n).alias("regime"), *[e.alias(a) for a, e in (
        ("active_days", F.count(F.when(F.col("active") & F.array_contains("in", n), 1))), ("hit", F.avg(F.when(F.col("active") & F.array_contains("in", n), (F.col("target_return") > 0).cast("int")))),
        ("mean_next", F.avg(F.when(F.col("active") & F.array_contains("in", n), F.col("target_return")))))]) for n in REGIMES]
    g = r.groupBy("symbol", "label").agg(F.array(*parts).alias("p")).select("symbol", "label", F.inline("p"))
    return g.withColumn("regime_status", F.when(F.col("active_days") < MIN_REGIME_DAYS, "regime_insufficient_sample").when(F.col("hit") < 0.5, "watchlist_regime_weakness").otherwise("pass"))


@query("a35_regime_diagnostics", "symbol:s label:s regime:s active_days:i hit:6 mean_next:8 regime_status:s", "SELECT * FROM regime_rows", "A35 A17")
def _(spark, d):
    return regimes(spark, d)


_BASE = rl.rule_grid()[0]["label"]
add_view("stable_summary", f"""
WITH g AS (SELECT symbol, label, min(annualized_return) AS a, min(sharpe_ratio) AS s, max(abs(max_drawdown)) AS dd, min(win_rate) AS w, min(profit_factor) AS pf, sum(len(fails)) AS nf,
   max(annualized_return) FILTER (months = 60) AS long_a FROM gated_candidates GROUP BY 1, 2),
 o AS (SELECT symbol, label, max(degradation) AS worst, quantile_cont(degradation, 0.5) AS mid, max(CASE WHEN tail_status = 'oos_insufficient_sample' THEN 1 ELSE 0 END) AS few, max(CASE WHEN tail_status = 'reject_oos_degradation' THEN 1 ELSE 0 END) AS bad FROM tails GROUP BY 1, 2),
 r AS (SELECT symbol, label, count(*) FILTER (regime_status = 'watchlist_regime_weakness') AS weak FROM regime_rows GROUP BY 1, 2),
 x AS (SELECT p.symbol, p.label, o.worst, o.mid, coalesce(r.weak, 0) AS weak,
   CASE WHEN p.label = '{_BASE}' THEN 'current_baseline' WHEN p.status NOT IN ('promote_candidate', 'watchlist_strong_recent_mid') THEN p.status
     WHEN o.few IS NULL OR o.few = 1 THEN 'oos_insufficient_sample' WHEN o.bad = 1 THEN 'reject_oos_degradation' WHEN r.weak > 0 THEN 'watchlist_regime_weakness' ELSE p.status END AS status,
   CASE WHEN g.long_a IS NULL THEN -999 ELSE CASE WHEN g.nf = 0 THEN 3 ELSE 0 END + g.a * 4 + g.s * 1.5 + g.w * 1.5 + g.pf * 0.6 + g.long_a * 1.5 - g.dd * 4 - greatest(0, coalesce(o.worst, 1)) * 2 - coalesce(r.weak, 0) * 0.75 END AS stable_score
   FROM promotion p JOIN g ON g.symbol = p.symbol AND g.label = p.label LEFT JOIN o ON o.symbol = p.symbol AND o.label = p.label LEFT JOIN r ON r.symbol = p.symbol AND r.label = p.label)
SELECT *, CASE status WHEN 'current_baseline' THEN 'BASELINE_AUDITED_SEPARATELY' WHEN 'promote_candidate' THEN 'PASS_WITH_WARNINGS' ELSE 'REJECT_OR_WATCHLIST' END AS overfit_proxy FROM x""")


def downgraded(status, is_base, few, bad, weak):
    """A passing status falls by the first of: too few trades in a tail (or no tails), a tail that degrades, a weak regime."""
    passing = status.isin("promote_candidate", "watchlist_strong_recent_mid")
    return (F.when(is_base, "current_baseline").when(~passing, status).when(F.coalesce(few, F.lit(1)) == 1, "oos_insufficient_sample")
            .when(bad == 1, "reject_oos_degradation").when(weak > 0, "watchlist_regime_weakness").otherwise(status))


def stable_summary(spark, d):
    """Promotion status downgraded by trailing tails and regimes, with one score over all look-backs."""
    keys = ["symbol", "label"]
    g = gated_candidates(spark, d).groupBy(*keys).agg(
        F.min("annualized_return").alias("a"), F.min("sharpe_ratio").alias("s"), F.max(F.abs("max_drawdown")).alias("dd"), F.min("win_rate").alias("w"), F.min("profit_factor").alias("pf"),
        F.sum(F.size("fails")).alias("nf"), F.max(F.when(F.col("months") == 60, F.col("annualized_return"))).alias("long_a"))
    o = tails(spark, d).groupBy(*keys).agg(F.max("degradation").alias("worst"), F.percentile("degradation", 0.5).alias("mid"), F.max(flag(F.col("tail_status") == "oos_insufficient_sample")).alias("few"),
                                           F.max(flag(F.col("tail_status") == "reject_oos_degradation")).alias("bad"))
    r = regimes(spark, d).groupBy(*keys).agg(F.sum(flag(F.col("regime_status") == "watchlist_regime_weakness")).alias("weak"))
    j = promotion(spark, d).select(*keys, F.col("status").alias("before")).join(g, keys).join(o, keys, "left").join(r, keys, "left").withColumn("weak", F.coalesce("weak", F.lit(0)))
    status = downgraded(F.col("before"), F.col("label") == _BASE, F.col("few"), F.col("bad"), F.col("weak"))
    score = (F.when(F.col("nf") == 0, 3.0).otherwise(0.0) + F.col("a") * 4 + F.col("s") * 1.5 + F.col("w") * 1.5 + F.col("pf") * 0.6 + F.col("long_a") * 1.5 - F.col("dd") * 4
             - F.greatest(F.lit(0.0), F.coalesce("worst", F.lit(1.0))) * 2 - F.col("weak") * 0.75)
    j = j.withColumn("status", status).withColumn("stable_score", F.when(F.col("long_a").isNull(), -999.0).otherwise(score))
    return j.withColumn("overfit_proxy", F.when(F.col("status") == "current_baseline", "BASELINE_AUDITED_SEPARATELY").when(F.col("status") == "promote_candidate", "PASS_WITH_WARNINGS").otherwise("REJECT_OR_WATCHLIST"))


@query("a35_stable_summary", "symbol:s label:s status:s stable_score:3 worst:4 mid:4 weak:i overfit_proxy:s", "SELECT * FROM stable_summary", "A35 P30 P28")
def _(spark, d):
    return stable_summary(spark, d)


add_view("promotion_scores", f"""
WITH w AS (SELECT symbol, label, {', '.join(f"max({c}) FILTER (months = {m}) AS c{m}_{c}" for m in (24, 36, 60) for c in [*PROMO, "dir_precision", "dir_active_days"])} FROM candidates GROUP BY 1, 2),
 o AS (SELECT symbol, label, max(degradation) AS worst FROM tails GROUP BY 1, 2)
SELECT w.symbol, w.label,
  CASE WHEN w.c24_sharpe_ratio IS NULL THEN -999 ELSE w.c24_dir_precision * 4 + w.c24_sharpe_ratio * 0.65 + w.c24_annualized_return * 1.2 + least(w.c24_profit_factor, 6) * 0.25 - abs(w.c24_max_drawdown) * 4 + least(w.c24_num_trades / 50.0, 1) * 0.6
   + coalesce(w.c36_annualized_return + w.c36_sharpe_ratio * 0.35 + w.c36_win_rate * 0.5 - greatest(0, 0.12 - w.c36_annualized_return) * 3 - greatest(0, abs(w.c36_max_drawdown) - 0.15) * 3, 0)
   + coalesce(w.c60_annualized_return * 0.35 + w.c60_sharpe_ratio * 0.15 - greatest(0, -w.c60_annualized_return) * 4 - greatest(0, abs(w.c60_max_drawdown) - 0.25) * 2.5, 0) END AS promotion_score,
  {' + '.join(f"CASE WHEN w.c{m}_{c} < b.c{m}_{c} THEN 1 ELSE 0 END" for m in (24, 36) for c in MORE_CONSTRAINTS)} + {' + '.join(f"CASE WHEN abs(w.c{m}_max_drawdown) > abs(b.c{m}_max_drawdown) + {DRAWDOWN_SLACK} THEN 1 ELSE 0 END" for m in (24, 36))} AS weakened,
  (w.c60_annualized_return - b.c60_annualized_return) * 18 + (w.c60_sharpe_ratio - b.c60_sharpe_ratio) * 4 + (w.c60_profit_factor - b.c60_profit_factor) * 1.2 + (w.c60_win_rate - b.c60_win_rate) * 3
   + least(w.c60_num_trades / 120.0, 1.5) + least(w.c60_dir_active_days / 180.0, 1.5) - greatest(0, abs(w.c60_max_drawdown) - abs(b.c60_max_drawdown)) * 12 - greatest(0, coalesce(o.worst, 1)) * 2 AS long_first_score
FROM w JOIN w b ON b.symbol = w.symbol AND b.label = '{_BASE}' LEFT JOIN o ON o.symbol = w.symbol AND o.label = w.label""")


def promotion_scores(spark, d):
    """Promotion score over three look-backs, and the score that puts the longest one first against the baseline rule."""
    metrics = [*PROMO, "dir_precision", "dir_active_days"]
    w = candidates(spark, d).groupBy("symbol", "label").pivot("months", [24, 36, 60]).agg(*[F.max(c).alias(c) for c in metrics])
    w = w.select("symbol", "label", *[F.col(f"`{m}_{c}`").alias(f"c{m}_{c}") for m in (24, 36, 60) for c in metrics])
    base = w.filter(F.col("label") == _BASE).select("symbol", *[F.col(f"c{m}_{c}").alias(f"b{m}_{c}") for m in (24, 36, 60) for c in metrics])
    o = tails(spark, d).groupBy("symbol", "label").agg(F.max("degradation").alias("worst"))
    j = w.join(base, "symbol").join(o, ["symbol", "label"], "left")
    z = F.lit(0.0)

    def c(months, name, side="c"):
        return F.col(f"{side}{months}_{name}")

    recent = (c(24, "dir_precision") * 4 + c(24, "sharpe_ratio") * 0.65 + c(24, "annualized_return") * 1.2 + F.least(c(24, "profit_factor"), F.lit(6.0)) * 0.25
              - F.abs(c(24, "max_drawdown")) * 4 + F.least(c(24, "num_trades") / 50, F.lit(1.0)) * 0.6)
    mid = (c(36, "annualized_return") + c(36, "sharpe_ratio") * 0.35 + c(36, "win_rate") * 0.5 - F.greatest(z, 0.12 - c(36, "annualized_return")) * 3
           - F.greatest(z, F.abs(c(36, "max_drawdown")) - 0.15) * 3)
    far = (c(60, "annualized_return") * 0.35 + c(60, "sharpe_ratio") * 0.15 - F.greatest(z, -c(60, "annualized_return")) * 4 - F.greatest(z, F.abs(c(60, "max_drawdown")) - 0.25) * 2.5)
    worse = sum((flag(c(m, n) < c(m, n, "b")) for m in (24, 36) for n in MORE_CONSTRAINTS), F.lit(0))
    worse = sum((flag(F.abs(c(m, "max_drawdown")) > F.abs(c(m, "max_drawdown", "b")) + DRAWDOWN_SLACK) for m in (24, 36)), worse)

    def gain(name):
        return c(60, name) - c(60, name, "b")

    long_first = (gain("annualized_return") * 18 + gain("sharpe_ratio") * 4 + gain("profit_factor") * 1.2 + gain("win_rate") * 3
                  + F.least(c(60, "num_trades") / 120, F.lit(1.5)) + F.least(c(60, "dir_active_days") / 180, F.lit(1.5))
                  - F.greatest(z, F.abs(c(60, "max_drawdown")) - F.abs(c(60, "max_drawdown", "b"))) * 12 - F.greatest(z, F.coalesce("worst", F.lit(1.0))) * 2)
    score = F.when(c(24, "sharpe_ratio").isNull(), -999.0).otherwise(recent + F.coalesce(mid, z) + F.coalesce(far, z))
    return j.select("symbol", "label", score.alias("promotion_score"), worse.alias("weakened"), long_first.alias("long_first_score"))


@query("p30_promotion_scores", "symbol:s label:s promotion_score:3 weakened:i long_first_score:3", "SELECT * FROM promotion_scores", "P30 P29")
def _(spark, d):
    return promotion_scores(spark, d)


@query("a36_overfit_audit", "symbol:s label:s metric:s margin:5 train_delta:5 neighbours:i",
       """WITH m AS (SELECT symbol, label, months, metric, value FROM (UNPIVOT (SELECT symbol, label, months, CAST(annualized_return - 0.12 AS DOUBLE) AS annualized_return, CAST(sharpe_ratio - 1 AS DOUBLE) AS sharpe_ratio, CAST(win_rate - 0.55 AS DOUBLE) AS win_rate FROM candidates) ON annualized_return, sharpe_ratio, win_rate INTO NAME metric VALUE value)),
          n AS (SELECT symbol, split_part(label, '_mq', 1) AS family, count(*) AS k FROM candidates WHERE months = 60 AND sharpe_ratio > 0 GROUP BY 1, 2)
          SELECT a.symbol, a.label, a.metric, a.value AS margin, a.value - b.value AS train_delta, coalesce(n.k, 0) AS neighbours FROM m a JOIN m b ON b.symbol = a.symbol AND b.label = a.label AND b.metric = a.metric AND b.months = 60
          LEFT JOIN n ON n.symbol = a.symbol AND n.family = split_part(a.label, '_mq', 1) WHERE a.months = 24""", "A36")
def _(spark, d):
    c = candidates(spark, d)
    m = c.select("symbol", "label", "months", (F.col("annualized_return") - 0.12).alias("annualized_return"), (F.col("sharpe_ratio") - 1).alias("sharpe_ratio"), (F.col("win_rate") - 0.55).alias("win_rate"))
    u = m.unpivot(["symbol", "label", "months"], ["annualized_return", "sharpe_ratio", "win_rate"], "metric", "value")
    p = u.groupBy("symbol", "label", "metric").pivot("months", [24, 60]).agg(F.max("value"))
    fam = F.split("label", "_mq").getItem(0)
    near = c.filter("months = 60 AND sharpe_ratio > 0").groupBy("symbol", fam.alias("family")).agg(F.count("*").alias("k"))
    p = p.filter(F.col("24").isNotNull() & F.col("60").isNotNull()).withColumn("family", fam)
    return p.join(near, ["symbol", "family"], "left").select("symbol", "label", "metric", F.col("24").alias("margin"), (F.col("24") - F.col("60")).alias("train_delta"),
                                                             F.coalesce("k", F.lit(0)).alias("neighbours"))


@query("a51_feature_importance", "symbol:s feature:s weight:6 share:6",
       """WITH c AS (SELECT symbol, unnest(['ret5', 'ret20', 'z20', 'vol20', 'vix']) AS feature, unnest([abs(corr(ret5, target_return)), abs(corr(ret20, target_return)), abs(corr(z20, target_return)), abs(corr(vol20, target_return)), abs(corr(vix, target_return))]) AS weight FROM signals WHERE target_return IS NOT NULL AND vol20 IS NOT NULL GROUP BY symbol)
          SELECT *, weight / sum(weight) OVER (PARTITION BY symbol) AS share FROM c""", "A51")
def _(spark, d):
    cols = ["ret5", "ret20", "z20", "vol20", "vix"]
    g = views.signals(spark, d).filter("target_return IS NOT NULL AND vol20 IS NOT NULL").groupBy("symbol").agg(*[F.abs(F.corr(c, "target_return")).alias(c) for c in cols])
    u = g.unpivot("symbol", cols, "feature", "weight")
    return u.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("symbol")))
