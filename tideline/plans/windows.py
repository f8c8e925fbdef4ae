"""Window queries: returns, rolling statistics, technical blocks, folds."""

import math

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import clip, flag, num, sdiv, truth
from tideline.operators import features as feat
from tideline.operators.rolling import (by_symbol, ewm_means, full, gated, limited_fill, pct_change, frame_quantiles, prior_quantile,
                                        rank_in_window, span, trailing)
from tideline.plans.catalog import query
from tideline.plans.sqlviews import add_view, ewm, full as sfull, gated as sgated, pct, prior_q
from tideline.sources import views




@query("w01_row_returns", "symbol:s session:d ret1:8 ret5:8 ret10:8 ret20:8 ret60:8 tnx_chg5:6",
       "SELECT symbol, session, ret1, ret5, ret10, ret20, ret60, tnx_chg5 FROM features", "W01")
def _(spark, d):
    return views.features(spark, d)


@query("w02_rolling_stats", "symbol:s session:d mean20:4 std20:6 sum20:3 max20:6 min20:6 vol_mean10:6",
       f"""SELECT symbol, session, {sfull('avg', 'close', 20)} AS mean20, {sfull('stddev_samp', 'close', 20)} AS std20,
           {sfull('sum', 'close', 20)} AS sum20, {sfull('max', 'close', 20)} AS max20, {sfull('min', 'close', 20)} AS min20,
           {sgated('avg', 'volume', -19, 0, 10)} AS vol_mean10 FROM bars""", "W02")
def _(spark, d):
    return views.bars(spark, d).select(
        "symbol", "session", full(F.avg, "close", 20).alias("mean20"), full(F.stddev_samp, "close", 20).alias("std20"),
        full(F.sum, "close", 20).alias("sum20"), full(F.max, "close", 20).alias("max20"),
        full(F.min, "close", 20).alias("min20"), gated(F.avg, "volume", trailing(20), 10).alias("vol_mean10"))


EMAS = {"ema10": ("close", span(10), 10), "ema20": ("close", span(20), 20), "ema50": ("close", span(50), 50)}


@query("w03_ewm_mean", "symbol:s session:d ema10:4 ema20:4 ema50:4 ema_10_20_spread:8 ema_20_50_spread:8",
       f"""SELECT *, (ema10 - ema20) / nullif(close, 0) AS ema_10_20_spread,
           (ema20 - ema50) / nullif(close, 0) AS ema_20_50_spread FROM ({ewm('bars', EMAS)})""", "W03")
def _(spark, d):
    e = ewm_means(views.bars(spark, d), EMAS)
    return e.select("*", sdiv(F.col("ema10") - F.col("ema20"), "close").alias("ema_10_20_spread"),
                    sdiv(F.col("ema20") - F.col("ema50"), "close").alias("ema_20_50_spread"))


@query("w04_ewm_std", "symbol:s session:d ewm_std60:8",
       """SELECT symbol, session, CASE WHEN n >= 2 THEN sqrt(greatest(m2 - m1 * m1, 0) / (1 - (
             pow(q, 2 * (n - 1)) + pow(1 - q, 2) * (1 - pow(q, 2 * (n - 1))) / (1 - q * q)))) END AS ewm_std60
          FROM (SELECT *, 1.0::DOUBLE - 2.0::DOUBLE / 61 AS q, count(ret1) OVER (PARTITION BY symbol ORDER BY session
             ROWS UNBOUNDED PRECEDING) AS n FROM (""" + ewm(
           "(SELECT symbol, session, ret1, ret1 * ret1 AS retsq FROM features)",
           {"m1": ("ret1", span(60), 1), "m2": ("retsq", span(60), 1)}) + "))", "W04")
def _(spark, d):
    return feat.ewm_std(views.features(spark, d).select("symbol", "session", "ret1"), "ret1", 60, "ewm_std60")


@query("w05_rsi", "symbol:s session:d rsi_wilder:6 rsi_simple:6",
       f"""SELECT symbol, session,
             CASE WHEN ag IS NOT NULL AND al <> 0 THEN 100 - 100 / (1 + ag / al) END AS rsi_wilder,
             CASE WHEN sg IS NOT NULL AND sl <> 0 THEN 100 - 100 / (1 + sg / sl) END AS rsi_simple
           FROM ({ewm(f"(SELECT *, {sfull('avg', 'up', 14)} AS sg, {sfull('avg', 'down', 14)} AS sl FROM (SELECT symbol, session, greatest(chg, 0.0) AS up, greatest(-chg, 0.0) AS down FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY session) AS chg FROM bars) WHERE chg IS NOT NULL))",
                      {"ag": ("up", 1 / 14, 14), "al": ("down", 1 / 14, 14)})})""", "W05")
def _(spark, d):
    return feat.rsi(views.bars(spark, d)).filter("chg IS NOT NULL")


@query("w06_atr", "symbol:s session:d atr14:6 atr_ratio:8",
       f"""SELECT *, atr14 / close AS atr_ratio FROM (SELECT *, {sfull('avg', 'tr', 14)} AS atr14 FROM (
           SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
           FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)))""", "W06")
def _(spark, d):
    return feat.atr(views.bars(spark, d))


add_view("obv_rows", f"""SELECT *, obv - obv_ema AS obv_signal FROM ({ewm("(SELECT *, sum(sgn * volume) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY session)), 0) AS sgn FROM bars))",
            {"obv_ema": ("obv", span(10), 1)})})""")


@query("w07_obv", "symbol:s session:d obv:3 obv_signal:4", "SELECT * FROM obv_rows", "W07")
def _(spark, d):
    return feat.obv(views.bars(spark, d))


@query("w08_macd", "symbol:s session:d macd_line:8 macd_signal:8 macd_hist:8",
       f"""SELECT symbol, session, line / close AS macd_line, sig / close AS macd_signal, (line - sig) / close AS macd_hist
           FROM ({ewm("(SELECT *, e12 - e26 AS line FROM (" + ewm('bars', {"e12": ("close", span(12), 12), "e26": ("close", span(26), 26)}) + "))",
                      {"sig": ("line", span(9), 9)})})""", "W08")
def _(spark, d):
    return feat.macd(views.bars(spark, d))


@query("w09_bollinger", "symbol:s session:d upper_distance:8 lower_distance:8 bandwidth:8 percent_b:6 boll_z:6 price_z:6",
       """SELECT symbol, session, (sma20 + 2 * std20 - close) / close AS upper_distance,
          (close - sma20 + 2 * std20) / close AS lower_distance, 4 * std20 / sma20 AS bandwidth,
          (close - sma20 + 2 * std20) / nullif(4 * std20, 0) AS percent_b,
          (close - sma20) / nullif(2 * std20, 0) AS boll_z, z20 AS price_z FROM features""", "W09")
def _(spark, d):
    return feat.bollinger(views.features(spark, d)).withColumn("price_z", F.col("z20"))


@query("w10_shifted_quantile", "symbol:s session:d cut90:8 shock:i vix_lo:6 vix_hi:6",
       f"""SELECT *, CASE WHEN absret > cut90 THEN 1 ELSE 0 END AS shock FROM (SELECT symbol, session, absret,
           {prior_q('absret', 0.9)} AS cut90, {prior_q('vix', 0.35, 252, 60)} AS vix_lo,
           {prior_q('vix', 0.7, 252, 60)} AS vix_hi FROM (SELECT *, abs(ret1) AS absret FROM features))""", "W10")
def _(spark, d):
    f = views.features(spark, d).withColumn("absret", F.abs("ret1"))
    f = f.select("symbol", "session", "absret", prior_quantile("absret", 0.9).alias("cut90"),
                 frame_quantiles("vix", (0.35, 0.7), trailing(252, -1), 60).alias("v"))
    f = f.select("symbol", "session", "absret", "cut90", F.col("v.q0").alias("vix_lo"), F.col("v.q1").alias("vix_hi"))
    return f.withColumn("shock", flag(F.col("absret") > F.col("cut90")))


def _pair(fn, a, b, n):
    fr = trailing(n)
    return F.when(F.count(F.when(num(a).isNotNull() & num(b).isNotNull(), 1)).over(fr) >= n, fn(a, b).over(fr))


@query("w11_rolling_beta", "symbol:s session:d corr20:6 beta60:6",
       """SELECT symbol, session, CASE WHEN count(ret1) OVER a >= 20 THEN corr(ret1, idx_ret1) OVER a END AS corr20,
          CASE WHEN count(ret1) OVER b >= 60 THEN covar_samp(ret1, idx_ret1) OVER b / nullif(var_samp(idx_ret1) OVER b, 0) END
          AS beta60 FROM features WINDOW
          a AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
          b AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", "W11")
def _(spark, d):
    return views.features(spark, d).select(
        "symbol", "session", _pair(F.corr, "ret1", "idx_ret1", 20).alias("corr20"),
        sdiv(_pair(F.covar_samp, "ret1", "idx_ret1", 60), full(F.var_samp, "idx_ret1", 60)).alias("beta60"))


@query("w12_forward_labels", "symbol:s session:d next_close:8 next_open:8 fwd1:8 fwd3:8 fwd5:8 dir5:s direction:i label_end:d",
       """SELECT symbol, session, lead(close) OVER w / close - 1 AS next_close,
          lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS next_open, lead(close, 1) OVER w / close - 1 AS fwd1,
          lead(close, 3) OVER w / close - 1 AS fwd3, lead(close, 5) OVER w / close - 1 AS fwd5,
          CASE WHEN lead(close, 5) OVER w IS NULL THEN 'unknown' WHEN lead(close, 5) OVER w / close - 1 > 0.005 THEN 'bullish'
               WHEN lead(close, 5) OVER w / close - 1 < -0.005 THEN 'bearish' ELSE 'neutral' END AS dir5,
          CASE WHEN lead(open, 2) OVER w / lead(open, 1) OVER w - 1 > 0 THEN 1 WHEN lead(open, 2) OVER w IS NOT NULL THEN 0 END
          AS direction, lead(session, 2) OVER w AS label_end
          FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)""", "W12 F17")
def _(spark, d):
    return feat.forward_labels(views.bars(spark, d))


@query("w13_shock_and_tail", "symbol:s session:d future_vol:8 prior_vol:8 volatility_shock:i downside_tail:i",
       """SELECT *, CASE WHEN future_vol IS NULL THEN NULL WHEN future_vol > greatest(prior_vol * 1.25, 0.01) THEN 1 ELSE 0 END
            AS volatility_shock, CASE WHEN future_vol IS NULL THEN NULL WHEN worst <= -0.03 THEN 1 ELSE 0 END AS downside_tail
          FROM (SELECT symbol, session, CASE WHEN count(*) OVER f >= 5 THEN stddev_pop(ret1) OVER f END AS future_vol,
            coalesce(stddev_pop(ret1) OVER p, 0) AS prior_vol, least(min(close) OVER f / close - 1, 0) AS worst
          FROM features WINDOW f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
            p AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""", "W13")
def _(spark, d):
    return feat.shock_labels(views.features(spark, d))


@query("w14_research_block", "symbol:s session:d day_range:8 overnight:8 volume_ratio:6 price_ma20:8 price_ma60:8 volume_change:6 vol20:8 vol60:8 research_target:8",
       """SELECT symbol, session, (high - low) / close AS day_range, open / lag(close) OVER w - 1 AS overnight,
          vol_ratio AS volume_ratio, p20 - 1 AS price_ma20, p60 - 1 AS price_ma60,
          CASE WHEN lag(volume) OVER w IS NOT NULL THEN least(greatest(volume / nullif(lag(volume) OVER w, 0) - 1, -0.99), 10.0)
            END AS volume_change, vol20, vol60, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS research_target
          FROM features WINDOW w AS (PARTITION BY symbol ORDER BY session) QUALIFY rn > 60""", "W14")
def _(spark, d):
    return feat.research_block(views.features(spark, d)).filter("rn > 60")


add_view("technical_rows", f"""WITH e AS ({ewm('features', {**EMAS, "e12": ("close", span(12), 12), "e26": ("close", span(26), 26)})}),
           m AS ({ewm('(SELECT *, e12 - e26 AS line FROM e)', {"sig": ("line", span(9), 9)})}),
           r AS ({ewm("(SELECT *, greatest(chg, 0.0) AS up, greatest(-chg, 0.0) AS down FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY session) AS chg, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY session)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY session))) AS tr FROM m) WHERE chg IS NOT NULL)",
                      {"ag": ("up", 1 / 14, 14), "al": ("down", 1 / 14, 14)})}),
           t AS (SELECT *, CASE WHEN al <> 0 THEN 100 - 100 / (1 + ag / al) END AS rsi_14 FROM r)
           SELECT *, {sfull('avg', 'tr', 14)} / close AS atr_ratio, close / ema10 AS ema_10_ratio, close / ema20 AS ema_20_ratio,
             close / ema50 AS ema_50_ratio, (line - sig) / close AS macd_hist,
             CASE WHEN close = {sfull('max', 'close', 20)} AND rsi_14 < lag(rsi_14, 5) OVER (PARTITION BY symbol ORDER BY session)
               THEN 1 ELSE 0 END AS rsi_divergence FROM t""")


@query("w15_technical_block", "symbol:s session:d p20:8 p60:8 z20:6 vol20:8 vol60:8 vol_ratio:6 atr_ratio:8 ema_10_ratio:8 ema_20_ratio:8 ema_50_ratio:8 macd_hist:8 rsi_14:6 rsi_divergence:i", "SELECT * FROM technical_rows WHERE rn > 60", "W15 J01")
def _(spark, d):
    return feat.technical_block(views.features(spark, d)).filter("rn > 60")


@query("w16_external_block", "symbol:s session:d vix:6 vix_chg5:6 idx_ret5:8 idx_ret1:8 tnx:6 tnx_chg5:6 spread_proxy:8",
       """SELECT symbol, session, vix, vix_chg5, idx_ret5, idx_ret1, tnx / 10 AS tnx, tnx_chg5 / 10 AS tnx_chg5,
          -(r / lag(r, 5) OVER (PARTITION BY symbol ORDER BY session) - 1) AS spread_proxy
          FROM (SELECT *, idx / nullif(tnx, 0) AS r FROM features)""", "W16")
def _(spark, d):
    f = views.features(spark, d).withColumn("r", sdiv("idx", "tnx"))
    return f.select("symbol", "session", "vix", "vix_chg5", "idx_ret5", "idx_ret1", (F.col("tnx") / 10).alias("tnx"),
                    (F.col("tnx_chg5") / 10).alias("tnx_chg5"), (-pct_change("r", 5)).alias("spread_proxy"))


add_view("states", f"""
SELECT *, CASE WHEN hv = 1 THEN 0.6 * ret5 + 0.4 * ret10 WHEN td = 1 THEN ret10
            WHEN tu = 1 THEN 0.5 * ret20 + 0.5 * ret60 ELSE ret20 END AS adaptive_momentum,
       CASE WHEN hv = 1 THEN 0.50 WHEN lv = 1 AND tu = 1 THEN 1.15 WHEN td = 1 THEN 0.70 ELSE 1.0 END AS risk_budget
FROM (SELECT *, CASE WHEN vix > vq70 THEN 1 ELSE 0 END AS hv, CASE WHEN vix < vq30 THEN 1 ELSE 0 END AS lv,
        CASE WHEN p20 > 1 AND p60 > 1 AND ret20 > 0 THEN 1 ELSE 0 END AS tu,
        CASE WHEN p20 < 1 AND p60 < 1 AND ret20 < 0 THEN 1 ELSE 0 END AS td
      FROM (SELECT *, {prior_q('vix', 0.7)} AS vq70, {prior_q('vix', 0.3)} AS vq30 FROM features))""")


@query("w17_market_state", "symbol:s session:d hv:i lv:i tu:i td:i adaptive_momentum:8 risk_budget:4",
       "SELECT * FROM states", "W17")
def _(spark, d):
    return feat.market_state(views.features(spark, d))


add_view("calendar_rows", """SELECT *, CASE WHEN next_gap >= 3 AND next_holiday = 1 THEN 1 ELSE 0 END AS pre_holiday,
            CASE WHEN prev_gap >= 3 AND prev_holiday = 1 THEN 1 ELSE 0 END AS post_holiday,
            CASE WHEN next_gap >= 3 AND next_holiday = 1 THEN ret5 ELSE 0 END AS pre_holiday_momentum
          FROM (SELECT symbol, session, ret5, greatest(coalesce(nx - session, 1), 1) AS next_gap,
            greatest(coalesce(session - pv, 1), 1) AS prev_gap,
            CASE WHEN nx IS NOT NULL AND EXISTS (SELECT 1 FROM range(1, 5000) t(i) WHERE i < nx - session AND isodow(session + CAST(i AS INT)) <= 5) THEN 1 ELSE 0 END AS next_holiday,
            CASE WHEN pv IS NOT NULL AND EXISTS (SELECT 1 FROM range(1, 5000) t(i) WHERE i < session - pv AND isodow(pv + CAST(i AS INT)) <= 5) THEN 1 ELSE 0 END AS prev_holiday,
            CASE WHEN open_days < (SELECT count(*) FROM range(-2, 6) t(i) WHERE isodow(session + CAST(i AS INT)) <= 5) THEN 1 ELSE 0 END AS holiday_week
          FROM (SELECT symbol, session, ret5, lead(session) OVER w AS nx, lag(session) OVER w AS pv,
            count(*) FILTER (isodow(session) <= 5) OVER (PARTITION BY symbol ORDER BY session RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 5 DAY FOLLOWING) AS open_days
            FROM features WINDOW w AS (PARTITION BY symbol ORDER BY session)))""")


@query("w18_calendar_block", "symbol:s session:d next_gap:i prev_gap:i next_holiday:i prev_holiday:i pre_holiday:i post_holiday:i holiday_week:i pre_holiday_momentum:8", "SELECT * FROM calendar_rows", "W18 U05")
def _(spark, d):
    return feat.calendar_block(views.features(spark, d))


@query("w19_sentiment_history", "session:d rv20:6 dist200:6 term:6 tnx_1m:6 yoy:6 filled:6 filled5:6",
       f"""WITH m AS (SELECT *, 1 AS k, idx / lag(idx) OVER (ORDER BY session) - 1 AS r,
             CASE WHEN vix > 20 THEN vix END AS gappy FROM market)
           SELECT session, {sfull('stddev_samp', 'r', 20, 'k')} * sqrt(252) AS rv20, idx / {sfull('avg', 'idx', 200, 'k')} - 1 AS dist200,
             vix - tnx / 4 AS term, tnx - lag(tnx, 21) OVER (ORDER BY session) AS tnx_1m,
             idx / lag(idx, 252) OVER (ORDER BY session) - 1 AS yoy,
             last_value(gappy IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS filled,
             last_value(gappy IGNORE NULLS) OVER (ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS filled5
           FROM m""", "W19")
def _(spark, d):
    m = views.market(spark, d).withColumn("k", F.lit(1))
    w = Window.partitionBy("k").orderBy("session")
    m = m.withColumn("r", pct_change("idx", 1, w)).withColumn("gappy", F.when(F.col("vix") > 20, F.col("vix")))
    return m.select("session", (full(F.stddev_samp, "r", 20, w) * math.sqrt(252)).alias("rv20"),
                    (sdiv("idx", full(F.avg, "idx", 200, w)) - 1).alias("dist200"), (F.col("vix") - F.col("tnx") / 4).alias("term"),
                    (F.col("tnx") - F.lag("tnx", 21).over(w)).alias("tnx_1m"), pct_change("idx", 252, w).alias("yoy"),
                    limited_fill("gappy", 21, w).alias("filled"), limited_fill("gappy", 5, w).alias("filled5"))


@query("w20_drawdown", "symbol:s session:d drawdown:8",
       """SELECT symbol, session, close / max(close) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
          FROM bars""", "W20")
def _(spark, d):
    up = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return views.bars(spark, d).select("symbol", "session", (F.col("close") / F.max("close").over(up) - 1).alias("drawdown"))


@query("w21_equity_curve", "strategy:s symbol:s session:d equity:2",
       """SELECT strategy, symbol, session, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)) AS equity
          FROM net_returns""", "W21")
def _(spark, d):
    up = Window.partitionBy("strategy", "symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return views.net_returns(spark, d).select("strategy", "symbol", "session",
                                              F.exp(F.sum(F.log1p("net")).over(up)).alias("equity"))


add_view("intraday_features", """
SELECT *, sum((high + low + close) / 3.0 * volume) OVER s / nullif(sum(volume) OVER s, 0) AS vwap,
       close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret5, close / nullif(lag(close, 15) OVER w, 0) - 1 AS ret15,
       (close - min(low) OVER s) / nullif(max(high) OVER s - min(low) OVER s, 0) AS range_pos,
       CASE WHEN count(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5
             AND count(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) >= 10
        THEN avg(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
          / avg(volume) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) END AS volume_accel
FROM (SELECT symbol, bar, CAST(timezone('America/New_York', bar AT TIME ZONE 'UTC') AS DATE) AS session_ny,
             open, high, low, close, nullif(volume, 0) AS volume FROM intraday)
WINDOW s AS (PARTITION BY symbol, session_ny ORDER BY bar ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY symbol ORDER BY bar)""")


@query("w22_session_vwap", "symbol:s bar:t session_ny:d vwap:6 vwap_gap:8 range_pos:6",
       "SELECT *, close / vwap - 1 AS vwap_gap FROM intraday_features", "W22 F13")
def _(spark, d):
    return feat.intraday_features(views.intraday(spark, d)).withColumn("vwap_gap", F.col("close") / F.col("vwap") - 1)


@query("w23_volume_acceleration", "symbol:s bar:t volume_accel:6", "SELECT * FROM intraday_features", "W23")
def _(spark, d):
    return feat.intraday_features(views.intraday(spark, d))


add_view("intraday_scored", """
SELECT *, CASE WHEN micro_score >= 2 THEN 1 WHEN micro_score <= -2 THEN -1 ELSE 0 END AS signal FROM (
 SELECT *, (CASE WHEN ret5 > 0.001 THEN 1 WHEN ret5 < -0.001 THEN -1 ELSE 0 END)
   + (CASE WHEN ret15 > 0.002 THEN 1 WHEN ret15 < -0.002 THEN -1 ELSE 0 END)
   + (CASE WHEN close / vwap - 1 > 0.0005 THEN 1 WHEN close / vwap - 1 < -0.0005 THEN -1 ELSE 0 END)
   + (CASE WHEN range_pos > 0.68 THEN 1 WHEN range_pos < 0.32 THEN -1 ELSE 0 END)
   + (CASE WHEN volume_accel > 1.35 THEN sign(coalesce(ret5, 0)) ELSE 0 END) AS micro_score FROM intraday_features)""")


@query("w24_micro_score", "symbol:s bar:t micro_score:i signal:i inverse_signal:i",
       "SELECT *, -signal AS inverse_signal FROM intraday_scored", "W24")
def _(spark, d):
    return feat.micro_score(feat.intraday_features(views.intraday(spark, d))).withColumn("inverse_signal", -F.col("signal"))


@query("w25_rolling_rank", "symbol:s session:d rank60:6",
       """SELECT symbol, session, CASE WHEN len(l) >= 20 THEN (len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2.0) / len(l) END AS rank60
          FROM (SELECT symbol, session, volume AS x, list(volume) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM bars)""", "W25")
def _(spark, d):
    return views.bars(spark, d).select("symbol", "session", rank_in_window("volume", 60, 20).alias("rank60"))


@query("w26_history_rank", "session:d expanding_pct:6 trailing_pct:6 trailing_z:6",
       """SELECT session, CASE WHEN len(e) >= 20 THEN len(list_filter(e, lambda v: v <= x)) * 100.0 / len(e) END AS expanding_pct,
            len(list_filter(t, lambda v: v <= x)) * 100.0 / len(t) AS trailing_pct, z AS trailing_z
          FROM (SELECT session, vix AS x, list(vix) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS e,
            list(vix) OVER (ORDER BY session ROWS BETWEEN 259 PRECEDING AND CURRENT ROW) AS t,
            (vix - avg(vix) OVER w) / nullif(stddev_samp(vix) OVER w, 0) AS z FROM market
            WINDOW w AS (ORDER BY session ROWS BETWEEN 259 PRECEDING AND CURRENT ROW))""", "W26 S23")
def _(spark, d):
    w = Window.orderBy("session")
    t = w.rowsBetween(-259, 0)

    def share(frame):
        values = F.collect_list("vix").over(frame)
        return F.size(F.filter(values, lambda v: v <= F.col("vix"))) * 100.0 / F.size(values)

    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return views.market(spark, d).select(
        "session", F.when(F.count("vix").over(up) >= 20, share(up)).alias("expanding_pct"), share(t).alias("trailing_pct"),
        sdiv(F.col("vix") - F.avg("vix").over(t), F.stddev_samp("vix").over(t)).alias("trailing_z"))


@query("w34_position_changes", "strategy:s symbol:s entries:i exits:i turnover:4",
       """SELECT strategy, symbol, sum(CASE WHEN chg > 0 THEN 1 ELSE 0 END) AS entries, sum(CASE WHEN chg < 0 THEN 1 ELSE 0 END) AS exits,
          sum(abs(chg)) AS turnover FROM (SELECT *, target - coalesce(lag(target) OVER (PARTITION BY strategy, symbol ORDER BY session), 0) AS chg
          FROM strategies) GROUP BY 1, 2""", "W34")
def _(spark, d):
    w = Window.partitionBy("strategy", "symbol").orderBy("session")
    c = views.strategies(spark, d).withColumn("chg", F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0.0)))
    return c.groupBy("strategy", "symbol").agg(F.sum(flag(F.col("chg") > 0)).alias("entries"),
                                               F.sum(flag(F.col("chg") < 0)).alias("exits"),
                                               F.sum(F.abs("chg")).alias("turnover"))


@query("w35_rolling_sharpe", "strategy:s symbol:s session:d sharpe63:5",
       f"""SELECT strategy, symbol, session, {sfull('avg', 'net', 63, 'strategy, symbol')} * sqrt(252)
             / CASE WHEN {sfull('stddev_samp', 'net', 63, 'strategy, symbol')} > 1e-12 THEN {sfull('stddev_samp', 'net', 63, 'strategy, symbol')} END AS sharpe63 FROM net_returns""", "W35")
def _(spark, d):
    w = by_symbol("strategy", "symbol")
    sd = full(F.stddev_samp, "net", 63, w)
    return views.net_returns(spark, d).select("strategy", "symbol", "session", (
        full(F.avg, "net", 63, w) * math.sqrt(252) / F.when(sd > 1e-12, sd)).alias("sharpe63"))


@query("w37_array_windows", "symbol:s session:d n:i last_over_first:8 last5_mean:6 rising:i window_high:6",
       """SELECT symbol, session, len(l) AS n, l[-1] / l[1] - 1 AS last_over_first, list_avg(l[-5:]) AS last5_mean,
            len(list_filter(range(2, len(l) + 1), lambda i: l[i] > l[i - 1])) AS rising, list_max(l) AS window_high
          FROM (SELECT symbol, session, list(close) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM bars)""", "W37 F15")
def _(spark, d):
    return feat.array_window_features(views.bars(spark, d))


add_view("peers", """
SELECT session, avg(ret1) AS mean1, avg(ret5) AS mean5, quantile_cont(ret1, 0.5) AS median1, quantile_cont(ret5, 0.5) AS median5,
       stddev_samp(ret5) AS disp5, avg(CASE WHEN ret1 > 0 THEN 1.0 ELSE 0.0 END) AS breadth1,
       avg(CASE WHEN ret5 > 0 THEN 1.0 ELSE 0.0 END) AS breadth5, avg(CASE WHEN close > sma20 THEN 1.0 ELSE 0.0 END) AS above20, count(*) AS n
FROM features GROUP BY 1""")

add_view("shocks", f"""
SELECT session, sum(shock) AS shock_count, sum(up_move) AS positive, sum(down_move) AS negative, sum(up_move) - sum(down_move) AS net,
       coalesce(max(CASE WHEN shock = 1 THEN abs(ret1) END), 0) AS max_abs, coalesce(avg(CASE WHEN shock = 1 THEN ret1 END), 0) AS mean_ret,
       sum(spike) AS spikes
FROM (SELECT *, CASE WHEN shock = 1 AND ret1 > 0 THEN 1 ELSE 0 END AS up_move, CASE WHEN shock = 1 AND ret1 < 0 THEN 1 ELSE 0 END AS down_move
      FROM (SELECT *, CASE WHEN absret > cut_move OR vol_ratio > cut_vol THEN 1 ELSE 0 END AS shock,
                   CASE WHEN vol_ratio > cut_vol THEN 1 ELSE 0 END AS spike
            FROM (SELECT *, {prior_q('absret', 0.9)} AS cut_move, {prior_q('vol_ratio', 0.9)} AS cut_vol
                  FROM (SELECT *, abs(ret1) AS absret FROM features)))) GROUP BY 1""")


@query("w38_relative_strength", "symbol:s session:d vs_mean5:8 vs_median5:8 after_positive:i after_negative:i",
       """SELECT f.symbol, f.session, f.ret5 - p.mean5 AS vs_mean5, f.ret5 - p.median5 AS vs_median5,
            CASE WHEN lag(s.net) OVER w > 0 AND f.ret1 > 0 THEN 1 ELSE 0 END AS after_positive,
            CASE WHEN lag(s.net) OVER w < 0 AND f.ret1 < 0 THEN 1 ELSE 0 END AS after_negative
          FROM features f JOIN peers p USING (session) JOIN shocks s USING (session) WINDOW w AS (PARTITION BY f.symbol ORDER BY f.session)""", "W38")
def _(spark, d):
    f = views.features(spark, d)
    p = feat.peer_cross_section(f)
    s = feat.peer_shocks(f).select("session", "net")
    j = f.join(p, "session").join(s, "session")
    return j.select("symbol", "session", (F.col("ret5") - F.col("mean5")).alias("vs_mean5"),
                    (F.col("ret5") - F.col("median5")).alias("vs_median5"),
                    flag((F.lag("net").over(by_symbol()) > 0) & (F.col("ret1") > 0)).alias("after_positive"),
                    flag((F.lag("net").over(by_symbol()) < 0) & (F.col("ret1") < 0)).alias("after_negative"))
