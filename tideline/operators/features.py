"""Feature blocks over daily and intraday bars. All frames end at the current row or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.numeric import clip, flag, num, sdiv, truth
from tideline.operators.rolling import (by_symbol, ewm_means, full, gated, pct_change, frame_quantiles, prior_quantile, span, trailing)


def ewm_std(df: DataFrame, x: str, n: int, out: str, key: str = "symbol", order: str = "session") -> DataFrame:
    """Bias-corrected exponentially weighted standard deviation from the first two moments."""
    a = span(n)
    q = 1.0 - a
    cols = df.columns
    m = ewm_means(df.withColumn("_sq", F.col(x) * F.col(x)), {"_m1": (x, a, 1), "_m2": ("_sq", a, 1)}, key, order)
    seen = F.count(x).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("_n", seen)
    tail = F.pow(F.lit(q), (F.col("_n") - 1) * 2)
    squared_weights = tail + F.lit(a * a / (1 - q * q)) * (F.lit(1.0) - tail)
    var = F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)) / (F.lit(1.0) - squared_weights)
    return m.select(*cols, F.when(F.col("_n") >= 2, F.sqrt(var)).alias(out))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength in Wilder form and with simple rolling means."""
    chg = F.col("close") - F.lag("close").over(by_symbol())
    base = bars.withColumn("chg", chg).select(
        "*", F.when(F.col("chg").isNotNull(), F.greatest(F.col("chg"), F.lit(0.0))).alias("up"),
        F.when(F.col("chg").isNotNull(), F.greatest(-F.col("chg"), F.lit(0.0))).alias("down"))
    m = ewm_means(base, {"_g": ("up", 1 / n, n), "_l": ("down", 1 / n, n)})
    m = m.select("*", full(F.avg, "up", n).alias("_sg"), full(F.avg, "down", n).alias("_sl"))
    return m.select(*base.columns, (F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + sdiv("_g", "_l"))).alias("rsi_wilder"),
                    (F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + sdiv("_sg", "_sl"))).alias("rsi_simple"))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    prev = F.lag("close").over(by_symbol())
    t = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    t = t.withColumn(f"atr{n}", full(F.avg, "tr", n))
    return t.withColumn("atr_ratio", sdiv(f"atr{n}", "close"))


def obv(bars: DataFrame) -> DataFrame:
    w = by_symbol()
    sgn = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0))
    o = bars.withColumn("_flow", sgn * F.col("volume")).withColumn(
        "obv", F.sum("_flow").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ewm_means(o, {"_e": ("obv", span(10), 1)}).withColumn("obv_signal", F.col("obv") - F.col("_e"))


def macd(bars: DataFrame) -> DataFrame:
    m = ewm_means(bars, {"_e12": ("close", span(12), 12), "_e26": ("close", span(26), 26)})
    m = m.withColumn("_line", F.col("_e12") - F.col("_e26"))
    m = ewm_means(m, {"_sig": ("_line", span(9), 9)})
    return m.select(*bars.columns, sdiv("_line", "close").alias("macd_line"), sdiv("_sig", "close").alias("macd_signal"),
                    sdiv(F.col("_line") - F.col("_sig"), "close").alias("macd_hist"))


def bollinger(f: DataFrame) -> DataFrame:
    """Distances to the two-sigma band, expressed on the 20-row mean and sample deviation."""
    upper = F.col("sma20") + 2 * F.col("std20")
    lower = F.col("sma20") - 2 * F.col("std20")
    return f.select(
        "*", sdiv(upper - F.col("close"), "close").alias("upper_distance"),
        sdiv(F.col("close") - lower, "close").alias("lower_distance"), sdiv(upper - lower, "sma20").alias("bandwidth"),
        sdiv(F.col("close") - lower, upper - lower).alias("percent_b"),
        sdiv(F.col("close") - F.col("sma20"), 2 * F.col("std20")).alias("boll_z"))


def forward_labels(bars: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Outcomes known only after the row; never to be joined to features before maturity."""
    w = by_symbol()
    fwd = {n: sdiv(F.lead("close", n).over(w), "close") - 1 for n in (1, 3, 5)}
    open_ret = sdiv(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1
    out = bars.select("symbol", "session", fwd[1].alias("next_close"), open_ret.alias("next_open"),
                      *[c.alias(f"fwd{n}") for n, c in fwd.items()], F.lead("session", 2).over(w).alias("label_end"))
    return out.select("*", direction_label("fwd5", threshold).alias("dir5"),
                      F.when(F.col("next_open").isNotNull(), (F.col("next_open") > 0).cast("int")).alias("direction"))


def direction_label(x, threshold: float):
    c = num(x)
    return (F.when(c.isNull(), "unknown").when(c > threshold, "bullish").when(c < -threshold, "bearish")
            .otherwise("neutral"))


def shock_labels(f: DataFrame, horizon: int = 5, multiple: float = 1.25, tail: float = -0.03) -> DataFrame:
    w = by_symbol()
    ahead = w.rowsBetween(1, horizon)
    out = f.select(
        "symbol", "session", F.when(F.count(F.lit(1)).over(ahead) >= horizon, F.stddev_pop("ret1").over(ahead)).alias("future_vol"),
        F.coalesce(F.stddev_pop("ret1").over(trailing(20)), F.lit(0.0)).alias("prior_vol"),
        F.least(F.min("close").over(ahead) / F.col("close") - 1, F.lit(0.0)).alias("worst"))
    mature = F.col("future_vol").isNotNull()
    return out.select(
        "*", F.when(mature, (F.col("future_vol") > F.greatest(F.col("prior_vol") * multiple, F.lit(0.01))).cast("int"))
        .alias("volatility_shock"), F.when(mature, (F.col("worst") <= tail).cast("int")).alias("downside_tail"))


def research_block(f: DataFrame) -> DataFrame:
    w = by_symbol()
    return f.select(
        "symbol", "session", "rn", sdiv(F.col("high") - F.col("low"), "close").alias("day_range"),
        (sdiv("open", F.lag("close").over(w)) - 1).alias("overnight"), F.col("vol_ratio").alias("volume_ratio"),
        (F.col("p20") - 1).alias("price_ma20"), (F.col("p60") - 1).alias("price_ma60"),
        clip(pct_change("volume", 1), -0.99, 10.0).alias("volume_change"), "vol20", "vol60",
        "ret1", "ret5", "ret20", "ret60", F.lead("session", 2).over(w).alias("label_end_at"),
        (sdiv(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1).alias("research_target"))


def technical_block(f: DataFrame) -> DataFrame:
    """Thirty-odd technical columns; all means of the close come from one blocked recursion."""
    w = by_symbol()
    prev = F.lag("close").over(w)
    chg = F.col("close") - prev
    t = f.withColumn("_chg", chg).withColumn(
        "tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    t = t.select("*", F.when(F.col("_chg").isNotNull(), F.greatest(F.col("_chg"), F.lit(0.0))).alias("_up"),
                 F.when(F.col("_chg").isNotNull(), F.greatest(-F.col("_chg"), F.lit(0.0))).alias("_down"))
    t = ewm_means(t, {**{f"_e{n}": ("close", span(n), n) for n in (10, 12, 20, 26, 50)},
                      "_g": ("_up", 1 / 14, 14), "_l": ("_down", 1 / 14, 14)})
    t = ewm_means(t.withColumn("_line", F.col("_e12") - F.col("_e26")), {"_sig": ("_line", span(9), 9)})
    t = t.withColumn("rsi_14", F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + sdiv("_g", "_l")))
    top = F.col("close") == full(F.max, "close", 20)
    return t.select(
        "*", sdiv(full(F.avg, "tr", 14), "close").alias("atr_ratio"),
        *[sdiv("close", f"_e{n}").alias(f"ema_{n}_ratio") for n in (10, 20, 50)],
        sdiv(F.col("_e10") - F.col("_e20"), "close").alias("ema_10_20_spread"),
        sdiv(F.col("_e20") - F.col("_e50"), "close").alias("ema_20_50_spread"),
        sdiv("_line", "close").alias("macd_line"), sdiv("_sig", "close").alias("macd_signal"),
        sdiv(F.col("_line") - F.col("_sig"), "close").alias("macd_hist"),
        flag(top & (F.col("rsi_14") < F.lag("rsi_14", 5).over(w))).alias("rsi_divergence"))


def market_state(f: DataFrame) -> DataFrame:
    """Regime flags with shifted quantile cut-offs, adaptive momentum and risk budget."""
    s = f.select("*", frame_quantiles("vix", (0.7, 0.3), trailing(126, -1), 40).alias("_v"))
    s = s.select("*", F.col("_v.q0").alias("vq70"), F.col("_v.q1").alias("vq30")).drop("_v")
    s = s.select(
        "*", flag(F.col("vix") > F.col("vq70")).alias("hv"), flag(F.col("vix") < F.col("vq30")).alias("lv"),
        flag((F.col("p20") > 1) & (F.col("p60") > 1) & (F.col("ret20") > 0)).alias("tu"),
        flag((F.col("p20") < 1) & (F.col("p60") < 1) & (F.col("ret20") < 0)).alias("td"))
    on = {c: F.col(c) == 1 for c in ("hv", "lv", "tu", "td")}
    return s.select(
        "*", F.when(on["hv"], 0.6 * F.col("ret5") + 0.4 * F.col("ret10")).when(on["td"], F.col("ret10"))
        .when(on["tu"], 0.5 * F.col("ret20") + 0.5 * F.col("ret60")).otherwise(F.col("ret20")).alias("adaptive_momentum"),
        F.when(on["hv"], 0.50).when(on["lv"] & on["tu"], 1.15).when(on["td"], 0.70).otherwise(1.0).alias("risk_budget"))


def _weekdays_through(day):
    """Number of weekdays from a fixed Monday up to and including a date: gaps become a difference."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))  # fixed value: 1900-01-01 was a Monday
    return F.floor((n + 1) / 7) * 5 + F.least(F.pmod(n + 1, F.lit(7)), F.lit(5))


def calendar_block(f: DataFrame) -> DataFrame:
    """Gaps and holidays of each symbol's own calendar; a holiday is a weekday without a session."""
    w = by_symbol()
    nx, pv = F.lead("session").over(w), F.lag("session").over(w)
    day = F.datediff("session", F.lit("1970-01-01").cast("date"))
    near = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-2, 5)
    g = f.withColumn("_day", day).select(
        "symbol", "session", "ret5", nx.alias("_nx"), pv.alias("_pv"),
        F.sum((F.weekday("session") < 5).cast("int")).over(near).alias("_open"))

    def missed(a, b):
        return flag(_weekdays_through(F.date_sub(b, 1)) - _weekdays_through(a) > 0)

    expected = _weekdays_through(F.date_add("session", 5)) - _weekdays_through(F.date_sub("session", 3))
    g = g.select(
        "symbol", "session", "ret5", F.greatest(F.coalesce(F.datediff("_nx", "session"), F.lit(1)), F.lit(1)).alias("next_gap"),
        F.greatest(F.coalesce(F.datediff("session", "_pv"), F.lit(1)), F.lit(1)).alias("prev_gap"),
        missed(F.col("session"), F.col("_nx")).alias("next_holiday"), missed(F.col("_pv"), F.col("session")).alias("prev_holiday"),
        flag(F.col("_open") < expected).alias("holiday_week"))
    pre = (F.col("next_gap") >= 3) & (F.col("next_holiday") == 1)
    return g.select("*", flag(pre).alias("pre_holiday"),
                    flag((F.col("prev_gap") >= 3) & (F.col("prev_holiday") == 1)).alias("post_holiday"),
                    F.when(pre, F.col("ret5")).otherwise(0.0).alias("pre_holiday_momentum"))


def intraday_features(bars: DataFrame) -> DataFrame:
    """Cumulative session values restart with the New York date; windows over one session only."""
    b = bars.select("symbol", "bar", F.to_date(F.from_utc_timestamp(F.col("bar").cast("timestamp"), "America/New_York"))
                    .alias("session_ny"), "open", "high", "low", "close", F.nullif("volume", F.lit(0.0)).alias("volume"))
    s = Window.partitionBy("symbol", "session_ny").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy("symbol").orderBy("bar")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    hi, lo = F.max("high").over(s), F.min("low").over(s)
    return b.select(
        "*", sdiv(F.sum(typical * F.col("volume")).over(s), F.sum("volume").over(s)).alias("vwap"),
        pct_change("close", 5, w).alias("ret5"), pct_change("close", 15, w).alias("ret15"),
        sdiv(F.col("close") - lo, hi - lo).alias("range_pos"),
        sdiv(gated(F.avg, "volume", trailing(5, 0, w), 5), gated(F.avg, "volume", trailing(20, -5, w), 10)).alias("volume_accel"))


def _tri(x, up: float, down: float):
    c = num(x)
    return F.when(c > up, 1).when(c < down, -1).otherwise(0)


def micro_score(f: DataFrame, threshold: int = 2) -> DataFrame:
    score = (_tri("ret5", 0.001, -0.001) + _tri("ret15", 0.002, -0.002)
             + _tri(F.col("close") / F.col("vwap") - 1, 0.0005, -0.0005) + _tri("range_pos", 0.68, 0.32)
             + F.when(F.col("volume_accel") > 1.35, F.signum(F.coalesce("ret5", F.lit(0.0))).cast("int")).otherwise(0))
    s = f.withColumn("micro_score", score)
    return s.withColumn("signal", _tri("micro_score", threshold - 0.5, -threshold + 0.5))


def array_window_features(bars: DataFrame, n: int = 20) -> DataFrame:
    """Features of the stored pre-event window, computed on the array itself."""
    a = bars.select("symbol", "session", F.collect_list("close").over(trailing(n)).alias("v"))
    tail = F.slice("v", F.greatest(F.size("v") - 4, F.lit(1)), 5)
    steps = F.zip_with(F.slice("v", 2, n), F.slice("v", 1, n), lambda x, y: (x > y).cast("int"))
    return a.select(
        "symbol", "session", F.size("v").alias("n"),
        (F.element_at("v", -1) / F.element_at("v", 1) - 1).alias("last_over_first"),
        (F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)).alias("last5_mean"),
        F.aggregate(steps, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))).alias("rising"), F.array_max("v").alias("window_high"))


def peer_cross_section(f: DataFrame) -> DataFrame:
    """One row per session over all peers: mean, median, dispersion, breadth."""
    return f.groupBy("session").agg(
        F.avg("ret1").alias("mean1"), F.avg("ret5").alias("mean5"), F.percentile("ret1", 0.5).alias("median1"),
        F.percentile("ret5", 0.5).alias("median5"), F.stddev_samp("ret5").alias("disp5"),
        F.avg(flag(F.col("ret1") > 0)).alias("breadth1"), F.avg(flag(F.col("ret5") > 0)).alias("breadth5"),
        F.avg(flag(F.col("close") > F.col("sma20"))).alias("above20"), F.count("*").alias("n"))


def peer_shocks(f: DataFrame) -> DataFrame:
    """Counts of unusual peer moves per session, each against its own shifted cut-off."""
    s = f.withColumn("absret", F.abs("ret1")).select(
        "session", "ret1", "absret", "vol_ratio", prior_quantile("absret", 0.9).alias("cut_move"),
        prior_quantile("vol_ratio", 0.9).alias("cut_vol"))
    spike = truth(F.col("vol_ratio") > F.col("cut_vol"))
    s = s.withColumn("shock", truth(F.col("absret") > F.col("cut_move")) | spike).withColumn("spike", spike)
    return s.groupBy("session").agg(
        F.sum(flag(F.col("shock"))).alias("shock_count"), F.sum(flag(F.col("shock") & (F.col("ret1") > 0))).alias("positive"),
        F.sum(flag(F.col("shock") & (F.col("ret1") < 0))).alias("negative"),
        (F.sum(flag(F.col("shock") & (F.col("ret1") > 0))) - F.sum(flag(F.col("shock") & (F.col("ret1") < 0)))).alias("net"),
        F.coalesce(F.max(F.when(F.col("shock"), F.col("absret"))), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.avg(F.when(F.col("shock"), F.col("ret1"))), F.lit(0.0)).alias("mean_ret"),
        F.sum(flag(F.col("spike"))).alias("spikes"))
