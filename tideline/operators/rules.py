"""Rule grid evaluated as data: thresholds once per (key, fold, quantile), rules as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions.numeric import clip

# The searched quantiles and the optional predicates, in SQL that reads columns of the rule frame and
# training cut-offs of the fold.
MOMENTUM = ("ret20", "z20")
QUANTILES = ((0.65, 0.55), (0.55, 0.50), (0.60, 0.60), (0.70, 0.65), (0.75, 0.50))  # momentum, volume
PREDICATES = {
    "sector_up": "sector_ret1 > 0", "index_up": "idx_ret1 > 0", "market_up": "idx_ret5 > 0", "macd_up": "macd_hist > 0",
    "obv_up": "obv_signal > 0", "vol_calm": "vol20 < vol60 * 1.10", "rsi_cap": "rsi_14 < 72", "floor60": "p60 > 1.00",
    "breadth": "breadth5 >= 0.55", "peer_mean": "mean5 > 0", "peer_net": "net3 >= 0", "no_stress": "stress <= stress_cut",
    "vix_cap": "vix_chg5 < vix_cut", "no_bad_holiday": "NOT (pre_holiday = 1 AND pre_holiday_momentum < 0)"}
SETS = ((), ("sector_up",), ("index_up",), ("sector_up", "index_up"), ("sector_up", "market_up"), ("sector_up", "macd_up"),
        ("sector_up", "obv_up"), ("sector_up", "vol_calm"), ("sector_up", "index_up", "no_bad_holiday"), ("sector_up", "breadth"),
        ("sector_up", "peer_mean"), ("sector_up", "peer_net"), ("sector_up", "no_stress"), ("rsi_cap", "floor60"), ("vix_cap",))
STRESS_Q, VIX_Q = 0.75, 0.80


def percent(q: float) -> int:
    return round(q * 100)


def rule_grid() -> list[dict]:
    """Every quantile pair without predicates and every predicate set at the first pair, for each momentum."""
    pairs = [(q, ()) for q in QUANTILES] + [(QUANTILES[0], s) for s in SETS[1:]]
    return [{"label": f"{m}_mq{mq:.2f}_vq{vq:.2f}_{'+'.join(s) or 'base'}", "m": m, "mq": mq, "vq": vq, "set": s}
            for m in MOMENTUM for (mq, vq), s in pairs]


def cut_columns() -> list[tuple[str, str, float]]:
    """(name, column, quantile) of every training cut-off that any rule needs."""
    cuts = [(f"{m}_{percent(q)}", m, q) for m in MOMENTUM for q in sorted({mq for mq, _ in QUANTILES})]
    cuts += [(f"vol_{percent(q)}", "vol_ratio", q) for q in sorted({vq for _, vq in QUANTILES})]
    return [*cuts, ("stress_cut", "stress", STRESS_Q), ("vix_cut", "vix_chg5", VIX_Q)]


def mask_sql(rule: dict) -> str:
    """The rule as SQL over the rule frame and the cut-offs; the same text serves Spark and its twin."""
    terms = [f"{rule['m']} > {rule['m']}_{percent(rule['mq'])}", f"vol_ratio > vol_{percent(rule['vq'])}"]
    return "coalesce(" + " AND ".join(terms + [f"({PREDICATES[p]})" for p in rule["set"]]) + ", false)"


def fold_thresholds(folds: DataFrame) -> DataFrame:
    """Every training quantile any rule needs, in one aggregation."""
    tr = folds.filter("role = 'train'")
    return tr.groupBy("symbol", "fold").agg(*[F.percentile(c, q).alias(n) for n, c, q in cut_columns()])


def rule_activity(folds: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per row of ``folds`` and rule, with the activity flag."""
    j = folds.join(thresholds, ["symbol", "fold"])
    rows = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.expr(mask_sql(r)).alias("active")) for r in rule_grid()])
    return j.select("symbol", "session", "fold", "role", "i", "ret1", "target_return", "target_direction", F.inline(rows))


def rule_signals(activity: DataFrame, exposure: float = 0.95) -> DataFrame:
    """Test-day signals: shrunken training precision as probability, training median as size of move."""
    on = F.col("active")
    fit = activity.filter("role = 'train'").groupBy("symbol", "fold", "label").agg(
        F.sum(on.cast("int")).alias("n"), F.avg(F.when(on, F.col("target_direction"))).alias("precision"),
        F.percentile(F.when(on, F.col("target_return")), 0.5).alias("median"))
    prec = F.coalesce("precision", F.lit(0.5))
    fit = fit.select("symbol", "fold", "label", clip((prec * F.col("n") + 6) / (F.col("n") + 12), 0.51, 0.85).alias("p"),
                     F.greatest(F.coalesce("median", F.lit(0.0)), F.lit(0.0005)).alias("move"))
    s = activity.filter("role = 'test'").join(fit, ["symbol", "fold", "label"])
    return s.select("symbol", "session", "fold", "label", "i", "ret1", "target_return", "target_direction", "active",
                    F.when(on, F.col("p")).otherwise(0.5).alias("prob_up"), F.when(on, F.col("move")).otherwise(0.0).alias("expected"),
                    (on.cast("double") * exposure).alias("position"))
