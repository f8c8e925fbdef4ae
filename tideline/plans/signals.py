"""Folds, rules, signal policies and return operators."""

import itertools
import math

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import clip, flag, logistic, sdiv, truth
from tideline.operators import features as feat, folds as fd, returns as rt, rules as rl
from tideline.operators.rolling import by_symbol, frame_quantiles, pct_change, prior_quantile, trailing
from tideline.plans.catalog import query
from tideline.plans.sqlviews import add_view, gated as sgated, prior_q
from tideline.sources import views
from tideline.sources.stages import stage

TRAIN, TEST = 252, 63

add_view("fold_rows", f"""
SELECT b.*, f.fold, CASE WHEN b.i < {TRAIN} + f.fold * {TEST} THEN 'train' ELSE 'test' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS len
      FROM features WHERE target_return IS NOT NULL) b, range(0, 200) f(fold)
WHERE {TRAIN} + f.fold * {TEST} < b.len AND b.i >= f.fold * {TEST} AND b.i < {TRAIN} + f.fold * {TEST} + {TEST}""")


def fold_rows(spark, d):
    f = views.features(spark, d).filter("target_return IS NOT NULL")
    return fd.with_folds(fd.number_rows(f), TRAIN, TEST)


@query("w28_walk_forward_folds", "symbol:s fold:i train_start:d train_end:d test_start:d test_end:d n_train:i n_test:i",
       """SELECT symbol, fold, min(session) FILTER (role = 'train') AS train_start, max(session) FILTER (role = 'train') AS train_end,
            min(session) FILTER (role = 'test') AS test_start, max(session) FILTER (role = 'test') AS test_end,
            count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM fold_rows GROUP BY 1, 2""", "W28")
def _(spark, d):
    f = views.features(spark, d).filter("target_return IS NOT NULL").select("symbol", "session")
    return fd.fold_bounds(f, TRAIN, TEST)


@query("p03_train_winsor", "symbol:s fold:i lo:8 hi:8 mid:8 test_mean:8",
       """WITH l AS (SELECT symbol, fold, coalesce(quantile_cont(ret20, 0.01), 0) AS lo, coalesce(quantile_cont(ret20, 0.99), 0) AS hi FROM fold_rows WHERE role = 'train' GROUP BY 1, 2),
          m AS (SELECT l.*, (SELECT coalesce(quantile_cont(CASE WHEN r.ret20 IS NOT NULL THEN least(greatest(r.ret20, l.lo), l.hi) END, 0.5), 0) FROM fold_rows r WHERE r.symbol = l.symbol AND r.fold = l.fold AND r.role = 'train') AS mid FROM l)
          SELECT m.*, (SELECT avg(coalesce(CASE WHEN r.ret20 IS NOT NULL THEN least(greatest(r.ret20, m.lo), m.hi) END, m.mid)) FROM fold_rows r WHERE r.symbol = m.symbol AND r.fold = m.fold AND r.role = 'test') AS test_mean FROM m""", "P03")
def _(spark, d):
    f = fold_rows(spark, d).select("symbol", "fold", "role", "ret20")
    fit = fd.winsor_fit(f, "ret20")
    j = f.filter("role = 'test'").join(fit, ["symbol", "fold"])
    x = F.coalesce(F.when(F.col("ret20").isNotNull(), F.least(F.greatest("ret20", "lo"), "hi")), "mid")
    return j.groupBy("symbol", "fold", "lo", "hi", "mid").agg(F.avg(x).alias("test_mean"))


add_view("contract", """
SELECT f.symbol, f.session, f.rn, f.target_direction, s.market_close AS available_at, s.market_close AS decision_at,
       e.market_close AS label_end_at FROM features f JOIN sessions s ON s.session = f.session
LEFT JOIN (SELECT symbol, session, lead(session, 1) OVER (PARTITION BY symbol ORDER BY session) AS next_session FROM bars) n
  ON n.symbol = f.symbol AND n.session = f.session LEFT JOIN sessions e ON e.session = n.next_session""")


def contract(spark, d):
    """Four time columns of every feature row: the label ends at the symbol's next session close."""
    cal = views.sessions(spark, d).select("session", "market_close")
    f = views.features(spark, d).select("symbol", "session", "rn", "target_direction").join(cal, "session")
    f = f.withColumn("decision_at", F.col("market_close")).withColumnRenamed("market_close", "available_at")
    return f.withColumn("label_end_at", F.lead("available_at").over(by_symbol()))


@query("p06_time_contract", "symbol:s session:d available_at:t decision_at:t label_end_at:t", "SELECT * FROM contract", "P06")
def _(spark, d):
    return contract(spark, d)


@query("p04_label_purge", "symbol:s n:i up:i last_end:t",
       """SELECT symbol, count(*) AS n, sum(target_direction) AS up, max(label_end_at) AS last_end FROM contract
          WHERE label_end_at <= TIMESTAMP '2000-12-31 21:00:00' AND available_at <= TIMESTAMP '2000-12-31 21:00:00' GROUP BY 1""", "P04")
def _(spark, d):
    ok = fd.mature_only(contract(spark, d), F.expr("TIMESTAMP_NTZ '2000-12-31 21:00:00'"))
    return ok.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("target_direction").alias("up"), F.max("label_end_at").alias("last_end"))


add_view("rule_frame", """
SELECT f.*, avg(f.ret1) OVER (PARTITION BY f.sector, f.session) AS sector_ret1, t.rsi_14, t.macd_hist, o.obv_signal, c.pre_holiday, c.pre_holiday_momentum, p.breadth5, p.mean5, s.net3, s.stress
FROM features f LEFT JOIN technical_rows t ON t.symbol = f.symbol AND t.session = f.session LEFT JOIN obv_rows o ON o.symbol = f.symbol AND o.session = f.session
LEFT JOIN calendar_rows c ON c.symbol = f.symbol AND c.session = f.session LEFT JOIN peers p ON p.session = f.session
LEFT JOIN (SELECT session, sum(net) OVER (ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS net3, negative AS stress FROM shocks) s ON s.session = f.session""")
add_view("rule_fold_rows", f"""
SELECT b.*, f.fold, CASE WHEN b.i < {TRAIN} + f.fold * {TEST} THEN 'train' ELSE 'test' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS len
      FROM rule_frame WHERE target_return IS NOT NULL) b, range(0, 200) f(fold)
WHERE {TRAIN} + f.fold * {TEST} < b.len AND b.i >= f.fold * {TEST} AND b.i < {TRAIN} + f.fold * {TEST} + {TEST}""")
_CUTS = ", ".join(f"quantile_cont({c}, {q}) AS {n}" for n, c, q in rl.cut_columns())
_MASKS = ", ".join(f"{{'label': '{r['label']}', 'active': {rl.mask_sql(r)}}}" for r in rl.rule_grid())
add_view("rule_activity", f"""
SELECT symbol, session, fold, role, i, ret1, target_return, target_direction, u.label AS label, u.active AS active FROM (
  SELECT r.symbol, r.session, r.fold, r.role, r.i, r.ret1, r.target_return, r.target_direction, unnest([{_MASKS}]) AS u
  FROM rule_fold_rows r JOIN (SELECT symbol, fold, {_CUTS} FROM rule_fold_rows WHERE role = 'train' GROUP BY 1, 2) t ON t.symbol = r.symbol AND t.fold = r.fold)""")
add_view("rule_signals", """
SELECT a.symbol, a.session, a.fold, a.label, a.i, a.ret1, a.target_return, a.target_direction, a.active,
       CASE WHEN a.active THEN f.p ELSE 0.5 END AS prob_up, CASE WHEN a.active THEN f.move ELSE 0.0 END AS expected,
       CASE WHEN a.active THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS position
FROM rule_activity a JOIN (
  SELECT symbol, fold, label, least(greatest((coalesce(avg(target_direction) FILTER (active), 0.5) * count(*) FILTER (active) + 6) / (count(*) FILTER (active) + 12), 0.51), 0.85) AS p,
         greatest(coalesce(quantile_cont(target_return, 0.5) FILTER (active), 0), 0.0005) AS move
  FROM rule_activity WHERE role = 'train' GROUP BY 1, 2, 3) f ON f.symbol = a.symbol AND f.fold = a.fold AND f.label = a.label
WHERE a.role = 'test'""")


def build_rule_frame(spark, d):
    """Features with every column that a rule predicate reads; the peer columns are one row per session."""
    f = views.features(spark, d)
    key = ["symbol", "session"]
    shocks = feat.peer_shocks(f).select("session", F.sum("net").over(Window.orderBy("session").rowsBetween(-2, 0)).alias("net3"), F.col("negative").alias("stress"))
    f = f.withColumn("sector_ret1", F.avg("ret1").over(Window.partitionBy("sector", "session")))
    return (f.join(feat.technical_block(views.features(spark, d)).select(*key, "rsi_14", "macd_hist"), key, "left")
            .join(feat.obv(views.bars(spark, d)).select(*key, "obv_signal"), key, "left")
            .join(feat.calendar_block(views.features(spark, d)).select(*key, "pre_holiday", "pre_holiday_momentum"), key, "left")
            .join(feat.peer_cross_section(views.features(spark, d)).select("session", "breadth5", "mean5"), "session", "left")
            .join(shocks, "session", "left"))


def rule_frame(spark, d):
    return stage(spark, d, "rule_frame", views.BAR_TABLES, build_rule_frame)


def activity(spark, d):
    f = fd.with_folds(fd.number_rows(rule_frame(spark, d).filter("target_return IS NOT NULL")), TRAIN, TEST)
    return rl.rule_activity(f, rl.fold_thresholds(f))


def rule_signals(spark, d):
    """Walk-forward signals of every rule, a stage table: the selection queries all start here."""
    return stage(spark, d, "rule_signals", views.BAR_TABLES, lambda s, f: rl.rule_signals(activity(s, f)))


@query("p11_rule_mask", "symbol:s label:s role:s fold:i active:i",
       "SELECT symbol, label, role, fold, sum(CASE WHEN active THEN 1 ELSE 0 END) AS active FROM rule_activity GROUP BY 1, 2, 3, 4", "P11 J14 P12")
def _(spark, d):
    return activity(spark, d).groupBy("symbol", "label", "role", "fold").agg(F.sum(F.col("active").cast("int")).alias("active"))


@query("p37_rule_signals", "symbol:s session:d label:s prob_up:6 expected:8 position:2", "SELECT * FROM rule_signals", "P37")
def _(spark, d):
    return rule_signals(spark, d)


@query("p13_score_rule", "symbol:s session:d score:6 prob_up:6",
       """SELECT *, least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-score)), 0.05), 0.95) AS prob_up FROM (
            SELECT symbol, session, 0.8 * tanh(20 * (p20 - 1)) + 0.6 * tanh(10 * (p60 - 1)) + 0.5 * tanh(ret5 * 15) - 0.4 * tanh(z20 / 2) AS score FROM signals WHERE p60 IS NOT NULL)""", "P13")
def _(spark, d):
    s = views.signals(spark, d).filter("p60 IS NOT NULL")
    score = (F.tanh((F.col("p20") - 1) * 20) * 0.8 + F.tanh((F.col("p60") - 1) * 10) * 0.6 + F.tanh(F.col("ret5") * 15) * 0.5
             - F.tanh(F.col("z20") / 2) * 0.4)
    s = s.select("symbol", "session", score.alias("score"))
    return s.withColumn("prob_up", clip(logistic("score"), 0.05, 0.95))


POLICY_SQL = """SELECT symbol, session, target_return, ret1, CASE WHEN least(greatest(prob_up, 0.01), 0.99) >= {t} AND expected >= {m} THEN 1 ELSE 0 END AS direction,
  greatest(prob_up, 1 - prob_up) AS confidence, CASE WHEN least(greatest(prob_up, 0.01), 0.99) >= {t} AND expected >= {m} THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS position FROM signals"""


def policy(s, threshold=0.52, minimum=0.0):
    p = clip("prob_up", 0.01, 0.99)
    on = flag((p >= threshold) & (F.col("expected") >= minimum))
    return s.select("symbol", "session", "target_return", "ret1", on.alias("direction"),
                    F.greatest(F.col("prob_up"), 1 - F.col("prob_up")).alias("confidence"), (on * F.lit(0.95)).alias("position"))


@query("p14_signal_policy", "symbol:s session:d direction:i confidence:6 position:4", POLICY_SQL.format(t=0.52, m=0.0), "P14")
def _(spark, d):
    return policy(views.signals(spark, d))


@query("p31_position_frame", "symbol:s session:d direction:i prob_down:6 confidence:6",
       "SELECT symbol, session, CAST(sign(position) AS INT) AS direction, 1 - prob_up AS prob_down, greatest(prob_up, 1 - prob_up) AS confidence FROM signals", "P31")
def _(spark, d):
    return views.signals(spark, d).select("symbol", "session", F.signum("position").alias("direction"), (1 - F.col("prob_up")).alias("prob_down"),
                                          F.greatest(F.col("prob_up"), 1 - F.col("prob_up")).alias("confidence"))


add_view("state_signals", """
SELECT s.*, h.hv, h.lv, h.tu, h.td, h.vq70, p.breadth5, p.mean5, p.above20, k.net AS shock_net, k.negative AS shock_negative
FROM signals s JOIN states h ON h.symbol = s.symbol AND h.session = s.session JOIN peers p ON p.session = s.session JOIN shocks k ON k.session = s.session""")


def state_signals(spark, d):
    return stage(spark, d, "state_signals", views.BAR_TABLES, build_state_signals)


def build_state_signals(spark, d):
    f = views.features(spark, d)
    st = feat.market_state(f).select("symbol", "session", "hv", "lv", "tu", "td", "vq70")
    peers = feat.peer_cross_section(f).select("session", "breadth5", "mean5", "above20")
    shocks = feat.peer_shocks(f).select("session", F.col("net").alias("shock_net"), F.col("negative").alias("shock_negative"))
    return views.signals(spark, d).join(st, ["symbol", "session"]).join(peers, "session").join(shocks, "session")


# The current value is part of its own window and may be the cut-off itself: a hair's width keeps it on the same side.
REGIMES = {"vix_high": ("vix >= vix_q70 - 1e-9", lambda: F.col("vix") >= F.col("vix_q70") - 1e-9),
           "vix_low": ("vix <= vix_q35 + 1e-9", lambda: F.col("vix") <= F.col("vix_q35") + 1e-9),
           "index_strong": ("idx_ret5 > 0", lambda: F.col("idx_ret5") > 0), "index_weak": ("idx_ret5 <= 0", lambda: F.col("idx_ret5") <= 0),
           "breadth_strong": ("breadth5 >= 0.625", lambda: F.col("breadth5") >= 0.625), "breadth_weak": ("breadth5 <= 0.375", lambda: F.col("breadth5") <= 0.375),
           "vol_calm": ("vol20 < vol60", lambda: F.col("vol20") < F.col("vol60")), "vol_hot": ("vol20 >= vol60 * 1.2", lambda: F.col("vol20") >= F.col("vol60") * 1.2)}
add_view("regimes", f"""
WITH q AS (SELECT *, coalesce({sgated('quantile_cont({x}, 0.35)', 'vix', -251, 0, 60)}, quantile_cont(vix, 0.35) OVER (PARTITION BY symbol)) AS vix_q35,
                  coalesce({sgated('quantile_cont({x}, 0.7)', 'vix', -251, 0, 60)}, quantile_cont(vix, 0.7) OVER (PARTITION BY symbol)) AS vix_q70 FROM state_signals)
""" + " UNION ALL ".join(f"SELECT symbol, session, position, prob_up, target_return, target_direction, '{k}' AS regime FROM q WHERE {c}" for k, (c, _) in REGIMES.items()))


def regimes(spark, d):
    """Long table of (row, regime) memberships; cut-offs are trailing and include the current row. The fallback for
    the first rows is the whole sample's quantile, which looks ahead: these masks describe results and trade nothing."""
    s = state_signals(spark, d)
    whole = Window.partitionBy("symbol")
    s = s.withColumn("_v", frame_quantiles("vix", (0.35, 0.7), trailing(252), 60))
    for i, q in enumerate((0.35, 0.7)):
        s = s.withColumn(f"vix_q{int(q * 100)}", F.coalesce(F.col("_v")[f"q{i}"], F.percentile("vix", q).over(whole)))
    member = F.explode(F.array_compact(F.array(*[F.when(truth(c()), k) for k, (_, c) in REGIMES.items()])))
    return s.select("symbol", "session", "position", "prob_up", "target_return", "target_direction", member.alias("regime"))


@query("p15_regime_masks", "symbol:s regime:s days:i", "SELECT symbol, regime, count(*) AS days FROM regimes GROUP BY 1, 2", "P15")
def _(spark, d):
    return regimes(spark, d).groupBy("symbol", "regime").agg(F.count("*").alias("days"))


add_view("guarded", f"""
SELECT *, CASE WHEN votes >= 3 THEN 1 ELSE 0 END AS risk_off, CASE WHEN position > 0 AND votes >= 3 THEN 1 ELSE 0 END AS blocked,
       CASE WHEN position > 0 AND votes >= 3 THEN 0 ELSE position END AS guarded_position
FROM (SELECT *, td + hv + CASE WHEN vix_chg5 > vj THEN 1 ELSE 0 END + CASE WHEN idx_ret5 < 0 THEN 1 ELSE 0 END
   + CASE WHEN breadth5 <= 0.45 OR mean5 < 0 THEN 1 ELSE 0 END + CASE WHEN shock_negative > 0 THEN 1 ELSE 0 END
   + CASE WHEN vol20 > vol60 * 1.05 THEN 1 ELSE 0 END + CASE WHEN p20 < 1 AND ret5 < 0 THEN 1 ELSE 0 END AS votes
  FROM (SELECT *, {prior_q('vix_chg5', 0.75)} AS vj FROM state_signals))""")


def guarded(spark, d, min_votes: int = 3):
    s = state_signals(spark, d).withColumn("vj", prior_quantile("vix_chg5", 0.75))
    parts = [F.col("td"), F.col("hv"), flag(F.col("vix_chg5") > F.col("vj")), flag(F.col("idx_ret5") < 0),
             flag((F.col("breadth5") <= 0.45) | (F.col("mean5") < 0)), flag(F.col("shock_negative") > 0),
             flag(F.col("vol20") > F.col("vol60") * 1.05), flag((F.col("p20") < 1) & (F.col("ret5") < 0))]
    s = s.withColumn("votes", sum(parts[1:], parts[0]))
    off = F.col("votes") >= min_votes
    return s.select("*", off.cast("int").alias("risk_off"), flag((F.col("position") > 0) & off).alias("blocked"),
                    F.when((F.col("position") > 0) & off, 0.0).otherwise(F.col("position")).alias("guarded_position"))


@query("p16_risk_guard", "symbol:s session:d votes:i risk_off:i blocked:i guarded_position:2", "SELECT * FROM guarded", "P16")
def _(spark, d):
    return guarded(spark, d)


@query("a18_blocked_trades", "symbol:s blocked_days:i blocked_loss_rate:6 blocked_avg:8 blocked_median:8 loss_capture:6",
       """SELECT symbol, count(*) FILTER (blocked = 1) AS blocked_days, coalesce(avg(CASE WHEN target_return <= 0 THEN 1.0 ELSE 0.0 END) FILTER (blocked = 1), 0) AS blocked_loss_rate,
            coalesce(avg(target_return) FILTER (blocked = 1), 0) AS blocked_avg, coalesce(quantile_cont(target_return, 0.5) FILTER (blocked = 1), 0) AS blocked_median,
            coalesce(count(*) FILTER (blocked = 1 AND target_return <= 0) * 1.0 / nullif(count(*) FILTER (position > 0 AND target_return <= 0), 0), 0) AS loss_capture
          FROM guarded WHERE target_return IS NOT NULL GROUP BY 1""", "A18")
def _(spark, d):
    g = guarded(spark, d).filter("target_return IS NOT NULL")
    b, lose = F.col("blocked") == 1, F.col("target_return") <= 0
    return g.groupBy("symbol").agg(
        F.sum(b.cast("int")).alias("blocked_days"), F.coalesce(F.avg(F.when(b, lose.cast("int"))), F.lit(0.0)).alias("blocked_loss_rate"),
        F.coalesce(F.avg(F.when(b, F.col("target_return"))), F.lit(0.0)).alias("blocked_avg"),
        F.coalesce(F.percentile(F.when(b, F.col("target_return")), 0.5), F.lit(0.0)).alias("blocked_median"),
        F.coalesce(sdiv(F.sum((b & lose).cast("int")), F.sum(((F.col("position") > 0) & lose).cast("int"))), F.lit(0.0)).alias("loss_capture"))


# Rule weights of the pool follow the order of the grid.
WEIGHTS = {r["label"]: 1.0 + 0.1 * k for k, r in enumerate(rl.rule_grid())}
_WTS = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in WEIGHTS.items())
add_view("consensus", f"""
SELECT *, least(greatest(coalesce(wp / nullif(aw, 0), 0.5), 0.01), 0.99) AS weighted_prob, greatest(coalesce(we / nullif(aw, 0), 0), 0) AS weighted_expected
FROM (SELECT r.symbol, r.session, any_value(r.ret1) AS ret1, any_value(r.target_return) AS target_return, any_value(r.target_direction) AS target_direction,
        sum(CASE WHEN active THEN 1 ELSE 0 END) AS active_count, sum(CASE WHEN active THEN w / tot END) AS aw0, coalesce(sum(CASE WHEN active THEN w / tot END), 0) AS aw,
        sum(CASE WHEN active THEN prob_up * w / tot END) AS wp, sum(CASE WHEN active THEN expected * w / tot END) AS we, sum(prob_up * w / tot) AS all_prob
      FROM rule_signals r JOIN (SELECT *, sum(w) OVER () AS tot FROM (VALUES {_WTS}) t(label, w)) x ON x.label = r.label GROUP BY 1, 2)""")


def consensus(spark, d):
    """Weighted vote of the active rules per symbol and session."""
    total = sum(WEIGHTS.values())
    w = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v / total))]), F.col("label"))
    s = rule_signals(spark, d).withColumn("w", w)
    on = F.col("active")
    g = s.groupBy("symbol", "session").agg(
        F.first("ret1").alias("ret1"), F.first("target_return").alias("target_return"), F.first("target_direction").alias("target_direction"),
        F.sum(on.cast("int")).alias("active_count"), F.coalesce(F.sum(F.when(on, F.col("w"))), F.lit(0.0)).alias("aw"),
        F.sum(F.when(on, F.col("prob_up") * F.col("w"))).alias("wp"), F.sum(F.when(on, F.col("expected") * F.col("w"))).alias("we"),
        F.sum(F.col("prob_up") * F.col("w")).alias("all_prob"))
    return g.select("*", clip(F.coalesce(sdiv("wp", "aw"), F.lit(0.5)), 0.01, 0.99).alias("weighted_prob"),
                    F.greatest(F.coalesce(sdiv("we", "aw"), F.lit(0.0)), F.lit(0.0)).alias("weighted_expected"))


add_view("reaction", """
SELECT *, CASE WHEN alert = 1 THEN 0.35::DOUBLE * least(greatest((weighted_prob - 0.5) / 0.05, 0), 1.5) / 1.5 * least(aw / 0.25, 1.5) / 1.5 ELSE 0 END AS shadow_position
FROM (SELECT c.*, coalesce(s.position, 0) AS baseline_position, coalesce(s.prob_up, 0.5) AS baseline_prob, coalesce(s.vol20, 0) AS vol20,
        CASE WHEN coalesce(s.position, 0) <= 0 AND active_count >= 3 AND aw >= 0.25 AND weighted_prob >= 0.52 THEN 1 ELSE 0 END AS alert
      FROM consensus c LEFT JOIN signals s ON s.symbol = c.symbol AND s.session = c.session)""")


def reaction(spark, d):
    base = views.signals(spark, d).select("symbol", "session", F.col("position").alias("baseline_position"), F.col("prob_up").alias("baseline_prob"), "vol20")
    c = consensus(spark, d).join(base, ["symbol", "session"], "left").fillna({"baseline_position": 0.0, "baseline_prob": 0.5, "vol20": 0.0})
    c = c.withColumn("alert", flag((F.col("baseline_position") <= 0) & (F.col("active_count") >= 3) & (F.col("aw") >= 0.25) & (F.col("weighted_prob") >= 0.52)))
    strength = clip((F.col("weighted_prob") - 0.5) / 0.05, 0.0, 1.5) / 1.5
    vote = F.least(F.col("aw") / 0.25, F.lit(1.5)) / 1.5
    return c.withColumn("shadow_position", F.when(F.col("alert") == 1, 0.35 * strength * vote).otherwise(0.0))


@query("p18_reaction_consensus", "symbol:s session:d active_count:i aw:6 weighted_prob:6 weighted_expected:8 alert:i shadow_position:6", "SELECT * FROM reaction", "P18")
def _(spark, d):
    return reaction(spark, d)


add_view("meta", """
SELECT *, CASE decision WHEN 'BASELINE_LONG' THEN baseline_position WHEN 'TACTICAL_LONG' THEN shadow_position ELSE 0 END AS meta_position
FROM (SELECT r.*, g.risk_off, CASE
   WHEN r.baseline_position > 0 AND g.risk_off = 1 THEN 'BLOCK_LONG' WHEN r.baseline_position > 0 THEN 'BASELINE_LONG'
   WHEN r.shadow_position > 0 AND g.risk_off = 0 THEN 'TACTICAL_LONG' WHEN g.risk_off = 1 THEN 'RISK_OFF' ELSE 'NO_TRADE' END AS decision
 FROM reaction r JOIN guarded g ON g.symbol = r.symbol AND g.session = r.session)""")


def meta(spark, d):
    r = reaction(spark, d).join(guarded(spark, d).select("symbol", "session", "risk_off"), ["symbol", "session"])
    long, off = F.col("baseline_position") > 0, F.col("risk_off") == 1
    dec = (F.when(long & off, "BLOCK_LONG").when(long, "BASELINE_LONG").when((F.col("shadow_position") > 0) & ~off, "TACTICAL_LONG")
           .when(off, "RISK_OFF").otherwise("NO_TRADE"))
    r = r.withColumn("decision", dec)
    return r.withColumn("meta_position", F.when(F.col("decision") == "BASELINE_LONG", F.col("baseline_position"))
                        .when(F.col("decision") == "TACTICAL_LONG", F.col("shadow_position")).otherwise(0.0))


@query("p17_meta_decision", "symbol:s session:d decision:s risk_off:i meta_position:6", "SELECT * FROM meta", "P17")
def _(spark, d):
    return meta(spark, d)


@query("a37_decision_counts", "symbol:s baseline_long:i tactical_long:i block_long:i risk_off:i watch:i no_trade:i",
       """SELECT symbol, count(*) FILTER (decision = 'BASELINE_LONG') AS baseline_long, count(*) FILTER (decision = 'TACTICAL_LONG') AS tactical_long,
            count(*) FILTER (decision = 'BLOCK_LONG') AS block_long, count(*) FILTER (decision = 'RISK_OFF') AS risk_off,
            count(*) FILTER (decision = 'WATCH') AS watch, count(*) FILTER (decision = 'NO_TRADE') AS no_trade FROM meta GROUP BY 1""", "A37")
def _(spark, d):
    kinds = ["BASELINE_LONG", "TACTICAL_LONG", "BLOCK_LONG", "RISK_OFF", "WATCH", "NO_TRADE"]
    p = meta(spark, d).groupBy("symbol").pivot("decision", kinds).count().na.fill(0)
    return p.select("symbol", *[F.col(k).alias(k.lower()) for k in kinds])


@query("p19_repair_overlay", "symbol:s session:d core:4 repair:4 combined:4 overlay:i",
       """SELECT symbol, session, baseline_position AS core, shadow_position AS repair, CASE WHEN o THEN least(shadow_position, 0.2) ELSE baseline_position END AS combined, CASE WHEN o THEN 1 ELSE 0 END AS overlay
          FROM (SELECT *, baseline_position <= 0 AND shadow_position > 0 AND weighted_prob >= 0.53 AS o FROM reaction)""", "P19")
def _(spark, d):
    r = reaction(spark, d)
    o = (F.col("baseline_position") <= 0) & (F.col("shadow_position") > 0) & (F.col("weighted_prob") >= 0.53)
    return r.select("symbol", "session", F.col("baseline_position").alias("core"), F.col("shadow_position").alias("repair"),
                    F.when(o, F.least("shadow_position", F.lit(0.2))).otherwise(F.col("baseline_position")).alias("combined"), flag(o).alias("overlay"))


@query("p20_ensemble_vote", "symbol:s session:d direction:i prob_up:6 position:6",
       """SELECT symbol, session, direction, prob_up, CASE WHEN direction = 1 THEN least(greatest(0.95::DOUBLE * least(aw / 0.2, 1.5) / 1.5 * least(greatest((prob_up - 0.5) / 0.25, 0), 1)
              * coalesce(least(greatest(0.25 / nullif(vol20 * sqrt(252), 0), 0.5), 1.5), 1), 0.05), 0.95) ELSE 0 END AS position
          FROM (SELECT *, CASE WHEN aw >= 0.2 AND active_count >= 2 AND prob_up >= 0.52 THEN 1 ELSE 0 END AS direction
                FROM (SELECT *, least(greatest(coalesce(wp / nullif(aw, 0), all_prob), 0.01), 0.99) AS prob_up FROM reaction))""", "P20 U03")
def _(spark, d):
    r = reaction(spark, d).withColumn("prob_up", clip(F.coalesce(sdiv("wp", "aw"), F.col("all_prob")), 0.01, 0.99))
    r = r.withColumn("direction", flag((F.col("aw") >= 0.2) & (F.col("active_count") >= 2) & (F.col("prob_up") >= 0.52)))
    scalar = F.coalesce(clip(sdiv(F.lit(0.25), F.col("vol20") * math.sqrt(252)), 0.5, 1.5), F.lit(1.0))
    size = F.lit(0.95) * F.least(F.col("aw") / 0.2, F.lit(1.5)) / 1.5 * clip((F.col("prob_up") - 0.5) / 0.25, 0.0, 1.0) * scalar
    return r.select("symbol", "session", "direction", "prob_up", F.when(F.col("direction") == 1, clip(size, 0.05, 0.95)).otherwise(0.0).alias("position"))


@query("p21_factor_signs", "symbol:s momentum:i reversion:i trend:i volatility:i index_link:i mean_sign:6",
       """SELECT *, (momentum + reversion + trend + volatility + index_link) / 5.0 AS mean_sign FROM (SELECT symbol, CAST(sign(ret20) AS INT) AS momentum, CASE WHEN z20 < -1 THEN 1 WHEN z20 > 1 THEN -1 ELSE 0 END AS reversion,
            CASE WHEN p20 > 1 AND p60 > 1 THEN 1 WHEN p20 < 1 AND p60 < 1 THEN -1 ELSE 0 END AS trend, CASE WHEN vol20 < vol60 THEN 1 ELSE -1 END AS volatility, CAST(sign(idx_ret5) AS INT) AS index_link
          FROM signals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) = 1)""", "P21 W31")
def _(spark, d):
    s = views.signals(spark, d)
    last = s.groupBy("symbol").agg(F.max_by(F.struct("ret20", "z20", "p20", "p60", "vol20", "vol60", "idx_ret5"), "session").alias("r")).select("symbol", "r.*")
    out = last.select(
        "symbol", F.signum("ret20").cast("int").alias("momentum"), F.when(F.col("z20") < -1, 1).when(F.col("z20") > 1, -1).otherwise(0).alias("reversion"),
        F.when((F.col("p20") > 1) & (F.col("p60") > 1), 1).when((F.col("p20") < 1) & (F.col("p60") < 1), -1).otherwise(0).alias("trend"),
        F.when(F.col("vol20") < F.col("vol60"), 1).otherwise(-1).alias("volatility"), F.signum("idx_ret5").cast("int").alias("index_link"))
    parts = ["momentum", "reversion", "trend", "volatility", "index_link"]
    return out.withColumn("mean_sign", sum((F.col(c) for c in parts[1:]), F.col(parts[0])) / 5.0)


@query("p22_volatility_state", "session:d vix:4 change1:6 change5:6 state:s guidance:s",
       """SELECT *, CASE state WHEN 'panic' THEN 'cut exposure' WHEN 'elevated' THEN 'reduce size' WHEN 'normal' THEN 'no change' ELSE 'watch complacency' END AS guidance FROM (
            SELECT session, vix, vix / nullif(lag(vix) OVER w, 0) - 1 AS change1, vix / nullif(lag(vix, 5) OVER w, 0) - 1 AS change5,
              CASE WHEN vix >= 23 THEN 'panic' WHEN vix >= 21 THEN 'elevated' WHEN vix >= 18 THEN 'normal' ELSE 'calm' END AS state FROM market WINDOW w AS (ORDER BY session))""", "P22")
def _(spark, d):
    w = Window.orderBy("session")
    v = F.col("vix")
    m = views.market(spark, d).select("session", "vix", pct_change("vix", 1, w).alias("change1"), pct_change("vix", 5, w).alias("change5"),
                                      F.when(v >= 23, "panic").when(v >= 21, "elevated").when(v >= 18, "normal").otherwise("calm").alias("state"))
    text = F.create_map(*[F.lit(x) for kv in {"panic": "cut exposure", "elevated": "reduce size", "normal": "no change", "calm": "watch complacency"}.items() for x in kv])
    return m.withColumn("guidance", F.element_at(text, F.col("state")))


VARIANTS_SQL = """SELECT symbol, session, v.variant, CASE v.variant WHEN 'raw_threshold' THEN CASE WHEN prob_up >= 0.52 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
   WHEN 'vol_target' THEN CASE WHEN prob_up >= 0.52 THEN coalesce(least(0.25 / nullif(vol20 * sqrt(252), 0), 1), 0) ELSE 0 END
   WHEN 'fixed_risk' THEN CASE WHEN prob_up >= 0.52 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END WHEN 'buy_hold' THEN 1.0::DOUBLE ELSE CASE WHEN p60 > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS position
   FROM signals, (VALUES ('raw_threshold'), ('vol_target'), ('fixed_risk'), ('buy_hold'), ('trend')) v(variant)"""


@query("p32_strategy_variants", "variant:s symbol:s days:i mean_position:8 active:i",
       f"SELECT variant, symbol, count(*) AS days, avg(position) AS mean_position, count(*) FILTER (position > 0) AS active FROM ({VARIANTS_SQL}) GROUP BY 1, 2", "P32")
def _(spark, d):
    s = views.signals(spark, d)
    on = (F.col("prob_up") >= 0.52).cast("double")
    target = F.coalesce(F.least(sdiv(F.lit(0.25), F.col("vol20") * math.sqrt(252)), F.lit(1.0)), F.lit(0.0))
    v = {"raw_threshold": on, "vol_target": on * target, "fixed_risk": on * 0.6, "buy_hold": F.lit(1.0), "trend": F.coalesce((F.col("p60") > 1).cast("double"), F.lit(0.0))}
    long = s.select("symbol", "session", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("position")) for k, c in v.items()])))
    return long.groupBy("variant", "symbol").agg(F.count("*").alias("days"), F.avg("position").alias("mean_position"), F.sum((F.col("position") > 0).cast("int")).alias("active"))


@query("p38_latest_prediction", "symbol:s label:s session:d active:i prob_up:6 stop_price:4 take_price:4",
       """SELECT r.symbol, r.label, r.session, CASE WHEN active THEN 1 ELSE 0 END AS active, prob_up, b.close * 0.97 AS stop_price, b.close * 1.05 AS take_price
          FROM (SELECT * FROM rule_signals QUALIFY row_number() OVER (PARTITION BY symbol, label ORDER BY session DESC) = 1) r JOIN bars b ON b.symbol = r.symbol AND b.session = r.session""", "P38")
def _(spark, d):
    last = rule_signals(spark, d).groupBy("symbol", "label").agg(F.max("session").alias("session"), F.max_by(F.struct("active", "prob_up"), "session").alias("r"))
    b = views.bars(spark, d).select("symbol", "session", "close")
    return last.join(b, ["symbol", "session"]).select("symbol", "label", "session", F.col("r.active").cast("int").alias("active"), F.col("r.prob_up").alias("prob_up"),
                                                      (F.col("close") * 0.97).alias("stop_price"), (F.col("close") * 1.05).alias("take_price"))


@query("r01_net_returns", "strategy:s symbol:s session:d held:2 turn:2 net:8", "SELECT * FROM net_returns", "R01")
def _(spark, d):
    return views.net_returns(spark, d)


add_view("trades", """
SELECT strategy, symbol, trade, min(session) FILTER (held > 0) AS entry, max(session) FILTER (held > 0) AS exit, count(*) FILTER (held > 0) AS bars_held, exp(sum(ln(1 + net))) - 1 AS pnl
FROM (SELECT *, sum(CASE WHEN held > 0 AND before <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS trade
      FROM (SELECT *, coalesce(lag(held) OVER (PARTITION BY strategy, symbol ORDER BY session), 0) AS before FROM net_returns))
WHERE trade > 0 AND (held > 0 OR before > 0) GROUP BY 1, 2, 3""")


@query("r02_trade_episodes", "strategy:s symbol:s trade:i entry:d exit:d bars:i pnl:7", "SELECT *, bars_held AS bars FROM trades", "R02")
def _(spark, d):
    return rt.trades(views.net_returns(spark, d), ["strategy", "symbol"])


@query("r03_barrier_touch", "symbol:s session:d exit_day:d reason:s trade_return:7",
       """WITH e AS (SELECT s.symbol, s.session, b.close, b.rn FROM (SELECT *, position > 0 AND coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY session), 0) <= 0 AS entry_flag FROM signals) s JOIN features b ON b.symbol = s.symbol AND b.session = s.session WHERE entry_flag),
          p AS (SELECT e.symbol, e.session, e.close AS entry_close, x.session AS day, x.open, x.high, x.low, x.close, x.rn - e.rn AS step,
             CASE WHEN x.open <= e.close * 0.97 THEN 'gap_stop' WHEN x.open >= e.close * 1.05 THEN 'gap_take' WHEN x.low <= e.close * 0.97 THEN 'stop' WHEN x.high >= e.close * 1.05 THEN 'take' END AS reason FROM e JOIN features x ON x.symbol = e.symbol AND x.rn BETWEEN e.rn + 1 AND e.rn + 10),
          f AS (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY CASE WHEN reason IS NOT NULL THEN step ELSE 1000 - step END) AS k FROM p)
          SELECT symbol, session, day AS exit_day, coalesce(reason, 'timeout') AS reason, CASE WHEN reason LIKE 'gap%' THEN open WHEN reason = 'stop' THEN entry_close * 0.97 WHEN reason = 'take' THEN entry_close * 1.05 ELSE close END / entry_close - 1 AS trade_return FROM f WHERE k = 1""", "R03")
def _(spark, d):
    s = views.signals(spark, d)
    entry = (F.col("position") > 0) & (F.coalesce(F.lag("position").over(by_symbol()), F.lit(0.0)) <= 0)
    e = s.select("symbol", "session", entry.alias("entry_flag"))
    b = views.bars(spark, d).join(e, ["symbol", "session"], "left").withColumn("entry_flag", F.coalesce("entry_flag", F.lit(False)))
    return rt.barrier_touch(b, ["symbol"])


@query("r04_ledger", "strategy:s symbol:s fills:i fees:4 realised:4 cash:3 broken:i",
       """SELECT strategy, symbol, count(*) FILTER (qty <> 0) AS fills, arg_max(fees, session) AS fees, arg_max(realised, session) AS realised, arg_max(cash, session) AS cash,
            count(*) FILTER (abs(1000000 + realised + unrealised - fees - cash - shares * close) > 1e-4) AS broken
          FROM (SELECT *, 1000000 - sum(qty * close + fee) OVER u AS cash, sum(fee) OVER u AS fees, sum(CASE WHEN qty < 0 THEN -qty * (close - basis) ELSE 0 END) OVER u AS realised, coalesce(shares * (close - basis), 0) AS unrealised
            FROM (SELECT *, abs(qty) * close * 0.0015 AS fee, last_value(CASE WHEN qty > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY strategy, symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS basis
              FROM (SELECT x.strategy, x.symbol, x.session, b.close, target * 100 AS shares, target * 100 - coalesce(lag(target * 100) OVER (PARTITION BY x.strategy, x.symbol ORDER BY x.session), 0) AS qty
                FROM strategies x JOIN bars b ON b.symbol = x.symbol AND b.session = x.session))
            WINDOW u AS (PARTITION BY strategy, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2""", "R04")
def _(spark, d):
    b = views.bars(spark, d).select("symbol", "session", "close")
    led = rt.ledger(views.strategies(spark, d).select("strategy", "symbol", "session", "target").join(b, ["symbol", "session"]), ["strategy", "symbol"])
    return led.groupBy("strategy", "symbol").agg(
        F.sum((F.col("qty") != 0).cast("int")).alias("fills"), F.max_by("fees", "session").alias("fees"), F.max_by("realised", "session").alias("realised"),
        F.max_by("cash", "session").alias("cash"), F.sum((F.abs("residual") > 1e-4).cast("int")).alias("broken"))


@query("r05_drawdown_cutoff", "strategy:s symbol:s halted_days:i first_breach:d cut_log_return:6",
       """SELECT strategy, symbol, sum(halted) AS halted_days, min(CASE WHEN dd <= -0.15 THEN session END) AS first_breach, sum(CASE WHEN halted = 1 THEN 0 ELSE ln(1 + net) END) AS cut_log_return
          FROM (SELECT *, coalesce(max(CASE WHEN dd <= -0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS halted
            FROM (SELECT *, exp(lg - greatest(max(lg) OVER (PARTITION BY strategy, symbol ORDER BY session ROWS UNBOUNDED PRECEDING), 0)) - 1 AS dd
              FROM (SELECT *, sum(ln(1 + net)) OVER (PARTITION BY strategy, symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS lg FROM net_returns))) GROUP BY 1, 2""", "R05")
def _(spark, d):
    c = rt.drawdown_cutoff(views.net_returns(spark, d), ["strategy", "symbol"])
    return c.groupBy("strategy", "symbol").agg(F.sum("halted").alias("halted_days"), F.min(F.when(F.col("drawdown") <= -0.15, F.col("session"))).alias("first_breach"),
                                               F.sum(F.log1p("cut_net")).alias("cut_log_return"))


@query("r06_greedy_intraday", "symbol:s signal_time:t exit_time:t side:i gross:8 net:8",
       """WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM intraday_scored),
            c AS (SELECT b.symbol, b.i, b.bar AS signal_time, x.bar AS exit_time, b.signal AS side, b.signal * (x.close / e.open - 1) AS gross FROM b JOIN b e ON e.symbol = b.symbol AND e.i = b.i + 1 JOIN b x ON x.symbol = b.symbol AND x.i = b.i + 4
                  WHERE b.signal <> 0 AND e.session_ny = x.session_ny AND b.i < b.n - 5),
            nx AS (SELECT c.symbol, c.i, min(d.i) AS next_i FROM c LEFT JOIN c d ON d.symbol = c.symbol AND d.i >= c.i + 5 GROUP BY 1, 2),
            chain(symbol, i) AS (SELECT symbol, min(i) FROM c GROUP BY 1 UNION ALL SELECT nx.symbol, nx.next_i FROM chain JOIN nx ON nx.symbol = chain.symbol AND nx.i = chain.i WHERE nx.next_i IS NOT NULL)
          SELECT c.*, gross - 0.0015 AS net FROM c JOIN chain ON chain.symbol = c.symbol AND chain.i = c.i""", "R06")
def _(spark, d):
    return rt.greedy_intraday_trades(feat.micro_score(feat.intraday_features(views.intraday(spark, d))))


# Settings of the walk-forward search on hourly bars, in order of preference among equals.
R07_MODES, R07_THRESHOLDS, R07_HORIZONS, R07_MIN_TRADES, R07_TRAIN = ("trend", "inverse"), (2, 3, 4, 5), (2, 4, 6), 6, 4
_R07 = ", ".join(f"({k}, '{m}', {t}, {h})" for k, (m, t, h) in enumerate(itertools.product(R07_MODES, R07_THRESHOLDS, R07_HORIZONS)))


@query("r07_walk_forward_intraday", "symbol:s test_session:d enabled:i mode:s threshold:i horizon:i train_trades:i test_trades:i test_net:8",
       f"""WITH RECURSIVE d AS (SELECT symbol, session_ny, row_number() OVER (PARTITION BY symbol ORDER BY session_ny) AS k FROM (SELECT DISTINCT symbol, session_ny FROM intraday_scored)),
          t AS (SELECT symbol, session_ny AS test_session, k AS test_k FROM d WHERE k > {R07_TRAIN}),
          g AS (SELECT s.symbol, t.test_k, CASE WHEN d.k < t.test_k THEN 'train' ELSE 'test' END AS part, s.bar, s.session_ny, s.open, s.close, s.micro_score
                FROM intraday_scored s JOIN d ON d.symbol = s.symbol AND d.session_ny = s.session_ny JOIN t ON t.symbol = s.symbol AND d.k BETWEEN t.test_k - {R07_TRAIN} AND t.test_k),
          p AS (SELECT *, row_number() OVER (PARTITION BY symbol, test_k, part ORDER BY bar) - 1 AS i, count(*) OVER (PARTITION BY symbol, test_k, part) AS n FROM g),
          st AS (SELECT * FROM (VALUES {_R07}) v(place, mode, threshold, h)),
          c AS (SELECT p.symbol, p.test_k, p.part, st.place, st.h, p.i, (CASE WHEN p.micro_score >= st.threshold THEN 1 ELSE -1 END) * (CASE st.mode WHEN 'trend' THEN 1 ELSE -1 END) * (x.close / e.open - 1) - 0.0015 AS r
                FROM p JOIN st ON abs(p.micro_score) >= st.threshold JOIN p e ON e.symbol = p.symbol AND e.test_k = p.test_k AND e.part = p.part AND e.i = p.i + 1
                JOIN p x ON x.symbol = p.symbol AND x.test_k = p.test_k AND x.part = p.part AND x.i = p.i + st.h WHERE p.i < p.n - st.h - 1 AND e.session_ny = x.session_ny),
          nx AS (SELECT c.*, d.i AS next_i FROM c ASOF LEFT JOIN c d ON c.symbol = d.symbol AND c.test_k = d.test_k AND c.part = d.part AND c.place = d.place AND c.i + c.h + 1 <= d.i),
          chain(symbol, test_k, part, place, i) AS (SELECT symbol, test_k, part, place, min(i) FROM c GROUP BY 1, 2, 3, 4
                UNION ALL SELECT nx.symbol, nx.test_k, nx.part, nx.place, nx.next_i FROM chain a JOIN nx ON nx.symbol = a.symbol AND nx.test_k = a.test_k AND nx.part = a.part AND nx.place = a.place AND nx.i = a.i WHERE nx.next_i IS NOT NULL),
          tr AS (SELECT nx.* FROM nx JOIN chain USING (symbol, test_k, part, place, i)),
          q AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, test_k, place ORDER BY i) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, test_k, place ORDER BY i)) AS eq FROM tr WHERE part = 'train')),
          m AS (SELECT symbol, test_k, place, count(*) AS n, avg(r) AS mean, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win, arg_max(eq, i) AS last, min(dd) AS dd,
                CASE WHEN coalesce(sum(r) FILTER (r < 0), 0) < 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) ELSE 1e9 END AS pf FROM q GROUP BY 1, 2, 3),
          b AS (SELECT * FROM m WHERE n >= {R07_MIN_TRADES} QUALIFY row_number() OVER (PARTITION BY symbol, test_k ORDER BY round(mean * 1000 + least(pf, 3.0) + win + last - 1 - abs(dd) * 2, 9) DESC, place) = 1),
          o AS (SELECT t.*, b.place, b.n, CASE WHEN b.mean >= 0.0005 AND b.pf >= 1.25 AND b.win >= 0.55 THEN 1 ELSE 0 END AS enabled FROM t LEFT JOIN b USING (symbol, test_k)),
          z AS (SELECT symbol, test_k, place, count(*) AS trades, sum(r) AS net FROM tr WHERE part = 'test' GROUP BY 1, 2, 3)
          SELECT o.symbol, o.test_session, o.enabled, coalesce(st.mode, 'none') AS mode, coalesce(st.threshold, 0) AS threshold, coalesce(st.h, 0) AS horizon, coalesce(o.n, 0) AS train_trades,
            CASE WHEN o.enabled = 1 THEN coalesce(z.trades, 0) ELSE 0 END AS test_trades, CASE WHEN o.enabled = 1 THEN coalesce(z.net, 0) ELSE 0 END AS test_net
          FROM o LEFT JOIN st USING (place) LEFT JOIN z ON z.symbol = o.symbol AND z.test_k = o.test_k AND z.place = o.place""", "R07")
def _(spark, d):
    import numpy as np
    import pandas as pd

    f = feat.micro_score(feat.intraday_features(views.intraday(spark, d))).select("symbol", "bar", "session_ny", "open", "close", "micro_score")
    days = f.select("symbol", "session_ny").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("symbol").orderBy("session_ny")))
    f = f.join(days, ["symbol", "session_ny"])
    # Each bar serves the next four test sessions as training data and its own as test data.
    f = f.withColumn("test_k", F.explode(F.sequence(F.col("k"), F.col("k") + R07_TRAIN))).filter(F.col("test_k") > R07_TRAIN)

    def trades(p, threshold, mode, h):
        score = p["micro_score"].to_numpy()
        sig = np.where(score >= threshold, 1, np.where(score <= -threshold, -1, 0)) * (1 if mode == "trend" else -1)
        day, op, cl = p["session_ny"].to_numpy(), p["open"].to_numpy(), p["close"].to_numpy()
        out, i = [], 0
        while i < len(p) - h - 1:
            if sig[i] == 0 or day[i + 1] != day[i + h]:
                i += 1
                continue
            out.append(sig[i] * (cl[i + h] / op[i + 1] - 1) - 0.0015)
            i += h + 1
        return np.array(out)

    def choose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        train, test = pdf[pdf["k"] < key[1]], pdf[pdf["k"] == key[1]]
        if test.empty:
            return pd.DataFrame(columns=["symbol", "test_session", "enabled", "mode", "threshold", "horizon", "train_trades", "test_trades", "test_net"])
        best, best_score = None, -np.inf
        for mode in R07_MODES:
            for threshold in R07_THRESHOLDS:
                for h in R07_HORIZONS:
                    t = trades(train, threshold, mode, h)
                    if len(t) < R07_MIN_TRADES:
                        continue
                    loss = -t[t < 0].sum()
                    pf = t[t > 0].sum() / loss if loss > 0 else np.inf
                    eq = np.cumprod(1 + t)
                    dd = (eq / np.maximum.accumulate(eq) - 1).min()
                    score = round(t.mean() * 1000 + min(pf, 3.0) + (t > 0).mean() + eq[-1] - 1 - abs(dd) * 2, 9)  # equal trades tie
                    if score > best_score:
                        best, best_score = (mode, threshold, h, len(t), t.mean(), pf, (t > 0).mean()), score
        on = best is not None and best[4] >= 0.0005 and best[5] >= 1.25 and best[6] >= 0.55
        got = trades(test, best[1], best[0], best[2]) if on else np.array([])
        mode, threshold, h, n = best[:4] if best else ("none", 0, 0, 0)
        return pd.DataFrame([[key[0], test["session_ny"].iloc[0], int(on), mode, threshold, h, n, len(got), float(got.sum())]],
                            columns=["symbol", "test_session", "enabled", "mode", "threshold", "horizon", "train_trades", "test_trades", "test_net"])

    # A group is one symbol and five sessions.
    return f.groupBy("symbol", "test_k").applyInPandas(
        choose, "symbol string, test_session date, enabled int, mode string, threshold int, horizon int, train_trades int, test_trades int, test_net double")
