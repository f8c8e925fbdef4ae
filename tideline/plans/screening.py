"""Screen of the candidate product: the plan uses bitmaps, its twin plain rows."""

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import sdiv
from tideline.operators import features as feat, grid, rules as rl
from tideline.operators.rolling import by_symbol
from tideline.plans import signals as sg
from tideline.plans.catalog import query
from tideline.plans.sqlviews import add_view
from tideline.sources import views
from tideline.sources.stages import stage

CAP = 10_000  # a search is asked for its first candidates in order of priority; the operator's default is the whole product


def _values(name, values, kind="DOUBLE"):
    rows = ", ".join(f"({i}, {'NULL' if v is None else repr(v)}::{kind})" for i, v in enumerate(values))
    return f"(VALUES {rows}) {name}({name}_i, {name})"


def _list(values):
    return "[" + ", ".join(map(str, values)) + "]"


_SET_VALUES = ", ".join(f"({i}, '{'+'.join(s)}')" for i, s in enumerate(grid.SETS))
_SET_BITS = " + ".join(f"CASE WHEN {' AND '.join(f'({rl.PREDICATES[p]})' for p in s) or 'true'} THEN {1 << i} ELSE 0 END" for i, s in enumerate(grid.SETS))
_MOMENTUM_VALUE = "CASE c.mom " + " ".join(f"WHEN '{m}' THEN r.{m}" for m in grid.MOMENTUM) + " END"

add_view("screen_frame", """
SELECT r.*, t.ema_10_20_spread, t.ema_20_50_spread, (r.close - r.sma20 + 2 * r.std20) / nullif(4 * r.std20, 0) AS percent_b,
       lead(r.low) OVER (PARTITION BY r.symbol ORDER BY r.session) / nullif(r.close, 0) - 1 AS next_low,
       lead(r.high) OVER (PARTITION BY r.symbol ORDER BY r.session) / nullif(r.close, 0) - 1 AS next_high
FROM rule_frame r LEFT JOIN (SELECT symbol, session, (ema10 - ema20) / nullif(close, 0) AS ema_10_20_spread, (ema20 - ema50) / nullif(close, 0) AS ema_20_50_spread
                             FROM technical_rows) t ON t.symbol = r.symbol AND t.session = r.session""")
add_view("screen_candidates", f"""
SELECT *, row_number() OVER (ORDER BY {{order}}) - 1 AS rank FROM (SELECT * FROM {_values('tw', grid.TRAIN_WINDOWS)}, {_values('sw', grid.TEST_WINDOWS)}, {_values('mq', grid.MOMENTUM_QUANTILES)},
  {_values('vq', grid.VOLUME_QUANTILES)}, {_values('mom', grid.MOMENTUM, 'VARCHAR')}, {_values('rsi', grid.RSI_CAPS)}, {_values('pf', grid.PRICE_FLOORS)},
  {_values('vx', grid.VIX_QUANTILES)}, {_values('stop', grid.STOPS)}, {_values('take', grid.TAKES)}, {_values('ex', grid.EXPOSURES)}, (VALUES {_SET_VALUES}) st(set_i, flags)
  WHERE take > stop ORDER BY {{order}} LIMIT {CAP})""".format(order=f"""abs(tw - {grid.BASE_TRAIN}) / 252, abs(sw - {grid.BASE_TEST}) / 63, abs(mq - 0.65::DOUBLE), abs(vq - 0.55::DOUBLE),
  CASE WHEN mom IN ('ret10', 'ret20') THEN 0 WHEN mom IN ('ret5', 'ret60') THEN 1 ELSE 2 END, CASE WHEN contains(flags, 'sector_up') THEN 0 ELSE 1 END,
  abs(stop - {grid.BASE_STOP}::DOUBLE), abs(take - {grid.BASE_TAKE}::DOUBLE), tw_i, sw_i, mom_i, mq_i, vq_i, rsi_i, pf_i, vx_i, stop_i, take_i, ex_i, set_i"""))
_RULE = "tw, sw, mom, mq_i, vq_i, rsi_i, pf_i, vx_i, set_i"
add_view("screen_rules", f"SELECT {_RULE}, any_value(rsi) AS rsi, any_value(pf) AS pf, min(rank) AS rule FROM screen_candidates GROUP BY ALL")
add_view("screen_rows", """
SELECT b.*, l.tw, l.sw, f.fold, CASE WHEN b.i < l.tw + f.fold * l.sw THEN 'train' ELSE 'test' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS len FROM screen_frame WHERE target_return IS NOT NULL) b,
     (SELECT DISTINCT tw, sw FROM screen_rules) l, range(0, 300) f(fold)
WHERE l.tw + f.fold * l.sw < b.len AND b.i >= f.fold * l.sw AND b.i < l.tw + f.fold * l.sw + l.sw""")
add_view("screen_active", f"""
WITH cuts AS (SELECT r.symbol, r.tw, r.sw, r.fold, c.mom, quantile_cont({_MOMENTUM_VALUE}, {_list(grid.MOMENTUM_QUANTILES)}) AS cm, quantile_cont(vol_ratio, {_list(grid.VOLUME_QUANTILES)}) AS cv,
                     quantile_cont(stress, {rl.STRESS_Q}) AS stress_cut, quantile_cont(vix_chg5, {_list(grid.VIX_QUANTILES[1:])}) AS cx
              FROM screen_rows r, (SELECT DISTINCT mom FROM screen_rules) c WHERE role = 'train' GROUP BY 1, 2, 3, 4, 5),
wide AS (SELECT r.*, c.mom, q.mq_i, q.vq_i, k.cx, {_SET_BITS} AS sets FROM screen_rows r JOIN cuts k ON k.symbol = r.symbol AND k.tw = r.tw AND k.sw = r.sw AND k.fold = r.fold
  JOIN (SELECT DISTINCT tw, sw, mom, mq_i, vq_i FROM screen_rules) q ON q.tw = r.tw AND q.sw = r.sw AND q.mom = k.mom JOIN (SELECT DISTINCT mom FROM screen_rules) c ON c.mom = k.mom
  WHERE {_MOMENTUM_VALUE} > k.cm[q.mq_i + 1] AND vol_ratio > k.cv[q.vq_i + 1]),
slim AS (SELECT symbol, tw, sw, fold, role, i, year(session) AS year, target_return, target_direction, next_low, next_high, mom, mq_i, vq_i, rsi_14, p60, sets, vix_chg5 < cx[1] AS v1, vix_chg5 < cx[2] AS v2 FROM wide)
SELECT w.symbol, w.fold, w.role, w.i, w.year, w.target_return, w.target_direction, w.next_low, w.next_high, s.rule
FROM slim w JOIN screen_rules s ON s.tw = w.tw AND s.sw = w.sw AND s.mom = w.mom AND s.mq_i = w.mq_i AND s.vq_i = w.vq_i
WHERE (w.sets >> s.set_i) & 1 = 1 AND (s.vx_i = 0 OR (s.vx_i = 1 AND v1) OR (s.vx_i = 2 AND v2)) AND (s.rsi IS NULL OR rsi_14 < s.rsi) AND (s.pf IS NULL OR p60 > s.pf)""")
add_view("screen_results", f"""
WITH fit AS (SELECT symbol, fold, rule, count(*) AS tn, sum(target_direction) AS tu FROM screen_active WHERE role = 'train' GROUP BY ALL),
hits AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY symbol, fold, rule ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS entry FROM screen_active WHERE role = 'test'),
fitted AS (SELECT h.*, least(greatest((coalesce(f.tu, 0) + 6) / (coalesce(f.tn, 0) + 12), 0.51), 0.85) AS p FROM hits h LEFT JOIN fit f USING (symbol, fold, rule)),
lost AS (SELECT symbol, rule, sum(CASE WHEN 2 * u < n THEN 1 ELSE 0 END) AS lost FROM (SELECT symbol, fold, rule, count(*) AS n, sum(target_direction) AS u FROM hits GROUP BY ALL) GROUP BY ALL),
parts AS (SELECT symbol, fold, rule, year, any_value(p) AS p, count(*) AS n, sum(target_direction) AS u, sum(entry) AS entries FROM fitted GROUP BY symbol, fold, rule, year),
years AS (SELECT symbol, rule, sum(n) AS n, sum(u) AS u, sum(entries) AS entries, sum(floor((u * (1 - p) * (1 - p) + (n - u) * p * p) * {grid.BILLION} + 0.5)) AS miss FROM parts GROUP BY symbol, rule, year),
whole AS (SELECT symbol, rule, sum(n) AS n, sum(u) AS u, sum(entries) AS entries, sum(miss) AS miss, stddev_pop(u / n) AS year_std, min(u / n) AS worst_year FROM years GROUP BY ALL),
worth AS (SELECT symbol, rule, stop_i, take_i, sum(floor(greatest(r, 0) * 1000000 + 0.5)) AS gain, sum(floor(greatest(-r, 0) * 1000000 + 0.5)) AS loss FROM (
  SELECT h.*, b.stop_i, b.take_i, CASE WHEN next_low <= -b.stop THEN -b.stop WHEN next_high >= b.take THEN b.take ELSE target_return END AS r
  FROM hits h, (SELECT DISTINCT stop_i, stop, take_i, take FROM screen_candidates) b) GROUP BY ALL),
days AS (SELECT symbol, tw, sw, count(*) AS days FROM screen_rows WHERE role = 'test' GROUP BY ALL),
joined AS (SELECT d.symbol, c.*, d.days, coalesce(w.n, 0) AS n, coalesce(w.u, 0) AS u, coalesce(w.entries, 0) AS entries, w.miss, w.year_std, w.worst_year, coalesce(g.gain, 0) AS gain, coalesce(g.loss, 0) AS loss, coalesce(l.lost, 99) AS lost
  FROM (SELECT c.*, s.rule FROM screen_candidates c JOIN screen_rules s USING ({_RULE})) c JOIN days d USING (tw, sw) LEFT JOIN whole w USING (symbol, rule) LEFT JOIN worth g USING (symbol, rule, stop_i, take_i) LEFT JOIN lost l USING (symbol, rule)),
measured AS (SELECT symbol, rank, tw, sw, mom, mq, vq, rsi, pf, vx, stop, take, ex, flags, n AS active_days, entries AS trades, n / days AS coverage, CASE WHEN n > 0 THEN u / n ELSE 0 END AS precision,
  CASE WHEN n > 0 THEN ex * (gain - loss) / 1000000 / n ELSE 0 END AS avg_return, CASE WHEN loss > 0 THEN gain / loss END AS profit_factor, coalesce(worst_year, 0) AS worst_year,
  CASE WHEN n > 0 THEN year_std ELSE 1 END AS year_std, lost AS losing_windows, coalesce(miss, 0) AS miss, gain, loss FROM joined)
SELECT *, CASE WHEN active_days >= {grid.MIN_DAYS} AND trades >= {grid.MIN_TRADES}
  THEN precision * 5 + least(coalesce(profit_factor, CASE WHEN gain > 0 THEN 5 ELSE 0 END), 5) * 0.45::DOUBLE + avg_return * 50 - greatest(coverage - 0.25::DOUBLE, 0) * 3 - year_std * 1.5::DOUBLE - losing_windows * 0.15::DOUBLE
  ELSE -100 - greatest({grid.MIN_DAYS} - active_days, 0) - 2 * greatest({grid.MIN_TRADES} - trades, 0) END AS screen_score FROM measured""")


def build_screen_frame(spark, d):
    """Rule columns, the remaining momentum columns and the next session's extremes."""
    key = ["symbol", "session"]
    r = sg.rule_frame(spark, d)
    band = F.col("std20") * 2
    r = r.select("*", sdiv(F.col("close") - F.col("sma20") + band, band * 2).alias("percent_b"),
                 (sdiv(F.lead("low").over(by_symbol()), "close") - 1).alias("next_low"), (sdiv(F.lead("high").over(by_symbol()), "close") - 1).alias("next_high"))
    return r.join(feat.technical_block(views.features(spark, d)).select(*key, "ema_10_20_spread", "ema_20_50_spread"), key, "left")


def screened(spark, d):
    """Results of the first ``CAP`` candidates for every symbol, a stage table."""
    return stage(spark, d, "screened", views.BAR_TABLES, lambda s, f: grid.screen(stage(s, f, "screen_frame", views.BAR_TABLES, build_screen_frame), CAP))


@query("j14_candidate_screen", "symbol:s rank:i active_days:i trades:i coverage:8 precision:8 gain:i loss:i profit_factor:5 worst_year:6 year_std:6 losing_windows:i miss:i screen_score:5",
       "SELECT * FROM screen_results", "J14 P11 L08")
def _(spark, d):
    return screened(spark, d)


@query("l08_screen_leaders", "symbol:s place:i rank:i label:s stop:3 take:3 exposure:2 screen_score:5",
       """SELECT * FROM (SELECT symbol, rank, stop, take, ex AS exposure, screen_score, row_number() OVER (PARTITION BY symbol ORDER BY round(screen_score, 6) DESC, rank) AS place,
            printf('tw%d_sw%d_%s_mq%.2f_vq%.2f_', CAST(tw AS INT), CAST(sw AS INT), mom, mq, vq) || coalesce(nullif(concat_ws('+', nullif(flags, ''), 'rsi<' || printf('%.2f', rsi), 'p60>' || printf('%.2f', pf), 'vix<' || printf('%.2f', vx)), ''), 'base') AS label
            FROM screen_results) WHERE place <= 20""", "L08 L02")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.round("screen_score", 6).desc(), "rank")
    best = screened(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 20")
    return grid.labelled(best, CAP)
