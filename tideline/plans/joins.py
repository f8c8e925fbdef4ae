"""Join queries: as-of in both directions, overlap, range with aggregate, semi, anti, nearest."""

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import flag, sdiv
from tideline.operators import features as feat
from tideline.operators.asof import asof_join, backward_map, forward_map, interval_overlap_join
from tideline.operators.rolling import by_symbol, pct_change, trailing
from tideline.plans.catalog import query
from tideline.plans.sqlviews import add_view
from tideline.sources import views
from tideline.sources.tables import read_table


@query("j01_feature_families", "symbol:s session:d ret5:8 mean5:8 breadth5:6 shock_count:i max_abs:8 idx_ret5:8",
       """SELECT f.symbol, f.session, f.ret5, p.mean5, p.breadth5, s.shock_count, s.max_abs, f.idx_ret5
          FROM features f LEFT JOIN peers p USING (session) LEFT JOIN shocks s USING (session)""", "J01")
def _(spark, d):
    f = views.features(spark, d)
    return (f.select("symbol", "session", "ret5", "idx_ret5")
            .join(feat.peer_cross_section(f).select("session", "mean5", "breadth5"), "session", "left")
            .join(feat.peer_shocks(f).select("session", "shock_count", "max_abs"), "session", "left"))


@query("j02_backward_asof", "event_id:i symbol:s bar_close:6 bar_end:t",
       """SELECT t.event_id, t.symbol, b.close AS bar_close, b.bar_end FROM ticks t ASOF LEFT JOIN
          (SELECT symbol, bar + INTERVAL 1 HOUR AS bar_end, close FROM intraday) b ON t.symbol = b.symbol AND t.ts >= b.bar_end""", "J02")
def _(spark, d):
    done = views.intraday(spark, d).select("symbol", (F.col("bar") + F.expr("INTERVAL 1 HOUR")).alias("bar_end"), "close")
    j = asof_join(views.ticks(spark, d).select("event_id", "symbol", "ts"), done, "ts", "bar_end", ["bar_end", "close"],
                  ["symbol"], grain="hour")
    return j.withColumnRenamed("close", "bar_close")


add_view("statements", """
SELECT symbol, quarter, visible, revenue,
       CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 2
         THEN sum(revenue) OVER (PARTITION BY symbol ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS revenue_ttm,
       revenue / nullif(lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY quarter), 0) - 1 AS growth
FROM (SELECT symbol, CAST(date_trunc('quarter', session) AS DATE) AS quarter,
             CAST(date_trunc('quarter', session) + INTERVAL 3 MONTH AS DATE) AS visible, sum(ext) AS revenue
      FROM lines GROUP BY 1, 2, 3)""")


@query("j03_report_lag_asof", "symbol:s session:d revenue_ttm:2 growth:6 price_to_revenue:8",
       """SELECT b.symbol, b.session, s.revenue_ttm, s.growth, b.close / nullif(s.revenue_ttm / 1000000, 0) AS price_to_revenue
          FROM bars b ASOF LEFT JOIN statements s ON b.symbol = s.symbol AND b.session >= s.visible""", "J03")
def _(spark, d):
    q = views.lines(spark, d).groupBy("symbol", F.trunc("session", "quarter").alias("quarter")).agg(F.sum("ext").alias("revenue"))
    w = Window.partitionBy("symbol").orderBy("quarter")
    four = w.rowsBetween(-3, 0)
    # A statement closes on the last day of its quarter and is visible one day later.
    q = q.select("symbol", F.add_months("quarter", 3).alias("visible"),
                 F.when(F.count("*").over(four) >= 2, F.sum("revenue").over(four)).alias("revenue_ttm"),
                 pct_change("revenue", 4, w).alias("growth"))
    j = asof_join(views.bars(spark, d).select("symbol", "session", "close"), q, "session", "visible",
                  ["visible", "revenue_ttm", "growth"], ["symbol"])
    return j.withColumn("price_to_revenue", sdiv("close", F.col("revenue_ttm") / 1000000))


@query("j04_forward_anchor", "sample_id:i event_date:d anchor:d pos:i",
       """SELECT s.sample_id, s.event_date, m.session AS anchor, m.pos FROM samples s ASOF LEFT JOIN sessions m
          ON s.event_date <= m.session""", "J04")
def _(spark, d):
    s = views.samples(spark, d)
    days = s.select("event_date").distinct()
    anchored = asof_join(days, views.sessions(spark, d).withColumnRenamed("session", "anchor"), "event_date", "anchor",
                         ["anchor", "pos"], forward=True)
    return s.join(anchored, "event_date", "left")


@query("j05_forward_asof_instant", "doc_id:i available_at:t session:d market_close:t",
       """SELECT a.doc_id, a.available_at, s.session, s.market_close FROM articles a ASOF LEFT JOIN sessions s
          ON a.available_at <= s.market_close""", "J05")
def _(spark, d):
    return asof_join(views.articles(spark, d).select("doc_id", "available_at"), views.sessions(spark, d), "available_at",
                     "market_close", ["market_close", "session"], forward=True)


@query("j06_point_in_time_history", "doc_id:i known_session:d ret5:8 vol20:8",
       """SELECT a.doc_id, m.session AS known_session, m.ret5, m.vol20 FROM articles a ASOF LEFT JOIN (
            SELECT session, CAST(session AS TIMESTAMP) + INTERVAL 21 HOUR AS market_close, idx / lag(idx, 5) OVER w - 1 AS ret5,
              CASE WHEN count(r) OVER f >= 20 THEN stddev_pop(r) OVER f END AS vol20
            FROM (SELECT *, idx / lag(idx) OVER (ORDER BY session) - 1 AS r FROM market)
            WINDOW w AS (ORDER BY session), f AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) m
          ON a.available_at >= m.market_close""", "J06")
def _(spark, d):
    w = Window.orderBy("session")
    f = trailing(20, 0, w)
    m = views.market(spark, d).withColumn("r", pct_change("idx", 1, w)).select(
        F.col("session").alias("known_session"),
        (F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOUR")).alias("market_close"),
        pct_change("idx", 5, w).alias("ret5"), F.when(F.count("r").over(f) >= 20, F.stddev_pop("r").over(f)).alias("vol20"))
    return asof_join(views.articles(spark, d).select("doc_id", "available_at"), m, "available_at", "market_close",
                     ["market_close", "known_session", "ret5", "vol20"])


@query("j07_news_to_session", "session:d articles:i chars:i",
       """SELECT session, count(*) AS articles, sum(length(body)) AS chars FROM (SELECT a.*, s.session FROM articles a
          ASOF JOIN sessions s ON a.available_at <= s.market_close) GROUP BY 1""", "J07")
def _(spark, d):
    a = views.articles(spark, d).select("available_at", F.length("body").alias("chars"))
    j = asof_join(a, views.sessions(spark, d), "available_at", "market_close", ["market_close", "session"], forward=True)
    return j.filter("session IS NOT NULL").groupBy("session").agg(F.count("*").alias("articles"), F.sum("chars").alias("chars"))


@query("j08_lagged_asof", "sample_id:i feature_date:d vix:6",
       """SELECT s.sample_id, m.session AS feature_date, m.vix FROM samples s ASOF LEFT JOIN market m
          ON s.event_date - 1 >= m.session""", "J08")
def _(spark, d):
    s = views.samples(spark, d).withColumn("limit_day", F.date_sub("event_date", 1))
    days = s.select("limit_day").distinct()
    env = asof_join(days, views.market(spark, d).withColumnRenamed("session", "feature_date"), "limit_day", "feature_date",
                    ["feature_date", "vix"])
    return s.join(env, "limit_day", "left")


add_view("metric_history", """
SELECT session AS obs, 'rate' AS metric, CASE WHEN tnx > 40 THEN tnx END AS value FROM market UNION ALL
SELECT session, 'vol', CASE WHEN vix > 20 THEN vix END FROM market UNION ALL
SELECT session, 'index', CASE WHEN vix < 21 THEN idx END FROM market""")


def metric_history(spark, d):
    m = views.market(spark, d)
    return m.select(F.col("session").alias("obs"), F.inline(F.array(
        F.struct(F.lit("rate").alias("metric"), F.when(F.col("tnx") > 40, F.col("tnx")).alias("value")),
        F.struct(F.lit("vol").alias("metric"), F.when(F.col("vix") > 20, F.col("vix")).alias("value")),
        F.struct(F.lit("index").alias("metric"), F.when(F.col("vix") < 21, F.col("idx")).alias("value")))))


@query("j09_metric_asof", "event_date:d rate:6 vol:6 index_level:6",
       """SELECT event_date, max(value) FILTER (metric = 'rate') AS rate, max(value) FILTER (metric = 'vol') AS vol,
            max(value) FILTER (metric = 'index') AS index_level
          FROM (SELECT e.event_date, e.metric, h.value FROM (SELECT DISTINCT event_date, metric FROM samples, (VALUES ('rate'), ('vol'), ('index')) t(metric)) e
            ASOF LEFT JOIN (SELECT * FROM metric_history WHERE value IS NOT NULL) h ON e.metric = h.metric AND e.event_date >= h.obs)
          GROUP BY 1""", "J09")
def _(spark, d):
    days = views.samples(spark, d).select("event_date").distinct().withColumn(
        "metric", F.explode(F.array(F.lit("rate"), F.lit("vol"), F.lit("index"))))
    h = metric_history(spark, d).filter("value IS NOT NULL")
    j = asof_join(days, h, "event_date", "obs", ["obs", "value"], ["metric"])
    p = j.groupBy("event_date").pivot("metric", ["rate", "vol", "index"]).agg(F.max("value"))
    return p.withColumnRenamed("index", "index_level")


add_view("noise_periods", """
SELECT 'vol-' || strftime(m, '%Y-%m') AS name, m AS start_day, CAST(m + INTERVAL 1 MONTH AS DATE) - 1 AS end_day
FROM (SELECT CAST(date_trunc('month', session) AS DATE) AS m, avg(vix) AS v FROM market GROUP BY 1) WHERE v > 20.4""")


def noise_periods(spark, d):
    m = views.market(spark, d).groupBy(F.trunc("session", "month").alias("start_day")).agg(F.avg("vix").alias("v"))
    return m.filter("v > 20.4").select(F.concat(F.lit("vol-"), F.date_format("start_day", "yyyy-MM")).alias("name"),
                                       "start_day", F.last_day("start_day").alias("end_day"))


def noisy_days(spark, d):
    """Event dates with the names of noise periods within ten days, at one row per date."""
    days = views.samples(spark, d).select("event_date").distinct().select(
        "event_date", F.date_sub("event_date", 10).alias("lo"), F.date_add("event_date", 10).alias("hi"))
    hits = interval_overlap_join(days, noise_periods(spark, d), ("lo", "hi"), ("start_day", "end_day"))
    named = hits.groupBy("event_date").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("noise_reason"))
    return days.join(named, "event_date", "left")


@query("j10_interval_overlap", "sample_id:i excluded:i noise_reason:s",
       """SELECT s.sample_id, CASE WHEN count(p.name) > 0 THEN 1 ELSE 0 END AS excluded,
            coalesce(string_agg(DISTINCT p.name, '; ' ORDER BY p.name), '') AS noise_reason
          FROM samples s LEFT JOIN noise_periods p ON p.start_day <= s.event_date + 10 AND p.end_day >= s.event_date - 10 GROUP BY 1""", "J10 S14")
def _(spark, d):
    s = views.samples(spark, d).select("sample_id", "event_date").join(noisy_days(spark, d), "event_date", "left")
    return s.select("sample_id", F.col("noise_reason").isNotNull().cast("int").alias("excluded"),
                    F.coalesce("noise_reason", F.lit("")).alias("noise_reason"))


add_view("upcoming", """
SELECT theme AS event_id, list_sort(list_distinct(list(CASE WHEN size > 495000 THEN category END) || [theme])) AS categories
FROM samples GROUP BY 1""")


AS_OF, SAMPLES_FROM = "1998-01-01", "1993-01-01"  # decision day and first day of the history


@query("p25_event_samples", "event_id:s sample_id:i event_date:d comparability:2",
       f"""SELECT DISTINCT u.event_id, s.sample_id, s.event_date, CASE WHEN s.category = list_min(u.categories) THEN 1.0 ELSE 0.75 END AS comparability
          FROM upcoming u JOIN samples s ON list_has_any(u.categories, [s.category, s.theme]) WHERE s.event_date < DATE '{AS_OF}' AND s.event_date >= DATE '{SAMPLES_FROM}'""", "P25")
def _(spark, d):
    return event_samples(upcoming(spark, d).withColumn("category", F.array_min("categories")), views.samples(spark, d), AS_OF, SAMPLES_FROM)


def event_samples(events, samples, as_of: str, start: str = "1900-01-01"):
    """Earlier samples that share a category with an event: comparability 1.0 for the event's own category, 0.75 for
    any other shared one. Dates before the decision day only; one row per sample and date."""
    past = samples.filter((F.col("event_date") < F.lit(as_of).cast("date")) & (F.col("event_date") >= F.lit(start).cast("date")))
    past = past.select("sample_id", "event_date", F.col("category").alias("_own"), F.explode(F.array_distinct(F.array("category", "theme"))).alias("tag"))
    met = events.select("event_id", "category", F.explode("categories").alias("tag")).join(past, "tag")
    return met.groupBy("event_id", "sample_id", "event_date").agg(
        F.max(F.when(F.col("_own") == F.col("category"), 1.0).otherwise(0.75)).alias("comparability"))


def upcoming(spark, d):
    s = views.samples(spark, d)
    return s.groupBy("theme").agg(F.collect_set(F.when(F.col("size") > 495000, F.col("category"))).alias("big")).select(
        F.col("theme").alias("event_id"), F.array_distinct(F.concat("big", F.array("theme"))).alias("categories"))


@query("j11_array_overlap", "event_id:s n_samples:i avg_size:4",
       """SELECT u.event_id, count(*) AS n_samples, avg(s.size) AS avg_size FROM upcoming u JOIN samples s
          ON list_has_any(u.categories, [s.category, s.theme]) GROUP BY 1""", "J11 P25")
def _(spark, d):
    s = views.samples(spark, d)
    up = upcoming(spark, d)
    # Samples collapse to one row per category set before they meet the events.
    sets = s.groupBy(F.array("category", "theme").alias("tags")).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    met = up.select("event_id", F.explode("categories").alias("tag")).join(
        sets.select("tags", "n", "total", F.explode("tags").alias("tag")), "tag")
    once = met.groupBy("event_id", "tags").agg(F.first("n").alias("n"), F.first("total").alias("total"))
    return once.groupBy("event_id").agg(F.sum("n").alias("n_samples"), (F.sum("total") / F.sum("n")).alias("avg_size"))


@query("j12_range_aggregate", "event_date:d rows_near:i max_vix:6 worst5:8",
       """WITH m AS (SELECT session, vix, idx / lag(idx, 5) OVER (ORDER BY session) - 1 AS r5, lag(session, 5) OVER (ORDER BY session) AS from_day FROM market)
          SELECT e.event_date, count(m.session) AS rows_near, max(m.vix) AS max_vix,
            CASE WHEN count(m.session) >= 5 THEN min(CASE WHEN m.from_day >= e.event_date - 10 THEN m.r5 END) END AS worst5
          FROM (SELECT DISTINCT event_date FROM samples) e LEFT JOIN m ON m.session BETWEEN e.event_date - 10 AND e.event_date + 10 GROUP BY 1""", "J12")
def _(spark, d):
    w = Window.orderBy("session")
    m = views.market(spark, d).select("session", "vix", pct_change("idx", 5, w).alias("r5"), F.lag("session", 5).over(w).alias("from_day"))
    # Each session reaches the dates whose +-10 day window contains it: a generator, not a range join.
    near = m.withColumn("event_date", F.explode(F.sequence(F.date_sub("session", 10), F.date_add("session", 10))))
    agg = near.groupBy("event_date").agg(
        F.count("*").alias("rows_near"), F.max("vix").alias("max_vix"),
        F.min(F.when(F.col("from_day") >= F.date_sub("event_date", 10), F.col("r5"))).alias("worst"))
    days = views.samples(spark, d).select("event_date").distinct()
    return days.join(agg, "event_date", "left").select(
        "event_date", F.coalesce("rows_near", F.lit(0)).alias("rows_near"), "max_vix",
        F.when(F.col("rows_near") >= 5, F.col("worst")).alias("worst5"))


@query("j17_anti_join", "doc_id:i source:s", "SELECT doc_id, source FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "J17")
def _(spark, d):
    return views.articles(spark, d).join(read_table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j18_semi_join", "symbol:s session:d close:4",
       """SELECT symbol, session, close FROM bars WHERE sector IN (SELECT r_name FROM region JOIN nation ON r_regionkey = n_regionkey
          JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer))""", "J18")
def _(spark, d):
    c = (read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    # Average per region and overall from the same partial sums.
    a = c.groupBy(F.col("r_name").alias("sector")).agg(F.sum("c_acctbal").alias("s"), F.count("c_acctbal").alias("n"))
    a = a.withColumn("overall", F.sum("s").over(Window.partitionBy(F.lit(1))) / F.sum("n").over(Window.partitionBy(F.lit(1))))
    rich = a.filter("s / n > overall").select("sector")
    return views.bars(spark, d).join(rich, "sector", "left_semi")


@query("j19_leave_one_out", "sample_id:i category:s size:2 others_mean:4",
       """SELECT sample_id, category, size, (sum(size) OVER (PARTITION BY category) - size) / nullif(count(*) OVER (PARTITION BY category) - 1, 0) AS others_mean
          FROM samples""", "J19")
def _(spark, d):
    s = views.samples(spark, d)
    # Totals by partial aggregation and an equi-join, so a hot category is never one window partition.
    t = s.groupBy("category").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    return s.join(t, "category").select("sample_id", "category", "size",
                                        sdiv(F.col("total") - F.col("size"), F.col("n") - 1).alias("others_mean"))


@query("j22_nearest_pick", "symbol:s session:d expiry:d atm_strike:2 near_delta_strike:2 dte:i",
       """WITH e AS (SELECT symbol, session, arg_min(expiry, (abs(dte - 30), CASE WHEN dte < 30 THEN 1 ELSE 0 END, dte)) AS expiry FROM option_bars GROUP BY 1, 2)
          SELECT o.symbol, o.session, o.expiry, arg_min(strike, (abs(strike - spot), strike)) AS atm_strike,
            arg_min(strike, (abs(abs(delta) - 0.25), strike)) AS near_delta_strike, min(dte) AS dte
          FROM option_bars o JOIN e ON o.symbol = e.symbol AND o.session = e.session AND o.expiry = e.expiry GROUP BY 1, 2, 3""", "J22")
def _(spark, d):
    o = views.option_bars(spark, d)
    score = F.struct(F.abs(F.col("dte") - 30), flag(F.col("dte") < 30), "dte")
    per_expiry = o.groupBy("symbol", "session", "expiry", "dte").agg(
        F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).alias("atm_strike"),
        F.min_by("strike", F.struct(F.abs(F.abs("delta") - 0.25), "strike")).alias("near_delta_strike"))
    best = per_expiry.groupBy("symbol", "session").agg(
        F.min_by(F.struct("expiry", "atm_strike", "near_delta_strike", "dte"), score).alias("b"))
    return best.select("symbol", "session", "b.*")


@query("j23_tolerance_compare", "symbol:s metric:s recorded:4 recomputed:4 verdict:s",
       """WITH recorded AS (SELECT symbol, metric, round(value, 2) AS recorded FROM (
            SELECT symbol, 'close' AS metric, avg(close) AS value FROM bars GROUP BY 1 UNION ALL SELECT symbol, 'days', count(*) FROM bars GROUP BY 1)),
          recomputed AS (SELECT symbol, metric, value AS recomputed FROM (SELECT symbol, 'close' AS metric, sum(close) / count(*) AS value FROM bars GROUP BY 1
            UNION ALL SELECT symbol, 'days', count(DISTINCT session) FROM bars GROUP BY 1 UNION ALL SELECT symbol, 'open', avg(open) FROM bars GROUP BY 1))
          SELECT symbol, metric, recorded, recomputed, CASE WHEN recorded IS NULL OR recomputed IS NULL THEN 'missing'
            WHEN abs(recorded - recomputed) <= 1e-10 THEN 'exact' WHEN abs(recorded - recomputed) <= 0.001 + 1e-5 * abs(recomputed) THEN 'near' ELSE 'mismatch' END AS verdict
          FROM recorded FULL JOIN recomputed USING (symbol, metric)""", "J23")
def _(spark, d):
    b = views.bars(spark, d)
    a = b.groupBy("symbol").agg(F.avg("close").alias("close"), F.count("*").cast("double").alias("days"))
    recorded = a.unpivot("symbol", ["close", "days"], "metric", "value").select("symbol", "metric", F.round("value", 2).alias("recorded"))
    c = b.groupBy("symbol").agg((F.sum("close") / F.count("*")).alias("close"),
                                F.count_distinct("session").cast("double").alias("days"), F.avg("open").alias("open"))
    again = c.unpivot("symbol", ["close", "days", "open"], "metric", "recomputed")
    gap = F.abs(F.col("recorded") - F.col("recomputed"))
    return recorded.join(again, ["symbol", "metric"], "full").withColumn(
        "verdict", F.when(gap.isNull(), "missing").when(gap <= 1e-10, "exact")
        .when(gap <= 0.001 + 1e-5 * F.abs("recomputed"), "near").otherwise("mismatch"))


@query("j24_matured_outcomes", "symbol:s session:d prob_up:6 exit_session:d realised:8 matured:i",
       """SELECT s.symbol, s.session, s.prob_up, e.exit_session, CASE WHEN e.exit_session <= DATE '2001-06-30' THEN x.close / s.close - 1 END AS realised,
            CASE WHEN e.exit_session <= DATE '2001-06-30' THEN 1 ELSE 0 END AS matured
          FROM signals s JOIN (SELECT symbol, session, lead(session, 5) OVER (PARTITION BY symbol ORDER BY session) AS exit_session FROM bars) e
            ON s.symbol = e.symbol AND s.session = e.session LEFT JOIN bars x ON x.symbol = s.symbol AND x.session = e.exit_session""", "J24")
def _(spark, d):
    b = views.bars(spark, d).select("symbol", "session", "close")
    exits = b.select("symbol", "session", F.lead("session", 5).over(by_symbol()).alias("exit_session"))
    j = views.signals(spark, d).select("symbol", "session", "prob_up", "close").join(exits, ["symbol", "session"])
    out = b.select("symbol", F.col("session").alias("exit_session"), F.col("close").alias("exit_close"))
    j = j.join(out, ["symbol", "exit_session"], "left")
    ripe = F.coalesce(F.col("exit_session") <= F.lit("2001-06-30").cast("date"), F.lit(False))
    return j.select("symbol", "session", "prob_up", "exit_session",
                    F.when(ripe, sdiv("exit_close", "close") - 1).alias("realised"), ripe.cast("int").alias("matured"))


@query("j25_labels_left_merge", "doc_id:i source:s quality:i toxic:i labelled:i",
       """SELECT a.doc_id, a.source, l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS labelled
          FROM articles a LEFT JOIN labels l ON a.doc_id = l.doc_id""", "J25")
def _(spark, d):
    lab = read_table(spark, d, "labels").withColumn("labelled", F.lit(1))
    return views.articles(spark, d).join(lab, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))


@query("j27_business_day_lookup", "symbol:s date:d prior_day:d next_day:d",
       """WITH days AS (SELECT DISTINCT b.symbol, e.event_date AS date FROM (SELECT DISTINCT symbol FROM bars) b, (SELECT DISTINCT event_date FROM samples) e)
          SELECT d.symbol, d.date, p.session AS prior_day, n.session AS next_day FROM days d ASOF LEFT JOIN bars p ON d.symbol = p.symbol AND d.date >= p.session
          ASOF LEFT JOIN bars n ON d.symbol = n.symbol AND d.date <= n.session""", "J27")
def _(spark, d):
    b = views.bars(spark, d).select("symbol", "session")
    days = views.samples(spark, d).select(F.col("event_date").alias("date")).distinct()
    ends = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()  # two dates
    # the maps reach beyond the sessions on one side each; a date outside a symbol's history keeps one neighbour
    nxt = forward_map(b, first_day=ends.a).withColumnRenamed("anchor", "next_day")
    prv = backward_map(b, ends.b).withColumnRenamed("anchor", "prior_day")
    return nxt.join(prv, ["symbol", "date"], "full").join(days, "date", "left_semi")
