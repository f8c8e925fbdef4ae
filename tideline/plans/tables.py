"""Source, validation, set-operation and scalar-function queries."""

import itertools
import math

from pyspark.sql import Window, functions as F

from tideline.functions.numeric import clip, finite, flag, logistic, logit, packed_order, sdiv, truth
from tideline.operators import features as feat, rules as rl
from tideline.operators.ranking import cluster_safe_boundaries, rank_all, walk_boundaries
from tideline.operators.rolling import by_symbol, pct_change, trailing
from tideline.plans import evaluation as evq, signals as sg
from tideline.plans.catalog import query
from tideline.plans.joins import metric_history
from tideline.plans.records import story
from tideline.plans.sqlviews import add_view
from tideline.sources import views
from tideline.sources.files import audit_columns
from tideline.sources.tables import read_table


@query("s01_daily_bars", "symbol:s sector:s session:d open:6 high:6 low:6 close:6 volume:3 n_lines:i",
       "SELECT * FROM bars WHERE session BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'", "S01")
def _(spark, d):
    return views.bars(spark, d).filter("session BETWEEN DATE'1995-06-01' AND DATE'2001-06-30'")


@query("s02_close_panel_fill", "session:d raw:9 filled:9 source:s",
       """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS session, avg(o_totalprice) / 1000 AS p, count(*) AS n FROM orders GROUP BY 1),
          x AS (SELECT m.session, CASE WHEN o.n >= 8 THEN o.p END AS p, CASE WHEN m.vix < 18 THEN m.idx END AS fb FROM market m LEFT JOIN o USING (session))
          SELECT session, coalesce(p, fb) AS raw, last_value(coalesce(p, fb) IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS filled, CASE WHEN p IS NOT NULL THEN 'primary' WHEN fb IS NOT NULL THEN 'fallback' ELSE 'filled' END AS source FROM x""", "S02")
def _(spark, d):
    o = read_table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("session")).agg((F.avg("o_totalprice") / 1000).alias("p"), F.count("*").alias("n"))
    x = views.market(spark, d).join(o, "session", "left").select("session", F.when(F.col("n") >= 8, F.col("p")).alias("p"), F.when(F.col("vix") < 18, F.col("idx")).alias("fb"))
    raw = F.coalesce("p", "fb")
    up = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("session", raw.alias("raw"), F.last(raw, ignorenulls=True).over(up).alias("filled"),
                    F.when(F.col("p").isNotNull(), "primary").when(F.col("fb").isNotNull(), "fallback").otherwise("filled").alias("source"))


@query("s03_peer_panel", "symbol:s sessions:i first:d last:d volume:2",
       """SELECT symbol, count(*) AS sessions, min(session) AS first, max(session) AS last, sum(volume) AS volume FROM bars WHERE sector IN (SELECT sector FROM (SELECT sector, sum(volume) AS v FROM bars GROUP BY 1 ORDER BY v DESC, sector LIMIT 2)) GROUP BY 1""", "S03")
def _(spark, d):
    b = views.bars(spark, d)
    top = b.groupBy("sector").agg(F.sum("volume").alias("v")).orderBy(F.desc("v"), "sector").limit(2).select("sector")
    return b.join(top, "sector", "left_semi").groupBy("symbol").agg(F.count("*").alias("sessions"), F.min("session").alias("first"), F.max("session").alias("last"), F.sum("volume").alias("volume"))


@query("s04_price_panel", "symbol:s session:d price:6 copies:i",
       """SELECT symbol, session, arg_max(CASE WHEN disc > 0.05 THEN price * (1 - disc) ELSE price END, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS price, count(*) AS copies FROM lines GROUP BY 1, 2""", "S04")
def _(spark, d):
    ln = views.lines(spark, d).withColumn("adjusted", F.when(F.col("disc") > 0.05, F.col("price") * (1 - F.col("disc"))))
    return ln.groupBy("symbol", "session").agg(F.max_by(F.coalesce("adjusted", "price"), views.line_order()).alias("price"), F.count("*").alias("copies"))


@query("s05_macro_parse", "obs_date:d value:4", "SELECT session AS obs_date, CASE WHEN vix >= 19 THEN round(vix, 4) END AS value FROM market WHERE session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", "S05")
def _(spark, d):
    m = views.market(spark, d)
    line = F.concat_ws(",", F.col("session").cast("string"), F.when(F.col("vix") < 19, ".").otherwise(F.round("vix", 4).cast("string")))
    row = F.from_csv(line, "obs_date DATE, value DOUBLE", {"nullValue": "."})
    return m.select(row.alias("r")).select("r.*").filter("obs_date BETWEEN DATE'1996-01-01' AND DATE'2000-12-31'")


@query("s06_window_resolution", "symbol:s report_start:d warmup_start:d end_day:d warm_rows:i report_rows:i",
       """WITH e AS (SELECT max(session) AS e, CAST(max(session) - INTERVAL 24 MONTH AS DATE) AS s FROM bars)
          SELECT symbol, any_value(s) AS report_start, any_value(s - 560) AS warmup_start, any_value(e) AS end_day, count(*) AS warm_rows, count(*) FILTER (session >= s) AS report_rows FROM bars, e WHERE session BETWEEN s - 560 AND e GROUP BY 1""", "S06")
def _(spark, d):
    b = views.bars(spark, d)
    li = read_table(spark, d, "lineitem")
    end = li.agg(F.to_date(F.max("l_shipdate"))).scalar()
    start = F.add_months(end, -24)
    x = b.filter(F.col("session").between(F.date_sub(start, 560), end))
    return x.groupBy("symbol").agg(F.count("*").alias("warm_rows"), F.sum((F.col("session") >= start).cast("int")).alias("report_rows")).select(
        "symbol", start.alias("report_start"), F.date_sub(start, 560).alias("warmup_start"), end.alias("end_day"), "warm_rows", "report_rows")


@query("s08_snapshot_json", "symbol:s session:d occ:s strike:2 volume:i",
       "SELECT symbol, session, occ, strike, CAST(volume AS BIGINT) AS volume FROM option_bars WHERE regexp_matches(occ, '^[A-Z0-9]+C')", "S08")
def _(spark, d):
    o = views.option_bars(spark, d)
    # One snapshot document per symbol and session: quotes of one day are few.
    quote = F.struct(F.col("strike").cast("int").alias("k"), F.col("volume").cast("int").alias("v"))
    snap = o.groupBy("symbol", "session").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("occ", quote.alias("q"))))).alias("doc"))
    m = F.from_json("doc", "map<string,struct<k:int,v:int>>")
    return snap.select("symbol", "session", F.explode(m).alias("occ", "q")).filter(F.col("occ").rlike("^[A-Z0-9]+C")).select(
        "symbol", "session", "occ", F.col("q.k").alias("strike"), F.col("q.v").alias("volume"))


@query("s09_minute_bars", "symbol:s minute:t price:6 size:2",
       "SELECT symbol, date_trunc('minute', ts) AS minute, arg_max(price, row(ts, event_id)) AS price, arg_max(size, row(ts, event_id)) AS size FROM ticks WHERE ts IS NOT NULL GROUP BY 1, 2", "S09")
def _(spark, d):
    t = views.ticks(spark, d)
    # Two feeds name their fields differently; the first present name wins.
    feed = t.select("symbol", "event_id", F.when(F.col("user_id") % 2 == 0, F.col("ts")).alias("t"), F.when(F.col("user_id") % 2 == 1, F.col("ts")).alias("timestamp"), F.col("price").alias("c"), "size")
    u = feed.withColumn("ts", F.coalesce("t", "timestamp")).filter("ts IS NOT NULL")
    k = views.tick_order()
    return u.groupBy("symbol", F.date_trunc("minute", "ts").alias("minute")).agg(F.max_by("c", k).alias("price"), F.max_by("size", k).alias("size"))


@query("s16_snapshot_overlay", "session:d metric:s value:6 source:s",
       """WITH u AS (SELECT session, 'vol' AS metric, vix AS value, 'auto' AS source, 1 AS p FROM market UNION ALL SELECT session, 'rate', tnx, 'auto', 1 FROM market UNION ALL SELECT session, 'vol', 19.5, 'manual', 2 FROM market WHERE vix > 22 UNION ALL SELECT session, 'level', idx, 'price', 3 FROM market)
          SELECT session, metric, arg_max(value, p) AS value, arg_max(source, p) AS source FROM u GROUP BY 1, 2""", "S16")
def _(spark, d):
    m = views.market(spark, d)
    row = lambda metric, v, src, p: F.struct(F.lit(metric).alias("metric"), v.cast("double").alias("value"), F.lit(src).alias("source"), F.lit(p).alias("p"))
    rows = F.array_compact(F.array(row("vol", F.col("vix"), "auto", 1), row("rate", F.col("tnx"), "auto", 1), F.when(F.col("vix") > 22, row("vol", F.lit(19.5), "manual", 2)), row("level", F.col("idx"), "price", 3)))
    return m.select("session", F.inline(rows)).groupBy("session", "metric").agg(F.max_by("value", "p").alias("value"), F.max_by("source", "p").alias("source"))


@query("s17_schema_growth", "kind:s rows:i with_theme:i with_lang:i",
       "SELECT kind, count(*) AS rows, count(theme) AS with_theme, count(lang) AS with_lang FROM (SELECT 'order' AS kind, sample_id AS id, theme, NULL AS lang FROM samples UNION ALL SELECT 'news', doc_id, NULL, lang FROM articles) GROUP BY 1", "S17 U01")
def _(spark, d):
    a = views.samples(spark, d).select(F.lit("order").alias("kind"), F.col("sample_id").alias("id"), "theme")
    b = views.articles(spark, d).select(F.lit("news").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("rows"), F.count("theme").alias("with_theme"), F.count("lang").alias("with_lang"))


@query("s20_latest_quotes", "symbol:s latest:t price:6 history:i", "SELECT symbol, max(ts) AS latest, arg_max(price, row(ts, event_id)) AS price, count(*) AS history FROM ticks GROUP BY 1", "S20 W31")
def _(spark, d):
    return views.ticks(spark, d).groupBy("symbol").agg(F.max("ts").alias("latest"), F.max_by("price", views.tick_order()).alias("price"), F.count("*").alias("history"))


@query("s21_strict_json", "symbol:s session:d doc:s", "SELECT symbol, session, CAST(json_object('symbol', symbol, 'n', n_lines, 'wide', CASE WHEN high > low THEN CAST(n_lines AS BIGINT) END) AS VARCHAR) AS doc FROM bars", "S21")
def _(spark, d):
    b = views.bars(spark, d)
    # A one-line bar has a 0/0 ratio: the NaN must leave as null.
    nan = finite(F.when(F.col("high") > F.col("low"), F.col("n_lines").cast("double")).otherwise(F.lit(float("nan"))))
    doc = F.to_json(F.struct("symbol", F.col("n_lines").alias("n"), nan.cast("bigint").alias("wide")), {"ignoreNullFields": "false"})
    return b.select("symbol", "session", doc.alias("doc"))


@query("s22_fingerprint", "year:i rows:i digest:i",
       """SELECT year, count(*) AS rows, sum(('0x' || substr(sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag)), 1, 8))::BIGINT) AS digest FROM (SELECT *, year(l_shipdate) AS year FROM lineitem) GROUP BY 1""", "S22")
def _(spark, d):
    li = read_table(spark, d, "lineitem")
    row = F.sha2(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint"), "l_returnflag").cast("binary"), 256)
    return li.select(F.year("l_shipdate").alias("year"), F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint").alias("h")).groupBy("year").agg(F.count("*").alias("rows"), F.sum("h").alias("digest"))


@query("s23_feed_history", "symbol:s month:d net:2 yoy:6 roll4:2 mean10:4",
       """WITH m AS (SELECT symbol, CAST(date_trunc('month', session) AS DATE) AS month, sum(CASE WHEN contains(occ, 'C0') THEN volume ELSE -volume END) AS net FROM option_bars GROUP BY 1, 2)
          SELECT *, net / nullif(lag(net, 12) OVER w, 0) - 1 AS yoy, CASE WHEN count(*) OVER f >= 4 THEN sum(net) OVER f END AS roll4, CASE WHEN count(*) OVER t >= 10 THEN avg(net) OVER t END AS mean10 FROM m
          WINDOW w AS (PARTITION BY symbol ORDER BY month), f AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), t AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "S23")
def _(spark, d):
    o = views.option_bars(spark, d)
    m = o.groupBy("symbol", F.trunc("session", "month").alias("month")).agg(F.sum(F.when(F.contains("occ", F.lit("C0")), F.col("volume")).otherwise(-F.col("volume"))).alias("net"))
    w = Window.partitionBy("symbol").orderBy("month")
    f, t = trailing(4, 0, w), trailing(10, 0, w)
    return m.select("symbol", "month", "net", pct_change("net", 12, w).alias("yoy"), F.when(F.count("*").over(f) >= 4, F.sum("net").over(f)).alias("roll4"), F.when(F.count("*").over(t) >= 10, F.avg("net").over(t)).alias("mean10"))


@query("s24_outer_merge", "obs:d rate:6 vol:6 index_level:6",
       """SELECT obs, rate, vol, index_level FROM (SELECT obs, value AS rate FROM metric_history WHERE metric = 'rate' AND value IS NOT NULL) FULL JOIN (SELECT obs, value AS vol FROM metric_history WHERE metric = 'vol' AND value IS NOT NULL) USING (obs)
          FULL JOIN (SELECT obs, value AS index_level FROM metric_history WHERE metric = 'index' AND value IS NOT NULL) USING (obs)""", "S24")
def _(spark, d):
    h = metric_history(spark, d).filter("value IS NOT NULL")
    # One shuffle and a pivot give the same table as a chain of full joins on the date.
    return h.groupBy("obs").pivot("metric", ["rate", "vol", "index"]).agg(F.first("value")).withColumnRenamed("index", "index_level")


@query("s25_filing_rows", "doc_id:i form:s headline:s event_type:s",
       """SELECT doc_id, upper(lang) AS form, upper(lang) || ' filing ' || CAST(published_at AS DATE) AS headline, CASE WHEN lang = 'de' THEN 'earnings' WHEN lang = 'fr' THEN 'guidance' ELSE 'neutral' END AS event_type FROM articles WHERE lang IN ('de', 'fr', 'en')""", "S25")
def _(spark, d):
    a = views.articles(spark, d).filter(F.col("lang").isin("de", "fr", "en"))
    return a.select("doc_id", F.upper("lang").alias("form"), F.concat(F.upper("lang"), F.lit(" filing "), F.to_date("published_at").cast("string")).alias("headline"),
                    F.when(F.col("lang") == "de", "earnings").when(F.col("lang") == "fr", "guidance").otherwise("neutral").alias("event_type"))


@query("s26_asset_dimension", "grp:s symbol:s customers:i",
       "SELECT r_name AS grp, n_name AS symbol, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2", "S26")
def _(spark, d):
    n = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    config = n.groupBy(F.col("r_name").alias("grp")).agg(F.to_json(F.collect_list("n_name")).alias("members"))
    dim = config.select("grp", F.explode(F.from_json("members", "array<string>")).alias("symbol")).distinct()
    per = read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    named = read_table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("symbol"), "customers")
    return dim.join(named, "symbol", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


# ---------------------------------------------------------------- validation
@query("p01_ohlcv_validation", "symbol:s bars:i bad_price:i bad_range:i bad_volume:i duplicates:i missing_sessions:i",
       """WITH v AS (SELECT symbol, count(*) AS bars, count(*) FILTER (least(open, high, low, close) <= 0) AS bad_price, count(*) FILTER (high < greatest(open, low, close) OR low > least(open, high, close)) AS bad_range, count(*) FILTER (volume < 0) AS bad_volume,
            count(*) - count(DISTINCT session) AS duplicates, min(session) AS a, max(session) AS b FROM bars GROUP BY 1)
          SELECT v.*, (SELECT count(*) FROM sessions s WHERE s.session BETWEEN v.a AND v.b) - bars AS missing_sessions FROM v""", "P01")
def _(spark, d):
    b = views.bars(spark, d).join(views.sessions(spark, d).select("session", "pos"), "session", "left")
    v = b.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.least("open", "high", "low", "close") <= 0).alias("bad_price"),
        F.count_if((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))).alias("bad_range"), F.count_if(F.col("volume") < 0).alias("bad_volume"),
        (F.count("*") - F.count_distinct("session")).alias("duplicates"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    return v.withColumn("missing_sessions", F.col("span") - F.col("bars"))


@query("u05_missing_sessions", "symbol:s session:d",
       """SELECT x.symbol, s.session FROM (SELECT symbol, min(session) AS a, max(session) AS b FROM bars GROUP BY 1) x JOIN sessions s ON s.session BETWEEN x.a AND x.b EXCEPT SELECT symbol, session FROM bars""", "U05 J17 P01")
def _(spark, d):
    cal = views.sessions(spark, d).select("session", "pos")
    have = views.bars(spark, d).select("symbol", "session").join(cal, "session")
    want = have.groupBy("symbol").agg(F.explode(F.sequence(F.min("pos"), F.max("pos"))).alias("pos"))
    return want.join(have.select("symbol", "pos"), ["symbol", "pos"], "left_anti").join(cal, "pos")


@query("p02_structural_clean", "event_type:s n:i valid:i mean_value:6",
       """SELECT event_type, count(*) AS n, count(v) AS valid, avg(v) AS mean_value FROM (SELECT event_type, CASE WHEN value < 1 THEN NULL WHEN value > 300 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""", "P02")
def _(spark, d):
    e = read_table(spark, d, "events")
    raw = F.when(F.col("value") < 1, "n/a").when(F.col("value") > 300, "Infinity").otherwise(F.col("value").cast("string"))
    v = finite(F.expr("try_cast(raw AS DOUBLE)"))
    return e.withColumn("raw", raw).withColumn("v", v).groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("valid"), F.avg("v").alias("mean_value"))


@query("p05_label_normalisation", "symbol:s labels:i midnight:i rejected:i first_utc:t",
       """SELECT symbol, count(*) AS labels, count(*) FILTER (t = date_trunc('day', t)) AS midnight, count(*) FILTER (t <> date_trunc('day', t)) AS rejected, min(t) AS first_utc FROM (SELECT symbol, CASE WHEN n_ticks >= 3 THEN date_trunc('day', bar) ELSE bar END AS t FROM intraday) GROUP BY 1""", "P05")
def _(spark, d):
    t = views.intraday(spark, d).select("symbol", F.when(F.col("n_ticks") >= 3, F.date_trunc("day", "bar").cast("timestamp_ntz")).otherwise(F.col("bar")).alias("t"))
    at_midnight = F.col("t") == F.date_trunc("day", "t").cast("timestamp_ntz")
    return t.groupBy("symbol").agg(F.count("*").alias("labels"), F.count_if(at_midnight).alias("midnight"), F.count_if(~at_midnight).alias("rejected"), F.min("t").alias("first_utc"))


@query("p08_log_returns", "symbol:s n:i mean_lr:8 std_lr:8", "SELECT symbol, count(lr) AS n, avg(lr) AS mean_lr, stddev_samp(lr) AS std_lr FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS lr FROM bars WHERE close > 0) GROUP BY 1 HAVING count(lr) >= 30", "P08")
def _(spark, d):
    b = views.bars(spark, d).filter("close > 0")
    lr = b.select("symbol", finite(F.log(F.col("close") / F.lag("close").over(by_symbol()))).alias("lr"))
    return lr.groupBy("symbol").agg(F.count("lr").alias("n"), F.avg("lr").alias("mean_lr"), F.stddev_samp("lr").alias("std_lr")).filter("n >= 30")


@query("p09_compounded_return", "symbol:s first_day:d last_day:d compounded:8", "SELECT symbol, min(session) AS first_day, max(session) AS last_day, arg_max(close, session) / arg_min(close, session) - 1 AS compounded FROM bars WHERE session BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY 1", "P09")
def _(spark, d):
    b = views.bars(spark, d).filter("session BETWEEN DATE'1997-01-01' AND DATE'1999-12-31'")
    return b.groupBy("symbol").agg(F.min("session").alias("first_day"), F.max("session").alias("last_day"), (F.max_by("close", "session") / F.min_by("close", "session") - 1).alias("compounded"))


@query("p24_extreme_flags", "session:d percentile:5 flag:s",
       """SELECT session, p AS percentile, CASE WHEN p >= 90 THEN 'extreme_high' WHEN p <= 10 THEN 'extreme_low' ELSE 'normal' END AS flag FROM (SELECT session, len(list_filter(l, lambda v: v <= x)) * 100.0 / len(l) AS p FROM (SELECT session, vix AS x, list(vix) OVER (ORDER BY session ROWS BETWEEN 259 PRECEDING AND CURRENT ROW) AS l FROM market))""", "P24")
def _(spark, d):
    l = F.collect_list("vix").over(Window.orderBy("session").rowsBetween(-259, 0))
    m = views.market(spark, d).select("session", (F.size(F.filter(l, lambda v: v <= F.col("vix"))) * 100.0 / F.size(l)).alias("percentile"))
    return m.withColumn("flag", F.when(F.col("percentile") >= 90, "extreme_high").when(F.col("percentile") <= 10, "extreme_low").otherwise("normal"))


@query("p26_next_week_events", "event_date:d importance:i category:s n:i total:2",
       """SELECT event_date, importance, category, count(*) AS n, sum(size) AS total FROM samples WHERE event_date BETWEEN DATE '2000-06-19' AND DATE '2000-06-25' GROUP BY 1, 2, 3""", "P26 F12")
def _(spark, d):
    monday = F.next_day(F.lit("2000-06-14").cast("date"), "Mon")
    s = views.samples(spark, d).filter(F.col("event_date").between(monday, F.date_add(monday, 6)))
    return s.groupBy("event_date", "importance", "category").agg(F.count("*").alias("n"), F.sum("size").alias("total")).orderBy("event_date", F.desc("importance"), "category")


@query("p36_data_status", "series:s last_day:d stale_days:i status:s",
       """WITH s AS (SELECT 'bars:' || symbol AS series, max(session) AS last_day FROM bars GROUP BY 1 UNION ALL SELECT 'orders', max(event_date) FROM samples UNION ALL SELECT 'news:' || lang, max(CAST(published_at AS DATE)) FROM articles GROUP BY lang),
          e AS (SELECT max(session) AS e FROM sessions) SELECT series, last_day, e - last_day AS stale_days, CASE WHEN e - last_day > 5 THEN 'CHECK_WARNINGS' ELSE 'FRESH' END AS status FROM s, e""", "P36")
def _(spark, d):
    b = views.bars(spark, d).groupBy(F.concat(F.lit("bars:"), "symbol").alias("series")).agg(F.max("session").alias("last_day"))
    o = views.samples(spark, d).agg(F.max("event_date").alias("last_day")).select(F.lit("orders").alias("series"), "last_day")
    n = views.articles(spark, d).groupBy(F.concat(F.lit("news:"), "lang").alias("series")).agg(F.max(F.to_date("published_at")).alias("last_day"))
    end = read_table(spark, d, "lineitem").agg(F.to_date(F.max("l_shipdate"))).scalar()
    s = b.unionByName(o).unionByName(n).withColumn("stale_days", F.datediff(end, "last_day"))
    return s.withColumn("status", F.when(F.col("stale_days") > 5, "CHECK_WARNINGS").otherwise("FRESH"))


@query("p39_best_quote", "symbol:s day:d price:6 provider:s session_class:s change:6",
       """WITH t AS (SELECT symbol, CAST(ts AS DATE) AS day, ts, event_id, price, CASE WHEN user_id % 3 = 0 THEN 'primary' ELSE 'backup' END AS provider, hour(timezone('America/New_York', ts AT TIME ZONE 'UTC')) * 60 + minute(timezone('America/New_York', ts AT TIME ZONE 'UTC')) AS mins FROM ticks),
          b AS (SELECT symbol, day, arg_max(price, row(CASE WHEN provider = 'primary' THEN 1 ELSE 0 END, ts, event_id)) AS price, arg_max(provider, row(CASE WHEN provider = 'primary' THEN 1 ELSE 0 END, ts, event_id)) AS provider, arg_max(mins, row(CASE WHEN provider = 'primary' THEN 1 ELSE 0 END, ts, event_id)) AS mins, arg_max(price, row(ts, event_id)) AS last_price FROM t GROUP BY 1, 2)
          SELECT symbol, day, price, provider, CASE WHEN mins BETWEEN 570 AND 959 THEN 'regular' WHEN mins BETWEEN 240 AND 569 THEN 'pre' WHEN mins BETWEEN 960 AND 1199 THEN 'post' ELSE 'overnight' END AS session_class, price / nullif(lag(last_price) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS change FROM b""", "P39")
def _(spark, d):
    ny = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    t = views.ticks(spark, d).withColumn("first", (F.col("user_id") % 3 == 0).cast("int")).withColumn("mins", F.hour(ny) * 60 + F.minute(ny))
    at = ((F.unix_micros(F.col("ts").cast("timestamp")), 17), ("event_id", 19))
    rank = packed_order(("first", 1), *at)
    b = t.groupBy("symbol", F.to_date("ts").alias("day")).agg(*[F.max_by(c, rank).alias(c) for c in ("price", "first", "mins")], F.max_by("price", packed_order(*at)).alias("last_price"))
    m = F.col("mins")
    return b.select("symbol", "day", "price", F.when(F.col("first") == 1, "primary").otherwise("backup").alias("provider"),
                    F.when(m.between(570, 959), "regular").when(m.between(240, 569), "pre").when(m.between(960, 1199), "post").otherwise("overnight").alias("session_class"),
                    (sdiv("price", F.lag("last_price").over(Window.partitionBy("symbol").orderBy("day"))) - 1).alias("change"))


_AUDIT = ["symbol", "session", "close", "volume", "ret1", "ret20", "vol60", "target_return"]


@query("p07_column_audit", "column:s role:s reason:s non_null:i",
       " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{'label' if c == 'target_return' else 'excluded' if c == 'future_return' else 'price_input' if c in ('close', 'volume') else 'feature'}' AS role, '{'label or decision field' if c == 'future_return' else ''}' AS reason, count({'target_return' if c == 'future_return' else c}) AS non_null FROM features"""
                          for c in [*_AUDIT, "future_return"]), "P07")
def _(spark, d):
    # a copy of the label under a label-side name must be found out
    f = views.features(spark, d).select(*_AUDIT, F.col("target_return").alias("future_return"))
    return audit_columns(f, prices=("close", "volume"), labels=("target_return",))


_PROFILE = ["ret1", "ret20", "z20", "vol60", "target_return"]


@query("p40_quality_profile", "source:s field:s rows:i non_null:i missing_rate:6 first_valid:d last_valid:d latest:6 leaky:i",
       "SELECT symbol AS source, field, count(*) AS rows, count(v) AS non_null, 1 - count(v) * 1.0 / count(*) AS missing_rate, min(session) FILTER (v IS NOT NULL) AS first_valid, max(session) FILTER (v IS NOT NULL) AS last_valid, arg_max(v, session) FILTER (v IS NOT NULL) AS latest, CASE WHEN field LIKE 'target%' THEN 1 ELSE 0 END AS leaky FROM (SELECT symbol, session, unnest(["
       + ", ".join(f"'{c}'" for c in _PROFILE) + "]) AS field, unnest([" + ", ".join(_PROFILE) + "]) AS v FROM features) GROUP BY 1, 2", "P40 P07")
def _(spark, d):
    u = views.features(spark, d).select("symbol", "session", *_PROFILE).unpivot(["symbol", "session"], _PROFILE, "field", "v")
    ok = F.col("v").isNotNull()
    return u.groupBy(F.col("symbol").alias("source"), "field").agg(
        F.count("*").alias("rows"), F.count("v").alias("non_null"), (1 - F.count("v") / F.count("*")).alias("missing_rate"), F.min(F.when(ok, F.col("session"))).alias("first_valid"),
        F.max(F.when(ok, F.col("session"))).alias("last_valid"), F.max_by("v", F.when(ok, F.col("session"))).alias("latest")).withColumn("leaky", F.col("field").startswith("target").cast("int"))


# ---------------------------------------------------------------- cross-section aggregates
@query("a31_peer_cross_section", "session:d mean1:8 mean5:8 median1:8 median5:8 disp5:8 breadth1:6 breadth5:6 above20:6 n:i", "SELECT * FROM peers", "A31")
def _(spark, d):
    return feat.peer_cross_section(views.features(spark, d))


@query("a32_peer_shocks", "session:d shock_count:i positive:i negative:i net:i net3:i max_abs:8 mean_ret:8 spikes:i stress:6",
       """SELECT *, sum(net) OVER (ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS net3, negative + 10 * max(max_abs) OVER (ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - 0.5 * positive AS stress FROM shocks""", "A32")
def _(spark, d):
    w = Window.orderBy("session").rowsBetween(-2, 0)
    s = feat.peer_shocks(views.features(spark, d))
    return s.withColumn("net3", F.sum("net").over(w)).withColumn("stress", F.col("negative") + F.max("max_abs").over(w) * 10 - F.col("positive") * 0.5)


@query("a54_metric_snapshot", "metric:s as_of:d value:5 percentile:5 z_score:5 status:s flag:s",
       """WITH h AS (SELECT obs, metric, value FROM metric_history WHERE value IS NOT NULL), l AS (SELECT metric, max(obs) FILTER (isodow(obs) <= 5) AS as_of, arg_max(value, obs) FILTER (isodow(obs) <= 5) AS value FROM h GROUP BY 1),
          s AS (SELECT l.metric, l.as_of, l.value, avg(CASE WHEN h.value <= l.value THEN 100.0 ELSE 0.0 END) AS percentile, (l.value - avg(h.value)) / nullif(stddev_samp(h.value), 0) AS z_score FROM l JOIN h ON h.metric = l.metric GROUP BY 1, 2, 3)
          SELECT *, CASE WHEN (SELECT max(session) FROM market) - as_of > 10 THEN 'stale' ELSE 'available' END AS status, CASE WHEN percentile >= 90 THEN 'extreme_high' WHEN percentile <= 10 THEN 'extreme_low' ELSE 'normal' END AS flag FROM s""", "A54")
def _(spark, d):
    h = metric_history(spark, d).filter("value IS NOT NULL")
    week = F.weekday("obs") < 5
    l = h.groupBy("metric").agg(F.max(F.when(week, F.col("obs"))).alias("as_of"), F.max_by("value", F.when(week, F.col("obs"))).alias("now"))
    j = h.join(l, "metric")
    s = j.groupBy("metric", "as_of", F.col("now").alias("value0")).agg((F.avg((F.col("value") <= F.col("now")).cast("int")) * 100).alias("percentile"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    end = read_table(spark, d, "lineitem").agg(F.to_date(F.max("l_shipdate"))).scalar()
    return s.select("metric", "as_of", F.col("value0").alias("value"), "percentile", sdiv(F.col("value0") - F.col("m"), "sd").alias("z_score"), F.when(F.datediff(end, "as_of") > 10, "stale").otherwise("available").alias("status"),
                    F.when(F.col("percentile") >= 90, "extreme_high").when(F.col("percentile") <= 10, "extreme_low").otherwise("normal").alias("flag"))


# ---------------------------------------------------------------- sets and scalars
@query("u03_day_union", "symbol:s session:d baseline:2 reaction:2",
       """SELECT symbol, session, coalesce(b.position, 0) AS baseline, coalesce(r.p, 0) AS reaction FROM (SELECT symbol, session FROM signals UNION SELECT symbol, session FROM rule_signals) LEFT JOIN signals b USING (symbol, session) LEFT JOIN (SELECT symbol, session, max(position) AS p FROM rule_signals GROUP BY 1, 2) r USING (symbol, session)""", "U03")
def _(spark, d):
    b = views.signals(spark, d).select("symbol", "session", F.col("position").alias("baseline"))
    r = sg.rule_signals(spark, d).groupBy("symbol", "session").agg(F.max("position").alias("reaction"))
    # Union of the day sets with both sides attached is one full join.
    return b.join(r, ["symbol", "session"], "full").fillna(0.0, ["baseline", "reaction"])


@query("u04_common_strikes", "symbol:s expiry:d strike:2", "SELECT symbol, expiry, strike FROM option_bars WHERE cp = 'C' INTERSECT SELECT symbol, expiry, strike FROM option_bars WHERE cp = 'P'", "U04")
def _(spark, d):
    o = views.option_bars(spark, d)
    # Both memberships in one pass: a strike is common when it was seen on both sides.
    return o.groupBy("symbol", "expiry", "strike").agg(F.bool_or(F.col("cp") == "C").alias("c"), F.bool_or(F.col("cp") == "P").alias("p")).filter("c AND p")


@query("f11_rule_labels", "symbol:s label:s feature:s quantile:2 cap:2 rebuilt:i rows:i",
       r"""SELECT symbol, label, split_part(label, '_mq', 1) AS feature, CAST(regexp_extract(label, '_mq([0-9.]+)', 1) AS DOUBLE) AS quantile, CASE WHEN label LIKE 'z20%' THEN 0.5 ELSE 0.95 END AS cap, 1 AS rebuilt, count(*) AS rows FROM rule_signals GROUP BY 1, 2""", "F11")
def _(spark, d):
    g = sg.rule_signals(spark, d).groupBy("symbol", "label").agg(F.count("*").alias("rows"))
    g = g.select("*", F.split("label", "_mq").getItem(0).alias("feature"), F.regexp_extract("label", "_mq([0-9.]+)", 1).cast("double").alias("quantile"),
                 F.regexp_extract("label", "_vq([0-9.]+)", 1).cast("double").alias("vq"), F.regexp_extract("label", "_vq[0-9.]+_(.*)$", 1).alias("flt"))
    again = F.concat("feature", F.lit("_mq"), F.format_number("quantile", 2), F.lit("_vq"), F.format_number("vq", 2), F.lit("_"), "flt")
    caps = F.create_map(F.lit("z20"), F.lit(0.5))
    return g.select("symbol", "label", "feature", "quantile", F.coalesce(F.try_element_at(caps, F.col("feature")), F.lit(0.95)).alias("cap"), (again == F.col("label")).cast("int").alias("rebuilt"), "rows")


@query("f12_calendar_dates", "session:d month_start:d quarter_start:d next_monday:d third_friday:d next_session:d",
       """SELECT session, CAST(date_trunc('month', session) AS DATE) AS month_start, CAST(date_trunc('quarter', session) AS DATE) AS quarter_start, session + CAST((8 - isodow(session)) AS INT) AS next_monday,
            CAST(date_trunc('month', session) AS DATE) + CAST((5 - isodow(date_trunc('month', session)) + 7) % 7 + 14 AS INT) AS third_friday, lead(session) OVER (ORDER BY session) AS next_session FROM sessions""", "F12")
def _(spark, d):
    m = F.trunc("session", "month")
    return views.sessions(spark, d).select("session", m.alias("month_start"), F.trunc("session", "quarter").alias("quarter_start"), F.next_day("session", "Mon").alias("next_monday"),
                                           F.date_add(F.next_day(F.date_sub(m, 1), "Fri"), 14).alias("third_friday"), F.lead("session").over(Window.orderBy("session")).alias("next_session"))


@query("f13_epoch_time", "event_id:i instant:t ny_day:d", "SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS instant, CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS ny_day FROM events", "F13")
def _(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", F.timestamp_seconds(F.unix_timestamp("ts")).alias("instant"), F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("ny_day"))


@query("f14_safe_math", "symbol:s session:d ratio:6 clipped:4 sgn:i squashed:8 prob:8 back:6 logvol:6",
       """SELECT symbol, session, (close - open) / nullif(high - low, 0) AS ratio, least(greatest((close - open) / nullif(high - low, 0), -0.5), 0.5) AS clipped, sign(close - open) AS sgn, tanh(ret1 * 10) AS squashed, 1 / (1 + exp(-ret1 * 50)) AS prob,
            ln(least(greatest(1 / (1 + exp(-ret1 * 50)), 0.001), 0.999) / (1 - least(greatest(1 / (1 + exp(-ret1 * 50)), 0.001), 0.999))) AS back, ln(1 + volume) AS logvol FROM features WHERE ret1 IS NOT NULL AND high > low""", "F14")
def _(spark, d):
    f = views.features(spark, d).filter("ret1 IS NOT NULL AND high > low")
    r = sdiv(F.col("close") - F.col("open"), F.col("high") - F.col("low"))
    return f.select("symbol", "session", r.alias("ratio"), clip(r, -0.5, 0.5).alias("clipped"), F.signum(F.col("close") - F.col("open")).cast("int").alias("sgn"), F.tanh(F.col("ret1") * 10).alias("squashed"),
                    logistic(F.col("ret1") * 50).alias("prob"), logit(logistic(F.col("ret1") * 50)).alias("back"), F.log1p("volume").alias("logvol"))


@query("f17_direction_labels", "symbol:s session:d label:s aligned:i", """SELECT symbol, session, CASE WHEN target_return IS NULL THEN 'unknown' WHEN target_return > 0.005 THEN 'bullish' WHEN target_return < -0.005 THEN 'bearish' ELSE 'neutral' END AS label,
       CASE WHEN target_return * ret5 > 0 THEN 1 WHEN target_return IS NOT NULL AND ret5 IS NOT NULL THEN 0 END AS aligned FROM features""", "F17")
def _(spark, d):
    f = views.features(spark, d)
    return f.select("symbol", "session", feat.direction_label("target_return", 0.005).alias("label"), (F.col("target_return") * F.col("ret5") > 0).cast("int").alias("aligned"))


def priority_grid(rows, order: list, cap: int | None = None):
    """All rows in order of priority; a caller may ask for the first ``cap`` only."""
    ranked = rank_all(rows, order, "place")
    return ranked if cap is None else ranked.filter(F.col("place") <= cap)


@query("l08_priority_grid", "place:i symbol:s label:s distance:4 long_score:4",
       r"""SELECT row_number() OVER (ORDER BY distance, symbol, label) AS place, symbol, label, distance, long_score FROM (SELECT symbol, label, round(abs(CAST(regexp_extract(label, '_mq([0-9.]+)', 1) AS DOUBLE) - 0.55) + CASE WHEN label LIKE 'ret20%' THEN 0 ELSE 0.1 END + CASE WHEN label LIKE '%base' THEN 0 ELSE 0.02 END, 6) AS distance, long_score FROM scored WHERE months = 60)""", "L08")
def _(spark, d):
    s = evq.scored(spark, d).filter("months = 60")
    dist = F.round(F.abs(F.regexp_extract("label", "_mq([0-9.]+)", 1).cast("double") - 0.55) + F.when(F.col("label").startswith("ret20"), 0.0).otherwise(0.1) + F.when(F.col("label").endswith("base"), 0.0).otherwise(0.02), 6)
    return priority_grid(s.withColumn("distance", dist), ["distance", "symbol", "label"])


# ---------------------------------------------------------------- adaptive rule choice
_Q = (0.55, 0.60, 0.65, 0.70)  # fixed values: searched quantiles
_FILTERS = {"rsi_below_75": "rsi_14 < 75", "sector_up": "sector_ret1 > 0", "index_up": "idx_ret1 > 0", "vix_calm": "vix_chg5 < vix80",
            "vol_calm": "vol20 < vol60 * 1.2", "trend_up": "p60 > 1.0", "no_bad_holiday": "NOT (pre_holiday = 1 AND pre_holiday_momentum < 0)"}
_SETS = [(), *[(f,) for f in _FILTERS], *itertools.combinations(_FILTERS, 2)]


def _spec_rows():
    return [(mq, vq, flt) for mq in _Q for vq in _Q for flt in _SETS]


_SPEC_SQL = ", ".join(f"({i}, {mq}, {vq}, '{'+'.join(flt)}', {len(flt)})" for i, (mq, vq, flt) in enumerate(_spec_rows()))
_THR = ", ".join(f"quantile_cont(r.ret20, {x}) AS m{int(x * 100 + 0.5)}, quantile_cont(r.vol_ratio, {x}) AS v{int(x * 100 + 0.5)}" for x in _Q)


_FILTER_SQL = " ".join(f"AND (NOT contains(sp.flt, '{k}') OR {c})" for k, c in _FILTERS.items())


@query("w36_adaptive_rule", "symbol:s spec:i momentum_q:2 volume_q:2 filters:s score:5",
       f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rule_frame WHERE target_return IS NOT NULL),
          k AS (SELECT DISTINCT symbol, n, f.fold, n - 189 + f.fold * 63 AS s0 FROM b, range(0, 3) f(fold) WHERE n >= 273),
          t AS (SELECT k.symbol, k.fold, k.s0, {_THR}, quantile_cont(r.vix_chg5, 0.8) AS vix80 FROM k JOIN b r ON r.symbol = k.symbol AND r.i < k.s0 GROUP BY 1, 2, 3),
          sp AS (SELECT * FROM (VALUES {_SPEC_SQL}) s(spec, mq, vq, flt, nf)),
          x AS (SELECT b.symbol, t.fold, sp.spec, b.i, b.target_return AS r, coalesce(b.ret20 > CASE sp.mq WHEN 0.55 THEN m55 WHEN 0.60 THEN m60 WHEN 0.65 THEN m65 ELSE m70 END AND b.vol_ratio > CASE sp.vq WHEN 0.55 THEN v55 WHEN 0.60 THEN v60 WHEN 0.65 THEN v65 ELSE v70 END
               {_FILTER_SQL}, false) AS a
              FROM t JOIN b ON b.symbol = t.symbol AND b.i >= t.s0 AND b.i < t.s0 + 63, sp),
          e AS (SELECT *, a AND NOT coalesce(lag(a) OVER (PARTITION BY symbol, fold, spec ORDER BY i), false) AS entry FROM x),
          f AS (SELECT symbol, fold, spec, count(*) FILTER (a) AS n, count(*) FILTER (entry) AS trades, avg(r) FILTER (a) AS m, stddev_pop(r) FILTER (a) AS sd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (a) AS win, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS cov,
               sum(r) FILTER (a AND r > 0) AS up, sum(r) FILTER (a AND r < 0) AS down FROM e GROUP BY 1, 2, 3),
          g AS (SELECT *, CASE WHEN n < 3 THEN -0.25 ELSE coalesce(m / nullif(sd, 0) * sqrt(252), 0) + 3 * m + 0.25 * win - (greatest(0, cov - 0.22) * 0.35 + greatest(0, 0.04 - cov) * 0.20) END AS fs FROM f),
          h AS (SELECT symbol, spec, avg(fs) AS av, stddev_pop(fs) AS sd, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS na, sum(CASE WHEN n >= 3 THEN trades ELSE 0 END) AS tr, coalesce(sum(up) FILTER (n >= 3), 0) AS up, abs(coalesce(sum(down) FILTER (n >= 3), 0)) AS down FROM g GROUP BY 1, 2),
          z AS (SELECT h.symbol, h.spec, sp.mq, sp.vq, sp.flt, round(av + 0.15 * least(CASE WHEN down > 0 THEN up / down ELSE 3 END, 3) - 0.15 * sd - CASE WHEN tr < 4 THEN 0.2 ELSE 0 END - 0.05 * nf, 7) AS score FROM h JOIN sp USING (spec) WHERE na >= 8)
          SELECT symbol, spec, mq AS momentum_q, vq AS volume_q, flt AS filters, score FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, spec) = 1""", "W36 P12 J14")
def _(spark, d):
    w = Window.partitionBy("symbol")
    b = sg.rule_frame(spark, d).filter("target_return IS NOT NULL").withColumn("i", F.row_number().over(w.orderBy("session")) - 1).withColumn("n", F.count("*").over(w)).filter("n >= 273")
    start = lambda f: F.col("n") - 189 + f * 63
    # Training rows serve every later fold; validation rows exactly one.
    tr = b.withColumn("fold", F.explode(F.array_compact(F.array(*[F.when(F.col("i") < start(f), f) for f in range(3)]))))
    t = tr.groupBy("symbol", "fold").agg(*[F.percentile(c, x).alias(f"{p}{int(x * 100 + 0.5)}") for x in _Q for c, p in (("ret20", "m"), ("vol_ratio", "v"))], F.percentile("vix_chg5", 0.8).alias("vix80"))
    va = b.filter(F.col("i") >= F.col("n") - 189).withColumn("fold", F.floor((F.col("i") - (F.col("n") - 189)) / 63).cast("int")).join(t, ["symbol", "fold"])
    va = va.select("symbol", "fold", "i", F.col("target_return").alias("r"), *[truth(F.expr(c)).alias(k) for k, c in _FILTERS.items()],
                   *[truth(F.col("ret20") > F.col(f"m{int(x * 100 + 0.5)}")).alias(f"am{int(x * 100 + 0.5)}") for x in _Q], *[truth(F.col("vol_ratio") > F.col(f"v{int(x * 100 + 0.5)}")).alias(f"av{int(x * 100 + 0.5)}") for x in _Q])
    specs = []
    for i, (mq, vq, flt) in enumerate(_spec_rows()):
        ok = F.col(f"am{int(mq * 100 + 0.5)}") & F.col(f"av{int(vq * 100 + 0.5)}")
        for f in flt:
            ok = ok & F.col(f)
        specs.append(ok)
    # the previous day's masks are one lag of an array: one sort by symbol and fold, not by specification
    masks = va.select("symbol", "fold", "i", "r", F.array(*specs).alias("on"))
    masks = masks.withColumn("was", F.lag("on").over(Window.partitionBy("symbol", "fold").orderBy("i")))
    pairs = F.zip_with("on", F.coalesce("was", F.transform("on", lambda a: F.lit(False))), lambda a, p: F.struct(a.alias("a"), (a & ~p).alias("entry")))
    e = masks.select("symbol", "fold", "r", F.posexplode(pairs).alias("spec", "p")).select("symbol", "fold", "r", "spec", "p.a", "p.entry")
    ar = F.when(F.col("a"), F.col("r"))
    g = e.groupBy("symbol", "fold", "spec").agg(
        F.count(ar).alias("n"), F.sum(F.col("entry").cast("int")).alias("trades"), F.avg(ar).alias("m"), F.stddev_pop(ar).alias("sd"), F.avg((ar > 0).cast("int")).alias("win"), F.avg(F.col("a").cast("int")).alias("cov"),
        F.sum(F.when(ar > 0, ar)).alias("up"), F.sum(F.when(ar < 0, ar)).alias("down"))
    penalty = F.greatest(F.lit(0.0), F.col("cov") - 0.22) * 0.35 + F.greatest(F.lit(0.0), 0.04 - F.col("cov")) * 0.20
    fs = F.when(F.col("n") < 3, -0.25).otherwise(F.coalesce(sdiv("m", "sd") * math.sqrt(252), F.lit(0.0)) + 3 * F.col("m") + 0.25 * F.col("win") - penalty)
    live = F.col("n") >= 3
    h = g.withColumn("fs", fs).groupBy("symbol", "spec").agg(
        F.avg("fs").alias("av"), F.stddev_pop("fs").alias("sd"), F.sum(F.when(live, F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(live, F.col("trades")).otherwise(0)).alias("tr"),
        F.coalesce(F.sum(F.when(live, F.col("up"))), F.lit(0.0)).alias("up"), F.abs(F.coalesce(F.sum(F.when(live, F.col("down"))), F.lit(0.0))).alias("down")).filter("na >= 8")
    rows = _spec_rows()
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), F.col("spec") + 1)
    h = h.withColumn("nf", pick([len(r[2]) for r in rows]))
    pf = F.least(F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(3.0), F.lit(3.0))
    score = F.round(F.col("av") + 0.15 * pf - 0.15 * F.col("sd") - F.when(F.col("tr") < 4, 0.2).otherwise(0.0) - 0.05 * F.col("nf"), 7)
    best = h.withColumn("score", score).groupBy("symbol").agg(F.max_by(F.struct("spec", "score"), F.struct("score", -F.col("spec"))).alias("b")).select("symbol", "b.*")
    return best.select("symbol", "spec", "score", pick([r[0] for r in rows]).alias("momentum_q"), pick([r[1] for r in rows]).alias("volume_q"), pick(["+".join(r[2]) for r in rows]).alias("filters"))


@query("w29_cluster_safe_folds", "fold:i train_end:i test_end:i",
       """WITH RECURSIVE e AS (SELECT available_at, story_id, row_number() OVER (ORDER BY available_at, published_at, doc_id) - 1 AS p, count(*) OVER () AS n FROM news),
          r AS (SELECT p, n, greatest(max(p) OVER (PARTITION BY story_id), max(p) OVER (PARTITION BY available_at)) AS h FROM e),
          c AS (SELECT p + 1 AS cut, n FROM (SELECT p, n, max(h) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS m FROM r) WHERE m = p),
          f(fold, s, t, n) AS (SELECT 0, s, (SELECT min(cut) FROM c WHERE cut >= s + n // 10), n FROM (SELECT min(cut) AS s, any_value(n) AS n FROM c WHERE cut >= n // 2 AND cut < n)
            UNION ALL SELECT fold + 1, s2, (SELECT min(cut) FROM c WHERE cut >= s2 + n // 10), n FROM (SELECT fold, n, (SELECT min(cut) FROM c WHERE cut >= greatest(s + n // 10, t) AND cut < f.n) AS s2 FROM f WHERE t IS NOT NULL) WHERE s2 IS NOT NULL)
          SELECT fold, s AS train_end, t AS test_end FROM f WHERE s IS NOT NULL AND t IS NOT NULL""", "W29")
def _(spark, d):
    from tideline.functions import text as tx

    n_rows = story(spark, d).select("doc_id", "published_at", "available_at", tx.story_hash("day", "title").alias("story_id"))
    cuts = cluster_safe_boundaries(n_rows, [F.col("available_at"), F.col("published_at"), F.col("doc_id")], ["story_id", "available_at"])
    n = read_table(spark, d, "documents").count()
    folds = walk_boundaries(cuts, n, n // 2, n // 10, n // 10)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(folds)], "fold int, train_end long, test_end long")
