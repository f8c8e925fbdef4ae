"""Source and sink queries over landed files: each table is written in the foreign format and read back whole."""

from pyspark.sql import functions as F

from tideline.plans.catalog import query
from tideline.sources import files, views
from tideline.streaming import jobs


@query("s01_bars_csv", "symbol:s rows:i first:d last:d volume:2",
       "SELECT symbol, count(*) AS rows, min(session) AS first, max(session) AS last, sum(volume) AS volume FROM bars WHERE session BETWEEN DATE '1994-01-03' AND DATE '1996-12-30' GROUP BY 1", "S01")
def _(spark, d):
    path = jobs.work_folder(spark) + "/bars"
    views.bars(spark, d).select("symbol", "session", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume")).write.csv(path, header=True)
    b = files.read_bars_csv(spark, path, "1994-01-03", "1996-12-30")
    return b.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("session").alias("first"), F.max("session").alias("last"), F.sum("volume").alias("volume"))


@query("s05_macro_csv", "series_id:s rows:i known:i total:4",
       """SELECT series_id, count(*) AS rows, count(v) AS known, sum(v) AS total FROM (SELECT 'rate' AS series_id, session, CASE WHEN tnx > 40 THEN tnx END AS v FROM market UNION ALL SELECT 'vol', session, CASE WHEN vix > 20 THEN vix END FROM market)
          WHERE session BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' GROUP BY 1""", "S05")
def _(spark, d):
    path = jobs.work_folder(spark) + "/macro"
    m = views.market(spark, d).select(F.inline(F.array(
        F.struct(F.lit("rate").alias("series_id"), F.col("session").alias("obs_date"), F.when(F.col("tnx") > 40, F.col("tnx")).alias("v")),
        F.struct(F.lit("vol").alias("series_id"), F.col("session").alias("obs_date"), F.when(F.col("vix") > 20, F.col("vix")).alias("v")))))
    m.select("series_id", "obs_date", F.coalesce(F.col("v").cast("string"), F.lit(".")).alias("raw")).write.csv(path, header=True)
    o = files.read_macro_csv(spark, path, "1993-01-01", "1997-12-31")
    return o.groupBy("series_id").agg(F.count("*").alias("rows"), F.count("value").alias("known"), F.sum("value").alias("total"))


@query("s21_json_export", "symbol:s rows:i with_return:i explicit_nulls:i",
       "SELECT symbol, count(*) AS rows, count(ret60) AS with_return, count(*) - count(ret60) AS explicit_nulls FROM features GROUP BY 1", "S21")
def _(spark, d):
    path = jobs.work_folder(spark) + "/export"
    files.export_json(views.features(spark, d).select("symbol", "session", "ret60"), path)
    # every line must name the key, also where it is null
    t = spark.read.text(path).select(F.get_json_object("value", "$.symbol").alias("symbol"), F.get_json_object("value", "$.ret60").alias("r"), F.json_object_keys("value").alias("k"))
    return t.groupBy("symbol").agg(F.count("*").alias("rows"), F.count("r").alias("with_return"),
                                   F.sum((F.col("r").isNull() & F.array_contains("k", "ret60")).cast("int")).alias("explicit_nulls"))


@query("s11_vendor_events", "source:s rows:i with_headline:i", "SELECT source, count(*) AS rows, count(title) AS with_headline FROM articles WHERE title <> '' GROUP BY 1", "S11")
def _(spark, d):
    path = jobs.work_folder(spark) + "/vendor"
    a = views.articles(spark, d).filter("title <> ''").select(F.col("doc_id").cast("string").alias("event_id"), "source", F.regexp_replace("title", '[\r"\\\\]', " ").alias("headline"))
    a.write.csv(path, header=True, quoteAll=True)
    return files.read_vendor_events(spark, path).groupBy("source").agg(F.count("*").alias("rows"), F.count("headline").alias("with_headline"))


@query("s12_aligned_samples", "symbol:s samples:i input_rows:i input_keys:i last_close_sum:1",
       "SELECT symbol, count(*) AS samples, sum(n) AS input_rows, sum(len(list_filter(['in_close', 'out_close'], lambda k: starts_with(k, 'in_')))) AS input_keys, sum(close) AS last_close_sum FROM (SELECT symbol, close, count(*) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM bars) GROUP BY 1", "S12")
def _(spark, d):
    from tideline.operators.rolling import trailing

    path = jobs.work_folder(spark) + "/aligned"
    b = views.bars(spark, d).select("symbol", "session", F.collect_list("close").over(trailing(10)).alias("input_window"),
                                    F.to_json(F.create_map(F.lit("in_close"), F.array("close"), F.lit("out_close"), F.array("open"))).alias("technical"))
    b.write.parquet(path)
    s = files.read_aligned_samples(spark, path)
    return s.groupBy("symbol").agg(F.count("*").alias("samples"), F.sum(F.size("input_window")).alias("input_rows"), F.sum(F.size("technical_in")).alias("input_keys"),
                                   F.sum(F.element_at("input_window", -1)).alias("last_close_sum"))


@query("s13_event_table", "category:s events:i first_day:d tags:i", "SELECT category, count(*) AS events, min(event_date) AS first_day, sum(len([theme, CAST(importance AS VARCHAR)])) AS tags FROM samples GROUP BY 1", "S13")
def _(spark, d):
    path = jobs.work_folder(spark) + "/events"
    s = views.samples(spark, d)
    s.select(F.col("sample_id").cast("string").alias("id"), F.col("event_date").alias("date"), "category", F.array("theme", F.col("importance").cast("string")).alias("secondary_categories"), "importance").write.json(path)
    e = files.read_event_lines(spark, path)
    return e.groupBy("category").agg(F.count("*").alias("events"), F.min("date").alias("first_day"), F.sum(F.size("secondary_categories")).alias("tags"))


@query("s18_tolerant_read", "category:s rows:i total_importance:i", "SELECT category, count(*) AS rows, sum(importance) AS total_importance FROM samples WHERE importance <> 3 GROUP BY 1", "S18")
def _(spark, d):
    path = jobs.work_folder(spark) + "/growing"
    # Rows of one priority are torn, as in a file read while it grows.
    torn = F.when(F.col("importance") == 3, "not-a-number").otherwise(F.col("importance").cast("string"))
    views.samples(spark, d).select("category", torn.alias("importance")).write.csv(path, header=True)
    g = files.read_growing_csv(spark, path, "category STRING, importance INT")
    return g.filter("importance IS NOT NULL").groupBy("category").agg(F.count("*").alias("rows"), F.sum("importance").alias("total_importance"))


@query("s19_result_sink", "run_id:s rows:i with_volume:i", "SELECT 'run_a' AS run_id, count(*) AS rows, 0 AS with_volume FROM bars UNION ALL SELECT 'run_b', count(*), count(volume) FROM bars", "S19 S17")
def _(spark, d):
    path = jobs.work_folder(spark) + "/results"
    b = views.bars(spark, d)
    files.append_results(b.select("symbol", "session", "close"), path, "run_a")
    files.append_results(b.select("symbol", "session", "close", "volume"), path, "run_b")
    return files.read_results(spark, path).groupBy("run_id").agg(F.count("*").alias("rows"), F.count("volume").alias("with_volume"))


@query("t09_tolerant_stream", "broken:i rows:i sum_ids:i", "SELECT CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS broken, count(*) AS rows, coalesce(sum(CASE WHEN user_id % 7 <> 0 THEN event_id END), 0) AS sum_ids FROM events GROUP BY 1", "T09")
def _(spark, d):
    base = jobs.work_folder(spark)
    t = views.ticks(spark, d)
    doc = F.to_json(F.struct("event_id", F.col("ts").cast("timestamp").alias("ts"), "symbol", F.col("price").alias("value")))
    # Some writers tear their lines; the stream marks them and goes on.
    t.select(F.when(F.col("user_id") % 7 == 0, F.substring(doc, 1, 12)).otherwise(doc).alias("value")).write.text(f"{base}/lines")
    s = jobs.run_to_table(jobs.parse_lines(spark.readStream.text(f"{base}/lines")), spark)
    return s.groupBy(F.col("broken").cast("int").alias("broken")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(~F.col("broken"), F.col("event_id"))), F.lit(0)).alias("sum_ids"))
