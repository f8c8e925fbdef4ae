"""News, options, holdings and scenario queries."""

import math

from pyspark.sql import Window, functions as F

from tideline.functions import text as tx
from tideline.functions.numeric import clip, flag, logistic, moment_skew, packed_order, sdiv, truth
from tideline.operators import evaluate as evl
from tideline.operators.asof import asof_join
from tideline.operators.ranking import rank_all
from tideline.operators.rolling import by_symbol, gated, pct_change, rank_in_window, trailing
from tideline.plans.catalog import query
from tideline.plans.events import cdf_sql
from tideline.plans.sqlviews import add_view, full as sfull
from tideline.sources import views
from tideline.sources.stages import stage
from tideline.sources.tables import read_table

# Names given to the anonymous feeds, by feed number.
PUBLISHERS = ["reuters", "bloomberg", "wall street journal", "sec", "cnbc", "marketwatch", "barron's", "yahoo finance", "zacks", "seeking alpha", "daily wire", "trade post"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(terms, t="lowered"):
    return "(" + " + ".join(f"CAST(contains({t}, {q(x)}) AS INT)" for x in terms) + ")"


_PUB = "[" + ", ".join(q(p) for p in PUBLISHERS) + "]"
_LEX = " + ".join(f"CASE WHEN contains(lowered, {q(t)}) THEN {w!r}::DOUBLE ELSE 0 END" for t, w in {**tx.POSITIVE_WEIGHTS, **tx.NEGATIVE_WEIGHTS}.items())
_WT = "CASE publisher " + " ".join(f"WHEN {q(k)} THEN {v!r}::DOUBLE" for k, v in tx.SOURCE_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
_GRADE = "CASE " + " ".join(f"WHEN contains(publisher, {q(k)}) THEN {v!r}::DOUBLE" for k, v in tx.SOURCE_GRADES.items()) + " ELSE 0.55::DOUBLE END"
add_view("story", f"""SELECT *, lower(body) AS lowered, {_PUB}[CAST(substr(source, 4) AS INT) % {len(PUBLISHERS)} + 1] AS publisher,
  CAST(published_at AS DATE) AS day FROM articles""")
add_view("news", f"""
SELECT *, least(greatest(0.25 + 0.30 * rel + 0.20 * quality + 0.20 * abs(kw) + CASE WHEN event_type IN ('earnings', 'guidance', 'export_control', 'customer_capex') THEN 0.20 ELSE 0.10 END + least(words / 500.0, 0.20), 0), 1) AS importance FROM (
 SELECT *, tanh(({_LEX}) * {_WT} / 4.0) AS sentiment, {", ".join(f"least({hits_sql(v)} / 3.0, 1.0) AS s_{k}" for k, v in tx.TOPIC_TERMS.items())},
   CASE WHEN best.h > 0 THEN best.k ELSE 'neutral' END AS event_type, tanh(({hits_sql(tx.SENTIMENT_POSITIVE)} - {hits_sql(tx.SENTIMENT_NEGATIVE)}) / 3.0) AS kw, {_GRADE} AS quality,
   least(greatest(0.25 + CASE WHEN lang = 'en' THEN 0.35 ELSE 0 END + least({hits_sql(tx.RELEVANCE_TERMS)} * 0.12, 0.40), 0), 1) AS rel, len(regexp_extract_all(lowered, '[\\p{{L}}\\p{{N}}_]+')) AS words,
   substr(sha256(day || '|' || lower(title)), 1, 20) AS story_id
 FROM (SELECT *, list_sort([{", ".join("{'h': " + hits_sql(v) + ", 'k': " + q(k) + "}" for k, v in tx.EVENT_KEYWORDS.items())}])[-1] AS best FROM story))""")


def story(spark, d):
    names = F.array(*[F.lit(p) for p in PUBLISHERS])
    a = views.articles(spark, d)
    return a.select("*", F.lower("body").alias("lowered"), F.to_date("published_at").alias("day"),
                    F.element_at(names, F.substring("source", 4, 10).cast("int") % len(PUBLISHERS) + 1).alias("publisher"))


def news(spark, d):
    return stage(spark, d, "news", ("documents",), build_news)


def build_news(spark, d):
    """Scored article table without its texts: whoever needs one joins the documents."""
    s = story(spark, d).withColumn("seen", tx.mentions("lowered"))  # scores look for terms here, not in the whole text
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in tx.SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("publisher")), F.lit(1.0))
    topics = [F.least(tx.hits("seen", t) / 3.0, F.lit(1.0)).alias(f"s_{k}") for k, t in tx.TOPIC_TERMS.items()]
    s = s.select("*", tx.lexicon_score("seen", weight).alias("sentiment"), *topics, tx.event_type("seen").alias("event_type"), tx.keyword_sentiment("seen").alias("kw"),
                 tx.source_quality("publisher").alias("quality"), tx.relevance("seen", F.col("lang") == "en").alias("rel"), tx.word_count("lowered").alias("words"),
                 tx.story_hash("day", "title").alias("story_id"))
    return s.withColumn("importance", tx.importance("event_type", "rel", "quality", "kw", "words")).drop("title", "body", "lowered", "seen")


@query("f01_text_clean", "page_id:i n:i digest:s head:s",
       "SELECT page_id, length(t) AS n, md5(t) AS digest, substr(t, 1, 40) AS head FROM (SELECT page_id, trim(regexp_replace(" + "replace(" * len(tx.ENTITIES)
       + r"regexp_replace(html, '<[^>]+>', ' ', 'g')" + "".join(f", {q(a)}, {q(b)})" for a, b in tx.ENTITIES) + r", '\s+', ' ', 'g')) AS t FROM pages)", "F01")
def _(spark, d):
    t = read_table(spark, d, "pages").select("page_id", tx.clean_text("html").alias("t"))
    return t.select("page_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"), F.substring("t", 1, 40).alias("head"))


@query("f02_article_id", "page_id:i article_id:s",
       r"SELECT page_id, substr(sha1(trim(regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^\p{L}\p{N}_]+', ' ', 'g')) || '|' || url), 1, 16) AS article_id FROM pages", "F02")
def _(spark, d):
    return read_table(spark, d, "pages").select("page_id", tx.article_id(F.regexp_extract("html", "<title>(.*?)</title>", 1), "url").alias("article_id"))


@query("f03_story_hash", "doc_id:i story_id:s", "SELECT doc_id, story_id FROM news", "F03")
def _(spark, d):
    return story(spark, d).select("doc_id", tx.story_hash("day", "title").alias("story_id"))


@query("f04_lexicon_score", "doc_id:i sentiment:8", "SELECT doc_id, sentiment FROM news", "F04 S10")
def _(spark, d):
    return news(spark, d)


@query("f05_topic_scores", "doc_id:i topic:s score:6 bullish:8",
       "SELECT doc_id, unnest(['earnings', 'analyst', 'regulatory', 'product', 'competition']) AS topic, unnest([s_earnings, s_analyst, s_regulatory, s_product, s_competition]) AS score, greatest(sentiment, 0) AS bullish FROM news", "F05 F16")
def _(spark, d):
    n = news(spark, d)
    m = F.create_map(*[x for k in tx.TOPIC_TERMS for x in (F.lit(k), F.col(f"s_{k}"))])
    return n.select("doc_id", F.greatest("sentiment", F.lit(0.0)).alias("bullish"), F.explode(m).alias("topic", "score"))


@query("f06_event_type", "doc_id:i event_type:s", "SELECT doc_id, event_type FROM news", "F06")
def _(spark, d):
    return news(spark, d)


@query("f07_event_grades", "doc_id:i quality:4 rel:4 kw:8 words:i importance:8 reasons:s",
       """SELECT *, array_to_string(list_filter(['event_type:' || event_type, CASE WHEN rel >= 0.75 THEN 'high_relevance' END, CASE WHEN quality >= 0.85 THEN 'high_source_quality' END,
            CASE WHEN kw >= 0.25 THEN 'positive_event_language' WHEN kw <= -0.25 THEN 'negative_event_language' END], lambda x: x IS NOT NULL), ',') AS reasons FROM news""", "F07")
def _(spark, d):
    kw = F.col("kw")
    codes = F.array(F.concat(F.lit("event_type:"), "event_type"), F.when(F.col("rel") >= 0.75, "high_relevance"), F.when(F.col("quality") >= 0.85, "high_source_quality"),
                    F.when(kw >= 0.25, "positive_event_language").when(kw <= -0.25, "negative_event_language"))
    return news(spark, d).withColumn("reasons", F.array_join(F.array_compact(codes), ","))


@query("f08_event_normalise", "event_id:s published:t available:t kind:s quality:4 scope:s problem:s",
       """SELECT 'event_' || doc_id AS event_id, published_at AS published, coalesce(available_at, published_at) AS available, CASE WHEN event_type IN ('earnings', 'guidance', 'analyst', 'product', 'supply_chain', 'export_control', 'competition', 'customer_capex', 'valuation', 'macro_ai_trade', 'legal_regulatory') THEN event_type ELSE 'neutral' END AS kind,
            quality, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(upper(lang || ',' || source || ' ' || lang), '[,|;\\s]+'), lambda x: x <> ''))), ' ') AS scope,
            CASE WHEN available_at < published_at THEN 'available_before_published' END AS problem FROM news""", "F08 P05")
def _(spark, d):
    known = [*tx.EVENT_KEYWORDS]
    return news(spark, d).select(
        F.concat(F.lit("event_"), F.col("doc_id").cast("string")).alias("event_id"), F.col("published_at").alias("published"), F.coalesce("available_at", "published_at").alias("available"),
        F.when(F.col("event_type").isin(known), F.col("event_type")).otherwise("neutral").alias("kind"), clip("quality", 0.0, 1.0).alias("quality"),
        F.array_join(tx.string_set(F.concat("lang", F.lit(","), "source", F.lit(" "), "lang")), " ").alias("scope"),
        F.when(F.col("available_at") < F.col("published_at"), "available_before_published").alias("problem"))


@query("f09_json_cells", "event_id:i k:i bad_is_empty:i n_keys:i",
       """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid('{' || props) THEN 0 ELSE 1 END AS bad_is_empty, len(json_keys(props)) AS n_keys FROM events""", "F09 S08")
def _(spark, d):
    e = read_table(spark, d, "events")
    m = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    broken = F.coalesce(F.from_json(F.concat(F.lit("{"), "props"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return e.select("event_id", F.try_element_at(m, F.lit("k")).cast("bigint").alias("k"), (F.size(broken) == 0).cast("int").alias("bad_is_empty"), F.size(m).alias("n_keys"))


@query("a28_daily_news", "session:d news_count:i sentiment_sum:6 sentiment_mean:6 bullish:6 bearish:6 regulatory:6 competition:6", """SELECT * FROM daily_news""", "A28 J07")
def _(spark, d):
    return daily_news(spark, d)


add_view("daily_news", """
SELECT s.session, count(*) AS news_count, sum(sentiment) AS sentiment_sum, avg(sentiment) AS sentiment_mean, sum(greatest(sentiment, 0)) AS bullish, sum(greatest(-sentiment, 0)) AS bearish,
       sum(s_regulatory) AS regulatory, sum(s_competition) AS competition, sum(s_earnings) AS earnings FROM news n ASOF JOIN sessions s ON n.available_at <= s.market_close GROUP BY 1""")


def daily_news(spark, d):
    n = news(spark, d).select("available_at", "sentiment", "s_regulatory", "s_competition", "s_earnings")
    j = asof_join(n, views.sessions(spark, d), "available_at", "market_close", ["market_close", "session"], forward=True).filter("session IS NOT NULL")
    z = F.lit(0.0)
    return j.groupBy("session").agg(
        F.count("*").alias("news_count"), F.sum("sentiment").alias("sentiment_sum"), F.avg("sentiment").alias("sentiment_mean"), F.sum(F.greatest("sentiment", z)).alias("bullish"),
        F.sum(F.greatest(-F.col("sentiment"), z)).alias("bearish"), F.sum("s_regulatory").alias("regulatory"), F.sum("s_competition").alias("competition"), F.sum("s_earnings").alias("earnings"))


@query("w27_rolling_news", "session:d count3:i count7:i mean3:6 mean7:6 bull_bear3:6 recency:6 risk:6",
       """WITH g AS (SELECT s.session, coalesce(n.news_count, 0) AS c, coalesce(n.sentiment_sum, 0) AS t, coalesce(n.bullish, 0) AS bu, coalesce(n.bearish, 0) AS be, coalesce(regulatory, 0) AS rg, coalesce(competition, 0) AS cp FROM sessions s LEFT JOIN daily_news n USING (session))
          SELECT session, sum(c) OVER w3 AS count3, sum(c) OVER w7 AS count7, coalesce(sum(t) OVER w3 / nullif(sum(c) OVER w3, 0), 0) AS mean3, coalesce(sum(t) OVER w7 / nullif(sum(c) OVER w7, 0), 0) AS mean7,
            sum(bu) OVER w3 - sum(be) OVER w3 AS bull_bear3, 0.55 * t + 0.30 * coalesce(lag(t) OVER o, 0) + 0.15 * coalesce(lag(t, 2) OVER o, 0) AS recency, sum(rg) OVER w3 + sum(cp) OVER w3 + sum(be) OVER w3 AS risk
          FROM g WINDOW o AS (ORDER BY session), w3 AS (ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w7 AS (ORDER BY session ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", "W27")
def _(spark, d):
    g = views.sessions(spark, d).select("session").join(daily_news(spark, d), "session", "left").fillna(0)
    w = Window.orderBy("session")
    w3, w7 = trailing(3, 0, w), trailing(7, 0, w)
    s, c = F.col("sentiment_sum"), F.col("news_count")

    def mean(fr):
        return F.coalesce(sdiv(F.sum(s).over(fr), F.sum(c).over(fr)), F.lit(0.0))

    lag = [F.coalesce(F.lag(s, k).over(w), F.lit(0.0)) for k in (1, 2)]
    return g.select("session", F.sum(c).over(w3).alias("count3"), F.sum(c).over(w7).alias("count7"), mean(w3).alias("mean3"), mean(w7).alias("mean7"),
                    (F.sum("bullish").over(w3) - F.sum("bearish").over(w3)).alias("bull_bear3"), (s * 0.55 + lag[0] * 0.30 + lag[1] * 0.15).alias("recency"),
                    (F.sum("regulatory").over(w3) + F.sum("competition").over(w3) + F.sum("bearish").over(w3)).alias("risk"))


AS_OF = "1999-06-01 00:00:00"


OVERLAY_HOURS = 720  # oldest article of the overlay


@query("a29_decayed_overlay", "lang:s article_count:i sentiment:6 signal:i confidence:6 flags:s",
       f"""WITH o AS (SELECT lang, count(*) AS article_count, sum(w * sentiment) / sum(w) AS sentiment, sum(w * s_regulatory) / sum(w) AS rg, sum(w * s_competition) / sum(w) AS cp, sum(w * s_earnings) / sum(w) AS er FROM (
             SELECT *, exp(-(epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 3600.0 / 72.0) AS w FROM news WHERE published_at <= TIMESTAMP '{AS_OF}' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AND available_at <= TIMESTAMP '{AS_OF}') GROUP BY 1),
          f AS (SELECT *, list_filter([CASE WHEN rg > 0.20 AND sentiment < 0.05 THEN 'regulatory_risk' END, CASE WHEN cp > 0.25 AND sentiment < 0.05 THEN 'competition_pressure' END, CASE WHEN er > 0.25 THEN 'earnings_sensitive' END], lambda x: x IS NOT NULL) AS fl FROM o)
          SELECT *, CASE WHEN sentiment >= 0.18 AND len(fl) = 0 THEN 1 WHEN sentiment <= -0.18 OR list_contains(fl, 'regulatory_risk') THEN -1 ELSE 0 END AS signal, least(greatest(abs(sentiment) * 0.20, 0), 0.08) AS confidence, array_to_string(fl, ',') AS flags FROM f""", "A29")
def _(spark, d):
    return overlay(news(spark, d))


TOP_ARTICLES = 10  # length of the list; the list is the feature


@query("a29_top_articles", "lang:s place:i doc_id:i published:t sentiment:6",
       f"""SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY published_at DESC, doc_id) AS place, doc_id, published_at AS published, sentiment FROM news
           WHERE published_at <= TIMESTAMP '{AS_OF}' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL {OVERLAY_HOURS} HOUR AND available_at <= TIMESTAMP '{AS_OF}' AND available_at >= published_at QUALIFY place <= {TOP_ARTICLES}""", "A29")
def _(spark, d):
    n = known_articles(news(spark, d), AS_OF, OVERLAY_HOURS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("published_at"), "doc_id"))
    return n.withColumn("place", place).filter(F.col("place") <= TOP_ARTICLES).withColumnRenamed("published_at", "published")


def known_articles(n, as_of: str, hours: int):
    """Articles of the last hours that were available at an instant."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age = (F.unix_timestamp(now) - F.unix_timestamp("published_at")) / 3600.0
    return n.filter((F.col("published_at") <= now) & (age <= hours) & (F.col("available_at") <= now) & (F.col("available_at") >= F.col("published_at"))).withColumn("age", age)


def overlay(n, as_of: str = AS_OF, hours: int = OVERLAY_HOURS):
    """Age-weighted sentiment per language at an instant; only articles known by then take part."""
    n = known_articles(n, as_of, hours).withColumn("w", F.exp(-F.col("age") / 72.0))
    w = F.col("w")
    g = n.groupBy("lang").agg(F.count("*").alias("article_count"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(a) for c, a in (
        ("sentiment", "sentiment"), ("s_regulatory", "rg"), ("s_competition", "cp"), ("s_earnings", "er"))])
    s = F.col("sentiment")
    fl = F.array_compact(F.array(F.when((F.col("rg") > 0.20) & (s < 0.05), "regulatory_risk"), F.when((F.col("cp") > 0.25) & (s < 0.05), "competition_pressure"),
                                 F.when(F.col("er") > 0.25, "earnings_sensitive")))
    g = g.withColumn("fl", fl)
    return g.select("lang", "article_count", "sentiment", F.when((s >= 0.18) & (F.size("fl") == 0), 1).when((s <= -0.18) | F.array_contains("fl", "regulatory_risk"), -1).otherwise(0).alias("signal"),
                    clip(F.abs(s) * 0.20, 0.0, 0.08).alias("confidence"), F.array_join("fl", ",").alias("flags"))


@query("l06_recent_articles", "published_at:t doc_id:i publisher:s sentiment:6", "SELECT published_at, doc_id, publisher, sentiment FROM news ORDER BY published_at DESC, doc_id LIMIT 10", "L06")
def _(spark, d):
    return news(spark, d).select("published_at", "doc_id", "publisher", "sentiment").orderBy(F.desc("published_at"), "doc_id").limit(10)


@query("l09_top_by_mean", "source:s mean_sentiment:6", "SELECT source, avg(sentiment) AS mean_sentiment FROM news GROUP BY 1 ORDER BY round(avg(sentiment), 9) DESC, source LIMIT 5", "L09")
def _(spark, d):
    return news(spark, d).groupBy("source").agg(F.avg("sentiment").alias("mean_sentiment")).orderBy(F.round("mean_sentiment", 9).desc(), "source").limit(5)


@query("w31_story_dedupe", "story_id:s first_doc:i last_doc:i copies:i", "SELECT story_id, arg_min(doc_id, row(published_at, doc_id)) AS first_doc, arg_max(doc_id, row(published_at, doc_id)) AS last_doc, count(*) AS copies FROM news GROUP BY 1", "W31 U02")
def _(spark, d):
    s = story(spark, d).select("doc_id", "published_at", tx.story_hash("day", "title").alias("story_id"))
    # Partial aggregates instead of a row number, so a story with very many copies stays cheap.
    k = packed_order((F.unix_micros(F.col("published_at").cast("timestamp")), 17), ("doc_id", 19))
    return s.groupBy("story_id").agg(F.min_by("doc_id", k).alias("first_doc"), F.max_by("doc_id", k).alias("last_doc"), F.count("*").alias("copies"))


@query("u02_distinct_text", "source:s articles:i distinct_texts:i", "SELECT source, count(*) AS articles, count(DISTINCT sha256(body)) AS distinct_texts FROM articles GROUP BY 1", "U02")
def _(spark, d):
    return views.articles(spark, d).groupBy("source").agg(F.count("*").alias("articles"), F.count_distinct(F.sha2(F.col("body").cast("binary"), 256)).alias("distinct_texts"))


@query("a30_store_audit", "lang:s events:i months:i max_source_share:6 source_counts:s reasons:s",
       """WITH c AS (SELECT lang, source, count(*) AS n FROM news GROUP BY 1, 2), s AS (SELECT lang, max(n) * 1.0 / sum(n) AS share, string_agg(source || '=' || n, ',' ORDER BY source) AS counts FROM c GROUP BY 1),
          m AS (SELECT lang, count(*) AS events, count(DISTINCT date_trunc('month', published_at)) AS months FROM news GROUP BY 1)
          SELECT m.*, s.share AS max_source_share, s.counts AS source_counts, array_to_string(list_filter([CASE WHEN events < 300 THEN 'labeled_events<300' END, CASE WHEN months < 12 THEN 'coverage_months<12' END, CASE WHEN share > 0.05 THEN 'single_source_share>0.05' END], lambda x: x IS NOT NULL), ';') AS reasons
          FROM m JOIN s USING (lang)""", "A30 P33")
def _(spark, d):
    a = story(spark, d).groupBy("lang", "source", F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n"))
    by_source = a.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    s = by_source.groupBy("lang").agg(F.sum("n").alias("events"), (F.max("n") / F.sum("n")).alias("max_source_share"),
                                      F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.col("n").cast("string"))))).alias("counts"))
    m = a.groupBy("lang").agg(F.count_distinct("month").alias("months"))
    j = s.join(m, "lang")
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    why = F.array(F.when(F.col("events") < 300, "labeled_events<300"), F.when(F.col("months") < 12, "coverage_months<12"), F.when(F.col("max_source_share") > 0.05, "single_source_share>0.05"))
    return j.select("lang", "events", "months", "max_source_share", text.alias("source_counts"), F.array_join(F.array_compact(why), ";").alias("reasons"))


# Gate of an event store, and the bases on which an availability time counts as verified.
GATE = {"events": 250, "months": 24, "share": 0.75}
VERIFIED = ("verified_ingestion_log", "verified_vendor_release")


@query("p33_event_gate", "lang:s status:s events:i months:i max_source_share:6 reasons:s",
       f"""WITH b AS (SELECT lang, source, published_at, available_at, CASE WHEN available_at > published_at THEN 'verified_ingestion_log' ELSE 'publication_time' END AS basis FROM articles),
          c AS (SELECT lang, source, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT lang, max(n) * 1.0 / sum(n) AS share FROM c GROUP BY 1),
          m AS (SELECT lang, count(*) AS events, count(DISTINCT date_trunc('month', published_at)) AS months, count(*) - count(available_at) AS missing, count(*) FILTER (basis NOT IN {VERIFIED}) AS unverified FROM b GROUP BY 1),
          r AS (SELECT m.*, s.share AS max_source_share, array_to_string(list_filter([CASE WHEN missing > 0 THEN 'historical_available_at_missing' END, CASE WHEN unverified > 0 THEN 'historical_availability_provenance_unverified' END,
            CASE WHEN events < {GATE['events']} THEN 'labeled_events<{GATE['events']}' END, CASE WHEN months < {GATE['months']} THEN 'coverage_months<{GATE['months']}' END, CASE WHEN share > {GATE['share']} THEN 'single_source_share>{GATE['share']:.2f}' END], lambda x: x IS NOT NULL), ';') AS reasons FROM m JOIN s USING (lang))
          SELECT *, CASE WHEN reasons = '' THEN 'ready_for_walk_forward' ELSE 'insufficient_point_in_time_sample' END AS status FROM r""", "P33")
def _(spark, d):
    a = views.articles(spark, d)
    basis = F.when(F.col("available_at") > F.col("published_at"), "verified_ingestion_log").otherwise("publication_time")
    a = a.groupBy("lang", "source", F.trunc(F.to_date("published_at"), "month").alias("month")).agg(
        F.count("*").alias("n"), F.sum(F.col("available_at").isNull().cast("int")).alias("missing"), F.sum((~basis.isin(*VERIFIED)).cast("int")).alias("unverified"))
    return event_gate(a)


def event_gate(counts):
    """Gate per language from counts per (lang, source, month); every reason that speaks against the store."""
    s = counts.groupBy("lang", "source").agg(F.sum("n").alias("n")).groupBy("lang").agg((F.max("n") / F.sum("n")).alias("max_source_share"))
    g = counts.groupBy("lang").agg(F.sum("n").alias("events"), F.count_distinct("month").alias("months"), F.sum("missing").alias("missing"), F.sum("unverified").alias("unverified")).join(s, "lang")
    why = F.array_join(F.array_compact(F.array(
        F.when(F.col("missing") > 0, "historical_available_at_missing"), F.when(F.col("unverified") > 0, "historical_availability_provenance_unverified"),
        F.when(F.col("events") < GATE["events"], f"labeled_events<{GATE['events']}"), F.when(F.col("months") < GATE["months"], f"coverage_months<{GATE['months']}"),
        F.when(F.col("max_source_share") > GATE["share"], f"single_source_share>{GATE['share']:.2f}"))), ";")
    return g.withColumn("reasons", why).withColumn("status", F.when(F.col("reasons") == "", "ready_for_walk_forward").otherwise("insufficient_point_in_time_sample"))


@query("p34_news_freshness", "doc_id:i freshness:s eligible:i age_hours:4",
       f"""SELECT doc_id, freshness, CASE WHEN freshness = 'fresh' THEN 1 ELSE 0 END AS eligible, CASE WHEN freshness IN ('fresh', 'expired') THEN age END AS age_hours FROM (
            SELECT doc_id, age, CASE WHEN length(body) < 20 THEN 'empty' WHEN published_at IS NULL OR available_at IS NULL THEN 'missing_timestamp' WHEN published_at > TIMESTAMP '{AS_OF}' OR available_at > TIMESTAMP '{AS_OF}' THEN 'future_timestamp' WHEN age > 2400 THEN 'expired' ELSE 'fresh' END AS freshness
            FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 3600.0 AS age FROM articles))""", "P34")
def _(spark, d):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    age = (F.unix_timestamp(now) - F.unix_timestamp("published_at")) / 3600.0
    a = views.articles(spark, d).withColumn("age", age)
    st = (F.when(F.length("body") < 20, "empty").when(F.col("published_at").isNull() | F.col("available_at").isNull(), "missing_timestamp")
          .when((F.col("published_at") > now) | (F.col("available_at") > now), "future_timestamp").when(F.col("age") > 2400, "expired").otherwise("fresh"))
    a = a.withColumn("freshness", st)
    return a.select("doc_id", "freshness", (F.col("freshness") == "fresh").cast("int").alias("eligible"), F.when(F.col("freshness").isin("fresh", "expired"), F.col("age")).alias("age_hours"))


@query("p35_overlay_adjustment", "doc_id:i adjusted_mu:8 adjusted_sigma:8 tail_multiplier:6 shock:6",
       """SELECT doc_id, 0.0005 + 0.05 * least(greatest(bull - bear, -1), 1) AS adjusted_mu, 0.02 * least(greatest(1 + 0.25 * shock, 1), 1.3) AS adjusted_sigma, least(greatest(1 + 0.5 * bear, 1), 1.5) AS tail_multiplier, shock FROM (
            SELECT *, least(greatest(0.50 * (1 - neutral) + 0.35 * abs(bull - bear) + 0.15 * (1 - rel), 0), 1) AS shock FROM (SELECT *, greatest(sentiment, 0) AS bull, greatest(-sentiment, 0) AS bear, 1 - abs(sentiment) AS neutral FROM news))""", "P35")
def _(spark, d):
    n = news(spark, d).select("doc_id", "rel", F.greatest("sentiment", F.lit(0.0)).alias("bull"), F.greatest(-F.col("sentiment"), F.lit(0.0)).alias("bear"), (1 - F.abs("sentiment")).alias("neutral"))
    gap = F.col("bull") - F.col("bear")
    n = n.withColumn("shock", clip(0.50 * (1 - F.col("neutral")) + 0.35 * F.abs(gap) + 0.15 * (1 - F.col("rel")), 0.0, 1.0))
    return n.select("doc_id", "shock", (0.0005 + 0.05 * clip(gap, -1.0, 1.0)).alias("adjusted_mu"), (0.02 * clip(1 + 0.25 * F.col("shock"), 1.0, 1.3)).alias("adjusted_sigma"),
                    clip(1 + 0.5 * F.col("bear"), 1.0, 1.5).alias("tail_multiplier"))


# ---------------------------------------------------------------- options
@query("s07_option_bars", "occ:s session:d expiry:d cp:s strike:3 mid:6 volume:2",
       r"""SELECT occ, session, strptime('20' || regexp_extract(occ, '(\d{6})[CP]\d{8}$', 1), '%Y%m%d') AS expiry, regexp_extract(occ, '\d{6}([CP])\d{8}$', 1) AS cp, CAST(regexp_extract(occ, '(\d{8})$', 1) AS INT) / 1000.0 AS strike, mid, volume FROM option_bars""", "S07 F10")
def _(spark, d):
    o = views.option_bars(spark, d)
    return o.select("occ", "session", F.to_date(F.concat(F.lit("20"), F.regexp_extract("occ", r"(\d{6})[CP]\d{8}$", 1)), "yyyyMMdd").alias("expiry"), F.regexp_extract("occ", r"\d{6}([CP])\d{8}$", 1).alias("cp"),
                    (F.regexp_extract("occ", r"(\d{8})$", 1).cast("int") / 1000.0).alias("strike"), "mid", "volume")


@query("f21_mid_price", "occ:s session:d price:6", "SELECT occ, session, CASE WHEN mid * 0.99 > 5 AND mid * 1.01 >= mid * 0.99 THEN (mid * 0.99 + mid * 1.01) / 2 ELSE spot * 0.01 END AS price FROM option_bars", "F21")
def _(spark, d):
    bid, ask = F.col("mid") * 0.99, F.col("mid") * 1.01
    return views.option_bars(spark, d).select("occ", "session", F.when((bid > 5) & (ask >= bid), (bid + ask) / 2).otherwise(F.col("spot") * 0.01).alias("price"))


@query("a45_expiry_table", "symbol:s session:d expiry:d dte:i atm_strike:2 atm_iv:6 straddle:4 move:6 skew25:6 skew_signal:s",
       """WITH x AS (SELECT symbol, session, expiry, any_value(dte) AS dte, any_value(spot) AS spot, arg_min(strike, (abs(strike - spot), strike)) AS atm_strike,
            arg_min(iv, (abs(abs(delta) - 0.25), strike)) FILTER (cp = 'C') AS c25, arg_min(iv, (abs(abs(delta) - 0.25), strike)) FILTER (cp = 'P') AS p25 FROM option_bars GROUP BY 1, 2, 3),
          a AS (SELECT o.symbol, o.session, o.expiry, avg(o.iv) AS atm_iv, CASE WHEN count(*) = 2 THEN sum(o.mid) END AS straddle FROM option_bars o JOIN x ON x.symbol = o.symbol AND x.session = o.session AND x.expiry = o.expiry AND x.atm_strike = o.strike GROUP BY 1, 2, 3)
          SELECT x.*, a.atm_iv, a.straddle, a.straddle / x.spot AS move, p25 - c25 AS skew25, CASE WHEN p25 - c25 IS NULL THEN 'unknown' WHEN p25 - c25 > 0.03 THEN 'downside_put_skew' WHEN p25 - c25 < -0.03 THEN 'upside_call_skew' ELSE 'balanced' END AS skew_signal
          FROM x JOIN a ON a.symbol = x.symbol AND a.session = x.session AND a.expiry = x.expiry""", "A45")
def _(spark, d):
    return expiry_table(views.option_bars(spark, d))


def expiry_table(o):
    """One aggregation per (symbol, session, expiry); the at-the-money pair is an arg-min, not a join."""
    call, put = F.col("cp") == "C", F.col("cp") == "P"
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")
    wing = F.struct(F.abs(F.abs("delta") - 0.25), "strike")
    pair = o.groupBy("symbol", "session", "expiry", "dte", "spot", "strike").agg(
        F.avg("iv").alias("iv"), F.count("*").alias("n"), F.sum("mid").alias("both"),
        F.min_by(F.struct("iv", "delta"), F.when(call, wing)).alias("c"), F.min_by(F.struct("iv", "delta"), F.when(put, wing)).alias("p"))
    dist = lambda s: F.struct(F.abs(F.abs(F.col(f"{s}.delta")) - 0.25), F.col("strike"))
    g = pair.groupBy("symbol", "session", "expiry", "dte", "spot").agg(
        F.min_by(F.struct("strike", "iv", F.when(F.col("n") == 2, F.col("both")).alias("straddle")), near).alias("a"),
        F.min_by("c.iv", F.when(F.col("c").isNotNull(), dist("c"))).alias("c25"), F.min_by("p.iv", F.when(F.col("p").isNotNull(), dist("p"))).alias("p25"))
    k = F.col("p25") - F.col("c25")
    return g.select("symbol", "session", "expiry", "dte", F.col("a.strike").alias("atm_strike"), F.col("a.iv").alias("atm_iv"), F.col("a.straddle").alias("straddle"),
                    (F.col("a.straddle") / F.col("spot")).alias("move"), k.alias("skew25"),
                    F.when(k.isNull(), "unknown").when(k > 0.03, "downside_put_skew").when(k < -0.03, "upside_call_skew").otherwise("balanced").alias("skew_signal"))


@query("a46_iv_surface", "symbol:s expiry:d c10:6 c25:6 atm:6 p25:6 p10:6 risk_reversal:6 butterfly:6",
       """WITH g AS (SELECT symbol, expiry, arg_min(iv, (abs(delta - 0.10), session, strike)) FILTER (cp = 'C') AS c10, arg_min(iv, (abs(delta - 0.25), session, strike)) FILTER (cp = 'C') AS c25, arg_min(iv, (abs(delta - 0.50), session, strike)) FILTER (cp = 'C') AS atm,
            arg_min(iv, (abs(delta + 0.25), session, strike)) FILTER (cp = 'P') AS p25, arg_min(iv, (abs(delta + 0.10), session, strike)) FILTER (cp = 'P') AS p10 FROM option_bars GROUP BY 1, 2)
          SELECT *, c25 - p25 AS risk_reversal, (c25 + p25) / 2 - atm AS butterfly FROM g""", "A46")
def _(spark, d):
    o = views.option_bars(spark, d)
    targets = {"c10": ("C", 0.10), "c25": ("C", 0.25), "atm": ("C", 0.50), "p25": ("P", -0.25), "p10": ("P", -0.10)}
    g = o.groupBy("symbol", "expiry").agg(*[F.min_by("iv", F.when(F.col("cp") == cp, F.struct(F.abs(F.col("delta") - t), "session", "strike"))).alias(k) for k, (cp, t) in targets.items()])
    return g.select("*", (F.col("c25") - F.col("p25")).alias("risk_reversal"), ((F.col("c25") + F.col("p25")) / 2 - F.col("atm")).alias("butterfly"))


@query("f22_call_curve", "symbol:s expiry:d strike:2 price:6",
       """SELECT symbol, expiry, strike, min(p) OVER (PARTITION BY symbol, expiry ORDER BY strike ROWS UNBOUNDED PRECEDING) AS price FROM (
            SELECT symbol, expiry, strike, avg(mid) AS p FROM option_bars WHERE cp = 'C' AND strike BETWEEN spot * 0.55 AND spot * 1.6 AND mid > 0 GROUP BY 1, 2, 3)""", "F22")
def _(spark, d):
    c = views.option_bars(spark, d).filter("cp = 'C' AND strike BETWEEN spot * 0.55 AND spot * 1.6 AND mid > 0").groupBy("symbol", "expiry", "strike").agg(F.avg("mid").alias("p"))
    w = Window.partitionBy("symbol", "expiry").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("price", F.min("p").over(w))


def implied_vol(o, rate: float = 0.04):
    """Vectorised bisection over Arrow batches: 80 halvings of [0.01, 5] for all rows of a batch at once."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("double")
    def solve(price: pd.Series, spot: pd.Series, strike: pd.Series, tau: pd.Series, is_call: pd.Series) -> pd.Series:
        p, s, k, t, call = (x.to_numpy() for x in (price, spot, strike, tau, is_call))

        def cdf(x):
            z = np.abs(x) / np.sqrt(2.0)
            u = 1.0 / (1.0 + 0.3275911 * z)
            poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
            return 0.5 * (1.0 + np.sign(x) * (1.0 - poly * np.exp(-z * z)))

        lo, hi = np.full(len(p), 0.01), np.full(len(p), 5.0)
        disc = k * np.exp(-rate * t)
        for _ in range(80):
            mid = (lo + hi) / 2
            root = mid * np.sqrt(t)
            d1 = (np.log(s / k) + (rate + 0.5 * mid * mid) * t) / root
            d2 = d1 - root
            value = np.where(call, s * cdf(d1) - disc * cdf(d2), disc * cdf(-d2) - s * cdf(-d1))
            high = value > p
            hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
        ok = (p > 0) & (t > 0) & (p >= np.where(call, np.maximum(s - k, 0), np.maximum(k - s, 0)) * 0.98)
        return pd.Series(np.where(ok, (lo + hi) / 2, np.nan))

    iv = solve(F.col("mid"), F.col("spot"), F.col("strike"), F.greatest(F.col("dte"), F.lit(1)) / F.lit(365.0), F.col("cp") == "C")
    return o.withColumn("solved_iv", F.nullif(F.nanvl(iv, F.lit(-1.0)), F.lit(-1.0)))


def _value_sql(m: str) -> str:
    """Option value at volatility ``m`` for the columns of the view below."""
    d1 = f"((log_moneyness + (0.04::DOUBLE + 0.5::DOUBLE * {m} * {m}) * tau) / ({m} * sqrt(tau)))"
    d2 = f"({d1} - {m} * sqrt(tau))"
    return (f"CASE WHEN cp = 'C' THEN spot * {cdf_sql(d1)} - disc * {cdf_sql(d2)} ELSE disc * {cdf_sql('-' + d2)} - spot * {cdf_sql('-' + d1)} END")


# The lower end of the interval is carried through 80 halvings of its width.
add_view("solved_options", f"""
SELECT *, CASE WHEN mid > 0 AND mid >= CASE WHEN cp = 'C' THEN greatest(spot - strike, 0) ELSE greatest(strike - spot, 0) END * 0.98
   THEN list_reduce(list_prepend(0.01::DOUBLE, list_transform(range(1, 81), lambda i: 4.99::DOUBLE / pow(2.0::DOUBLE, i))),
     lambda low, w: CASE WHEN {_value_sql('(low + w)')} > mid THEN low ELSE low + w END) + 4.99::DOUBLE / pow(2.0::DOUBLE, 81) END AS solved_iv
FROM (SELECT *, greatest(dte, 1) / 365.0::DOUBLE AS tau, strike * exp(-0.04::DOUBLE * greatest(dte, 1) / 365.0::DOUBLE) AS disc, ln(spot / strike) AS log_moneyness FROM option_bars)""")


@query("f20_implied_volatility", "occ:s session:d mid:4 solved_iv:4", "SELECT occ, session, mid, solved_iv FROM solved_options", "F20")
def _(spark, d):
    return implied_vol(views.option_bars(spark, d))


@query("a44_option_daily", "symbol:s session:d expiry:d atm_strike:2 straddle_move:6 atm_iv:4 put_minus_call:4 put_call_volume:6 iv_rank60:6",
       """WITH e AS (SELECT symbol, session, arg_min(expiry, abs(dte - 14) * 100000 + dte) AS expiry FROM solved_options GROUP BY 1, 2),
          x AS (SELECT o.* FROM solved_options o JOIN e USING (symbol, session, expiry)),
          s AS (SELECT symbol, session, expiry, spot, strike, max(mid) FILTER (cp = 'C') AS cm, max(mid) FILTER (cp = 'P') AS pm, max(solved_iv) FILTER (cp = 'C') AS civ, max(solved_iv) FILTER (cp = 'P') AS piv,
              coalesce(sum(volume) FILTER (cp = 'C'), 0) AS cv, coalesce(sum(volume) FILTER (cp = 'P'), 0) AS pv FROM x GROUP BY 1, 2, 3, 4, 5),
          g AS (SELECT *, sum(cv) OVER k AS acv, sum(pv) OVER k AS apv, row_number() OVER (PARTITION BY symbol, session, expiry, spot ORDER BY abs(strike - spot), strike) AS place FROM s WINDOW k AS (PARTITION BY symbol, session, expiry, spot)),
          a AS (SELECT symbol, session, expiry, strike AS atm_strike, (cm + pm) / spot AS straddle_move, (coalesce(civ, piv) + coalesce(piv, civ)) / 2 AS atm_iv, piv - civ AS put_minus_call, apv / nullif(acv, 0) AS put_call_volume FROM g WHERE place = 1),
          l AS (SELECT *, list(atm_iv) FILTER (atm_iv IS NOT NULL) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM a)
          SELECT *, CASE WHEN len(l) >= 20 AND atm_iv IS NOT NULL THEN (len(list_filter(l, lambda v: v < atm_iv)) + (len(list_filter(l, lambda v: v = atm_iv)) + 1) / 2.0) / len(l) END AS iv_rank60 FROM l""", "A44")
def _(spark, d):
    o = implied_vol(views.option_bars(spark, d))
    call, put = F.col("cp") == "C", F.col("cp") == "P"
    best = F.struct(F.abs(F.col("dte") - 14), F.col("dte"))
    near = o.groupBy("symbol", "session").agg(F.min_by("expiry", best).alias("expiry"))
    x = o.join(near, ["symbol", "session", "expiry"])
    dist = F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")
    s = x.groupBy("symbol", "session", "expiry", "spot", "strike").agg(
        F.max(F.when(call, F.col("mid"))).alias("cm"), F.max(F.when(put, F.col("mid"))).alias("pm"), F.max(F.when(call, F.col("solved_iv"))).alias("civ"),
        F.max(F.when(put, F.col("solved_iv"))).alias("piv"), F.sum(F.when(call, F.col("volume")).otherwise(0)).alias("cv"), F.sum(F.when(put, F.col("volume")).otherwise(0)).alias("pv"))
    g = s.groupBy("symbol", "session", "expiry", "spot").agg(F.min_by(F.struct("strike", "cm", "pm", "civ", "piv"), dist).alias("a"), F.sum("cv").alias("cv"), F.sum("pv").alias("pv"))
    g = g.select("symbol", "session", "expiry", F.col("a.strike").alias("atm_strike"), ((F.col("a.cm") + F.col("a.pm")) / F.col("spot")).alias("straddle_move"),
                 ((F.coalesce("a.civ", "a.piv") + F.coalesce("a.piv", "a.civ")) / 2).alias("atm_iv"), (F.col("a.piv") - F.col("a.civ")).alias("put_minus_call"), sdiv("pv", "cv").alias("put_call_volume"))
    return g.withColumn("iv_rank60", rank_in_window("atm_iv", 60, 20))


# ---------------------------------------------------------------- holdings
add_view("holding_groups", """
SELECT cusip, count(DISTINCT manager) AS holders, sum(value_usd) AS total_value, sum(amount) AS total_amount FROM holdings WHERE amount_type = 'SH' AND put_call IS NULL AND cusip IS NOT NULL GROUP BY 1""")


def share_rows(spark, d):
    return views.holdings(spark, d).filter("amount_type = 'SH' AND put_call IS NULL AND cusip IS NOT NULL")


@query("s15_holdings_scan", "cusip:i managers:i rows:i", "SELECT cusip, count(DISTINCT manager) AS managers, count(*) AS rows FROM holdings WHERE amount_type = 'SH' AND put_call IS NULL AND cusip IS NOT NULL GROUP BY 1", "S15")
def _(spark, d):
    return share_rows(spark, d).groupBy("cusip").agg(F.count_distinct("manager").alias("managers"), F.count("*").alias("rows"))


@query("a38_holdings_consensus", "place:i cusip:i holders:i total_value:2 total_amount:2",
       "SELECT row_number() OVER (ORDER BY holders DESC, round(total_value, 2) DESC, cusip) AS place, * FROM holding_groups WHERE holders >= 3", "A38 L01")
def _(spark, d):
    # (cusip, manager) first: the distinct count is then a plain count and copies add up before the shuffle.
    m = share_rows(spark, d).groupBy("cusip", "manager").agg(F.sum("value_usd").alias("v"), F.sum("amount").alias("a"))
    g = m.groupBy("cusip").agg(F.count("*").alias("holders"), F.sum("v").alias("total_value"), F.sum("a").alias("total_amount")).filter("holders >= 3")
    return rank_all(g, [F.desc("holders"), F.desc(F.round("total_value", 2)), F.col("cusip")], "place")


@query("a38_holder_pairs", "cusip:i manager:i value_usd:2", "SELECT cusip, manager, sum(value_usd) AS value_usd FROM holdings WHERE amount_type = 'SH' AND put_call IS NULL AND cusip IS NOT NULL GROUP BY 1, 2", "A38")
def _(spark, d):
    return share_rows(spark, d).groupBy("cusip", "manager").agg(F.sum("value_usd").alias("value_usd"))


add_view("price_stats", """
SELECT symbol, arg_max(close, session) / arg_min(close, session) - 1 AS return_6m, arg_max(close, session) / coalesce(max(close) FILTER (back = 62), arg_min(close, session)) - 1 AS return_3m, arg_max(close, session) / coalesce(max(close) FILTER (back = 20), arg_min(close, session)) - 1 AS return_1m,
       avg(close) FILTER (back < 50) AS ma50, avg(close) FILTER (back < 120) AS ma120, stddev_samp(r) FILTER (back < 125) * sqrt(252) AS annual_vol, min(dd) AS max_drawdown, arg_max(close, session) AS last_close
FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (
  SELECT symbol, session, close, ret1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) - 1 AS back FROM features) WHERE back < 126) GROUP BY 1 HAVING count(*) >= 30""")


def price_stats(spark, d):
    """Half-year price statistics per security from its last 126 rows."""
    f = views.features(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session"))) - 1).filter("back < 126")
    up = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("dd", F.col("close") / F.max("close").over(up) - 1)
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    g = f.groupBy("symbol").agg(
        F.max_by("close", "session").alias("last_close"), F.min_by("close", "session").alias("first"), at(62).alias("c63"), at(20).alias("c21"), F.avg(F.when(F.col("back") < 50, F.col("close"))).alias("ma50"),
        F.avg(F.when(F.col("back") < 120, F.col("close"))).alias("ma120"), (F.stddev_samp(F.when(F.col("back") < 125, F.col("ret1"))) * math.sqrt(252)).alias("annual_vol"), F.min("dd").alias("max_drawdown"), F.count("*").alias("n"))
    last = F.col("last_close")
    return g.filter("n >= 30").select("symbol", "last_close", (last / F.col("first") - 1).alias("return_6m"), (last / F.coalesce("c63", "first") - 1).alias("return_3m"), (last / F.coalesce("c21", "first") - 1).alias("return_1m"),
                                      "ma50", "ma120", "annual_vol", "max_drawdown")


@query("a39_price_metrics", "symbol:s return_1m:8 return_3m:8 return_6m:8 ma50:4 ma120:4 annual_vol:7 max_drawdown:8", "SELECT * FROM price_stats", "A39")
def _(spark, d):
    return price_stats(spark, d)


@query("a40_composite_score", "symbol:s holders:i breadth:6 capital:6 momentum:6 trend:4 risk_adjusted:6 model_score:6 probability:6",
       """WITH h AS (SELECT symbol, count(DISTINCT l_suppkey) AS holders, sum(ext) AS value FROM lines GROUP BY 1), j AS (SELECT *, return_6m / nullif(annual_vol, 0) AS ra FROM h JOIN price_stats USING (symbol)),
          k AS (SELECT *, holders * 1.0 / max(holders) OVER () AS breadth, ln(1 + value) / max(ln(1 + value)) OVER () AS capital, least(greatest((return_6m + 0.20) / 0.80, 0), 1) AS momentum,
             0.5 * CASE WHEN last_close > ma50 THEN 1 ELSE 0 END + 0.5 * CASE WHEN ma50 > ma120 THEN 1 ELSE 0 END AS trend, (rank() OVER (ORDER BY ra) - 1 + 0.5 * count(*) OVER (PARTITION BY ra)) / count(*) OVER () AS risk_adjusted, least(greatest(abs(max_drawdown) / 0.45, 0), 1) AS pen FROM j),
          s AS (SELECT *, 0.35 * breadth + 0.20 * capital + 0.25 * momentum + 0.12 * trend + 0.08 * risk_adjusted - 0.08 * pen AS model_score FROM k)
          SELECT *, 1 / (1 + exp(-(-1.15 + 3.2 * model_score))) AS probability FROM s""", "A40")
def _(spark, d):
    m = views.lines(spark, d).groupBy("symbol", "l_suppkey").agg(F.sum("ext").alias("v"))
    h = m.groupBy("symbol").agg(F.count("*").alias("holders"), F.sum("v").alias("value"))
    j = h.join(price_stats(spark, d), "symbol").withColumn("ra", sdiv("return_6m", "annual_vol"))
    # One row per security of the asset dimension: the whole-table windows are over that dimension.
    allr = Window.partitionBy(F.lit(1))
    mid = (F.rank().over(Window.partitionBy(F.lit(1)).orderBy("ra")) - 1 + 0.5 * F.count("*").over(Window.partitionBy("ra"))) / F.count("*").over(allr)
    k = j.select("*", (F.col("holders") / F.max("holders").over(allr)).alias("breadth"), (F.log1p("value") / F.max(F.log1p("value")).over(allr)).alias("capital"),
                 clip((F.col("return_6m") + 0.20) / 0.80, 0.0, 1.0).alias("momentum"), (flag(F.col("last_close") > F.col("ma50")) * 0.5 + flag(F.col("ma50") > F.col("ma120")) * 0.5).alias("trend"),
                 mid.alias("risk_adjusted"), clip(F.abs("max_drawdown") / 0.45, 0.0, 1.0).alias("pen"))
    score = 0.35 * F.col("breadth") + 0.20 * F.col("capital") + 0.25 * F.col("momentum") + 0.12 * F.col("trend") + 0.08 * F.col("risk_adjusted") - 0.08 * F.col("pen")
    k = k.withColumn("model_score", score)
    return k.withColumn("probability", logistic(-1.15 + 3.2 * F.col("model_score")))


@query("a52_comparables", "brand:s n:i median_price:6 mean_price:6 mean_size:6",
       "SELECT p_brand AS brand, count(*) AS n, quantile_cont(p_retailprice, 0.5) AS median_price, avg(p_retailprice) AS mean_price, avg(p_size) AS mean_size FROM part GROUP BY 1", "A52")
def _(spark, d):
    # Prices repeat, so the exact median works on the counts of distinct prices.
    p = read_table(spark, d, "part").groupBy("p_brand", "p_retailprice").agg(F.count("*").alias("k"), F.sum("p_size").alias("sz"))
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.sum("k").alias("n"), F.percentile("p_retailprice", 0.5, F.col("k")).alias("median_price"),
                                                          (F.sum(F.col("k") * F.col("p_retailprice")) / F.sum("k")).alias("mean_price"), (F.sum("sz") / F.sum("k")).alias("mean_size"))


# ---------------------------------------------------------------- scenarios and validation
add_view("scenario", """
SELECT symbol, session, h.method, h.steps, CASE WHEN count(*) = h.steps THEN arg_max(x.close, x.rn) / any_value(f.close) - 1 END AS terminal, max(x.close) / any_value(f.close) - 1 AS top, min(x.close) / any_value(f.close) - 1 AS bottom
FROM features f JOIN (VALUES ('ten_day', 10), ('month', 20)) h(method, steps) ON true JOIN (SELECT symbol AS s2, rn, close FROM features) x ON x.s2 = f.symbol AND x.rn BETWEEN f.rn + 1 AND f.rn + h.steps GROUP BY 1, 2, 3, 4 HAVING count(*) = h.steps""")


def scenario(spark, d):
    """Each bar starts one realised path per method; terminal return and path extremes come from row frames."""
    f = views.features(spark, d)
    w = by_symbol()
    rows = []
    for m, n in (("ten_day", 10), ("month", 20)):
        fr = w.rowsBetween(1, n)
        rows.append(F.struct(F.lit(m).alias("method"), (F.when(F.count("close").over(fr) == n, F.lead("close", n).over(w)) / F.col("close") - 1).alias("terminal"),
                             (F.max("close").over(fr) / F.col("close") - 1).alias("top"), (F.min("close").over(fr) / F.col("close") - 1).alias("bottom")).alias(m))
    return f.select("symbol", "session", *rows).select("symbol", "session", F.inline(F.array("ten_day", "month"))).filter("terminal IS NOT NULL")


@query("a41_scenario_metrics", "symbol:s method:s n:i p_up:6 mean:8 median:8 std:8 skew:4 low80:8 high80:8 var95:8 cvar95:8 touch_up5:6 touch_down5:6",
       """SELECT symbol, method, count(*) AS n, avg(CASE WHEN terminal > 0 THEN 1.0 ELSE 0.0 END) AS p_up, avg(terminal) AS mean, quantile_cont(terminal, 0.5) AS median, stddev_samp(terminal) AS std, skewness(terminal) AS skew,
            quantile_cont(terminal, 0.1) AS low80, quantile_cont(terminal, 0.9) AS high80, max(terminal) FILTER (k <= ceil(nn * 5 / 100.0)) AS var95, avg(terminal) FILTER (k <= ceil(nn * 5 / 100.0)) AS cvar95,
            avg(CASE WHEN top >= 0.05 THEN 1.0 ELSE 0.0 END) AS touch_up5, avg(CASE WHEN bottom <= -0.05 THEN 1.0 ELSE 0.0 END) AS touch_down5
          FROM (SELECT *, row_number() OVER (PARTITION BY symbol, method ORDER BY terminal, session) AS k, count(*) OVER (PARTITION BY symbol, method) AS nn FROM scenario) GROUP BY 1, 2""", "A41")
def _(spark, d):
    s = scenario(spark, d)
    w = Window.partitionBy("symbol", "method")
    s = s.withColumn("k", F.row_number().over(w.orderBy("terminal", "session"))).withColumn("nn", F.count("*").over(w))
    t = F.col("terminal")
    tail = F.when(F.col("k") <= F.ceil(F.col("nn") * 5 / 100.0), t)
    g = s.groupBy("symbol", "method").agg(
        F.count("*").alias("n"), F.avg((t > 0).cast("int")).alias("p_up"), F.avg(t).alias("mean"), F.percentile(t, 0.5).alias("median"), F.stddev_samp(t).alias("std"), F.sum(t).alias("s1"), F.sum(t * t).alias("s2"),
        F.sum(t * t * t).alias("s3"), F.percentile(t, 0.1).alias("low80"), F.percentile(t, 0.9).alias("high80"), F.max(tail).alias("var95"), F.avg(tail).alias("cvar95"),
        F.avg((F.col("top") >= 0.05).cast("int")).alias("touch_up5"), F.avg((F.col("bottom") <= -0.05).cast("int")).alias("touch_down5"))
    return g.withColumn("skew", moment_skew("n", "s1", "s2", "s3"))


@query("a41_method_average", "symbol:s methods:i mean_p_up:6 mean_return:8 diverges:i",
       "SELECT symbol, count(*) AS methods, avg(p_up) AS mean_p_up, avg(m) AS mean_return, CASE WHEN max(p_up) - min(p_up) > 0.10 THEN 1 ELSE 0 END AS diverges FROM (SELECT symbol, method, avg(CASE WHEN terminal > 0 THEN 1.0 ELSE 0.0 END) AS p_up, avg(terminal) AS m FROM scenario GROUP BY 1, 2) GROUP BY 1", "A41")
def _(spark, d):
    g = scenario(spark, d).groupBy("symbol", "method").agg(F.avg((F.col("terminal") > 0).cast("int")).alias("p"), F.avg("terminal").alias("m"))
    return g.groupBy("symbol").agg(F.count("*").alias("methods"), F.avg("p").alias("mean_p_up"), F.avg("m").alias("mean_return"), flag(F.max("p") - F.min("p") > 0.10).alias("diverges"))


_GROUPS = "unnest(['overall', 'sector:' || sector, 'quality:' || CASE WHEN abs(prob_up - 0.5) >= 0.2 THEN 'high' ELSE 'low' END, 'regime:' || CASE WHEN vol20 > vol60 THEN 'hot' ELSE 'calm' END])"


@query("a42_group_validation", "grp:s n:i accuracy:6 brier:6 log_loss:6 auc:6",
       f"""WITH x AS (SELECT prob_up AS p, target_direction AS y, {_GROUPS} AS grp FROM signals WHERE target_direction IS NOT NULL),
          r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS rk FROM x)
          SELECT grp, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(pow(p - y, 2)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss,
            (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY 1""", "A42")
def _(spark, d):
    s = views.signals(spark, d).filter("target_direction IS NOT NULL")
    grp = F.explode(F.array(F.lit("overall"), F.concat(F.lit("sector:"), "sector"), F.when(F.abs(F.col("prob_up") - 0.5) >= 0.2, "quality:high").otherwise("quality:low"),
                            F.when(F.col("vol20") > F.col("vol60"), "regime:hot").otherwise("regime:calm")))
    x = s.select(F.col("prob_up").alias("p"), F.col("target_direction").alias("y"), grp.alias("grp"))
    p, y = F.col("p"), F.col("y")
    g = x.groupBy("grp").agg(F.count("*").alias("n"), F.avg(((p >= 0.5) == (y == 1)).cast("int")).alias("accuracy"), F.avg(F.pow(p - y, 2)).alias("brier"),
                             F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    return g.join(evl.auc(x, ["grp"], "p", "y"), "grp")


@query("a43_move_coverage", "symbol:s coverage:6 var95_coverage:6 tail_recall:6",
       """SELECT symbol, avg(CASE WHEN abs(r5) <= move THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN r5 >= -1.65 * move THEN 1.0 ELSE 0.0 END) AS var95_coverage,
            count(*) FILTER (r5 <= -0.03 AND prob_up <= 0.5) * 1.0 / nullif(count(*) FILTER (r5 <= -0.03), 0) AS tail_recall FROM (
            SELECT s.symbol, s.prob_up, lead(close, 5) OVER (PARTITION BY s.symbol ORDER BY s.session) / close - 1 AS r5, greatest(vol20 * sqrt(5), 0.005) AS move FROM signals s) WHERE r5 IS NOT NULL AND move IS NOT NULL GROUP BY 1""", "A43")
def _(spark, d):
    s = views.signals(spark, d).select("symbol", "prob_up", (F.lead("close", 5).over(by_symbol()) / F.col("close") - 1).alias("r5"), F.greatest(F.col("vol20") * math.sqrt(5), F.lit(0.005)).alias("move"))
    s = s.filter("r5 IS NOT NULL AND move IS NOT NULL")
    r, m = F.col("r5"), F.col("move")
    return s.groupBy("symbol").agg(F.avg((F.abs(r) <= m).cast("int")).alias("coverage"), F.avg((r >= -1.65 * m).cast("int")).alias("var95_coverage"),
                                   sdiv(F.sum(((r <= -0.03) & (F.col("prob_up") <= 0.5)).cast("int")), F.sum((r <= -0.03).cast("int"))).alias("tail_recall"))


@query("a47_environment_summary", "source:s articles:i bullish:i bearish:i neutral:i label:s",
       """SELECT *, CASE WHEN articles < 20 THEN 'low' WHEN articles < 40 THEN 'medium' ELSE 'high' END AS label FROM (SELECT source, count(*) AS articles, count(*) FILTER (sentiment > 0.05) AS bullish, count(*) FILTER (sentiment < -0.05) AS bearish, count(*) FILTER (abs(sentiment) <= 0.05) AS neutral FROM news GROUP BY 1)""", "A47")
def _(spark, d):
    s = F.col("sentiment")
    g = news(spark, d).groupBy("source").agg(F.count("*").alias("articles"), F.count_if(s > 0.05).alias("bullish"), F.count_if(s < -0.05).alias("bearish"), F.count_if(F.abs(s) <= 0.05).alias("neutral"))
    return g.withColumn("label", F.when(F.col("articles") < 20, "low").when(F.col("articles") < 40, "medium").otherwise("high"))


@query("a48_weighted_mean", "lang:s weighted:8 plain:8",
       "SELECT lang, coalesce(sum(CASE WHEN kw <> 0 THEN importance END * sentiment) / nullif(sum(CASE WHEN kw <> 0 THEN importance END), 0), avg(sentiment)) AS weighted, avg(sentiment) AS plain FROM news GROUP BY 1", "A48")
def _(spark, d):
    w = F.when(F.col("kw") != 0, F.col("importance"))
    return news(spark, d).groupBy("lang").agg(F.coalesce(sdiv(F.sum(w * F.col("sentiment")), F.sum(w)), F.avg("sentiment")).alias("weighted"), F.avg("sentiment").alias("plain"))
