"""Point-in-time research tables derived from the supplied star schema.

Every view reads whole tables. Daily tables hold at most one row per symbol and session, so a
window over one symbol is bounded by the calendar however large ``lineitem`` grows; the reduction
from lines to bars is a partially aggregated ``groupBy``, which tolerates a hot symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideline.functions.numeric import clip, logistic, packed_order, sdiv
from tideline.operators.rolling import by_symbol, full, pct_change
from tideline.sources.stages import stage
from tideline.sources.tables import read_table

BAR_TABLES = ("lineitem", "supplier", "nation", "region")

COST_PER_SIDE = 0.0015  # fixed value: commission 0.001 plus slippage 0.0005, one side


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per traded line. The quote sits on a square-root scale so that daily moves stay
    around one percent and compounded equity stays inside double range."""
    li = read_table(spark, d, "lineitem").select(*["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                            "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    # Joined one table at a time: each right side is a base table of known size, so the planner can
    # broadcast it when it is small and shuffle both sides by key when it is not.
    supplier = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("symbol"))
    region = read_table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    placed = (li.join(supplier, li.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    return placed.select(
        "symbol", "sector", F.to_date("l_shipdate").alias("session"),
        (F.lit(5000.0) + F.sqrt("l_extendedprice")).alias("price"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("ext"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def line_order() -> Column:
    """Trading order of lines; the last two parts break ties."""
    return packed_order(("l_orderkey", 14), ("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 11))


def tick_order() -> Column:
    return packed_order((F.unix_micros(F.col("ts").cast("timestamp")), 18), ("event_id", 19))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars, a stage table: nearly every query starts from it."""
    return stage(spark, d, "bars", BAR_TABLES, build_bars)


def build_bars(spark: SparkSession, d: str) -> DataFrame:
    seq = line_order()
    return lines(spark, d).groupBy("symbol", "sector", "session").agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", seq).alias("close"),
        F.sum("qty").alias("volume"), F.count("*").alias("n_lines"))


def market(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "market", ("lineitem",), build_market)


def build_market(spark: SparkSession, d: str) -> DataFrame:
    """One row per session: broad index, volatility gauge, rate. ``pos`` numbers the sessions;
    the table is one row per calendar day at most, so the single ordered window is bounded."""
    li = read_table(spark, d, "lineitem")
    daily = li.groupBy(F.to_date("l_shipdate").alias("session")).agg(
        (F.lit(5000.0) + F.sum("l_extendedprice") / F.sum("l_quantity") / 10).alias("idx"),
        (F.avg("l_discount") * 400).alias("vix"),
        (F.avg("l_tax") * 1000).alias("tnx"))
    return daily.withColumn("pos", F.row_number().over(Window.orderBy("session")))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Exchange calendar: open 14:30 and close 21:00 UTC."""
    days = market(spark, d).select("session", "pos")
    midnight = F.col("session").cast("timestamp_ntz")
    return days.select("session", "pos",
                       (midnight + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("market_open"),
                       (midnight + F.expr("INTERVAL '21:00' HOUR TO MINUTE")).alias("market_close"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the market columns of the same session."""
    return bars(spark, d).join(market(spark, d), "session")


def features(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "features", BAR_TABLES, build_features)


def build_features(spark: SparkSession, d: str) -> DataFrame:
    """Daily feature frame: one shuffle by symbol, every rolling column on the same sort."""
    w = by_symbol()
    base = panel(spark, d).withColumn("rn", F.row_number().over(w))
    base = base.select(
        "*", pct_change("close", 1).alias("ret1"), pct_change("close", 5).alias("ret5"),
        pct_change("close", 10).alias("ret10"), pct_change("close", 20).alias("ret20"),
        pct_change("close", 60).alias("ret60"), pct_change("idx", 1).alias("idx_ret1"),
        pct_change("idx", 5).alias("idx_ret5"), pct_change("vix", 5).alias("vix_chg5"),
        (F.col("tnx") - F.lag("tnx", 5).over(w)).alias("tnx_chg5"),
        (sdiv(F.lead("close", 1).over(w), "close") - 1).alias("target_return"))
    base = base.select(
        "*", full(F.avg, "close", 20).alias("sma20"), full(F.avg, "close", 60).alias("sma60"),
        full(F.stddev_samp, "close", 20).alias("std20"),
        full(F.stddev_samp, "ret1", 20).alias("vol20"), full(F.stddev_samp, "ret1", 60).alias("vol60"),
        sdiv("volume", full(F.avg, "volume", 20)).alias("vol_ratio"))
    return base.select(
        "*", sdiv("close", "sma20").alias("p20"), sdiv("close", "sma60").alias("p60"),
        sdiv(F.col("close") - F.col("sma20"), "std20").alias("z20"),
        F.when(F.col("target_return").isNotNull(),
               (F.col("target_return") > 0).cast("int")).alias("target_direction"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Baseline long signal with a probability, an expected return and its realised outcome."""
    f = features(spark, d)
    prob = logistic(clip("z20", -3.0, 3.0) * F.lit(-0.4))
    return f.filter("ret20 IS NOT NULL AND z20 IS NOT NULL").select(
        "symbol", "sector", "session", "rn", "close", "ret1", "ret5", "ret20", "vol20", "vol60", "p20", "p60",
        "vix", "vix_chg5", "idx_ret5", "z20", "target_return", "target_direction",
        prob.alias("prob_up"), (F.col("ret20") > 0).cast("double").alias("position"),
        clip(F.col("ret20") / 20, -0.05, 0.05).alias("expected"))


def strategy_names() -> list[str]:
    return ["buy_hold", "momentum", "reversal", "trend"]


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Four target-position series per symbol as one long table (generator, no join)."""
    s = signals(spark, d)
    rules: dict[str, Column] = {
        "buy_hold": F.lit(1.0),
        "momentum": (F.col("ret20") > 0).cast("double"),
        "reversal": (F.col("z20") < 0).cast("double"),
        "trend": F.coalesce((F.col("p60") > 1).cast("double"), F.lit(0.0)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("target")) for k, v in rules.items()])
    return s.select("symbol", "session", "ret1", "target_return", "target_direction", "prob_up", "vix", "vol20",
                    F.inline(rows))


def net_returns(spark: SparkSession, d: str, cost: float = COST_PER_SIDE) -> DataFrame:
    """Lagged position times return, less the cost of the position change, per strategy."""
    w = Window.partitionBy("strategy", "symbol").orderBy("session")
    held = strategies(spark, d).withColumn("held", F.coalesce(F.lag("target").over(w), F.lit(0.0)))
    turned = held.withColumn("turn", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))))
    return turned.withColumn("net", F.col("held") * F.col("ret1") - F.col("turn") * F.lit(cost))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Dated event samples: every order."""
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.to_date("o_orderdate").alias("event_date"),
        F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("theme"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("importance"),
        F.col("o_totalprice").alias("size"), F.col("o_custkey").alias("cust"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """News records; the whole text is the body and the first line the title."""
    return shape_articles(read_table(spark, d, "documents"))


def shape_articles(raw: DataFrame) -> DataFrame:
    """News records from landed texts, bounded or streamed."""
    return raw.select(
        F.col("doc_id"), F.split("text", "\n").getItem(0).alias("title"), F.col("text").alias("body"),
        "source", "lang",
        F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id * 7919 % 2000000 AS INT), 0)")
        .alias("published_at"),
        F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00' + make_dt_interval(0, 0, "
               "CAST(doc_id * 7919 % 2000000 + doc_id % 180 AS INT), 0)").alias("available_at"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        F.col("event_id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        "user_id", (F.lit(100.0) + F.sqrt("value")).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"))


def intraday(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the tick stream."""
    seq = tick_order()
    return ticks(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", seq).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n_ticks"))


def holdings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("cusip"), F.col("l_suppkey").alias("manager"),
        F.when(F.col("l_linestatus") == "O", "SH").otherwise("PRN").alias("amount_type"),
        F.when(F.col("l_returnflag") == "R", "Put").alias("put_call"),
        F.col("l_extendedprice").alias("value_usd"), F.col("l_quantity").alias("amount"))


def option_bars(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "option_bars", BAR_TABLES, build_option_bars)


def build_option_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily option bars: strikes around the close, two monthly expiries, calls and puts."""
    ln = lines(spark, d).select(
        "symbol", "session", "qty", "disc",
        F.when(F.col("l_linenumber") % 2 == 1, "C").otherwise("P").alias("cp"),
        (F.lit(5000.0) + F.lit(50.0) * (F.col("qty").cast("int") % 9)).alias("strike"),
        F.date_add(F.add_months(F.trunc("session", "month"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(2)),
                   14).alias("expiry"))
    q = ln.groupBy("symbol", "session", "expiry", "strike", "cp").agg(
        F.sum("qty").alias("volume"), (F.lit(0.15) + F.avg("disc")).alias("iv"))
    spot = bars(spark, d).select("symbol", "session", F.col("close").alias("spot"))
    q = q.join(spot, ["symbol", "session"]).withColumn("dte", F.datediff("expiry", "session"))
    width = F.col("spot") * F.col("iv") * F.sqrt(F.col("dte") / F.lit(365.0))
    intrinsic = F.greatest(F.when(F.col("cp") == "C", F.col("spot") - F.col("strike"))
                           .otherwise(F.col("strike") - F.col("spot")), F.lit(0.0))
    call_delta = logistic(F.lit(1.6) * (F.col("spot") - F.col("strike")) / width)
    return q.select(
        "*", (intrinsic + F.lit(0.4) * width).alias("mid"),
        F.when(F.col("cp") == "C", call_delta).otherwise(call_delta - 1).alias("delta"),
        F.concat(F.regexp_replace("symbol", "[^A-Z0-9]", ""), F.date_format("expiry", "yyMMdd"), "cp",
                 F.lpad((F.col("strike") * 1000).cast("bigint").cast("string"), 8, "0")).alias("occ"))
