"""Structured Streaming jobs. Every transformation here takes a DataFrame that may be bounded or not."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, StringType, TimestampType

from tideline.functions.numeric import packed_order
from tideline.operators.asof import asof_join
from tideline.session import shared_folder

TICK_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession) -> str:
    """A new folder below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 64) -> DataFrame:
    raw = (spark.readStream.schema(TICK_SCHEMA).option("pathGlobFilter", pattern)
           .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
    return shape_ticks(raw)


def shape_ticks(raw: DataFrame) -> DataFrame:
    """Typed ticks; the instant becomes TIMESTAMP because a watermark needs one."""
    return raw.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
                      (F.lit(100.0) + F.sqrt("value")).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"))


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Drain what is available now into Parquet and read it back; nothing passes the driver."""
    base = work_folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    seq = packed_order((F.unix_micros("ts"), 18), ("event_id", 19))
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n"))
    return g.select("symbol", F.col("w.start").alias("bar"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "n")


def sliding_counts(news: DataFrame, width: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    g = news.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_x")


def activity_sessions(ticks: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


def decayed_means(ticks: DataFrame, width: str = "1 day", half_hours: float = 72.0, late: str = "1 hour") -> DataFrame:
    """Exponentially aged mean at the window end; weights are rebased to the window start so that
    partial sums stay in range and merge in any order."""
    w = F.window("ts", width)
    age = (F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", "ts"))) / F.lit(3.6e9)
    t = ticks.withColumn("k", F.exp(age / F.lit(half_hours)))
    g = t.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg((F.sum(F.col("k") * F.col("price")) / F.sum("k")).alias("aged_mean"), F.count("*").alias("n"))
    return g.select("symbol", F.col("w.start").alias("day"), "aged_mean", "n")


def forecasts_to_outcomes(ticks: DataFrame, horizon: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """A signup is a forecast about its user; the purchase within the horizon is its outcome."""
    f = ticks.filter("symbol = 'signup'").select("user_id", F.col("event_id").alias("forecast_id"), F.col("ts").alias("f_ts")).withWatermark("f_ts", late)
    o = ticks.filter("symbol = 'purchase'").select(F.col("user_id").alias("o_user"), F.col("event_id").alias("outcome_id"), F.col("ts").alias("o_ts"), "price").withWatermark("o_ts", late)
    on = F.expr(f"user_id = o_user AND o_ts > f_ts AND o_ts <= f_ts + INTERVAL {horizon}")
    return f.join(o, on).select("forecast_id", "outcome_id", "user_id", "f_ts", "o_ts", "price")


def unique_minutes(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """First record per story key inside the watermark; the key carries its minute."""
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm")
    key = F.substring(F.sha2(F.concat_ws("|", "symbol", minute).cast("binary"), 256), 1, 20)
    t = ticks.withWatermark("ts", late).withColumn("story", key).withColumn("minute", minute)
    return (t.dropDuplicatesWithinWatermark(["story"]) if t.isStreaming else t.dropDuplicates(["story"])).select("story", "symbol", "minute")


def parse_lines(lines: DataFrame, schema: str = "event_id BIGINT, ts TIMESTAMP, symbol STRING, value DOUBLE") -> DataFrame:
    """JSON lines, good rows only; a broken line is routed to ``broken`` instead of failing the job."""
    r = lines.select("value", F.from_json("value", schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return r.select("r.event_id", "r.ts", "r.symbol", F.col("r.value").alias("x"), (F.col("r._bad").isNotNull() | F.col("r.event_id").isNull()).alias("broken"))


def record_once(batch: DataFrame, path: str) -> None:
    """Append records whose identity (model, symbol, session) is new; refuse a changed record.

    Repeats inside the batch are written once; two different records of one identity, in the batch or against
    the history, fail the write before anything is committed. The table is partitioned by the month of the
    session, so a batch reads the months that it touches. Rerunning a batch adds nothing.
    """
    spark = batch.sparkSession
    ident = ["model", "symbol", "session"]
    body = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in batch.columns]).cast("binary"), 256)
    new = batch.withColumn("identity_hash", body).dropDuplicates(["identity_hash"]).withColumn("month", F.date_format("session", "yyyy-MM"))
    twice = F.count("*").over(Window.partitionBy(*ident)) > 1
    refuse = F.raise_error(F.lit("a recorded forecast may not change")).cast("string")
    new = new.withColumn("_twice", twice).withColumn("identity_hash", F.when(F.col("_twice"), refuse).otherwise(F.col("identity_hash"))).drop("_twice")
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:  # the first batch finds no table
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        old = old.join(new.select("month").distinct(), "month", "left_semi").select(*ident, F.col("identity_hash").alias("_old"))
        new = new.join(old, ident, "left")
        same = F.when(F.col("_old") != F.col("identity_hash"), refuse).otherwise(F.col("_old"))
        new = new.withColumn("_old", same).filter("_old IS NULL").drop("_old")
    try:
        new.repartition("month").write.mode("append").partitionBy("month").parquet(path)
    except PySparkException as e:
        if "a recorded forecast may not change" in str(e):
            raise ValueError("a recorded forecast may not change") from e
        raise


def record_sink(stream: DataFrame, path: str, state: str):
    return stream.writeStream.foreachBatch(lambda b, _: record_once(b, path)).option("checkpointLocation", state).trigger(availableNow=True).start()


def enrich_stream(ticks: DataFrame, bars: DataFrame, spark: SparkSession, base: str | None = None) -> DataFrame:
    """Attach the last closed bar to each tick, batch by batch, with the as-of join. Every batch owns a folder that
    a retry replaces."""
    base = base or work_folder(spark)

    def step(batch: DataFrame, number: int) -> None:
        joined = asof_join(batch, bars, "ts", "bar_end", ["bar_end", "bar_close"], ["symbol"], grain="hour")
        joined.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = ticks.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


VWAP_OUT = StructType([StructField("symbol", StringType()), StructField("day", StringType()), StructField("event_id", LongType()),
                       StructField("ts", TimestampType()), StructField("vwap", DoubleType()), StructField("high", DoubleType()), StructField("low", DoubleType())])


class SessionVwap(StatefulProcessor):
    """Running traded value, volume, high and low of one symbol and New York day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("day", StructType([StructField(n, DoubleType()) for n in ("pv", "v", "hi", "lo")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        pv, v, hi, lo = self.state.get() if self.state.exists() else (0.0, 0.0, float("-inf"), float("inf"))
        cum_pv, cum_v = pv + (p["price"] * p["size"]).cumsum(), v + p["size"].cumsum()
        high, low = p["price"].cummax().clip(lower=hi), p["price"].cummin().clip(upper=lo)
        self.state.update((float(cum_pv.iloc[-1]), float(cum_v.iloc[-1]), float(high.iloc[-1]), float(low.iloc[-1])))
        yield pd.DataFrame({"symbol": key[0], "day": key[1], "event_id": p["event_id"], "ts": p["ts"], "vwap": cum_pv / cum_v.where(cum_v > 0), "high": high, "low": low})

    def close(self) -> None:
        pass


def session_vwap(ticks: DataFrame) -> DataFrame:
    day = F.to_date(F.from_utc_timestamp("ts", "America/New_York")).cast("string")
    return ticks.withColumn("day", day).groupBy("symbol", "day").transformWithStateInPandas(
        statefulProcessor=SessionVwap(), outputStructType=VWAP_OUT, outputMode="Append", timeMode="None")


EWM_OUT = StructType([StructField("symbol", StringType()), StructField("event_id", LongType()), StructField("ts", TimestampType()),
                      StructField("fast", DoubleType()), StructField("slow", DoubleType()), StructField("rsi", DoubleType())])


class EwmState(StatefulProcessor):
    """Exponential means of 12 and 26 prices and the Wilder strength of 14, carried across batches.
    Prices of a symbol must arrive in order; bars (bounded per symbol and trigger) are the intended input."""

    FIELDS = ("fast", "slow", "gain", "loss", "last")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ewm", StructType([StructField(n, DoubleType()) for n in self.FIELDS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = self.state.get() if self.state.exists() else (None,) * len(self.FIELDS)
        fast, slow, gain, loss, last = held
        x = p["price"].astype(float)
        change = x.diff() if last is None else x - x.shift(fill_value=last)

        def carried(values: pd.Series, alpha: float, before: float | None) -> pd.Series:
            """Exponential mean that goes on from the carried value, which counts as the first element."""
            head = [] if before is None else [pd.Series([before])]
            out = pd.concat([*head, values], ignore_index=True).ewm(alpha=alpha, adjust=False).mean()
            return out.iloc[len(head):].set_axis(values.index)

        f = pd.DataFrame({"fast": carried(x, 2 / 13, fast), "slow": carried(x, 2 / 27, slow),
                          "gain": carried(change.clip(lower=0), 1 / 14, gain), "loss": carried(-change.clip(upper=0), 1 / 14, loss), "last": x})
        rsi = (100 - 100 / (1 + f["gain"] / f["loss"])).where(f["loss"] > 0)
        end = f.iloc[-1]
        self.state.update(tuple(None if pd.isna(end[n]) else float(end[n]) for n in self.FIELDS))
        yield pd.DataFrame({"symbol": key[0], "event_id": p["event_id"], "ts": p["ts"], "fast": f["fast"], "slow": f["slow"], "rsi": rsi})

    def close(self) -> None:
        pass


def streaming_ewm(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=EwmState(), outputStructType=EWM_OUT, outputMode="Append", timeMode="None")
