"""Evaluation of signals and probabilities as grouped aggregates."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tideline.functions.numeric import clip, num, sdiv
from tideline.operators.ranking import running_total


def right_closed_bin(p, lo: float, step: float, bins: int) -> Column:
    """1-based bin of (lo + (b-1) step, lo + b step], the lowest edge included, NULL outside."""
    c = num(p)
    raw = F.ceil((c - lo) / step - 1e-9)
    b = F.greatest(raw, F.lit(1))
    return F.when((c >= lo) & (b <= bins), b.cast("int"))


def directional(df: DataFrame, keys: list[str]) -> DataFrame:
    """Active-day accuracy with its spread over calendar years: two levels of partial sums."""
    on = F.col("position") > 0
    d = df.filter("target_return IS NOT NULL")
    year = d.withColumn("year", F.year("session")).groupBy(*keys, "year").agg(
        F.count("*").alias("n"), F.sum(on.cast("int")).alias("active"), F.sum((on & (F.col("target_return") > 0)).cast("int")).alias("up"),
        F.sum(F.when(on, F.col("target_return"))).alias("ret"))
    precise = sdiv("up", "active")
    g = year.groupBy(*keys).agg(
        F.sum("active").alias("dir_active_days"), (F.sum("active") / F.sum("n")).alias("coverage"),
        F.coalesce(sdiv(F.sum("up"), F.sum("active")), F.lit(0.0)).alias("dir_precision"),
        F.coalesce(sdiv(F.sum("ret"), F.sum("active")), F.lit(0.0)).alias("avg_next_return"),
        F.coalesce(F.stddev_pop(precise), F.lit(0.0)).alias("year_std"), F.coalesce(F.min(precise), F.lit(0.0)).alias("worst_year"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("active") > 0, F.concat_ws("=", F.col("year").cast("string"), F.col("up").cast("string"))))), ",").alias("year_hits"))
    return g


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Rank-sum area under the curve with average ranks for ties, on distinct-score counts; a group may hold all rows."""
    c = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    c = running_total(c, keys, [score], "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    g = c.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("_r"), F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    return g.select(*keys, sdiv(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_n") - F.col("_p"))).alias("auc"))


def newey_west(df: DataFrame, keys: list[str], x: str, lags: int, order: str = "session") -> DataFrame:
    """Standard error of a mean under autocorrelation up to ``lags`` (Bartlett weights)."""
    w = Window.partitionBy(*keys).orderBy(order)
    m = df.groupBy(*keys).agg(F.avg(x).alias("_m"))
    c = df.filter(F.col(x).isNotNull()).join(m, keys).withColumn("_c", F.col(x) - F.col("_m"))
    c = c.select(*keys, "_c", *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_g{k}") for k in range(1, lags + 1)])
    g = c.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"), *[F.sum(f"_g{k}").alias(f"_g{k}") for k in range(1, lags + 1)])
    total = F.col("_v") / F.col("n")
    for k in range(1, lags + 1):
        total = total + F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / F.col("n") * (2.0 * (1.0 - k / (lags + 1.0)))
    return g.join(m, keys).select(*keys, "n", F.col("_m").alias("mean"), F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("n")).alias("hac_se"))


def block_bootstrap(df: DataFrame, keys: list[str], x: str, reps: int, block: int, seed: str = "42", order: str = "session") -> DataFrame:
    """Circular block bootstrap of the mean with a hash-chosen block start.

    Block sums are prepared once per start row with a row frame (wrapping through a doubled
    prefix sum), so a repetition is a sum over n/block looked-up sums rather than over n rows.
    The last block of a repetition is cut so that every repetition has n terms. A series of at most
    one block has a mean and no limits.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.filter(F.col(x).isNotNull()).select(*keys, order, F.col(x).alias("v"))
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("prefix", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("v"))
    total = rows.groupBy(*keys, "n").agg(F.sum("v").alias("total"))
    slots = total.filter(F.col("n") > block).select(
        *keys, "n", "total", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))).alias("slot"))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep"), F.col("slot")).cast("binary")), 1, 8), 16, 10).cast("long")
    slots = slots.withColumn("i", (code % F.col("n")).cast("int")).withColumn(
        "size", F.least(F.lit(block), F.col("n") - F.col("slot") * block))
    slots = slots.withColumn("j", (F.col("i") + F.col("size")) % F.col("n")).withColumn("wraps", F.col("i") + F.col("size") >= F.col("n"))
    p = rows.select(*keys, "i", "prefix")
    a = slots.join(p.withColumnRenamed("prefix", "from_sum"), [*keys, "i"])
    b = a.join(p.withColumnRenamed("prefix", "to_sum").withColumnRenamed("i", "j"), [*keys, "j"])
    part = F.col("to_sum") - F.col("from_sum") + F.when(F.col("wraps"), F.col("total")).otherwise(0.0)
    means = b.groupBy(*keys, "n", "total", "rep").agg((F.sum(part) / F.first("n")).alias("m"))
    limits = means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return total.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean")).join(limits, keys, "left")


@lru_cache(maxsize=4)
def _draw_codes(seed: str, reps: int, slots: int) -> np.ndarray:
    """reps x slots numbers of 32 bits, each hash-chosen from seed, repetition and slot alone: all keys share them."""
    heads = b"".join(hashlib.md5(f"{seed}:{rep}:{slot}".encode()).digest()[:4] for rep in range(reps) for slot in range(slots))
    return np.frombuffer(heads, dtype=">u4").astype(np.int64).reshape(reps, slots)


def _path_figures(v: np.ndarray) -> tuple:
    """(Sharpe ratio, worst drawdown) of a path. The ratio of a flat path is NULL; a return of -1 or less has no
    logarithm, so it adds nothing, and before the first logarithm there is no drawdown."""
    with np.errstate(all="ignore"):
        spread = v.std()
        ratio = None if spread <= 1e-12 else float(v.mean() / spread * math.sqrt(252.0))
        known = ~(v <= -1)
        if not known.any():
            return ratio, None
        log = np.cumsum(np.where(known, np.log1p(v), 0.0))[known.argmax():]
        return ratio, float(np.fmin.reduce(np.exp(log - np.maximum(np.maximum.accumulate(log), 0.0)) - 1))


def iid_bootstrap(df: DataFrame, keys: list[str], x: str, reps: int, seed: str = "7", order: str = "session") -> DataFrame:
    """Resampled Sharpe ratio and worst drawdown with hash-chosen rows. A key's series, one number a session, travels as
    one array; its repetitions are drawn and reduced to two numbers where it lies, so no drawn row is ever shuffled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as told: the arrays are small, the work on each is not
    rows = df.filter(F.col(x).isNotNull()).dropna(subset=keys).select(*keys, order, F.col(x).cast("double").alias("v"))
    series = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "v"))).getField("v").alias("vs")).repartition(parts)

    def drawn(batches):
        for b in batches:
            for k in range(b.num_rows):
                v = b.column("vs")[k].values.to_numpy()
                codes = _draw_codes(seed, reps, 1 << (len(v) - 1).bit_length())[:, :len(v)]
                s, d = zip(*[_path_figures(v[code % len(v)]) for code in codes], strict=True)
                key = b.select(keys).take(pa.array([k] * reps))
                yield pa.RecordBatch.from_arrays([*key.columns, pa.array(s, pa.float64()), pa.array(d, pa.float64())], [*keys, "s", "d"])

    shape = StructType([*[df.schema[k] for k in keys], StructField("s", DoubleType()), StructField("d", DoubleType())])
    one = series.mapInArrow(drawn, shape)
    return one.groupBy(*keys).agg(F.percentile("s", 0.05).alias("sharpe_low"), F.percentile("s", 0.95).alias("sharpe_high"), F.percentile("d", 0.05).alias("drawdown_low"))
