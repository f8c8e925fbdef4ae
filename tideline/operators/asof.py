"""As-of joins and calendar maps.

The right side of an as-of join here is a calendar: sessions, hourly bars, statements, readings of a metric.
It becomes a map with one row per (key, time cell) that holds the few right rows a moment of the cell can
see: those inside the cell and the nearest one beyond its border. Facts meet the map by an equi-join on key
and cell and pick by comparison, so no window and no sort runs over facts; a key with a third of all rows
is an ordinary skewed join, and where the map is small Spark broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _bucket(t: str, days: int) -> Column:
    return F.floor(F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")) / days)


def _cell(t: str, grain: str) -> Column:
    if grain == "day":
        return F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    if grain == "hour":
        return F.floor(F.unix_micros(F.col(t).cast("timestamp")) / 3_600_000_000)
    raise ValueError(f"unknown grain {grain}")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str],
              keys: list[str] | None = None, forward: bool = False, allow_exact: bool = True,
              grain: str = "day") -> DataFrame:
    """Left rows with ``values`` of the latest right row at or before (or, forward, the first at or
    after) their own time. Unmatched left rows keep NULLs, rows without a time leave. Ties on the right
    resolve to the largest values struct going backward and the smallest going forward. A cell should
    hold few right rows; ``grain`` is ``day`` or ``hour``."""
    keys = keys or []
    rhs = right.select(*keys, F.col(right_time).cast(left.schema[left_time].dataType).alias("_t"), F.struct(*values).alias("_v")).filter("_t IS NOT NULL")
    rhs = rhs.withColumn("_c", _cell("_t", grain))
    ends = rhs.agg(F.min("_c").alias("low"), F.max("_c").alias("high")).first()  # two numbers of the calendar
    low, high = (ends.low - 1, ends.high + 1) if ends.low is not None else (0, 0)
    order = Window.partitionBy(*keys).orderBy("_t", "_v")
    # a row is seen from its own cell to that of its neighbour; the outermost reaches to the border
    if forward:
        rhs = rhs.withColumn("_from", F.coalesce(F.lag("_c").over(order), F.lit(low))).withColumn("_to", F.col("_c"))
    else:
        rhs = rhs.withColumn("_from", F.col("_c")).withColumn("_to", F.coalesce(F.lead("_c").over(order), F.lit(high)))
    seen = rhs.withColumn("_cell", F.explode(F.sequence("_from", "_to")))
    chart = seen.groupBy(*keys, "_cell").agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).alias("_seen"))
    facts = left.filter(F.col(left_time).isNotNull()).withColumn(
        "_cell", F.greatest(F.lit(low), F.least(F.lit(high), _cell(left_time, grain))))
    joined = facts.join(chart, [*keys, "_cell"], "left")
    moment = F.col(left_time)
    if forward:
        fits = F.filter("_seen", lambda x: x["_t"] >= moment if allow_exact else x["_t"] > moment)
        hit = F.try_element_at(fits, F.lit(1))
    else:
        fits = F.filter("_seen", lambda x: x["_t"] <= moment if allow_exact else x["_t"] < moment)
        hit = F.try_element_at(fits, F.lit(-1))
    joined = joined.withColumn("_hit", hit["_v"])
    return joined.select(*[F.col(c) for c in left.columns if c not in values], *[F.col("_hit").getField(v).alias(v) for v in values])


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def forward_map(bars: DataFrame, key: str = "symbol", day: str = "session", carry: tuple[str, ...] = (),
                first_day=None) -> DataFrame:
    """(key, date) -> first session at or after the date, dense over the calendar, by generator.
    The first session also answers the dates from ``first_day`` on (a date or a scalar subquery)."""
    prev = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    spans = bars.select(key, F.col(day).alias("anchor"), *carry, prev.alias("_prev"))
    reach = F.col("anchor") if first_day is None else F.least(F.col("anchor"), _day(first_day))
    start = F.coalesce(F.date_add("_prev", 1), reach)
    return spans.select(key, "anchor", *carry, F.explode(F.sequence(start, F.col("anchor"))).alias("date"))


def backward_map(bars: DataFrame, last_day, key: str = "symbol", day: str = "session",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, date) -> latest session at or before the date; the last session reaches to ``last_day``."""
    nxt = F.lead(day).over(Window.partitionBy(key).orderBy(day))
    spans = bars.select(key, F.col(day).alias("anchor"), *carry, nxt.alias("_next"))
    end = F.greatest(F.coalesce(F.date_sub("_next", 1), _day(last_day)), F.col("anchor"))
    return spans.select(key, "anchor", *carry, F.explode(F.sequence(F.col("anchor"), end)).alias("date"))


def interval_overlap_join(left: DataFrame, right: DataFrame, lspan: tuple[str, str], rspan: tuple[str, str],
                          bucket_days: int = 30) -> DataFrame:
    """Inner join of closed date intervals that overlap, as an equi-join on time buckets.

    A pair meets in every shared bucket; it is kept only in the first one, so no distinct is needed.
    """
    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(_bucket(lo, bucket_days), _bucket(hi, bucket_days))))

    a, b = spread(left, *lspan), spread(right, *rspan)
    first = F.greatest(_bucket(lspan[0], bucket_days), _bucket(rspan[0], bucket_days))
    return a.join(b, "_b").filter(
        (F.col(rspan[0]) <= F.col(lspan[1])) & (F.col(rspan[1]) >= F.col(lspan[0])) & (F.col("_b") == first)).drop("_b")
