"""Ordered-window building blocks. All features of one frame share the same window spec, so
Spark sorts each symbol once."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideline.functions.numeric import bind, num, sdiv


def by_symbol(*keys: str, order: str = "session") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(n: int, end: int = 0, w: WindowSpec | None = None) -> WindowSpec:
    """The n rows that end ``end`` rows after the current one (use -1 to exclude the own row)."""
    return (w or by_symbol()).rowsBetween(end - n + 1, end)


def gated(fn: Callable[[Column], Column], x, frame: WindowSpec, min_count: int) -> Column:
    """Aggregate over a frame; NULL until it holds ``min_count`` values."""
    c = num(x)
    return F.when(F.count(c).over(frame) >= min_count, fn(c).over(frame))


def full(fn, x, n: int, w: WindowSpec | None = None) -> Column:
    return gated(fn, x, trailing(n, 0, w), n)


def pct_change(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    c = num(x)
    return sdiv(c, F.lag(c, n).over(w or by_symbol())) - 1


def sorted_quantile(v: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    at = (F.size(v) - 1) * F.lit(float(q))
    lo = F.floor(at).cast("int")
    a, b = F.get(v, lo), F.get(v, F.least(lo + 1, F.size(v) - 1))
    return (F.lit(1.0) + lo - at) * a + (at - lo) * b


def frame_quantiles(x, qs: tuple[float, ...], frame: WindowSpec, min_count: int) -> Column:
    """Struct of quantiles q0, q1, ... of a frame's values, all from one sorted array."""
    values = F.sort_array(F.collect_list(num(x)).over(frame))
    return bind(values, lambda v: F.when(F.size(v) >= min_count, F.struct(*[sorted_quantile(v, q).alias(f"q{i}") for i, q in enumerate(qs)])))


def prior_quantile(x, q: float, n: int = 126, min_count: int = 40, w: WindowSpec | None = None) -> Column:
    """Quantile of the n rows before the current one: a value never sets its own cut-off. Sorting a
    short array once per row beats the map-based quantile aggregate, which is rebuilt for every frame."""
    return frame_quantiles(x, (q,), trailing(n, -1, w), min_count)["q0"]


def rank_in_window(x, n: int | None, min_count: int, w: WindowSpec | None = None) -> Column:
    """Average-rank percentile of the current value inside its trailing window."""
    base = w or by_symbol()
    frame = base.rowsBetween(-(n - 1), 0) if n else base.rowsBetween(Window.unboundedPreceding, 0)
    c = num(x)
    values = F.collect_list(c).over(frame)
    below = F.size(F.filter(values, lambda v: v < c))
    equal = F.size(F.filter(values, lambda v: v == c))
    return F.when(F.size(values) >= min_count,
                  (below + (equal + F.lit(1)) / F.lit(2.0)) / F.size(values))


def limited_fill(x, limit: int, w: WindowSpec | None = None) -> Column:
    """Last non-null value, but only within ``limit`` rows."""
    frame = (w or by_symbol()).rowsBetween(-limit, 0)
    return F.last(num(x), ignorenulls=True).over(frame)


def _ewm_group(df: DataFrame, x: str, specs: dict[str, tuple[float, int]], key: str, order: str) -> DataFrame:
    cols = df.columns
    rates = {out: -math.log(1.0 - alpha) for out, (alpha, _) in specs.items()}
    # One block ahead the weight is below e^-42, so the state of the previous block is all that counts;
    # the scaled weights inside a block stay far from overflow.
    block = math.ceil(42.0 / min(rates.values()))
    if max(rates.values()) * block > 650:
        raise ValueError("smoothing factors too far apart for one pass; split the call")
    w = Window.partitionBy(key).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn("_i", F.when(F.col(x).isNotNull(), F.count(x).over(up) - 1))
    live = seen.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_k", F.col("_i") % block)
    inner = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = live.select("*", *[
        (F.exp(F.lit(-r) * F.col("_k")) * F.sum(
            F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(specs[out][0])) * F.col(x) * F.exp(F.lit(r) * F.col("_k"))).over(inner))
        .alias(f"_y_{out}") for out, r in rates.items()])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    done = local.select("*", *[
        F.last(F.when(F.col("_k") == block - 1, F.col(f"_y_{out}")), ignorenulls=True).over(before).alias(f"_c_{out}") for out in specs])
    return done.select(*cols, *[
        F.when(F.col("_i") >= k - 1, F.col(f"_y_{out}") + F.exp(F.lit(-rates[out]) * (F.col("_k") + 1))
               * F.coalesce(F.col(f"_c_{out}"), F.lit(0.0))).alias(out) for out, (_, k) in specs.items()])


def ewm_means(df: DataFrame, specs: dict[str, tuple[str, float, int]], key: str = "symbol",
              order: str = "session") -> DataFrame:
    """Exponentially weighted means in recursive form (the first value seeds the state), no Python.

    ``specs`` maps an output name to (input column, alpha, minimum count). Rows are numbered per
    key and cut into blocks. Inside a block the recursion is a scaled prefix sum; the state carried
    in is the end of the block before. All windows share one shuffle by key, and a key is one
    symbol's bars, bounded by the calendar.
    """
    by_input: dict[str, dict[str, tuple[float, int]]] = {}
    for out, (x, alpha, k) in specs.items():
        by_input.setdefault(x, {})[out] = (alpha, k)
    for x, group in by_input.items():
        df = _ewm_group(df, x, group, key, order)
    return df


def span(n: float) -> float:
    """Smoothing factor of a span."""
    return 2.0 / (n + 1.0)
