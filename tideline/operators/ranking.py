"""Order-dependent operators over data too large for one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.session import cut_lineage


def rank_all(df: DataFrame, order: list, out: str) -> DataFrame:
    """Global 1-based rank of many rows without one big window: range partitions are numbered
    locally and shifted by the row counts of the partitions before them."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ordered = cut_lineage(ordered)
    local = ordered.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(
        F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(before.select("_p", "_before"), "_p").withColumn(out, F.col("_k") + F.col("_before"))
            .drop("_p", "_k", "_before"))


def running_total(df: DataFrame, keys: list[str], order: list[str], x: str, out: str) -> DataFrame:
    """Sum of ``x`` over the rows of the same keys before a row, in order, without gathering a key in one task:
    range partitions are summed locally and shifted by the partitions before; a key's first value is its origin."""
    by = [*keys, *order]
    ordered = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn("_k", F.coalesce(F.sum(x).over(w), F.lit(0)))
    sizes = ordered.groupBy("_p").agg(F.sum(x).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = local.join(before, "_p").withColumn("_g", F.col("_k") + F.col("_before"))
    origin = whole.groupBy(*keys).agg(F.min("_g").alias("_o"))
    return whole.join(origin, keys).withColumn(out, F.col("_g") - F.col("_o")).drop("_p", "_k", "_before", "_g", "_o")


def group_quantile(df: DataFrame, keys: list[str], x: str, q: float, out: str) -> DataFrame:
    """Linear-interpolated quantile per group for groups of any size: distinct values with counts, their running
    totals, and the two order statistics picked by position."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    placed = running_total(counts, keys, [x], "_c", "_b")
    total = placed.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = placed.join(total, keys).withColumn("_at", (F.col("_n") - 1) * F.lit(float(q))).withColumn("_lo", F.floor("_at"))
    holds = lambda i: (F.col("_b") <= i) & (i < F.col("_b") + F.col("_c"))
    low = F.max(F.when(holds(F.col("_lo")), F.col(x)))
    high = F.max(F.when(holds(F.least(F.col("_lo") + 1, F.col("_n") - 1)), F.col(x)))
    part = F.max(F.col("_at") - F.col("_lo"))
    return placed.groupBy(*keys).agg(((F.lit(1.0) - part) * low + part * high).alias(out))


def running_max(df: DataFrame, pos: str, x: str, out: str, block: int = 50_000) -> DataFrame:
    """Running maximum along a global position: inside blocks by window, across blocks by a summary."""
    b = df.withColumn("_b", F.floor(F.col(pos) / block))
    local = b.withColumn("_m", F.max(x).over(Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    tops = b.groupBy("_b").agg(F.max(x).alias("_top"))
    tops = tops.select("_b", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return local.join(tops, "_b").withColumn(out, F.greatest("_m", "_carry")).drop("_b", "_m", "_carry")


def cluster_safe_boundaries(events: DataFrame, order: list, clusters: list[str]) -> DataFrame:
    """Zero-based cut positions that split neither a cluster nor a run of equal keys. A cut before
    position p is safe exactly when no earlier row's cluster reaches p or beyond."""
    ranked = rank_all(events, order, "_r").withColumn("p", F.col("_r") - 1)
    ranked = cut_lineage(ranked.select("p", *clusters))
    reach = ranked
    for i, c in enumerate(clusters):
        ends = ranked.groupBy(c).agg(F.max("p").alias(f"_h{i}"))
        reach = reach.join(ends, c)
    tops = [F.col(f"_h{i}") for i in range(len(clusters))]
    reach = reach.select("p", (F.greatest(*tops) if len(tops) > 1 else tops[0]).alias("_h"))
    run = running_max(reach, "p", "_h", "_reach")
    return run.filter(F.col("_reach") == F.col("p")).select((F.col("p") + 1).alias("cut"))


def walk_boundaries(cuts: DataFrame, n: int, min_train: int, test: int, step: int) -> list[tuple[int, int]]:
    """Fold limits on safe cuts; sizes are minima. Each fold asks the cut table for two minima, so
    the driver sees two numbers per fold and never the table."""
    cuts = cut_lineage(cuts)
    folds, cursor = [], min_train
    while cursor < n:
        start = cuts.filter((F.col("cut") >= cursor) & (F.col("cut") < n)).agg(F.min("cut")).first()[0]
        if start is None:
            break
        end = cuts.filter(F.col("cut") >= start + test).agg(F.min("cut")).first()[0]
        if end is None:
            break
        folds.append((int(start), int(end)))
        cursor = max(start + step, end)
    return folds
