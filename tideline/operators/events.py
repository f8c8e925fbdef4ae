"""Event study on row positions.

Returns around an anchor depend only on (symbol, anchor session), never on the sample. So the
market-model fit and every event window are computed once per bar with row frames, and samples meet
them by an equi-join on the anchor. Samples that share a date collapse to a weight first, which
keeps the join bounded by the calendar however many samples there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.numeric import moment_skew, sdiv, student_t_tail
from tideline.operators.asof import forward_map
from tideline.operators.rolling import by_symbol

# Event windows as row offsets around the anchor.
WINDOWS: dict[str, tuple[int, int]] = {
    "pre_5": (-5, -1), "event_0_1": (0, 1), "post_1_5": (1, 5), "post_1_10": (1, 10), "post_1_20": (1, 20),
    "option_realized": (-1, 5)}


def aligned_returns(f: DataFrame) -> DataFrame:
    """Rows with a return of their own and of the benchmark; p is the zero-based return position."""
    return f.filter("ret1 IS NOT NULL").select("symbol", "sector", "session", F.col("ret1").alias("r"),
                                               F.col("idx_ret1").alias("m"), (F.col("rn") - 2).alias("p"))


def _prefix(ret: DataFrame) -> DataFrame:
    """Running sums along each symbol. Any later window sum is a difference of two of them, so the
    cost of a window does not depend on its width."""
    up = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    r, m = F.col("r"), F.col("m")
    terms = {"R": r, "M": m, "RR": r * r, "MM": m * m, "RM": r * m}
    return ret.select("*", *[F.sum(v).over(up).alias(f"_{k}") for k, v in terms.items()])


def _upto(name: str, offset: int):
    """Prefix value ``offset`` rows away, 0 before the first row."""
    w = by_symbol()
    c = F.lag(f"_{name}", -offset).over(w) if offset < 0 else F.lead(f"_{name}", offset).over(w) if offset else F.col(f"_{name}")
    return F.coalesce(c, F.lit(0.0)) if offset < 0 else c


def market_model(ret: DataFrame) -> DataFrame:
    """Alpha, beta and residual deviation known before each row: rows p-250 to p-21, all earlier
    rows when that span is too short, and the plain 60-row mean below 30 rows."""
    wide = F.col("p") > 50
    s = _prefix(ret)
    p = F.col("p")
    n = F.when(wide, F.least(p, F.lit(250)) - 20).otherwise(p).cast("double")
    sums = {k: F.when(wide, _upto(k, -21) - _upto(k, -251)).otherwise(_upto(k, -1)) for k in ("R", "M", "RR", "MM", "RM")}
    back60 = sdiv(_upto("R", -1) - _upto("R", -61), F.least(p, F.lit(60)))
    s = s.select(*ret.columns, "_R", "_M", "_RR", n.alias("n"), back60.alias("mean60"), *[v.alias(f"s{k}") for k, v in sums.items()])
    dof = F.nullif(F.col("n") - 1, F.lit(0.0))
    s = s.withColumn("y", sdiv("sR", "n")).withColumn("x", sdiv("sM", "n"))
    s = s.select("*", ((F.col("sRR") - F.col("n") * F.col("y") * F.col("y")) / dof).alias("vy"),
                 ((F.col("sMM") - F.col("n") * F.col("x") * F.col("x")) / dof).alias("vx"),
                 ((F.col("sRM") - F.col("n") * F.col("x") * F.col("y")) / dof).alias("c"))
    enough = F.col("n") >= 30
    flat = F.col("vx") <= 1e-18
    s = s.withColumn("beta", F.when(enough & ~flat, F.col("c") / F.col("vx")).otherwise(0.0))
    return s.select(
        *ret.columns, "_R", "_M", "_RR", "beta",
        F.when(enough, F.col("y") - F.col("beta") * F.col("x")).otherwise(F.coalesce("mean60", F.lit(0.0))).alias("alpha"),
        F.when(enough, F.sqrt(F.greatest(F.col("vy") - F.col("beta") * F.col("beta") * F.col("vx"), F.lit(0.0)))).alias("sigma"),
        enough.cast("int").alias("fitted"))


def window_arrays(fit: DataFrame, windows: dict[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    """One row per anchor session with the array of event windows that fit inside the series."""
    rows = []
    for name, (a, b) in windows.items():
        width = b - a + 1
        whole = (F.col("p") + a >= 0) & F.lead("r", b).over(by_symbol()).isNotNull() if b > 0 else F.col("p") + a >= 0
        raw, bench, sq = (_upto(k, b) - _upto(k, a - 1) for k in ("R", "M", "RR"))
        spread = F.sqrt(F.greatest(sq - raw * raw / width, F.lit(0.0)) / F.nullif(F.lit(width - 1.0), F.lit(0.0)))
        rows.append(F.when(whole, F.struct(F.lit(name).alias("window"), F.lit(width).alias("n"), raw.alias("raw"),
                                           bench.alias("bench"), spread.alias("spread"))).alias(name))
    keep = [c for c in fit.columns if not c.startswith("_")]
    return fit.select(*keep, *rows).select(*keep, F.array_compact(F.array(*[F.col(n) for n in windows])).alias("v"))


def unfold(arrays: DataFrame) -> DataFrame:
    """One row per window, with the expected and the abnormal part of its return."""
    long = arrays.select(*[c for c in arrays.columns if c != "v"], F.inline("v"))
    expected = F.col("alpha") * F.col("n") + F.col("beta") * F.col("bench")
    long = long.withColumn("expected", expected).withColumn("car", F.col("raw") - F.col("expected"))
    usable = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.col("spread"))
    return long.withColumn("scar", sdiv("car", usable * F.sqrt("n")))


def bar_windows(fit: DataFrame, windows: dict[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    return unfold(window_arrays(fit, windows))


def event_cells(samples: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """(symbol, anchor session, *by) with the number of samples k anchored there."""
    days = samples.groupBy("event_date", *by).agg(F.count("*").alias("k"))
    first = samples.agg(F.min("event_date")).scalar()
    where = forward_map(bars, first_day=first).withColumnRenamed("date", "event_date")
    met = days.join(where, "event_date")
    return met.groupBy("symbol", F.col("anchor").alias("session"), *by).agg(F.sum("k").alias("k"))


def weighted_summary(cells: DataFrame, by: list[str], x: str = "car", z: str = "scar") -> DataFrame:
    """n, moments and tests of x where a row stands for k samples."""
    k = F.col("k")
    v, s = F.col(x), F.col(z)
    g = cells.filter(v.isNotNull()).groupBy(*by).agg(
        F.sum(k).alias("n"), F.sum(k * v).alias("_s1"), F.sum(k * v * v).alias("_s2"), F.sum(k * v * v * v).alias("_s3"),
        F.percentile(v, 0.5, k).alias("median"), F.sum(F.when(v > 0, k).otherwise(0)).alias("_up"),
        F.sum(F.when(s.isNotNull(), k)).alias("_zn"), F.sum(k * s).alias("_z1"), F.sum(k * s * s).alias("_z2"))
    n = F.col("n").cast("double")
    mean = F.col("_s1") / n
    std = F.when(n > 1, F.sqrt(F.greatest(F.col("_s2") - n * mean * mean, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0)))).otherwise(0.0)
    zn = F.col("_zn").cast("double")
    zmean = F.col("_z1") / zn
    zstd = F.sqrt(F.greatest(F.col("_z2") - zn * zmean * zmean, F.lit(0.0)) / F.nullif(zn - 1, F.lit(0.0)))
    g = g.select(*by, "n", "median", mean.alias("mean"), std.alias("std"), (F.col("_up") / n).alias("win_rate"),
                 moment_skew(n, "_s1", "_s2", "_s3").alias("skew"), (F.col("_z1") / F.sqrt(zn)).alias("patell_z"),
                 sdiv(zmean, zstd / F.sqrt(zn)).alias("bmp_t"))
    g = g.withColumn("t_stat", sdiv("mean", F.col("std") / F.sqrt("n")))
    return g.select("*", (F.lit(2.0) * student_t_tail(F.abs("t_stat"), F.greatest(F.col("n") - 1, F.lit(1)))).alias("p_value"),
                    (F.abs("mean") >= 0.005).cast("int").alias("economic"))


def holm(df: DataFrame, group: list[str], p: str = "p_value", tie: str = "symbol") -> DataFrame:
    """Step-down adjustment inside each group of tests."""
    w = Window.partitionBy(*group).orderBy(F.col(p), F.col(tie))
    m = F.count(p).over(Window.partitionBy(*group))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return (df.filter(F.col(p).isNotNull()).withColumn("_step", step)
            .withColumn(f"{p}_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step"))


def quality(n, p):
    return (F.when(n <= 0, "BLACK").when(n < 10, "RED").when(n < 30, "YELLOW")
            .when(p < 0.05, "GREEN").otherwise("YELLOW"))
