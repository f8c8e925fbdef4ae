"""Walk-forward folds as a column: train rows [start - T, start), test rows [start, start + S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def number_rows(df: DataFrame, key: str = "symbol", order: str = "session") -> DataFrame:
    """Zero-based position ``i`` and length ``len`` of each key's series."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn(
        "len", F.count("*").over(Window.partitionBy(key)))


def with_folds(df: DataFrame, train: int, test: int) -> DataFrame:
    """Repeat each row for every fold it belongs to, with its role. A row is in at most
    ``train / test`` training folds and one test fold, so the fan-out is a constant."""
    last = F.ceil((F.col("len") - train) / test) - 1
    first_train = F.greatest(F.floor((F.col("i") - train) / test) + 1, F.lit(0))
    last_train = F.least(F.floor(F.col("i") / test), last)
    trains = F.when(last_train >= first_train, F.transform(
        F.sequence(first_train, last_train), lambda f: F.struct(f.cast("int").alias("fold"), F.lit("train").alias("role"))))
    own = F.floor((F.col("i") - train) / test)
    tests = F.when(F.col("i") >= train, F.array(F.struct(own.cast("int").alias("fold"), F.lit("test").alias("role"))))
    empty = F.array().cast("array<struct<fold:int,role:string>>")
    return df.select("*", F.inline(F.concat(F.coalesce(trains, empty), F.coalesce(tests, empty))))


def fold_bounds(df: DataFrame, train: int, test: int, key: str = "symbol", order: str = "session") -> DataFrame:
    f = with_folds(number_rows(df, key, order), train, test)
    is_train = F.col("role") == "train"
    return f.groupBy(key, "fold").agg(
        F.min(F.when(is_train, F.col(order))).alias("train_start"), F.max(F.when(is_train, F.col(order))).alias("train_end"),
        F.min(F.when(~is_train, F.col(order))).alias("test_start"), F.max(F.when(~is_train, F.col(order))).alias("test_end"),
        F.sum(is_train.cast("int")).alias("n_train"), F.sum((~is_train).cast("int")).alias("n_test"))


def winsor_fit(folds: DataFrame, x: str, key: str = "symbol", lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Training limits and the median of the clipped training values, per key and fold."""
    tr = folds.filter("role = 'train'")
    lim = tr.groupBy(key, "fold").agg(F.coalesce(F.percentile(x, lo), F.lit(0.0)).alias("lo"),
                                      F.coalesce(F.percentile(x, hi), F.lit(0.0)).alias("hi"))
    clipped = tr.join(lim, [key, "fold"]).withColumn(
        "_c", F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("lo")), F.col("hi"))))
    return clipped.groupBy(key, "fold", "lo", "hi").agg(F.coalesce(F.percentile("_c", 0.5), F.lit(0.0)).alias("mid"))


def mature_only(df: DataFrame, fit_at) -> DataFrame:
    """Training rows whose label and features were known at ``fit_at``; fails closed on NULL."""
    missing = {"label_end_at", "available_at"} - set(df.columns)
    if missing:
        raise ValueError(f"training requires explicit {sorted(missing)}")
    return df.filter(F.col("label_end_at").isNotNull() & F.col("available_at").isNotNull()
                     & (F.col("label_end_at") <= fit_at) & (F.col("available_at") <= fit_at))
