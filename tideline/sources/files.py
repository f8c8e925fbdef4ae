"""Landed files: readers with declared schemas and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Label-side columns, prefixes and parts of names.
FORBIDDEN_NAMES = {"label_end_at", "fit_at", "decision_at", "output_window", "output_timestamps", "future_return", "future_returns",
                   "future_1d_return", "future_3d_return", "future_5d_return", "future_1d_direction", "future_3d_direction",
                   "future_5d_direction", "volatility_shock", "downside_tail_risk", "trend", "alignment", "signal", "position", "direction"}
FORBIDDEN_PREFIXES = ("out_", "overall_", "output_", "future_")
FORBIDDEN_PARTS = ("future", "post_event", "after_event")
MIXED_COLUMNS = {"technical": "holds input and output readings together; only parsed in_ keys are allowed"}


def leak_reason(column: str, extra: tuple[str, ...] = ()) -> str | None:
    """Why a column may not be a feature; None if it may. ``extra`` names label columns of the caller."""
    name = column.strip().lower()
    if name in FORBIDDEN_NAMES or name in extra:
        return "label or decision field"
    if name.startswith(FORBIDDEN_PREFIXES):
        return "prefix of the label side"
    if any(p in name for p in FORBIDDEN_PARTS):
        return "names a later time"
    return MIXED_COLUMNS.get(name)


def assert_no_leakage(columns: list[str], extra: tuple[str, ...] = ()) -> None:
    """Refuse feature frames that carry label-side columns."""
    bad = {c: r for c in columns if (r := leak_reason(c, extra))}
    if bad:
        raise ValueError(f"feature frame contains label-side columns: {bad}")


def audit_columns(df: DataFrame, text: tuple[str, ...] = (), prices: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> DataFrame:
    """column, role (news_text, price_input, label, excluded, feature), reason and non-null rows of every column."""
    def role(c: str) -> str:
        return ("label" if c in labels else "excluded" if leak_reason(c) else "news_text" if c in text
                else "price_input" if c in prices else "feature")

    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(role(c)).alias("role"), F.lit(leak_reason(c) or "").alias("reason"),
                              F.col(f"c{i}").alias("non_null")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(rows))


def read_bars_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars; both dates inclusive, required columns enforced by the schema."""
    df = spark.read.csv(path, header=True, enforceSchema=False, mode="FAILFAST",
                        schema="symbol STRING, session DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE")
    if start:
        df = df.filter(F.col("session") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("session") <= F.lit(end).cast("date"))
    return df


def read_macro_csv(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Observation files with ``.`` for missing; unreadable numbers become NULL."""
    raw = spark.read.csv(path, header=True, schema="series_id STRING, obs_date DATE, raw STRING", nullValue=".")
    return raw.filter(F.col("obs_date").between(start, end)).select(
        "series_id", "obs_date", F.expr("try_cast(raw AS DOUBLE)").alias("value"))


def read_articles_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema=(
        "id STRING, title STRING, link STRING, source STRING, published_at STRING, summary STRING, query STRING, "
        "sentiment_score DOUBLE, event_scores MAP<STRING,DOUBLE>, fetched_at STRING, available_at STRING"))


def read_vendor_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    assert_no_leakage(df.columns)
    return df


def read_growing_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file still being appended to: rows that do not parse are skipped."""
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


EVENT_COLUMNS = ("id STRING, name STRING, date DATE, end_date DATE, category STRING, secondary_categories ARRAY<STRING>, importance INT, "
                 "geography STRING, source STRING, notes STRING, theme_tickers ARRAY<STRING>")


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """A hand-kept list in one JSON document."""
    return spark.read.json(path, multiLine=True, schema=EVENT_COLUMNS)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same table as splittable JSON lines, for lists that are not small."""
    return spark.read.json(path, schema=EVENT_COLUMNS)


def read_aligned_samples(spark: SparkSession, path: str) -> DataFrame:
    """Aligned news and price windows; only the input side may become features."""
    df = spark.read.parquet(path)
    return df.withColumn("technical_in", F.map_filter(
        F.coalesce(F.from_json("technical", "map<string,array<double>>"), F.create_map().cast("map<string,array<double>>")),
        lambda k, v: k.startswith("in_")))


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run; later runs may add columns, read them back with ``read_results``."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Strict JSON lines: NaN and infinities become null and nulls are written out."""
    from tideline.functions.numeric import finite

    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cols = [finite(c).alias(c) if c in doubles else F.col(c) for c in df.columns]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows and the sum of the leading 32 bits of each row hash."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]).cast("binary"), 256)
    return df.select(F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint").alias("h")).agg(
        F.count("*").alias("rows"), F.sum("h").alias("digest"))
