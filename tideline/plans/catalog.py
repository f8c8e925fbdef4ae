"""Query catalog: each entry holds a Spark plan, an output contract and its SQL twin.

The output contract is a string such as ``"symbol:s session:d n:i ret:6"``.
Kinds: s text, d date, t timestamp, i integer, a number = decimals kept of a double.
Both sides are projected through the same contract, so names, types and rounding agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.plans import sqlviews


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    contract: list[tuple[str, str]]
    body: str | None
    rows: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        """SQL twin with the shared views it needs in front."""
        return None if self.body is None else sqlviews.with_views(self.body)


CATALOG: dict[str, Query] = {}


def _parse(contract: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in contract.split()]


def _project(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in contract:
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            c = c.cast("bigint")
        else:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def _project_sql(body: str, contract: list[tuple[str, str]]) -> str:
    out = []
    for name, kind in contract:
        if kind == "s":
            e = f'CAST("{name}" AS VARCHAR)'
        elif kind == "d":
            e = f'CAST(CAST("{name}" AS DATE) AS VARCHAR)'
        elif kind == "t":
            e = f"""strftime("{name}", '%Y-%m-%d %H:%M:%S')"""
        elif kind == "i":
            e = f'CAST("{name}" AS BIGINT)'
        else:
            e = f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0'
        out.append(f'{e} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM (\n{body}\n) AS result"


def query(name: str, contract: str, sql: str | None = None, rows: str = ""):
    """Register a plan. ``rows`` lists the inventory ids it covers; ``sql`` may use any shared view."""
    cols = _parse(contract)

    def wrap(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _project(fn(spark, sf_dir), cols)

        body = None if sql is None else _project_sql(sql, cols)
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, build, cols, body, tuple(rows.split()))
        return fn

    return wrap
