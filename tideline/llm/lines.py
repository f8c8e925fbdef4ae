"""Cross-site boilerplate lines by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; partial sketches merge in the
aggregation. Lines whose estimate is clear of the threshold are decided by it; those near it get an exact
distinct count. Lines on ``min_sites`` sites or more leave every document.

A line is compared without white space at its ends; blank lines never leave. A null site is a site of its
own, a null text has no lines and stays null. Rows that repeat a ``doc_id`` are cleaned each by its own
lines. An empty table gives an empty result. Further columns are
carried, but for any named n_lines or n_removed. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import saved, shielded

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 8
#: log2 of a sketch's registers: 1.04 / sqrt(4096) = 1.6 % standard error, exact while few sites are seen.
SKETCH_BITS = 12
#: Half width of the band around the threshold that is counted exactly: six standard errors and one site.
BAND = 0.1
_BLANK = " \t\n\u000b\f\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANK)))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """line (hash), sites (distinct sites; estimated where far above the threshold), exact (whether counted)."""
    seen = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"),
                       F.explode(_lines("text")).alias("raw"))
    seen = seen.filter(F.length(F.btrim("raw", F.lit(_BLANK))) > 0).select("site", _key(F.col("raw")).alias("line"))
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    spread = seen.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    spread = saved(spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low), "spread")
    near = spread.filter(F.col("sites") <= high).select("line")
    counted = seen.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    counted = counted.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    clear = spread.filter(F.col("sites") > high)
    return clear.withColumn("exact", F.lit(False)).unionByName(counted.withColumn("exact", F.lit(True)))


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus n_lines and n_removed (long)."""
    bad = saved(boilerplate(docs, site, min_sites).select("line"), "boilerplate")
    own, restore = shielded(docs, ("doc_id", "text"))
    held = own.select("doc_id", F.explode(F.array_distinct(F.transform(_lines("text"), _key))).alias("line"))
    found = (held.join(bad, "line", "left_semi").groupBy(F.col("doc_id").alias("_id"))
             .agg(F.collect_set("line").alias("_bad")))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = F.filter(_lines("text"), lambda x: ~F.array_contains("_bad", _key(x)) | (F.length(F.btrim(x, F.lit(_BLANK))) == 0))
    out = joined.withColumn("_kept", F.when(F.col("_bad").isNull(), _lines("text")).otherwise(lines))
    null, n, k = F.col("text").isNull(), F.size(_lines("text")), F.size("_kept")
    out = (out.withColumn("n_lines", F.when(null, 0).otherwise(n).cast("long"))
           .withColumn("n_removed", F.when(null, 0).otherwise(n - k).cast("long"))
           .withColumn("text", F.when(F.col("_bad").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))))
    return restore(out, "n_lines", "n_removed")


#: DuckDB twin of the query: exact distinct counts for every line.
SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce('s' || source, '') AS site, unnest(string_split(text, chr(10))) AS raw FROM documents),
k AS (SELECT doc_id, site, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
d AS (SELECT doc_id, list(DISTINCT line) AS bad FROM k JOIN b USING (line) GROUP BY doc_id),
j AS (SELECT documents.doc_id, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)),
        lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
      FROM documents LEFT JOIN d ON d.doc_id IS NOT DISTINCT FROM documents.doc_id)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_removed FROM j
"""
