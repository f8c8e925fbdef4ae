"""Merkle manifest of a dataset, by nested-struct rollup.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of one ``lang`` ascend by
``doc_id`` and are ranked. A block is 8^4 consecutive leaves; inside it the octal digits of the rank are grouped
away one after the other, so that each node carries its children as an array of structs and one shuffle serves
all four levels. The nodes that head the blocks are ranked leaves of the next round, until a ``lang`` has one
block. The subroots, ordered by ``lang``, form a last tree of the same kind.

The way back meets no join: a block and the path above it are two rows of one group, and its nested structs are
exploded level by level, each child taking along what stands before and after it in its run. A row then holds all
siblings on its path: one hash of them is its proof, folding them around a leaf gives a root.

Null fields count as ``-``. Rows with null ``doc_id`` come first. Rows that repeat a ``doc_id`` are ordered by their
leaf; equal rows are leaves of their own, at any of their places. A null ``lang`` is a group of its own, before all
others. Texts of any length, empty ones too, are hashed whole. An empty table gives an empty manifest. Further
columns have no part in a leaf and are not returned. A null ``doc_id`` is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import saved
from tideline.llm.ranks import ranked

FANOUT = 8
LEVELS = 4
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(text: Column | str = "text") -> Column:
    """Digest (binary) of a row whose text is the given column."""
    parts = []
    for name in FIELDS:
        value = (F.col(text) if isinstance(text, str) else text) if name == "text" else F.col(name)
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _head(kids: Column) -> Column:
    """Digest of a run of children, in order."""
    return F.unhex(F.sha2(F.array_join(F.transform(kids, lambda k: _hex(k["h"])), ""), 256))


def _many(level: int) -> Column:
    """Whether the tree of ``n`` leaves has more than one node on a level."""
    return F.col("n") > FANOUT**level


def _around(kid: Column, i: Column) -> Column:
    """A child with the digests before and after it in its run."""
    digests = F.transform("kids", lambda k: _hex(k["h"]))
    return F.struct(kid.alias("own"), F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"),
                    F.array_join(F.slice(digests, i + 2, F.lit(FANOUT)), "").alias("after"))


def _rolled(leaves: DataFrame, name: str) -> DataFrame:
    """(key, n, block, h, kids): the blocks of leaves (key, n, rank, h and payload columns), children nested."""
    rows = leaves.withColumn("block", F.shiftright("rank", 3 * LEVELS)).repartition("key", "block")
    payload = [c for c in leaves.columns if c not in ("key", "n", "rank")]
    for level in range(LEVELS):
        digit = (F.col("rank") % FANOUT).cast("int").alias("d")
        kids = F.sort_array(F.collect_list(F.struct(digit, *payload)))
        rows = rows.groupBy("key", "n", "block", F.shiftright("rank", 3).alias("rank")).agg(kids.alias("kids"))
        alone = F.col("kids")[0]["h"]  # the only node left is the head itself
        rows = rows.withColumn("h", F.when(_many(level), _head(F.col("kids"))).otherwise(alone))
        payload = ["h", "kids"]
    return saved(rows.select("key", "n", "block", "h", "kids"), name)


def _unrolled(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(key, n, rank, payload of the leaf, path): the leaves of blocks (as ``_rolled`` gives them) under the paths
    (key, block, path) above their blocks."""
    named = blocks.select("key", "n", "block", "kids").unionByName(above.select("key", "block", "path"), allowMissingColumns=True)
    rows = named.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path")])
    rows = rows.withColumn("rank", F.col("block"))
    for level in reversed(range(LEVELS)):
        rows = rows.select("key", "n", "rank", "path", F.explode(F.transform("kids", _around)).alias("kid"))
        step = F.array(F.struct(F.col("kid.before").alias("before"), F.col("kid.after").alias("after")))
        path = F.when(_many(level), F.concat(step, F.col("path"))).otherwise(F.col("path"))
        rank = F.col("rank") * FANOUT + F.col("kid.own.d")
        own = F.col("kid.own.kids").alias("kids") if level else F.col("kid.own")
        rows = rows.select("key", "n", rank.alias("rank"), path.alias("path"), own)
    return rows


def _grown(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks from the leaves up, and (key, h) of the heads."""
    rounds, heads, most = [], [], leaves.agg(F.max("n")).first()[0]
    while True:
        blocks = _rolled(leaves, f"{name}-blocks")
        rounds.append(blocks)
        done = F.col("n") <= BLOCK
        heads.append(blocks.filter(done).select("key", "h"))
        if most is None or most <= BLOCK:
            break
        most = -(-most // BLOCK)
        leaves = blocks.filter(~done).select("key", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "h")
    out = heads[0]
    for more in heads[1:]:
        out = out.unionByName(more)
    return rounds, saved(out, f"{name}-heads")


def _shown(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of the first round under paths (key, path) above the heads."""
    tops = tops.select("key", F.lit(0).cast("long").alias("block"), "path")
    down = None
    for blocks in reversed(rounds):
        mine = tops.join(blocks.filter(F.col("n") <= BLOCK).select("key"), "key", "left_semi") if len(rounds) > 1 else tops
        down = mine if down is None else mine.unionByName(down.select("key", F.col("rank").alias("block"), "path"))
        down = _unrolled(blocks, down)
    return down


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path (array of before, after from the leaf up), tampered (the leaf again, from
    the tampered text where 3 divides the crc of the id)."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    slim = docs.select("doc_id", "lang", leaf().alias("h"), F.when(touched, leaf(text)).alias("t"))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("key")  # null first
    placed = ranked(slim.select("doc_id", key, "h", F.coalesce("t", "h").alias("t")), "key", ["doc_id", "h", "t"], "leaves")
    counts = saved(placed.groupBy("key").agg(F.count("*").alias("n")), "langs")
    rounds, heads = _grown(placed.join(counts, "key").select("key", "n", "rank", "h", "t", "doc_id"), "rows")

    one = F.lit("").alias("key")
    langs = ranked(heads.select(one, F.col("key").alias("lang_key"), "h"), "key", ["lang_key"], "subroots")
    n_langs = heads.count()
    lang_rounds, top = _grown(langs.withColumn("n", F.lit(n_langs).cast("long")), "langs")
    empty = F.array().cast("array<struct<before:string,after:string>>")
    shown = _shown(lang_rounds, top.select("key", empty.alias("path")))
    root = top.first()
    root = bytes(root.h).hex() if root is not None else None
    subroots = saved(shown.select(F.col("own.lang_key").alias("key"), F.col("own.h").alias("h"), "path"), "paths")
    # the subroot rides on the path as its last entry and is taken off again at the leaf
    tag = F.array(F.struct(_hex(F.col("h")).alias("before"), F.lit(None).cast("string").alias("after")))
    leaves = _shown(rounds, subroots.select("key", F.concat("path", tag).alias("path")))
    steps = F.slice("path", 1, F.size("path") - 1)
    lang = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1))
    return leaves.select(
        F.col("own.doc_id").alias("doc_id"), lang.alias("lang"), _hex(F.col("own.h")).alias("leaf"), F.element_at("path", -1)["before"].alias("subroot"),
        F.lit(root).cast("string").alias("root"), steps.alias("path"), _hex(F.col("own.t")).alias("tampered"))


def proof_of(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf_hex: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_hex, lambda own, p: F.sha2(F.concat(p["before"], own, p["after"]), 256))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = manifest(docs).select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"),
                                 folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 (unsigned) of a number's decimal digits.
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS pre FROM documents),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS key, sha256(pre || coalesce(strlen(text) || ':' || text, '-')) AS h,
  sha256(pre || coalesce(strlen(text) || ':' || CASE WHEN {CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS t FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h, t) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l),
t(key, lvl, pos, n, h) AS (SELECT key, 0, pos, n, h FROM b UNION ALL
  SELECT key, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY key, lvl, pos // 8, n),
s AS (SELECT key, lvl, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (SELECT 0, pos, n, h FROM s UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
leafs AS (SELECT b.*, s.lvl AS depth, s.h AS subroot, s.pos AS lang_pos FROM b JOIN s USING (key)),
g AS (  -- siblings on every level, of rows and of languages
  SELECT x.key, x.pos, x.lvl, string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.at) AS before, string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.at) AS after
  FROM (SELECT key, pos, lvl, pos // CAST(power(8, lvl) AS BIGINT) AS at FROM leafs, range(0, 12) r(lvl) WHERE lvl < depth) x
  JOIN t y ON y.key = x.key AND y.lvl = x.lvl AND y.pos // 8 = x.at // 8 GROUP BY 1, 2, 3, x.at
  UNION ALL
  SELECT x.key, x.pos, x.depth + x.lvl, string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.at), string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.at)
  FROM (SELECT key, pos, depth, lvl, lang_pos // CAST(power(8, lvl) AS BIGINT) AS at FROM leafs, (SELECT DISTINCT lvl FROM u WHERE n > 1)) x
  JOIN u y ON y.lvl = x.lvl AND y.pos // 8 = x.at // 8 GROUP BY 1, 2, 3, x.at),
p AS (SELECT key, pos, sha256(coalesce(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY lvl), '')) AS proof, max(lvl) AS top FROM g GROUP BY 1, 2),
w(key, pos, lvl, h) AS (SELECT key, pos, 0, t FROM b UNION ALL
  SELECT w.key, w.pos, w.lvl + 1, sha256(coalesce(g.before, '') || w.h || coalesce(g.after, '')) FROM w JOIN g ON g.key = w.key AND g.pos = w.pos AND g.lvl = w.lvl)
SELECT doc_id, leafs.h AS leaf, subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, w.h AS folded_root, w.h = root.h AS verified
FROM leafs LEFT JOIN p USING (key, pos) JOIN w ON w.key = leafs.key AND w.pos = leafs.pos AND w.lvl = coalesce(p.top + 1, 0),
  (SELECT h FROM u WHERE n = 1) root
""".replace("{CRC}", CRC.format("doc_id"))
