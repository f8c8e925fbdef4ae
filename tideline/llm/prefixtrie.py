"""Trie of conversation prefixes from padded turn-id matrices.

Conversations become rows of turn ids (two 64-bit hashes of role and text). Spark range-partitions and sorts the
rows; an Arrow batch of them is a shard. In a shard the rows are a padded matrix, put in order by ``numpy.lexsort``.
A mask of changes between neighbouring rows, OR-accumulated over the columns, marks where the nodes of every depth
start; ``reduceat`` sums a depth's nodes, deepest depth first, so that children add up into their parents.

A node is whole unless its rows reach the first or the last row of the shard. Those boundary nodes, at most two a
depth, are grouped again over all shards; each adds what it owns to its ancestors, whose ids it carries. Equal
conversations may lie in many shards, as the conversation's id is the last sort key.

A matrix is ``CHUNK`` turns wide. Longer conversations go on in a next row, whose group is the prefix before it; the
deepest chunk is done first and its groups' sums are added to the nodes where they begin. Rows whose prefix no other
conversation has hold a plain chain, which takes no turn of its own.

Turns of a conversation ascend by ``turn``, nulls first; equal ones by the ids of role and text. Null role or text
is empty. Rows without ``conv_id`` belong to no conversation and are left out. Repeated rows are turns of their own.
Texts of any length are hashed whole. Other columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm.common import arrow_by_bytes, crc_of_id, mix, odd_constants, saved
from tideline.llm.manifest import CRC
from tideline.llm.ranks import ranked

#: Turns of a matrix row.
CHUNK = 64
#: Turns that a conversation takes at most from the first of its hundred.
BORROWED = 5
_STEP = odd_constants(51, 4)
_NONE = sha256(b"").hexdigest()
_OUT = ("depth int, d1 long, d2 long, p1 long, p2 long, conv long, parent long, edge boolean, n_convs long, n_children long, "
        "n_leaves long, saved long, own_children long, own_leaves long, own_saved long, turn_chars long, ends string, "
        "path array<struct<d1:long,d2:long>>")
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 6, pa.bool_(), *[pa.int64()] * 8, pa.string(),
          pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64())]))]


def turns(conversations: DataFrame) -> DataFrame:
    """conv, rank, a, b (turn id), chars: the original turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(7), text, role).alias("b"), F.char_length(text).cast("long").alias("chars"))
    return ranked(slim, "conv", ["turn", "a", "b"], "turns").select("conv", "rank", "a", "b", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, a, b, chars) of the rebuilt conversations, and (conv, total): their turns, none included."""
    turn = F.struct("rank", "a", "b", "chars")
    first = own.filter((F.col("conv") % 100 == 0) & (F.col("rank") < BORROWED)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(turn)).alias("first"))
    lent = (crc_of_id("conv") % (BORROWED + 1)).cast("int")
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", lent.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    convs = convs.join(first, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<rank:long,a:long,b:long,chars:long>>")), F.lit(1), F.col("h")))
    total = F.size("first") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = saved(convs.select("conv", "h", "first", total.cast("long").alias("total")), "conversations")
    taken = convs.select("conv", F.explode("first").alias("t")).select("conv", F.col("t.rank").alias("pos"), "t.a", "t.b", "t.chars")
    kept = own.join(convs.select("conv", "h", F.size("first").alias("m")), "conv").filter("rank >= h")
    kept = kept.select("conv", (F.col("rank") - F.col("h") + F.col("m")).alias("pos"), "a", "b", "chars")
    return taken.unionByName(kept), convs.select("conv", "total")


def matrix_rows(laid: DataFrame, totals: DataFrame) -> DataFrame:
    """conv, k (chunk), r1, r2 (id of the prefix before it), n1, n2 (and including it), more, ids, chars, lone (no other
    conversation has this prefix), next_lone, head (smallest member of the node before it, null in the first chunk)."""
    root = totals.select("conv", F.lit(-1).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "chars")])
    cells = laid.unionByName(root).withColumn("k", (F.greatest("pos", F.lit(0)) / CHUNK).cast("int"))
    rows = cells.groupBy("conv", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("t"))
    rows = rows.withColumn("t", F.filter("t", lambda t: t["pos"] >= 0)).join(totals, "conv")
    rows = rows.select("conv", "k", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))).alias("ids"),
                       F.transform("t", lambda t: t["chars"]).alias("chars"), (F.col("total") > (F.col("k") + 1) * CHUNK).alias("more"))
    rows = saved(rows, "chunks")
    if rows.filter("k > 0").isEmpty():
        zero = F.lit(0).cast("long")
        return rows.select("*", *[zero.alias(c) for c in ("r1", "r2", "n1", "n2")], F.lit(False).alias("lone"), F.lit(False).alias("next_lone"),
                           F.lit(None).cast("long").alias("head"))
    # sums of chunk hashes identify a prefix; a conversation's chunks, a 64th of its turns, are one window
    before = Window.partitionBy("conv").orderBy("k")
    for name, seed in (("n1", 1), ("n2", 2)):
        rows = rows.withColumn(name, F.sum(F.xxhash64(F.lit(seed), "k", "ids").cast("decimal(20,0)")).over(before))
        rows = rows.withColumn(name, F.xxhash64(F.lit(seed), F.col(name).cast("string"), F.col("k")))
    zero = F.lit(0).cast("long")
    for name, own in (("r1", "n1"), ("r2", "n2")):
        rows = rows.withColumn(name, F.coalesce(F.lag(own).over(before), zero))
    rows = saved(rows, "chunks")
    alone = rows.filter("k > 0").groupBy("k", "r1", "r2").agg((F.count("*") == 1).alias("lone"))
    # the smallest member of the node that a chunk ends with may end there itself
    heads = rows.filter(F.size("ids") == CHUNK).groupBy((F.col("k") + 1).alias("k"), F.col("n1").alias("r1"), F.col("n2").alias("r2")).agg(F.min("conv").alias("head"))
    rows = rows.join(alone, ["k", "r1", "r2"], "left").withColumn("lone", F.coalesce("lone", F.lit(False))).join(heads, ["k", "r1", "r2"], "left")
    return saved(rows.withColumn("next_lone", F.coalesce(F.lead("lone").over(before), F.lit(False))), "chunks")


def _padded(column: pa.Array, lengths: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.to_numpy(zero_copy_only=False)
    return out


def _shard(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All nodes of a shard, as rows of ``_OUT``."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    numbers = lambda name: get(name).to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(get("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, width = batch.num_rows, int(lengths.max(initial=0))
    ids = get("ids").flatten()
    a, b = (_padded(ids.field(k), lengths, width) for k in (0, 1))
    chars = _padded(get("chars").flatten(), lengths, width)
    present = np.arange(width) < lengths[:, None]
    conv, r1, r2 = numbers("conv"), numbers("r1"), numbers("r2")
    columns = [x for d in reversed(range(width)) for x in (b[:, d], a[:, d], present[:, d])]
    order = np.lexsort((conv, *columns, r2, r1))
    a, b, chars, present, lengths, conv, r1, r2 = (x[order] for x in (a, b, chars, present, lengths, conv, r1, r2))
    more = numbers("more").astype(bool)[order]
    extra = [numbers(c)[order] for c in ("x_children", "x_leaves", "x_saved")]
    head = get("head").take(pa.array(order))

    changed = np.ones((rows, width + 1), dtype=bool)  # column d: a node of depth d may start here
    changed[1:, 0] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
    changed[1:, 1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (present[1:] != present[:-1])
    np.logical_or.accumulate(changed, axis=1, out=changed)
    ids_of = {}  # ids of the nodes on the paths of the first and the last row
    for row in {0, rows - 1}:
        x, y = np.array([r1[row]]).view(np.uint64), np.array([r2[row]]).view(np.uint64)
        path = [(int(r1[row]), int(r2[row]))]
        for d in range(lengths[row]):
            one, two = a[row : row + 1, d].view(np.uint64), b[row : row + 1, d].view(np.uint64)
            x, y = mix(x * _STEP[0] + one * _STEP[1] + np.uint64(1)), mix(y * _STEP[2] + two * _STEP[3] + np.uint64(2))
            path.append((int(x.view(np.int64)[0]), int(y.view(np.int64)[0])))
        ids_of[row] = path

    out: list[list] = [[] for _ in _COLUMNS]
    below = None  # (starts, leaves, saved, on the edge) of the nodes one deeper
    depths = []
    for d in reversed(range(width + 1)):
        member = present[:, d - 1] if d else np.ones(rows, dtype=bool)
        starts = np.flatnonzero(changed[:, d] & member)
        if not len(starts):
            continue
        count = np.add.reduceat(member.astype(np.int64), starts)
        least = np.minimum.reduceat(np.where(member, conv, np.iinfo(np.int64).max), starts)
        first_edge, last_edge = starts == 0, np.zeros(len(starts), dtype=bool)
        last_edge[-1] = bool(member[-1])
        edge = first_edge | last_edge
        text = chars[starts, d - 1] if d else np.zeros(len(starts), dtype=np.int64)
        goes_on = member & (lengths == d) & more
        mine = [np.maximum.reduceat(np.where(goes_on, x, 0), starts) for x in extra]
        children, leaves, saved_ = mine[0].copy(), mine[1].copy(), mine[2].copy()
        own = [np.zeros(len(starts), dtype=np.int64) for _ in range(3)]  # of children that are whole
        if below is not None:
            under, sub_leaves, sub_saved, sub_edge = below
            parent = np.searchsorted(starts, under, side="right") - 1
            np.add.at(children, parent, 1)
            np.add.at(leaves, parent, sub_leaves)
            np.add.at(saved_, parent, sub_saved)
            whole = ~sub_edge
            for k, x in enumerate((np.ones(len(under), dtype=np.int64), sub_leaves, sub_saved)):
                np.add.at(own[k], parent[whole], x[whole])
        leaves[children == 0] = 1
        saved_ += (count - 1) * text
        depths.append((d, starts, count, least, edge, text, mine, children, leaves, saved_, own, member))
        below = (starts, leaves, saved_, edge)

    above = None
    for d, starts, count, least, edge, text, mine, children, leaves, saved_, own, member in reversed(depths):
        n = len(starts)
        if above is None:
            parent_conv, parent_edge = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        else:
            parent = np.searchsorted(above[0], starts, side="right") - 1
            parent_conv, parent_edge = above[1][parent], above[2][parent]
        ends = [_NONE] * n
        done = np.flatnonzero(member & (lengths == d) & ~more)  # members that end here, ascending within a node
        if len(done):
            node = np.searchsorted(starts, done, side="right") - 1
            cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            for begin, end in zip(cuts, [*cuts[1:], len(done)], strict=True):
                joined = ",".join(map(str, conv[done[begin:end]].tolist()))
                at = int(node[begin])
                ends[at] = joined if edge[at] else sha256(joined.encode()).hexdigest()
        row_of = lambda i: 0 if starts[i] == 0 else rows - 1
        for i in np.flatnonzero(edge):
            if ends[i] == _NONE:
                ends[i] = None
        paths = [ids_of[row_of(i)][: d + 1] if e else None for i, e in enumerate(edge)]
        named = [p[-1] if p else (None, None) for p in paths]
        up = [(None, None)] * n
        if d:
            for i in np.flatnonzero(parent_edge):  # the parent lies on the path of the first or of the last row
                row = 0 if above[0][parent[i]] == 0 else rows - 1
                up[i] = ids_of[row][d - 1]
        elif n:
            named = [(int(r1[s]), int(r2[s])) for s in starts]
        parents = [int(p) if d and not e else None for p, e in zip(parent_conv, parent_edge, strict=True)]
        if d == 1 and head[0].is_valid:
            parents = head.take(pa.array(starts)).to_pylist()
        parts = (np.full(n, d), [x for x, _ in named], [y for _, y in named], [x for x, _ in up], [y for _, y in up], least,
                 parents, edge, count, children, leaves, saved_,
                 own[0], own[1], own[2], text, ends, [[{"d1": x, "d2": y} for x, y in p] if p else None for p in paths])
        # what begins in the next chunk is the same for all members: it is kept apart in an edge node
        for column, part in zip(out, parts, strict=True):
            column.extend(part if isinstance(part, list) else part.tolist())
        for i in np.flatnonzero(edge):
            at = len(out[0]) - n + i
            out[9][at], out[10][at], out[11][at] = (int(x[i]) for x in mine)
        above = (starts, least, edge)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], _COLUMNS)


def _nodes(rows: DataFrame, name: str) -> DataFrame:
    """d1, d2 (of depth 0 and edge nodes), depth in the chunk, conv, parent, n_convs, n_children, n_leaves, saved, ends_sha256
    of all nodes of matrix rows with x_children, x_leaves, x_saved: what begins where the row goes on."""
    by = [F.col(c) for c in ("r1", "r2", "ids", "conv")]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv", "r1", "r2", "ids", "chars", "more", "head", "x_children", "x_leaves", "x_saved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _shard(batch)

    found = saved(laid.mapInArrow(run, _OUT), f"{name}-shards")
    edges = found.filter("edge").groupBy("d1", "d2", "depth").agg(
        F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.max("turn_chars").alias("turn_chars"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"), F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("own_children", "own_leaves", "own_saved")],
        *[F.max(c).alias(c) for c in ("n_children", "n_leaves", "saved")], F.max("path").alias("path"))
    edges = saved(edges, f"{name}-edges")
    kin = edges.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("kin"))
    edges = edges.join(kin, ["d1", "d2"], "left").withColumn("children", F.col("own_children") + F.col("n_children") + F.coalesce("kin", F.lit(0)))
    adds = edges.select(F.explode("path").alias("up"), (F.col("own_leaves") + F.col("n_leaves") + (F.col("children") == 0).cast("long")).alias("leaves"),
                        (F.col("own_saved") + F.col("saved") + (F.col("n_convs") - 1) * F.col("turn_chars")).alias("all_saved"))
    sums = adds.groupBy("up.d1", "up.d2").agg(F.sum("leaves").alias("leaves"), F.sum("all_saved").alias("all_saved"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash of a node's ends, whose pieces stream by in order: SHA-256 is a chain, but only its state is held."""
        key, state, out = None, None, []
        for batch in batches:
            for x, y, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (x, y), sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield _hashes(out)
                out = []
        if key is not None:
            yield _hashes([(*key, state.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        d1, d2, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha)], ["d1", "d2", "ends_sha256"])

    first = F.substring_index("ends", ",", 1).cast("long").alias("first")
    pieces = found.filter("edge and ends is not null").select("d1", "d2", first, "ends").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    hashes = pieces.select("d1", "d2", "ends").mapInArrow(joined, "d1 long, d2 long, ends_sha256 string")
    up = edges.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("up_conv"))
    bounded = edges.join(sums, ["d1", "d2"]).join(hashes, ["d1", "d2"], "left").join(up, ["p1", "p2"], "left").select(
        "d1", "d2", "depth", "conv", F.coalesce("parent", "up_conv").alias("parent"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("all_saved").alias("saved"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    inner = found.filter("not edge").withColumnRenamed("ends", "ends_sha256")
    hung = inner.filter("p1 is not null").join(up, ["p1", "p2"]).withColumn("parent", F.coalesce("parent", "up_conv"))
    whole = inner.filter("p1 is null").select(*bounded.columns).unionByName(hung.select(*bounded.columns))
    return saved(whole.unionByName(bounded), f"{name}-nodes")


def _extra(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds what begins in the next chunk: a plain chain, or the group's sums."""
    chain = F.col("more") & F.col("next_lone")
    names = ("x_children", "x_leaves", "x_saved")
    if groups is None:
        one = chain.cast("long")
        return rows.select("*", one.alias(names[0]), one.alias(names[1]), F.lit(0).cast("long").alias(names[2]))
    sums = groups.select(F.col("d1").alias("n1"), F.col("d2").alias("n2"), *[F.col(c).alias(f"g_{c}") for c in ("n_children", "n_leaves", "saved")])
    out = rows.join(sums, ["n1", "n2"], "left")
    values = [F.when(chain, F.lit(v)).when(F.col("more"), F.col(f"g_{c}")).otherwise(0).cast("long").alias(x)
              for x, v, c in zip(names, (1, 1, 0), ("n_children", "n_leaves", "saved"), strict=True)]
    return out.select(*rows.columns, *values)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; a row per node."""
    arrow_by_bytes(conversations.sparkSession)
    laid, totals = rebuilt(turns(conversations))
    rows = matrix_rows(laid, totals)
    deepest = rows.filter("not lone").agg(F.max("k")).first()[0] or 0
    lone = rows.filter("lone")
    done = [] if lone.isEmpty() else [_depths(_chains(lone))]
    groups: DataFrame | None = None
    for k in range(deepest, -1, -1):
        mine = rows.filter((F.col("k") == k) & ~F.col("lone"))
        nodes = _nodes(_extra(mine, groups), f"trie{k}").withColumn("k", F.lit(k))
        groups = nodes.filter("depth = 0")
        done.append(_depths(nodes))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _chains(lone: DataFrame) -> DataFrame:
    """Nodes of rows that no other conversation shares: each has one member and at most one child."""
    last = (F.size("ids") == F.col("depth")) & ~F.col("more")
    rows = lone.filter(F.size("ids") > 0).select("conv", "k", "ids", "more", "head", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("depth"))
    one = F.lit(1).cast("long")
    return rows.select("depth", "conv", F.when(F.col("depth") == 1, F.col("head")).otherwise(F.col("conv")).alias("parent"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
                       one.alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
                       F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(_NONE).alias("ends_sha256"), "k")


def _depths(nodes: DataFrame) -> DataFrame:
    """Columns of the result; the first depth of a later chunk is the last one of the chunk before."""
    return nodes.filter("k = 0 or depth > 0").select(
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("k") * CHUNK).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


_CRC = CRC.format("conv_id")
SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'h': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))}} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, {_CRC} % 6 AS h FROM t),
z AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 100),
n AS (SELECT conv_id, len(s) AS total, d, s[1:d] AS p FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM z)),
g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends_sha256,
  (count(*) - 1) * coalesce(any_value(p[d].n), 0) AS own FROM n GROUP BY p, d),
k AS (SELECT c.p[1:c.d - 1] AS p, c.d - 1 AS d, count(*) AS n_children FROM g c WHERE c.d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (p, d)),
u AS (SELECT p[1:j] AS p, j AS d, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (p, d) LEFT JOIN g q ON q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]
"""
