"""Ranks within a key over a range-partitioned sort: no window, so a key with a third of all rows spreads over tasks.

Every task counts its own sorted rows as they stream by. The driver sees two rows a task (first and last key
with their counts) and tells each task how many rows of its first key lie in earlier tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tideline.llm.common import saved

_OWN = (("_part", IntegerType()), ("_run", LongType()), ("_local", LongType()))
_HEAD, _TAIL = -1, -2


def _starts(column: pa.Array, last) -> np.ndarray:
    """Where a row's key differs from the row before it; nulls equal each other."""
    if not len(column):
        return np.zeros(0, dtype=bool)
    first = last is None or not (column[0].as_py() == last[0])
    a, b = column[1:], column[:-1]
    same = pc.fill_null(pc.equal(a, b), False)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.concatenate([[first], ~pc.or_(same, both).to_numpy(zero_copy_only=False)])


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (long, from 0) of each row among those of its key, by ``order`` ascending, nulls first.
    Rows that are equal in ``order`` take any of their ranks. Written to the shared folder."""
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_tie")]
    laid = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head = tail = last = None
        run_no, count, head_count = -1, 0, 0

        def out(batch: pa.RecordBatch, runs, local) -> pa.RecordBatch:
            n = batch.num_rows
            own = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(runs, pa.int64()), pa.array(local, pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *(c for c, _ in _OWN)])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(at)
            new = _starts(column, last)
            runs = run_no + np.cumsum(new)
            at_row = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at_row, -1))
            local = np.where(begin < 0, at_row + count, at_row - begin)
            yield out(batch, runs, local)
            head = batch.slice(0, 1) if head is None else head
            head_count += int((runs == 0).sum())
            tail, last = batch.slice(n - 1, 1), (column[n - 1].as_py(),)
            run_no, count = int(runs[-1]), int(local[-1]) + 1
        if head is not None:
            yield out(head, [_HEAD], [head_count])
            yield out(tail, [_TAIL], [count])

    schema = StructType(df.schema.fields + [StructField(c, t) for c, t in _OWN])
    kept = saved(laid.mapInArrow(run, schema), name)
    marks: dict[int, dict] = {}
    for r in kept.filter("_run < 0").select("_part", "_run", "_local", F.col(key).alias("k")).collect():  # two a task
        marks.setdefault(r._part, {})[r._run] = (r.k, r._local)
    offsets, carry = [], None
    for part in sorted(marks):
        (first, heads), (final, tails) = marks[part][_HEAD], marks[part][_TAIL]
        before = carry[1] if carry is not None and carry[0] == first else 0
        offsets.append((part, before))
        carry = (final, tails + before if first == final else tails)
    known = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    out = kept.filter("_run >= 0").join(F.broadcast(known), "_part")  # a row a task
    rank = F.col("_local") + F.when(F.col("_run") == 0, F.col("_before")).otherwise(0)
    return out.select(*df.columns, rank.alias("rank"))
