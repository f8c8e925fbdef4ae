"""Stage tables: shared intermediates written once per session and read back by every later query.

A stage cuts lineage with a written table, so it survives lost executors, and it is the same idea as
a run whose stages are named tables. The folder is the shared checkpoint folder the cluster names in
``spark.checkpoint.dir``; without one a session that is not local is refused.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.session import shared_folder

_LOCK = threading.Lock()
_TABLES: dict[tuple, tuple[threading.Lock, dict]] = {}
_ROOTS: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _ROOTS:
            _ROOTS[app] = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        return _ROOTS[app]


def _inputs(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> tuple:
    """Names, sizes and times of the input files: a changed input gives a new stage."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet")
        status = path.getFileSystem(conf).getContentSummary(path)
        info = path.getFileSystem(conf).getFileStatus(path)
        out.append((t, status.getLength(), status.getFileCount(), info.getModificationTime()))
    return tuple(out)


def stage(spark: SparkSession, folder: str, name: str, tables: tuple[str, ...],
          build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Build ``name`` once per application and input state, then read it from Parquet."""
    key = (spark.sparkContext.applicationId, folder, name, _inputs(spark, folder, tables))
    with _LOCK:
        lock, slot = _TABLES.setdefault(key, (threading.Lock(), {}))
    with lock:
        if "path" not in slot:
            path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
            df = build(spark, folder)
            df.write.parquet(path)
            slot["path"], slot["schema"] = path, df.schema
    return spark.read.schema(slot["schema"]).parquet(slot["path"])
