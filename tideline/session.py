"""Session settings shared by tests, bench and callers."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()
_LOCAL: dict[str, str] = {}


def build_session(app: str = "tideline", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", split_bytes: str = "4m") -> SparkSession:
    """A local session for tests and bench; on a cluster pass the session you already have."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", split_bytes)
        .config("spark.sql.files.openCostInBytes", "0")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``. Only a session whose
    executors are threads of the driver may do without: it gets a new local folder, once per application."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master or "").startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    with _LOCK:
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        return _LOCAL[sc.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point reliable checkpoints at the shared folder."""
    folder = shared_folder(spark)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
