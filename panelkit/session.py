"""Session helpers: building a local session for tests/bench and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the bench: local[cpus], AQE on, UI off.

    On a cluster, callers build their own session; nothing in the library
    depends on local mode.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelkit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", driver_memory)
    )
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the session (``spark.checkpoint.dir``).

    Only a local session without that setting (tests, the bench) gets a
    scratch folder; on a cluster the folder must come from the session,
    because driver and executors share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="panelkit-ckpt-", dir=os.environ.get("PANELKIT_SCRATCH"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteratively reused table: a reliable checkpoint
    in the session's shared folder, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
