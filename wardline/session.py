"""Spark session helpers.

Library code never creates its own session: every operator takes DataFrames
and returns DataFrames.  ``get_spark`` is for tests, ``bench.py`` and local
runs; on a cluster the caller's session (and its ``spark.checkpoint.dir``)
is used unchanged.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every run relies on: UTC day boundaries (a business day is
# ``to_date(created_at)``), adaptive execution for partition coalescing and
# skew splitting, and no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Spark broadcasts a side only below this measured size.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # keyed streams (transformWithState) need it
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "wardline") -> SparkSession:
    """Local session for tests and benchmarks."""
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("WARDLINE_MASTER", "local[8]"))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("WARDLINE_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  A scratch folder is created only for a ``local[...]`` master
    (tests) that names none; any other master without the setting is an
    error, because its executors could not see a folder of the driver.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not is_local_master(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               f"executors share (master {sc.master})")
        current = tempfile.mkdtemp(prefix="wardline-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def is_local_master(master: str) -> bool:
    """One JVM that is driver and executor at once; ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")
