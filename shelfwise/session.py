"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "shelfwise", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for this workload.

    AQE re-plans joins and coalesces partitions at run time and splits skewed
    join partitions (one platform can hold a third of all rows).  Timestamps are
    pinned to UTC so results agree with the DuckDB oracle.  The web UI stays off.
    On a cluster, pass nothing: master and sizing come from spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if cpus is not None or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cpus or '*'}]")
    n = shuffle_partitions or int(os.environ.get("SHELFWISE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("SHELFWISE_TZ", "UTC"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# settings for a large cluster (the sizes assume executors of ~8 cores / 32 GB)
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8000",          # upper bound; AQE coalesces to ~256 MB partitions
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_cluster_spark(app: str = "shelfwise") -> SparkSession:
    """Session for a cluster run: master, executors and ``spark.checkpoint.dir``
    (shared storage) come from spark-submit; only SQL settings are set here."""
    builder = SparkSession.builder.appName(app)
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is read from the session and never overridden.  A session without one gets
    a scratch folder only when master is ``local[...]`` (tests); on a cluster a
    machine-local folder would be invisible to the executors, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
