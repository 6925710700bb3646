"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Defaults for every session we build; a cluster launcher may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Starting point for a large cluster (~100 TB inputs, ~1000 executors).  Shuffle
# partitions start high and AQE coalesces them to the advisory size, so a
# 100 TB shuffle lands near 256 MB per task instead of spilling; skewed
# partitions above 5x the median (and 512 MB) are split.  Arrow batches of 8,192
# rows keep the search's per-batch similarity block (queries × rows × 8 bytes)
# small.  Broadcasts Spark picks on its own stay under 64 MB; the operators'
# own broadcasts are separately size-checked.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.python.worker.reuse": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def get_spark(master: str | None = None, app: str = "quire",
              shuffle_partitions: int | None = None,
              conf: dict | None = None, cluster: bool = False) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC time and Arrow transfer on;
    ``cluster=True`` adds :data:`CLUSTER_CONF`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if cluster:
        settings.update(CLUSTER_CONF)
    if (master or "").startswith("local"):
        # local mode: the driver JVM is also the only executor
        settings.setdefault("spark.driver.memory", "8g")
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints, read from ``spark.checkpoint.dir``.

    On a cluster the launcher names a shared folder there.  ``fallback`` is only
    used when the setting is unset (tests, local benches).  Raises when neither
    is available, because a machine-local folder would not survive executor loss.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not fallback:
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder there")
        path = fallback
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint_subdir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A named folder under the shared checkpoint root (stream state, cut tables)."""
    return os.path.join(checkpoint_dir(spark, fallback), name)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests, local
    runs), a folder beside the session's own warehouse tables."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return checkpoint_dir(spark, path)


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into :func:`shared_root` (never ``localCheckpoint``)."""
    shared_root(spark or df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table under :func:`shared_root`."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
