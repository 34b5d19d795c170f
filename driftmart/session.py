"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Planning options this package benefits from; applied only where a session has
# not set them itself.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    # The mart is hash-distributed by entity. This lets the (period, entity) event
    # join use that distribution instead of shuffling the wide mart once more.
    # Rows per entity are bounded by months x modes at that point, so the coarser
    # key cannot create a hot task.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # HotSpot does not compile methods above 8000 bytes of bytecode. The widest column
    # blocks exceed that when fused into one method and would run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# For sessions built here. Shuffle partitions start high and adaptive execution
# merges them to the advisory size, so one setting serves small and huge inputs.
CLUSTER = {
    **PLANNING,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(
    app_name: str = "driftmart", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the planning options a session leaves unset."""
    for key, value in PLANNING.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Executors can be lost, so intermediate tables go to storage all nodes share.
    A session whose only executor is the driver itself (``local[..]``, as in tests) may
    go without that setting; any other master has to name the folder. The session's
    own checkpoint folder is left as it is.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = f"file://{tempfile.gettempdir()}/driftmart-{context.applicationId}"
    return f"{root.rstrip('/')}/driftmart-{purpose}-{uuid.uuid4().hex}"
