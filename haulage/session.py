"""Session construction and shared-storage helpers.

The library never changes the configuration of a session it is given; only
``build_session`` (used by tests and the bench) sets options. Scratch data
(snapshots, stream sources, stream checkpoints) lives under the folder the
cluster names in ``spark.checkpoint.dir``, which must be shared storage on a
real cluster.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "haulage", shared: str | None = None) -> SparkSession:
    """A session for local runs (tests, bench); ``shared`` is its scratch
    folder, unless the session has one. On a cluster, use the cluster's own
    session and its configuration instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("HAULAGE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if shared and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (``spark.checkpoint.dir``
    or the context's). The library sets none of its own: a machine-local
    folder would not survive the loss of an executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a folder that driver and executors share "
                           "(HDFS, S3, ...) before running snapshot, id or stream operators")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Scratch folders written by this process and not released yet.
_scratch: set[str] = set()


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders that this process has written. Call it when
    the results that read them have been published."""
    while _scratch:
        remove(_scratch.pop())


def _inside(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = _inside(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def remove(path: str) -> None:
    """Delete a folder, if it is there."""
    if exists(path):
        system, inner = _inside(path)
        system.delete_dir(inner)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/haulage-{purpose}-{uuid.uuid4().hex[:12]}"
    _scratch.add(path)
    return path


def materialize(df, purpose: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: lineage is cut (a lost executor re-reads files instead of
    recomputing), and later uses scan columnar files. The files stay until
    ``release_scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
