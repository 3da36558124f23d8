"""Spark session and shared-folder helpers.

The library never assumes a machine-local folder on a cluster: anything it
writes (lake snapshots, streaming checkpoints) goes under the folder the
cluster names in ``spark.checkpoint.dir``. Only when that setting is absent
(local tests, the local bench) does it create one of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "careflow", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench.

    AQE is on so that the shuffle partition count is an upper bound that gets
    coalesced at runtime, small sides become broadcasts only after their real
    size is known, and skewed join partitions are split.
    """
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # of a repeated JSON key the last value counts, as in the original
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # list many partition folders per listing task rather than one each
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20, shuffle_bytes: int | None = None,
                 max_shuffle_partitions: int = 200_000) -> dict[str, str]:
    """Settings sized to the data for a cluster run (pass as ``extra``).

    Shuffle partitions: the largest expected shuffle (default a quarter of
    the input; these jobs project columns and pre-aggregate before every
    shuffle) split into ~``target_partition_bytes`` pieces, at least three
    waves of tasks, and capped so the map-side block count stays sane. AQE
    coalesces small partitions at runtime and splits skewed ones (over 5x the
    median and over the target), so this is an upper bound. Scan splits use
    the same target, so one task's input fits comfortably in a core's share
    of executor memory.
    """
    slots = executors * cores_per_executor
    shuffle = shuffle_bytes if shuffle_bytes is not None else input_bytes // 4
    parts = min(max_shuffle_partitions, max(3 * slots, -(-shuffle // target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and sinks.

    Read from the session (``spark.checkpoint.dir``). Where it has none, a
    local folder is made for a ``local`` master only; on a cluster every
    executor would write to its own disk, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        root = tempfile.mkdtemp(prefix="careflow-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, "careflow", f"{name}-{uuid.uuid4().hex[:12]}")
