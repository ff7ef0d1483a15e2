"""Session construction and the shared work folder.

Results that cut lineage (materialised fixture tables, streaming checkpoints
and sinks) go under the folder the cluster names in ``spark.checkpoint.dir``.
The library reads that setting from the session; only when it is unset (local
runs and tests) does it create a folder of its own and register it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session defaults for local runs and tests.  On a cluster the same keys are
# set by the job submitter; shuffle partitions are sized so one partition
# stays near 128-256 MB at the target scale.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Remove RDD checkpoint files once their RDD is unreachable.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "escrowlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_dir(spark)
    return spark


def sized_conf(input_bytes: int, target_partition_mb: int = 256,
               min_partitions: int = 8) -> dict[str, str]:
    """Partition sizing for a job that reads about ``input_bytes``.

    Shuffle partitions are chosen so one partition holds about the target
    size (AQE then coalesces small ones and splits skewed ones); scan splits
    use the same target, so a task's input and its shuffle output both fit
    comfortably in executor memory and spill stays the exception.  At 100 TB
    and 256 MB this gives 409,600 partitions.
    """
    target = target_partition_mb * 1024 * 1024
    n = max(min_partitions, -(-input_bytes // target))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
    }


def work_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Where the setting is missing, a local session gets a folder of its own; on
    a cluster that would be a different disk on every machine, so it fails.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path:
            sc.setCheckpointDir(path)
            path = sc.getCheckpointDir() or path
    if not path:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="escrowlens-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the work folder (never reused)."""
    base = work_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
