"""Session helpers for tests, bench and the driver entry point.

Library code never builds a session; it receives one.  The only settings
made here are the ones a job owner would put in ``spark-defaults.conf``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "promspark",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Small dimension tables (code maps, per-value rank tables, model
        # summaries) are broadcast by size; anything above 32 MB is joined
        # by shuffle.  The estimate is Catalyst's, checked at plan time.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.driver.memory": os.environ.get("PROMSPARK_DRIVER_MEMORY", "16g"),
        # A PROM row has ~60 columns; whole-stage codegen of the cleaning /
        # scoring projection produces methods of ~30 KB, above the JIT's
        # 8 KB limit, so they would run interpreted (about 2x slower).
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        # checkpoint files (MICE rounds, rank/count tables) are removed once
        # nothing references them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings for a cluster run sized to the input.

    Shuffle partitions target ~256 MB each after the map side (AQE then
    coalesces small ones and splits skewed ones); scan splits are 512 MB so
    a 100 TB scan is ~200k tasks, a few waves on 1000 executors."""
    mb = 1024 * 1024
    parts = max(total_cores * 3, input_bytes // (256 * mb))
    return {
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.files.maxPartitionBytes": str(512 * mb),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(32 * mb),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    On a cluster the folder must be shared storage; it is read from the
    session.  Only when nothing is configured, ``allow_local`` is set and the
    master is local (one machine: tests, bench) is a scratch folder created
    and registered; on a cluster that raises an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not allow_local or not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    path = tempfile.mkdtemp(prefix="promspark-ckpt-")
    sc.setCheckpointDir(path)
    return path


def written_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder, read again:
    cuts the lineage, and every executor can read it when another is lost."""
    path = f"{checkpoint_dir(df.sparkSession, allow_local=True).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession) -> int:
    """Tasks that the executors run at once."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, int(sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())))
