"""Shared folder, tables and small helpers of the llm operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches to Python hold 2,000 rows unless the job has set another size:
    rows here are whole documents, and a batch of the default 10,000 is held on both sides."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, "2000")
    return df


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine without that setting (tests) gets a folder of its own; on a cluster the
    setting is needed.  Folders stay until the job's owner removes them, as results are read lazily."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
        root = tempfile.mkdtemp(prefix="promspark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/promspark-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and
    survives the loss of executors, whichever wrote the files."""
    path = shared_dir(df.sparkSession)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(df[column], F.lit(""))
