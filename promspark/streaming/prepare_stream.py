"""Structured Streaming form of the preparation job.

The reference has no streaming; its row-wise operators (role-scoped
sentinels, recodes, score back-fill, EQ-5D index, outcomes) are stateless
Column functions, so the same plan runs on a file stream that lands new
extracts: ``readStream`` -> roles + scores -> ``writeStream`` (parquet,
exactly-once through the checkpoint).  No state store is involved.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import catalog as cat
from ..operators import clean
from ..plans.prepare import derive_scores


def prepare_stream(stream: DataFrame, catalog: cat.Catalog | None = None) -> DataFrame:
    """Stateless preparation of a streaming (or batch) PROM frame."""
    df = clean.apply_roles(stream, catalog)
    df = clean.delete_listwise(df, cat.oks_items("t0"))
    return derive_scores(df)


def run_prepare_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                       checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Process every file in ``source_dir`` (new ones on later runs) into
    ``sink_dir``.  ``checkpoint`` must be on shared storage; restarting the
    query after a failure resumes from it without duplicating output."""
    src = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", 64).load(source_dir)
    q = (prepare_stream(src).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def stream_roundtrip_paths(base: str) -> tuple[str, str, str]:
    return os.path.join(base, "landing"), os.path.join(base, "prepared"), os.path.join(base, "_checkpoint")
