import os

from pyspark.sql import functions as F

from promspark.fixture import load_prom
from promspark.sources.files import work_dir, write_parquet
from promspark.streaming.prepare_stream import prepare_stream, run_prepare_stream, stream_roundtrip_paths


def test_stream_equals_batch(spark):
    base = work_dir(spark, "stream-test")
    landing, sink, ckpt = stream_roundtrip_paths(base)
    prom = load_prom(spark, "/root/testdata/sf0.001")
    write_parquet(prom, landing, "snappy")
    q = run_prepare_stream(spark, landing, prom.schema, sink, ckpt)
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = prepare_stream(spark.read.parquet(landing))
    cols = ["record_id", "oks_t0_score", "oks_t1_score", "t0_eq5d_index", "oks_success"]
    a, b = streamed.select(cols), batch.select(cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0
    # a restart with no new files adds nothing (exactly-once through the checkpoint)
    q2 = run_prepare_stream(spark, landing, prom.schema, sink, ckpt)
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == a.count()
