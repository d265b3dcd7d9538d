import random
import time

from pyspark.sql import functions as F

from promspark.operators.running import running_sums


def test_against_plain_sums_with_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, -1.5, 2.0]) if k % 50 == 0 else float(k), k % 7 - 3) for k in range(2000)]
    rng.shuffle(rows)
    rows = list({(g, v): (g, v, w) for g, v, w in rows}.values())
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(7)
    for ranges in (None, 1, 40):
        got = {(r.g, r.v): (r.before, r.n) for r in running_sums(df.withColumn("one", F.lit(1)), ["v"], {"w": "before", "one": "n"}, ["g"], ranges).collect()}
        assert len(got) == len(rows)
        for g in ("hot", "a", "b", None):
            total = n = 0
            for _, v, w in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0)):
                assert got[g, v] == (total, n)
                total, n = total + w, n + 1


def test_empty_and_types(spark):
    df = spark.createDataFrame([], "v int, w int")
    assert running_sums(df, ["v"], {"w": "b"}).columns == ["v", "w", "b"]
    assert running_sums(df, ["v"], {"w": "b"}).count() == 0


def test_bounds_are_in_no_expression_and_time_is_flat(spark):
    df = spark.range(50_000).select((F.col("id") * 7 % 50_000).alias("v"), F.lit(1).alias("w"))
    was, took = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (16, 16, 2000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            began = time.perf_counter()
            out = running_sums(df, ["v"], {"w": "before"})
            assert out.where("before <> v").count() == 0
            took.append(time.perf_counter() - began)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert took[2] < 10 * took[1] + 10
