import math
import random

import pytest
from pyspark.sql import functions as F

from promspark.operators import impute as I
from promspark.operators.asof import as_of


def brute(keys, donors, direction):
    out = {}
    for k in {k for k in keys if k is not None}:
        able = [(abs(k - d), d, v) for d, v in donors if d is not None and v is not None
                and (direction == "nearest" or (d <= k if direction == "backward" else d >= k))]
        out[k] = min(able)[1:] if able else (None, None)
    return out


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_against_brute_force(spark, direction, ranges):
    rng = random.Random(3)
    keys = [rng.choice([None, rng.randint(-50, 50) / 2, rng.gauss(0, 100)]) for _ in range(600)]
    donors = [(d, rng.choice(["x", "y", None])) for d in {rng.choice([rng.randint(-30, 30) / 2, rng.uniform(-40, 40)]) for _ in range(60)}]
    donors += [(None, "z"), (1e6, "far"), (-1e6, "far")][:1 if direction == "nearest" else 3]  # ranges without a donor at both ends
    got = as_of(spark.createDataFrame([(k, "extra") for k in keys], "k double, v string"), spark.createDataFrame(donors, "k double, v string"), "k", "v", direction, ranges).collect()
    assert {r.k: (r.donor_key, r.v) for r in got} == brute(keys, donors, direction) and len(got) == len(set(keys) - {None})


def test_edges(spark):
    keys = spark.createDataFrame([(1.0,), (1.0,), (None,)], "k double")
    donors = spark.createDataFrame([(0.0, "a"), (2.0, "b"), (2.0, "a"), (5.0, None)], "k double, v string")
    assert [tuple(r) for r in as_of(keys, donors, "k", "v").collect()] == [(1.0, 0.0, "a")]
    assert [tuple(r) for r in as_of(keys, donors, "k", "v", "forward").collect()] == [(1.0, 2.0, "a")]
    assert [tuple(r) for r in as_of(keys, donors.limit(0), "k", "v").collect()] == [(1.0, None, None)]
    assert as_of(keys.limit(0), donors, "k", "v").collect() == []
    top = as_of(keys.union(spark.createDataFrame([(math.nan,)], "k double")), donors, "k", "v", "backward").collect()
    assert {(str(r.k), r.v) for r in top} == {("1.0", "a"), ("nan", "a")}
    with pytest.raises(ValueError):
        as_of(keys, donors, "k", "v", "sideways")


def test_donor_fill(spark):
    train = spark.createDataFrame([(0, "a"), (0, "b"), (4, "c"), (4, "c"), (4, "a"), (9, None), (None, "z")], "gain int, band string")
    rows = [(1, 2, None), (2, 2, "own"), (3, 3, None), (4, 9, None), (5, None, None), (6, -7, None), (6, -7, None)]
    df = spark.createDataFrame(rows, "id int, gain int, band string").withColumn("__donor_note", F.lit(1))
    got = I.donor_fill(train, df, "band", "gain")
    assert got.columns == df.columns
    assert {(r.id, r.band) for r in got.collect()} == {(1, "a"), (2, "own"), (3, "c"), (4, "c"), (5, None), (6, "a")}
    assert got.count() == len(rows)
    assert {r.band for r in I.donor_fill(train.limit(0), df, "band", "gain").collect()} == {"own", None}


def test_a_range_is_all_that_a_window_holds(spark):
    keys = spark.range(20_000).select((F.col("id") * 1.5).alias("k"))
    donors = spark.range(0, 20_000, 7).select((F.col("id") * 1.5 + 0.25).alias("k"), F.col("id").alias("v"))
    plan = as_of(keys, donors, "k", "v", ranges=50)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    alone = [line for line in windows if "__d" not in line]  # over a row per range
    assert len(windows) == 4 and len(alone) == 2 and all("__part" in line.split("windowspec")[-1] for line in windows)
