from itertools import product

from pyspark.sql import functions as F

from promspark import catalog as cat
from promspark.functions import scores


def _ref_index(levels, legacy=False):
    # published UK (Dolan 1997) set, written out independently
    dec = sum(cat.EQ5D_WEIGHTS[d][lv - 2] for d, lv in zip(cat.EQ5D_DIMS, levels) if lv > 1)
    const = cat.EQ5D_CONSTANT if (legacy or any(lv > 1 for lv in levels)) else 0.0
    n3 = cat.EQ5D_N3 if any(lv == 3 for lv in levels) else 0.0
    return round(1.0 - (const + dec + n3), 6)


def test_eq5d_all_243_profiles(spark):
    rows = [tuple(p) for p in product([1, 2, 3], repeat=5)]
    df = spark.createDataFrame(rows, [f"d{i}" for i in range(5)])
    dims = [f"d{i}" for i in range(5)]
    out = df.select(*dims, scores.eq5d_index(dims).alias("idx"),
                    scores.eq5d_index(dims, legacy=True).alias("legacy"),
                    scores.eq5d_index(profile=scores.eq5d_profile(dims)).alias("from_profile")).collect()
    assert len(out) == 243
    for r in out:
        lv = [r[d] for d in dims]
        assert abs(r.idx - _ref_index(lv)) < 1e-9
        assert abs(r.legacy - _ref_index(lv, legacy=True)) < 1e-9
        assert r.from_profile == r.idx
    best = [r for r in out if all(r[d] == 1 for d in dims)][0]
    assert best.idx == 1.0 and abs(best.legacy - 0.919) < 1e-9
    worst = [r for r in out if all(r[d] == 3 for d in dims)][0]
    assert abs(worst.idx - (-0.594)) < 1e-9


def test_eq5d_invalid_is_null(spark):
    df = spark.createDataFrame([(1, 2, 9, 1, 1), (1, None, 1, 1, 1)], [f"d{i}" for i in range(5)])
    dims = [f"d{i}" for i in range(5)]
    assert [r.i for r in df.select(scores.eq5d_index(dims).alias("i")).collect()] == [None, None]
    assert df.select(scores.eq5d_index(profile=F.lit("1123x")).alias("i")).first().i is None


def test_score_null_semantics(spark):
    items = [f"i{k}" for k in range(3)]
    df = spark.createDataFrame([(1, 2, 3, None), (1, None, 3, None), (1, None, 3, 40)],
                               items + ["rec"])
    out = df.select(scores.oxford_score(items).alias("strict"),
                    scores.oxford_score(items, "skip").alias("skip"),
                    scores.backfill_score("rec", items).alias("fill"),
                    scores.backfill_score("rec", items, guard=True).alias("guard")).collect()
    assert [tuple(r) for r in out] == [(6, 6, 6, 6), (None, 4, None, None), (None, 4, 40, None)]


def test_success_and_good_outcome(spark):
    df = spark.createDataFrame([(20, 26), (20, 25), (10, 16), (10, None), (None, 44)], ["pre", "post"])
    out = df.select(scores.success("post", "pre").alias("s"),
                    scores.good_outcome("post", scores.gain("post", "pre")).alias("g")).collect()
    assert [r.s for r in out] == [1, 0, 1, 0, 1]
    assert [r.g for r in out] == [False, False, False, False, True]


def test_prepare_job_keeps_outcomes_and_drops_leakage(prom):
    from promspark.plans.prepare import prepare
    df, audit = prepare(prom)
    assert "oks_t1_score" in df.columns and "oks_success" in df.columns
    assert not any(c.startswith("oks_t1_") and c not in ("oks_t1_score",) for c in df.columns)
    assert df.where(F.col("age_band").isNull() | F.col("gender").isNull()).count() == 0
    assert set(r.gender for r in df.select("gender").distinct().collect()) <= {"Male", "Female", "Not known"}
