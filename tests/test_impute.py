from pyspark.sql import functions as F

from promspark.operators import clean
from promspark.operators import impute as I
from promspark.operators import split as SP


def test_median_mode_fill_leaves_no_nulls_and_keeps_values(prom):
    df = SP.random_split(clean.apply_roles(prom), "record_id", 80)
    train = df.where(F.col("split") == "train")
    med = I.fit_median(train, ["t0_eq_vas"])
    mode = I.fit_mode(train, ["t0_symptom_period"])
    out = I.apply_fill(I.apply_fill(df, med), mode)
    assert out.where(F.col("t0_eq_vas").isNull() | F.col("t0_symptom_period").isNull()).count() == 0
    j = df.alias("a").join(out.alias("b"), "record_id").where(F.col("a.t0_eq_vas").isNotNull())
    assert j.where(F.col("a.t0_eq_vas") != F.col("b.t0_eq_vas")).count() == 0


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "v int")
    assert I.fit_mode(df, ["v"]) == {"v": 1}


def test_chained_imputer(prom):
    cols = ["t0_eq_vas", "t1_eq_vas", "oks_t0_score", "oks_t1_score"]
    df = clean.apply_roles(prom).select("record_id", *cols)
    imp = I.ChainedImputer(cols, rounds=2).fit(df)
    out = imp.transform(df)
    assert out.where(" OR ".join(f"{c} IS NULL" for c in cols)).count() == 0
    j = df.alias("a").join(out.alias("b"), "record_id")
    for c in cols:
        assert j.where(F.col(f"a.{c}").isNotNull() & (F.col(f"a.{c}") != F.col(f"b.{c}"))).count() == 0
    assert len(imp.steps) == 2 * sum(1 for c in cols if df.where(F.col(c).isNull()).count() > 0)


def test_replace_sentinel_stage(spark):
    df = spark.createDataFrame([(9.0, 1.0), (2.0, 7.0)], "a double, b double")
    out = I.ReplaceSentinel(inputCols=["a", "b"], sentinel=7.0).transform(df).collect()
    assert [tuple(r) for r in out] == [(9.0, 1.0), (2.0, None)]
