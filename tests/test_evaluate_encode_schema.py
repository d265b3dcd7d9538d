import itertools

import numpy as np
from pyspark.sql import functions as F

from promspark.operators import encode, evaluate, schema


def test_auc_matches_pairwise_definition(spark):
    rng = np.random.default_rng(11)
    s = rng.integers(0, 8, 300)
    y = (s + rng.integers(-3, 4, 300) > 4).astype(int)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "score int, label int")
    got = evaluate.auc(df, "label", "score").first().auc
    pos, neg = s[y == 1], s[y == 0]
    # AUC = P(score_pos > score_neg) + 0.5 P(tie)
    ref = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(got - round(ref, 6)) < 1e-6


def test_curve_points_monotone(spark):
    df = spark.createDataFrame([(i % 7, int(i % 3 == 0)) for i in range(200)], "score int, label int")
    pts = evaluate.curve_points(df, "label", "score").orderBy(F.desc("threshold")).collect()
    tprs = [p.tpr for p in pts]
    assert tprs == sorted(tprs) and pts[-1].tpr == 1.0 and pts[-1].fpr == 1.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "y double, p double")
    r = evaluate.regression_metrics(df, "y", "p").first()
    e = np.array([-1.0, 0.0, -2.0])
    assert abs(r.mae - round(np.abs(e).mean(), 6)) < 1e-9
    assert abs(r.rmse - round(np.sqrt((e ** 2).mean()), 6)) < 1e-9
    assert abs(r.r2 - round(1 - (e ** 2).sum() / ((np.array([1, 2, 3.0]) - 2) ** 2).sum(), 6)) < 1e-9


def test_equal_width_bins_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.5, 5.0, 10.0]], "x double")
    got = [r.b for r in encode.equal_width_bins(df, "x", 4, "b").collect()]
    # edges (-0.01, 2.5], (2.5, 5], (5, 7.5], (7.5, 10]
    assert got == [1, 1, 1, 2, 4]


def test_quantile_bins_drop_duplicate_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 2, 3, 4, 5, 6]], "x double")
    got = [r.q for r in encode.quantile_bins(df, "x", 4, "q").collect()]
    edges = sorted(set(np.quantile([1, 1, 1, 1, 1, 2, 3, 4, 5, 6], [0, .25, .5, .75, 1])))
    ref = [1 + sum(v > e for e in edges[1:-1]) for v in [1, 1, 1, 1, 1, 2, 3, 4, 5, 6]]
    assert got == ref


def test_name_cleaning():
    assert schema.short_name("Knee Replacement Pre-Op Q Night Pain") == "oks_t0_night_pain"
    assert schema.short_name("Pre-Op Q Self-Care") == "t0_self_care"
    assert schema.short_name("Post-Op Q EQ VAS") == "t1_eq_vas"
    assert schema.clean_name("  3rd Quartile ") == "rd_quartile"
    assert schema.prefix_rename("Hip Replacement Pre-Op Q Pain") == "t0_HR_Pain"


def test_align_to_reference(spark):
    train = spark.createDataFrame([(1, 2.0, "a")], "id int, x double, g string")
    test = spark.createDataFrame([("b", 3)], "g string, id int")
    out = schema.align_to(test, train)
    assert out.columns == ["id", "x", "g"] and out.dtypes[1] == ("x", "double")
    assert tuple(out.first()) == (3, None, "b")
