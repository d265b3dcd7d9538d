import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from promspark.operators import model as M
from promspark.operators import split as SP
from promspark.operators import trees as T


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        a, b, c = float(rng.integers(0, 101)), float(rng.integers(0, 5)), float(rng.standard_normal())
        g = [None, "u", "v", "w"][rng.integers(0, 4)]
        y = a / 10 + b * (2 if g == "u" else -1) + c + float(rng.standard_normal())
        rows.append((k, a, b, c, 7.0, g, y, float(y > 4), "test" if k % 6 == 0 else "train"))
    return spark.createDataFrame(rows, "record_id int, a double, b double, c double, flat double, g string, y double, label double, split string").cache()


NUMERIC, CATEGORICAL = ["a", "b", "c", "flat"], ["g"]


def test_regression_folds_are_those_of_spark_ml(frame):
    got = T.grow(frame, "y", NUMERIC, CATEGORICAL, 5)
    want = M.cross_validate(frame.where("split = 'train'"), M.regressors()["tree"], NUMERIC, CATEGORICAL, "y").collect()
    mine = [T.regression_scores(got, i) for i in range(6)]
    for w in want:
        assert mine[w["fold"]] == pytest.approx((w["n"], w["mae"], w["rmse"], w["r2"]), abs=1e-6)
    assert mine[5][0] == 150
    # every training set in one reading a level: the trees are there together
    assert [t.held for t in got.trees] == [*((0, f) for f in range(5)), T.TEST]


@pytest.mark.parametrize("depth,weight", [(2, 0.0), (4, 0.05), (6, 0.0)])
def test_smaller_trees_are_the_top_of_deeper_ones(frame, depth, weight):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import vector_to_array
    got = T.grow(frame, "label", NUMERIC, CATEGORICAL, 6, [0.0, 0.05], gini=True)
    folds = SP.folds(frame.where("split = 'train'"), 5, "record_id")
    model = M.fit_pipeline(folds.where("fold <> 2"), DecisionTreeClassifier(maxDepth=depth, minWeightFractionPerNode=weight), NUMERIC, CATEGORICAL, "label")
    want = BinaryClassificationEvaluator().evaluate(model.transform(folds.where("fold = 2")))
    i = got.of((0, 2), weight)
    tree, (n, s, _, _) = got.trees[i], got.scores[i]
    end = tree.ends(depth, prune=True)
    assert T.auc([tree.s[e] for e in end], s, n - s) == pytest.approx(want, abs=1e-9)
    model = M.fit_pipeline(frame.where("split = 'train'"), DecisionTreeClassifier(maxDepth=depth, minWeightFractionPerNode=weight), NUMERIC, CATEGORICAL, "label")
    want = model.transform(frame.where("split = 'test'")).select("label", F.round(F.get(vector_to_array("probability"), 1), 9)).collect()
    i = got.of(T.TEST, weight)
    tree = got.trees[i]
    mine = got.test_scores(i, [tree.s[e] / tree.n[e] for e in tree.ends(depth, prune=True)]).collect()
    assert np.allclose(sorted((r[0], round(r[1], 9)) for r in mine), sorted(map(tuple, want)))


def test_edges(spark, frame):
    one = frame.withColumn("y", F.lit(3.0))
    got = T.grow(one, "y", ["flat"], [], 3)
    assert all(t.child == [0] for t in got.trees) and T.regression_scores(got, 5) == (150, 0.0, 0.0, None)
    got = T.grow(frame.where("split = 'test'"), "y", ["a"], [], 3, cv=False)
    assert got.trees[0].child == [0] and got.trees[0].n == [0.0]
    wide = spark.range(20_000).selectExpr("CAST(id AS int) AS record_id", "CAST(id AS double) AS x", "IF(id < 8000, 0D, 5D) AS y", "'train' AS split")
    tree = T.grow(wide, "y", ["x"], [], 1, cv=False).trees[0]  # more values than are counted one by one
    assert len(tree.child) == 3 and tree.n[0] == 20_000 and abs(tree.n[1] - 8000) < 700
