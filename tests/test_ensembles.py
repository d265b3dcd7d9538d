import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from promspark.operators import ensembles as EN
from promspark.operators import evaluate as E
from promspark.operators import model as M

NUMERIC, CATEGORICAL = ["a", "b", "c", "flat"], ["g"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(1500):
        a, b, c = float(rng.integers(0, 101)), float(rng.integers(0, 5)), float(rng.standard_normal())
        g = [None, "u", "v", "w"][rng.integers(0, 4)]
        y = a / 10 + b * (2 if g == "u" else -1) + c + float(rng.standard_normal())
        rows.append((k, a, b, c, 7.0, g, y, float(y > 4), 1.0 + (y > 4), "test" if k % 6 == 0 else "train"))
    return spark.createDataFrame(rows, "record_id int, a double, b double, c double, flat double, g string, y double, label double, weight double, split string").cache()


def ml(frame, estimator, label, score="prediction"):
    model = M.fit_pipeline(frame.where("split = 'train'"), estimator, NUMERIC, CATEGORICAL, label)
    return model.transform(frame.where("split = 'test'")).withColumn("s", F.col(score) if score == "prediction" else F.get(vector_to_array(score), 1))


def test_boosting_is_that_of_spark_ml(frame, monkeypatch):
    monkeypatch.setattr(EN, "REPLAY", 2)
    got, again = EN.boosted(frame, "y", NUMERIC, CATEGORICAL, 5, 3, 0.05, seeds=[1, 2])
    want = ml(frame, GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.05), "y")
    mine = sorted(r["prediction"] for r in got.collect())
    assert np.allclose(mine, sorted(r["s"] for r in want.collect())) and mine == sorted(r["prediction"] for r in again.collect())
    got = EN.boosted(frame, "label", NUMERIC, CATEGORICAL, 5, 3, 0.1, seeds=[1], classes=True)[0]
    want = ml(frame, GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.1), "label", "probability")
    assert np.allclose(sorted(map(tuple, got.select("label", "score", "prediction").collect())), sorted(map(tuple, want.select("label", "s", "prediction").collect())))


def test_boosting_on_shares_of_the_rows(frame):
    one, two = EN.boosted(frame, "label", NUMERIC, CATEGORICAL, 10, 3, 0.1, seeds=[1, 2], share=0.8, classes=True)
    want = E.auc(ml(frame, GBTClassifier(maxIter=10, maxDepth=3, subsamplingRate=0.8, seed=1), "label", "probability"), "label", "s").first()["auc"]
    a, b = (E.auc(x, "label", "score").first()["auc"] for x in (one, two))
    assert a != b and abs(a - want) < 0.02 and abs(b - want) < 0.02


@pytest.mark.parametrize("held", [1 << 27, 1])
def test_forests_are_as_good_as_spark_mls(frame, monkeypatch, held):
    monkeypatch.setattr(EN, "HELD", held)  # all trees in a reading, or one
    trees = 30 if held > 1 else 3
    got = E.regression_metrics(EN.forest(frame, "y", NUMERIC, CATEGORICAL, trees, 6, 42), "label", "prediction").first()
    want = E.regression_metrics(ml(frame, RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", maxDepth=6, seed=42), "y"), "y", "prediction").first()
    assert got["n"] == want["n"] and abs(got["r2"] - want["r2"]) < (0.01 if held > 1 else 0.04)
    if held > 1:
        for weight in (None, "weight"):
            got = EN.forest(frame, "label", NUMERIC, CATEGORICAL, trees, 6, 42, classes=True, weight=weight and F.col(weight))
            of = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=42, **({"weightCol": weight} if weight else {}))
            want = ml(frame, of, "label", "probability")
            assert abs(E.auc(got, "label", "score").first()["auc"] - E.auc(want, "label", "s").first()["auc"]) < 0.02
            assert abs(got.agg(F.avg("score")).first()[0] - want.agg(F.avg("s")).first()[0]) < 0.02


def test_one_tree_of_unit_weights_is_a_decision_tree(frame, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor
    monkeypatch.setattr(EN, "POISSON", np.array([-1.0, 2.0]))  # every draw is 1
    got = EN.forest(frame, "y", NUMERIC, CATEGORICAL, 2, 5, 42)
    want = ml(frame, DecisionTreeRegressor(maxDepth=5), "y")
    assert np.allclose(sorted(r["score"] for r in got.collect()), sorted(r["s"] for r in want.collect()))


def test_draws():
    draws = np.searchsorted(EN.POISSON, EN.uniform(np.arange(100_000), 3))
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03
    chosen = EN._chosen(np.arange(4000), 1, 10, 4)
    assert np.all(np.diff(chosen, axis=1) > 0) and np.all(abs(np.bincount(chosen.ravel()) / 4000 - 0.4) < 0.04)


def test_edges(frame):
    got = EN.forest(frame.withColumn("y", F.lit(3.0)), "y", ["flat"], [], 2, 3, 1).collect()
    assert len(got) == 250 and {r["prediction"] for r in got} == {3.0}
    assert EN.forest(frame.where("split = 'train'"), "y", NUMERIC, CATEGORICAL, 2, 3, 1).count() == 0


def test_boosting_by_readings_is_that_of_tasks_with_the_whole_table(frame, monkeypatch):
    data = EN.binned(frame, "y", NUMERIC, CATEGORICAL, k=3, repeats=2)
    models = [(1, (0, 1)), (1, (1, 2)), (2, EN.TEST)]
    here = EN.boosted_of(data, 6, 3, 0.1, models, 0.8)
    monkeypatch.setattr(EN, "HELD", 1)
    there = EN.boosted_of(data, 6, 3, 0.1, models, 0.8)
    for a, b in zip(here, there):
        assert np.allclose(sorted(r["prediction"] for r in a.collect()), sorted(r["prediction"] for r in b.collect()))
    assert [a.count() for a in here][2] == 250 and sum(EN.boosted_of(data, 1, 1, 0.1, [(1, (0, f)) for f in range(3)])[f].count() for f in range(3)) == 1250


def test_a_fold_s_models_are_those_of_its_training_rows(frame):
    from promspark.operators.split import folds
    data = EN.binned(frame, "y", NUMERIC, CATEGORICAL, k=3, repeats=2)
    got = EN.boosted_of(data, 4, 3, 0.1, [(1, (1, 2))])[0]
    alone = folds(frame.where("split = 'train'"), 3, repeat=1).withColumn("split", F.when(F.col("fold") == 2, "test").otherwise("train"))
    want = ml(alone, GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.1), "y")
    assert np.allclose(sorted(r["prediction"] for r in got.collect()), sorted(r["s"] for r in want.collect()))


@pytest.mark.parametrize("classes", [False, True])
def test_forests_of_both_ways_are_the_same(frame, monkeypatch, classes):
    data = EN.binned(frame, "label" if classes else "y", NUMERIC, CATEGORICAL, k=3, repeats=1)
    def predicted(held):
        return sorted(r["score"] for r in EN.forest_of(data, 3, 5, 42, classes, held=held).collect())
    here = {held: predicted(held) for held in [(0, 1), EN.TEST]}
    monkeypatch.setattr(EN, "HELD", 1)
    for held, want in here.items():
        assert np.allclose(predicted(held), want)


def test_the_registry_s_ensembles_need_no_fit_of_spark_ml(frame, monkeypatch):
    """Boosting, and the folds of forests and boosting, were a Spark ML fit each."""
    makes = M.regressors() | {"forest": lambda: RandomForestRegressor(numTrees=3, maxDepth=3, seed=1), "boosting": lambda: GBTRegressor(maxIter=3, maxDepth=3, subsamplingRate=0.8, seed=1)}
    monkeypatch.setattr(M, "regressors", lambda *_: makes)
    monkeypatch.setattr(M, "fit_pipeline", None)
    for row in M.score_regressors(frame, ["forest", "boosting"], NUMERIC, CATEGORICAL, "y", k=3, repeats=2):
        assert None not in row and 0 < row[-1] < 1 and abs(row[2] - row[6]) < 0.3
