"""Modelling on Spark ML.

Estimators are Spark ML (distributed fitting); cross-validation folds come
from the record key hash, so fold membership is reproducible.  Fold and
model fits (a bounded count) are independent Spark jobs submitted from a
small driver thread pool, as ``CrossValidator(parallelism=...)`` does.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ensembles as EN
from . import linear as L
from . import trees as T
from .evaluate import regression_metrics
from .split import folds as add_folds

# sklearn-equivalent parameterisation (see SURVEY §7.5):
#   Ridge(alpha):  regParam = alpha * sigma_y / n, elasticNet 0, no standardisation
#   Lasso(alpha):  regParam = alpha, elasticNet 1, no standardisation


def regressors(sigma_y: float = 1.0, n: int = 1) -> dict[str, Callable]:
    return {
        "linear": lambda: LinearRegression(solver="normal"),
        "ridge": lambda: LinearRegression(solver="normal", regParam=1.0 * sigma_y / max(n, 1),
                                          elasticNetParam=0.0, standardization=False),
        "lasso": lambda: LinearRegression(regParam=0.01, elasticNetParam=1.0, standardization=False,
                                          maxIter=1000, tol=1e-8),
        "tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=42),
        "forest": lambda: RandomForestRegressor(numTrees=200, featureSubsetStrategy="all", maxDepth=12, seed=42),
        "boosting": lambda: GBTRegressor(maxIter=300, stepSize=0.05, subsamplingRate=0.8, maxDepth=4, seed=42),
    }


def classifiers() -> dict[str, Callable]:
    return {
        "logistic": lambda: LogisticRegression(maxIter=100),
        "svm": lambda: LinearSVC(maxIter=100, regParam=0.01),
        "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=42),
        "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=42),
        "weighted_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, weightCol="weight"),
        "boosting": lambda: GBTClassifier(maxIter=50, maxDepth=4, seed=42),
    }


def feature_stages(numeric: Sequence[str], categorical: Sequence[str] = (),
                   out: str = "features") -> list:
    """One-hot categoricals (unknown kept as its own index), then
    assemble with the numeric columns."""
    stages = []
    ohe_cols = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        ohe_cols.append(f"{c}__ohe")
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=ohe_cols,
                                    handleInvalid="keep", dropLast=False))
    stages.append(VectorAssembler(inputCols=list(numeric) + ohe_cols, outputCol=out, handleInvalid="keep"))
    return stages


def feature_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Names of the assembled vector slots after one-hot."""
    names = list(numeric)
    idx = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"]
    for c, s in zip(categorical, idx):
        names += [f"{c}={v}" for v in s.labels] + [f"{c}=__unknown"]
    return names


def fit_pipeline(train: DataFrame, estimator, numeric: Sequence[str], categorical: Sequence[str],
                 label: str) -> PipelineModel:
    est = estimator.setLabelCol(label).setFeaturesCol("features")
    return Pipeline(stages=feature_stages(numeric, categorical) + [est]).fit(train)


def cross_validate(df: DataFrame, make_estimator: Callable, numeric: Sequence[str],
                   categorical: Sequence[str], label: str, k: int = 5, repeats: int = 1,
                   key: str = "record_id", parallelism: int = 4) -> DataFrame:
    """Repeated k-fold; one metrics row per (repeat, fold).

    Fold fits are independent Spark jobs submitted from ``parallelism``
    driver threads (as ``CrossValidator(parallelism=...)`` does), so small
    fits overlap instead of queueing; each fit is itself distributed."""
    from concurrent.futures import ThreadPoolExecutor

    spark = df.sparkSession
    frames = [add_folds(df, k, key, repeat=r, col="__fold").persist() for r in range(repeats)]

    def one(task):
        r, i = task
        f = frames[r]
        model = fit_pipeline(f.where(F.col("__fold") != i), make_estimator(), numeric, categorical, label)
        m = regression_metrics(model.transform(f.where(F.col("__fold") == i)), label, "prediction").first()
        return (r, i, m["n"], m["mae"], m["rmse"], m["r2"])

    try:
        tasks = [(r, i) for r in range(repeats) for i in range(k)]
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rows = list(pool.map(one, tasks))
    finally:
        for f in frames:
            f.unpersist()
    return spark.createDataFrame(rows, "repeat int, fold int, n long, mae double, rmse double, r2 double")


def score_regressors(df: DataFrame, names: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], label: str,
                     k: int = 5, repeats: int = 1, cv: bool = True) -> list[tuple]:
    """(model, cv_mae, cv_rmse, cv_rmse_std, cv_r2, test_mae, test_rmse, test_r2) per name.

    The linear family of ``linear.MODELS`` is scored together in two readings of the table, whatever the number
    of folds and models; the single trees of all folds are grown together, one reading a level; the forests and the
    boosted trees of all folds share one table of binned rows, and the boosted ones are fitted side by side."""
    family = {n: L.MODELS[n] for n in names if n in L.MODELS}
    rows = {}
    if family:
        got = L.evaluate(df, label, numeric, categorical, family, k=k, repeats=repeats)
        test = {t[0]: t[2:] for t in got.test}
        for n in family:
            rows[n] = (*_over_folds([f[4:] for f in got.folds if f[0] == n]), *test.get(n, (None,) * 3))
    if "tree" in names:
        grown = T.grow(df, label, numeric, categorical, regressors()["tree"]().getMaxDepth(), k=k, repeats=repeats, cv=cv)
        scored = [T.regression_scores(grown, i) for i in range(len(grown.trees))]
        each = [tuple(None if v is None else round(float(v), 6) for v in s[1:]) for s in scored[:-1] if s]
        rows["tree"] = (*_over_folds(each), *(scored[-1][1:] if scored[-1] else (None,) * 3))
    if left := [n for n in names if n not in rows]:
        data = EN.binned(df, label, numeric, categorical, k=k, repeats=repeats if cv else 0)
        helds = [h for h in data.used if h != T.TEST] + [T.TEST]
        for n in left:
            of = regressors()[n]()
            if n == "forest":
                preds = (EN.forest_of(data, of.getNumTrees(), of.getMaxDepth(), of.getSeed(), held=h) for h in helds)
            else:
                preds = EN.boosted_of(data, of.getMaxIter(), of.getMaxDepth(), of.getStepSize(), [(of.getSeed(), h) for h in helds], of.getSubsamplingRate())
            *each, t = (regression_metrics(p, "label", "prediction").first() for p in preds)
            rows[n] = (*_over_folds([(r["mae"], r["rmse"], r["r2"]) for r in each if r["n"]]), t["mae"], t["rmse"], t["r2"])
    return [(n, *(None if v is None else round(float(v), 6) for v in rows[n])) for n in names]


def _over_folds(folds: list[tuple]) -> tuple:
    """Mean MAE, mean and sample deviation of RMSE, mean R^2."""
    if not folds:
        return (None,) * 4
    mae, rmse, r2 = zip(*folds)
    mean = sum(rmse) / len(rmse)
    spread = (sum((x - mean) ** 2 for x in rmse) / (len(rmse) - 1)) ** 0.5 if len(rmse) > 1 else None
    return sum(mae) / len(mae), mean, spread, None if None in r2 else sum(r2) / len(r2)


SCORES = "model string, cv_mae double, cv_rmse double, cv_rmse_std double, cv_r2 double, test_mae double, test_rmse double, test_r2 double"


def importances(model: PipelineModel, names: Sequence[str], k: int | None = None) -> DataFrame:
    """Feature importances (trees) or absolute coefficients (linear)."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
        kind = "importance"
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
        kind = "abs_coefficient"
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    df = s.createDataFrame([(n, float(v), kind) for n, v in zip(names, vals)], "feature string, value double, kind string")
    df = df.orderBy(F.desc("value"), "feature")
    return df.limit(k) if k else df


def linear_attribution(pred: DataFrame, coefs: dict[str, float], means: dict[str, float],
                       key: str = "record_id") -> DataFrame:
    """M26 (linear models, exact): contribution = coef * (x - mean), and its
    share of the row's total absolute contribution; long format."""
    parts = [F.struct(F.lit(c).alias("feature"),
                      (F.lit(b) * (F.col(c).cast("double") - F.lit(means[c]))).alias("contribution"))
             for c, b in coefs.items()]
    long = pred.select(key, F.explode(F.array(*parts)).alias("s")).select(key, "s.*")
    tot = long.groupBy(key).agg(F.sum(F.abs("contribution")).alias("__t"))
    return long.join(tot, key).withColumn("pct_of_total", F.round(F.abs("contribution") * 100.0 / F.col("__t"), 6)) \
        .withColumn("contribution", F.round("contribution", 6)).drop("__t")


def representative_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One-row frame: median of every numeric, mode of every categorical."""
    from .impute import fit_median, fit_mode
    found = fit_median(df, numeric) | fit_mode(df, categorical)
    cells = [found.get(c) for c in numeric] + [found.get(c) for c in categorical]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` double" for c in numeric] + [f"`{c}` {kinds[c]}" for c in categorical])
    return df.sparkSession.createDataFrame([cells], schema)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (shared storage path)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
