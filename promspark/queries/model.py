"""Driver queries for modelling and evaluation."""

from __future__ import annotations

import os

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions import scores
from ..operators import ensembles as EN
from ..operators import evaluate as E
from ..operators import impute as I
from ..operators import linear as L
from ..operators import model as M
from ..operators import split as SP
from ..operators import trees as T
from ..session import checkpoint_dir
from ._sql import ctes, r6, scored_cte
from .impute import HASH_SQL, SPLIT_CTE
from .prep import T0, scored

NUMERIC = T0 + ["t0_eq_vas", "t0_mobility", "t0_discomfort", "t0_anxiety"] + cat.COMORBIDITIES
CATEGORICAL = ["age_band", "gender"]
TARGET = "oks_t1_score"


def _finish(result, *cached):
    """Materialise a (small) result to the shared checkpoint folder, then
    release the cached inputs it was computed from."""
    checkpoint_dir(result.sparkSession, allow_local=True)
    out = result.checkpoint(eager=True)
    for c in cached:
        c.unpersist()
    return out


def model_frame(spark, sf):
    """Train/test frame: complete pre-op items, known outcome, VAS and
    dimensions median-filled from train.  Callers persist it: every fold,
    grid point and model reads it again."""
    d = scored(spark, sf).where(F.col(TARGET).isNotNull())
    d = d.withColumns({"oks_success": scores.success("oks_t1_score", "oks_t0_score"),
                       "label": scores.success("oks_t1_score", "oks_t0_score").cast("double")})
    d = SP.random_split(d, "record_id", 80)
    med = I.fit_median(d.where(F.col("split") == "train"), ["t0_eq_vas", "t0_mobility", "t0_discomfort", "t0_anxiety"])
    d = I.apply_fill(d, med)
    return d.select("record_id", "split", *NUMERIC, *CATEGORICAL, "oks_t0_score", TARGET, "oks_success", "label")


def _one_feature(spark, sf):
    d = scored(spark, sf).where(F.col(TARGET).isNotNull())
    d = SP.random_split(d, "record_id", 80).persist()
    model = M.fit_pipeline(d.where(F.col("split") == "train"), M.regressors()["linear"](), ["oks_t0_score"], [], TARGET)
    pred = model.transform(d.where(F.col("split") == "test"))
    return pred, d


ONE_CTE = SPLIT_CTE + f""",
coef AS (SELECT regr_slope(oks_t1_score, oks_t0_score) AS b, regr_intercept(oks_t1_score, oks_t0_score) AS a
         FROM sp WHERE split = 'train' AND oks_t1_score IS NOT NULL),
pred AS (SELECT sp.*, a + b * oks_t0_score AS prediction FROM sp, coef WHERE split = 'test' AND oks_t1_score IS NOT NULL)"""


def m01_m18_linear_one(spark, sf):
    pred, d = _one_feature(spark, sf)
    return _finish(E.regression_metrics(pred, TARGET, "prediction"), d)


SQL_M01 = ctes(ONE_CTE) + f"""SELECT COUNT(*) AS n, {r6('AVG(abs(oks_t1_score - prediction))')} AS mae,
  {r6('sqrt(AVG(power(oks_t1_score - prediction, 2)))')} AS rmse,
  {r6('1.0 - SUM(power(oks_t1_score - prediction, 2)) / (SUM(power(oks_t1_score, 2)) - SUM(oks_t1_score) * SUM(oks_t1_score) / COUNT(*))')} AS r2
FROM pred"""


def _pred_success(pred):
    return pred.withColumns({
        "actual": scores.success("oks_t1_score", "oks_t0_score"),
        "predicted": F.coalesce((F.col("prediction") - F.col("oks_t0_score") >= 6) | (F.col("prediction") >= 26),
                                F.lit(False)).cast("int")})


def m19_confusion(spark, sf):
    pred, d = _one_feature(spark, sf)
    return _finish(E.confusion(_pred_success(pred), "actual", "predicted"), d)


PS_CTE = ONE_CTE + """,
ps AS (SELECT CAST(COALESCE(oks_t1_score - oks_t0_score >= 6 OR oks_t1_score >= 26, FALSE) AS INTEGER) AS actual,
  CAST(COALESCE(prediction - oks_t0_score >= 6 OR prediction >= 26, FALSE) AS INTEGER) AS predicted FROM pred)"""

SQL_M19 = ctes(PS_CTE) + f"""SELECT actual, predicted, COUNT(*) AS n, {r6('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM ps)')} AS share
FROM ps GROUP BY actual, predicted"""


def m22_accuracy(spark, sf):
    pred, d = _one_feature(spark, sf)
    return _finish(E.accuracy(_pred_success(pred), "actual", "predicted"), d)


SQL_M22 = ctes(PS_CTE) + f"SELECT {r6('AVG(CAST(actual = predicted AS DOUBLE))')} AS accuracy FROM ps"


def _scored_success(spark, sf):
    return scored(spark, sf).withColumn("success", scores.success("oks_t1_score", "oks_t0_score"))


def m20_m21_m30_curve(spark, sf):
    return E.curve_points(_scored_success(spark, sf), "success", "oks_t0_score")


CURVE_CTE = scored_cte() + """,
ss AS (SELECT oks_t0_score, CAST(COALESCE(oks_t1_score - oks_t0_score >= 6 OR oks_t1_score >= 26, FALSE) AS INTEGER) AS success FROM scored),
per AS (SELECT CAST(oks_t0_score AS DOUBLE) AS threshold, SUM(success) AS pos, SUM(1 - success) AS neg FROM ss
        WHERE oks_t0_score IS NOT NULL GROUP BY 1),
cur AS (SELECT threshold, SUM(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  SUM(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM per)"""

SQL_M20 = ctes(CURVE_CTE) + f"""SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P - tp AS BIGINT) AS fn,
  CAST(N - fp AS BIGINT) AS tn, {r6('tp / P')} AS tpr, {r6('fp / N')} AS fpr, {r6('tp / (tp + fp)')} AS precision, {r6('tp / P')} AS recall,
  {r6('P / (P + N)')} AS base_rate FROM cur"""


def m20_auc(spark, sf):
    return E.auc(_scored_success(spark, sf), "success", "oks_t0_score")


SQL_M20_AUC = ctes(CURVE_CTE) + f"""SELECT {r6('SUM(neg * (tp - pos / 2.0)) / (any_value(P) * any_value(N))')} AS auc
FROM cur JOIN per USING (threshold)"""


def m20_auc_continuous(spark, sf):
    """A score with as many values as rows: returned items by price."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    returned = (F.col("l_returnflag") == "R").cast("int")
    return E.auc(li.select(returned.alias("returned"), F.col("l_extendedprice").cast("double").alias("price")), "returned", "price")


SQL_M20_CONTINUOUS = f"""WITH r AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, rank() OVER (ORDER BY l_extendedprice) AS low,
  count(*) OVER (PARTITION BY l_extendedprice) AS ties FROM lineitem)
SELECT {r6('(SUM(CASE WHEN y = 1 THEN low + (ties - 1) / 2.0 END) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * SUM(1 - y))')} AS auc FROM r"""


def m25_residuals(spark, sf):
    pred, d = _one_feature(spark, sf)
    return _finish(E.residual_summary(pred, TARGET, "prediction", 10), d)


SQL_M25 = ctes(ONE_CTE, """r AS (SELECT CAST(oks_t1_score - prediction AS DOUBLE) AS residual FROM pred),
mm AS (SELECT MIN(residual) AS lo, MAX(residual) AS hi FROM r)""") + f"""SELECT bin, COUNT(*) AS n,
  {r6('ANY_VALUE(lo) + bin * ANY_VALUE((hi - lo) / 10)')} AS left_edge,
  (SELECT {r6('AVG(residual)')} FROM r) AS mean, (SELECT {r6('STDDEV_POP(residual)')} FROM r) AS std FROM (
  SELECT lo, hi, CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0 ELSE LEAST(9, FLOOR((residual - lo) / ((hi - lo) / 10))) END AS INTEGER) AS bin
  FROM r, mm) GROUP BY bin"""


def m31_funnel(spark, sf):
    return E.provider_funnel(_scored_success(spark, sf), "provider_code", "success", 10)


SQL_M31 = ctes(CURVE_CTE.replace("ss AS (SELECT oks_t0_score,", "ss AS (SELECT provider_code, oks_t0_score,"),
               """pv AS (SELECT provider_code, COUNT(*) AS n, AVG(CAST(success AS DOUBLE)) AS rate FROM ss GROUP BY provider_code),
e AS (SELECT list_sort(list_distinct(quantile_cont(n, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM pv),
o AS (SELECT AVG(CAST(success AS DOUBLE)) AS p FROM ss)""") + f"""SELECT provider_code, n,
  CAST(1 + len(list_filter(edges[2:len(edges) - 1], lambda v: n > v)) AS INTEGER) AS volume_decile, {r6('rate')} AS rate,
  {r6('p - 1.96 * sqrt(p * (1 - p) / n)')} AS lower, {r6('p + 1.96 * sqrt(p * (1 - p) / n)')} AS upper,
  (rate < p - 1.96 * sqrt(p * (1 - p) / n)) OR (rate > p + 1.96 * sqrt(p * (1 - p) / n)) AS outside FROM pv, e, o"""


def _run_regressors(spark, sf, names, k=5, repeats=1, cv=True):
    """One (dataset, model) run per name, M23: the comparison table ranked by test RMSE."""
    from pyspark.sql import Window
    d = model_frame(spark, sf).persist()
    try:
        rows = M.score_regressors(d, names, NUMERIC, CATEGORICAL, TARGET, k=k, repeats=repeats, cv=cv)
    finally:
        d.unpersist()
    table = spark.createDataFrame(rows, M.SCORES).drop("cv_mae").withColumn("dataset", F.lit("median_mode"))
    return table.withColumn("rank", F.row_number().over(Window.orderBy("test_rmse", "model")))


def m01_m04_m16_m23_linear_models(spark, sf):
    return _run_regressors(spark, sf, ["linear", "ridge", "lasso", "tree"])


def m17_repeated_kfold(spark, sf):
    d = model_frame(spark, sf).where(F.col("split") == "train").persist()
    try:
        got = L.evaluate(d, TARGET, NUMERIC, CATEGORICAL, {"linear": L.MODELS["linear"]}, k=5, repeats=3)
    finally:
        d.unpersist()
    return spark.createDataFrame([f[1:] for f in got.folds], "repeat int, fold int, n long, mae double, rmse double, r2 double")


def _one_feature_rows(spark, sf):
    d = scored(spark, sf).where(F.col(TARGET).isNotNull())
    return SP.random_split(d, "record_id", 80).select("record_id", "split", "oks_t0_score", TARGET)


def m16_m17_one_feature(spark, sf):
    """Linear, ridge and lasso regression on one feature: every fold of 5 x 3, and the test rows (repeat -1)."""
    got = L.evaluate(_one_feature_rows(spark, sf), TARGET, ["oks_t0_score"], k=5, repeats=3)
    rows = [(f[0], f[1], f[2], f[3], *(round(v, 6) for v in f[4:])) for f in got.folds] + [(t[0], -1, -1, t[1], *(round(v, 6) for v in t[2:])) for t in got.test]
    return spark.createDataFrame(rows, "model string, repeat int, fold int, n long, mae double, rmse double, r2 double")


ONE_CTES = SPLIT_CTE + f""",
ot AS (SELECT record_id, split, oks_t0_score AS x, oks_t1_score AS y FROM sp WHERE oks_t1_score IS NOT NULL),
fo AS (SELECT ot.*, r, CASE WHEN r = 0 THEN {HASH_SQL} ELSE ('0x' || substr(md5(CAST(record_id AS VARCHAR) || '#' || CAST(r AS VARCHAR)), 1, 8))::BIGINT END % 5 AS fold
       FROM ot, range(3) AS t(r) WHERE split = 'train'),
tr AS (SELECT r, f, x, y FROM fo, range(5) AS g(f) WHERE fold <> f UNION ALL SELECT -1, -1, x, y FROM ot WHERE split = 'train'),
te AS (SELECT r, fold AS f, x, y FROM fo UNION ALL SELECT -1, -1, x, y FROM ot WHERE split = 'test'),
ms AS (SELECT r, f, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, COVAR_POP(x, y) AS cxy, VAR_POP(x) AS vx, STDDEV_POP(x) AS sx FROM tr GROUP BY r, f)"""

SQL_M16 = ctes(ONE_CTES, """sl AS (SELECT ms.*, 'linear' AS model, cxy / vx AS b FROM ms
  UNION ALL SELECT ms.*, 'ridge', cxy / vx * n / (n + 1) FROM ms
  UNION ALL SELECT ms.*, 'lasso', sign(cxy) * greatest(abs(cxy / sx) - 0.01, 0) / sx FROM ms),
er AS (SELECT model, r, f, y, y - (my + b * (x - mx)) AS e FROM sl JOIN te USING (r, f))""") + f"""SELECT model, CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold,
  COUNT(*) AS n, {r6('AVG(abs(e))')} AS mae, {r6('sqrt(AVG(e * e))')} AS rmse, {r6('1 - SUM(e * e) / (VAR_POP(y) * COUNT(*))')} AS r2 FROM er GROUP BY model, r, f"""


def m03_lasso_path_one_feature(spark, sf):
    d = _one_feature_rows(spark, sf).where(F.col("split") == "train")
    return _path_rows(spark, L.lasso_path(d, TARGET, ["oks_t0_score"]))


def _path_rows(spark, path):
    best = int(path.errors.mean(0).argmin())
    rows = [(j, round(float(a), 6), *(round(float(e), 6) for e in (path.errors[:, j].mean(), path.errors[:, j].min(), path.errors[:, j].max())), j == best)
            for j, a in enumerate(path.alphas)]
    return spark.createDataFrame(rows, "step int, alpha double, mean_mse double, least_mse double, most_mse double, best boolean")


SQL_M03 = ctes(ONE_CTES, """al AS (SELECT j, abs(cxy / sx) * power(0.001, j / 99.0) AS alpha FROM ms, range(100) AS t(j) WHERE r = -1),
sl AS (SELECT j, alpha, f, mx, my, sign(cxy) * greatest(abs(cxy / sx) - alpha, 0) / sx AS b FROM ms, al WHERE r = 0),
er AS (SELECT j, alpha, f, AVG(power(y - (my + b * (x - mx)), 2)) AS mse FROM sl JOIN te USING (f) WHERE te.r = 0 GROUP BY j, alpha, f),
pa AS (SELECT j, alpha, AVG(mse) AS m, MIN(mse) AS l, MAX(mse) AS h FROM er GROUP BY j, alpha)""") + f"""SELECT CAST(j AS INTEGER) AS step, {r6('alpha')} AS alpha,
  {r6('m')} AS mean_mse, {r6('l')} AS least_mse, {r6('h')} AS most_mse, j = (SELECT arg_min(j, m) FROM pa) AS best FROM pa"""


def m03_lasso_path(spark, sf):
    """100 penalties over all features, 5 folds, and the slopes at the best one in the last rows."""
    d = model_frame(spark, sf).where(F.col("split") == "train")
    return _path_rows(spark, L.lasso_path(d, TARGET, NUMERIC, CATEGORICAL))


def m23_m29_registry(spark, sf):
    """Every dataset of the variants by every model of the registry, 5 x 3 folds and the test rows; ranked by test RMSE.
    Predictors are the pre-op columns without VAS; nulls that a variant keeps are filled with train medians."""
    from pyspark.sql import Window
    from ..plans import variants as V
    from ..session import written_table
    df = written_table(V.split_frame(spark, sf))
    both = V.simple_variants(df).unionByName(V.mice_variant(df))
    d = written_table(both.where(F.col("target").isNotNull()))
    numeric = [c for c in V.NUMERIC if not c.startswith(("t1_", "oks_t1_")) and c != "t0_eq_vas"]
    rows = []
    for dataset in ("keep_nulls", "median_mode", "mice"):
        one = d.where(F.col("variant") == dataset)
        if dataset == "keep_nulls":
            one = I.apply_fill(one, I.fit_median(one.where(F.col("split") == "train"), numeric))
        rows += [(dataset, *r) for r in M.score_regressors(one, list(M.regressors()), numeric, V.CATEGORICAL, "target", k=5, repeats=3)]
    table = spark.createDataFrame(rows, "dataset string, " + M.SCORES)
    return table.withColumn("rank", F.row_number().over(Window.orderBy("test_rmse", "dataset", "model")))


def m05_m06_forest_boosting(spark, sf):
    # 200 trees / 300 boosting rounds as the notebooks; one fit on train, scored on test
    # (k-fold CV of these: M23_M29_registry_over_variants)
    return _run_regressors(spark, sf, ["forest", "boosting"], cv=False)


def m08_m15_logistic_grid(spark, sf):
    d = model_frame(spark, sf).persist()
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    from pyspark.ml import Pipeline
    lr = M.classifiers()["logistic"]().setLabelCol("label").setFeaturesCol("features")
    pipe = Pipeline(stages=M.feature_stages(NUMERIC, CATEGORICAL) + [lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01, 0.1]).build()
    folds = SP.folds(train, 5, "record_id", col="fold")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
                        numFolds=5, foldCol="fold", parallelism=4).fit(folds)
    pred = cv.bestModel.transform(test)
    from pyspark.ml.functions import vector_to_array
    prob = pred.withColumn("p1", F.get(vector_to_array("probability"), 1))
    a = E.auc(prob, "label", "p1")
    return _finish(a.withColumns({"model": F.lit("logistic"), "cv_best_auc": F.lit(round(max(cv.avgMetrics), 6))}), d)


def m09_m14_classifiers(spark, sf):
    from pyspark.ml.functions import vector_to_array
    d = model_frame(spark, sf).persist()
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, kcls = sum(counts.values()), len(counts)
    weight = F.when(F.col("label") == 1.0, n / (kcls * counts.get(1.0, 1))).otherwise(n / (kcls * counts.get(0.0, 1)))
    train_w = train.withColumn("weight", weight)                               # M12 class weights
    minority = min(counts, key=counts.get)
    keep = counts[minority] / counts[1.0 - minority] if (1.0 - minority) in counts else 1.0
    balanced = train_w.where((F.col("label") == minority) |                     # M13 hash under-sample
                             (SP.key_hash("record_id") % 10000 < int(keep * 10000)))
    tests = test.withColumn("weight", F.lit(1.0))
    data = EN.binned(train_w.unionByName(tests), "label", NUMERIC, CATEGORICAL, F.col("weight"))
    rows = None
    for name, frame in [("svm", train_w), ("tree", train_w), ("forest", train_w), ("weighted_forest", train_w),
                        ("balanced_forest", balanced), ("boosting", train_w)]:
        est = M.classifiers()["forest" if name == "balanced_forest" else name]()
        if "forest" in name:
            of = data if frame is train_w else EN.binned(frame.unionByName(tests), "label", NUMERIC, CATEGORICAL)
            pred = EN.forest_of(of, est.getNumTrees(), est.getMaxDepth(), est.getSeed(), classes=True, whole=not est.isSet("weightCol"))
        elif name == "boosting":
            pred = EN.boosted_of(data, est.getMaxIter(), est.getMaxDepth(), est.getStepSize(), [(est.getSeed(), T.TEST)], est.getSubsamplingRate(), classes=True)[0]
        else:
            pred = M.fit_pipeline(frame, est, NUMERIC, CATEGORICAL, "label").transform(test)
            pred = pred.withColumn("score", F.get(vector_to_array("probability" if "probability" in pred.columns else "rawPrediction"), 1))
        acc = E.accuracy(pred, "label", "prediction").first()["accuracy"]
        a = E.auc(pred, "label", "score").withColumn("accuracy", F.lit(acc))
        a = a.withColumn("model", F.lit(name))
        rows = a if rows is None else rows.unionByName(a)
    return _finish(rows, d)


def m24_m26_m27_m28_explain(spark, sf):
    d = model_frame(spark, sf).persist()
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    model = M.fit_pipeline(train, M.regressors()["linear"](), NUMERIC, CATEGORICAL, TARGET)
    names = M.feature_names(model, NUMERIC, CATEGORICAL)
    imp = M.importances(model, names, k=10)                                     # M24
    coefs = dict(zip(NUMERIC, model.stages[-1].coefficients.toArray().tolist()[:len(NUMERIC)]))
    means = train.agg(*[F.avg(c).alias(c) for c in NUMERIC]).first().asDict()
    attr = M.linear_attribution(model.transform(test), coefs, means)           # M26
    top = attr.groupBy("feature").agg(F.round(F.avg(F.abs("contribution")), 6).alias("mean_abs_contribution"))
    rep = M.representative_profile(train, NUMERIC, CATEGORICAL)                  # M27
    from ..sources.files import work_dir
    path = os.path.join(work_dir(spark, "models"), "linear_pipeline")
    M.save_model(model, path)                                                    # M28
    reloaded = M.load_model(path)
    rep_pred = reloaded.transform(rep).select(F.round("prediction", 6).alias("p")).first()["p"]
    return _finish(imp.join(top, "feature", "full").withColumn("representative_prediction", F.lit(rep_pred)), d)


def m14_boosting_inverse_seeds(spark, sf):
    """Boosted classifier on the inverse target (predicting failure),
    five seeds to show the spread of test AUC."""
    seeds = (0, 1, 2, 3, 4)
    d = model_frame(spark, sf).withColumn("label", F.lit(1.0) - F.col("label")).persist()
    rows = None
    preds = EN.boosted(d, "label", NUMERIC, CATEGORICAL, rounds=50, depth=4, step=0.1, seeds=seeds, share=0.8, classes=True)
    for seed, pred in zip(seeds, preds):
        a = E.auc(pred, "label", "score").withColumn("seed", F.lit(seed))
        rows = a if rows is None else rows.unionByName(a)
    return _finish(rows, d)


QUERIES = {
    "M01_M18_linear_one_feature": (m01_m18_linear_one, SQL_M01),
    "M19_confusion_matrix": (m19_confusion, SQL_M19),
    "M22_accuracy": (m22_accuracy, SQL_M22),
    "M20_M21_M30_curve_points": (m20_m21_m30_curve, SQL_M20),
    "M20_auc": (m20_auc, SQL_M20_AUC),
    "M20_auc_continuous_score": (m20_auc_continuous, SQL_M20_CONTINUOUS),
    "M25_residuals": (m25_residuals, SQL_M25),
    "M31_provider_funnel": (m31_funnel, SQL_M31),
    "M02_M03_M04_M16_M23_M29_regression_comparison": (m01_m04_m16_m23_linear_models, None),
    "M17_repeated_kfold": (m17_repeated_kfold, None),
    "M16_M17_one_feature_folds": (m16_m17_one_feature, SQL_M16),
    "M03_lasso_path_one_feature": (m03_lasso_path_one_feature, SQL_M03),
    "M03_lasso_path": (m03_lasso_path, None),
    "M23_M29_registry_over_variants": (m23_m29_registry, None),
    "M05_M06_forest_boosting": (m05_m06_forest_boosting, None),
    "M08_M15_logistic_grid_cv": (m08_m15_logistic_grid, None),
    "M09_M10_M11_M12_M13_M14_classifiers": (m09_m14_classifiers, None),
    "M14_boosting_inverse_five_seeds": (m14_boosting_inverse_seeds, None),
    "M24_M26_M27_M28_explain_and_persist": (m24_m26_m27_m28_explain, None),
}


def e3_modelling_chain(spark, sf):
    """Entry 3 as one job: split, train-fitted fills, CV + test for the
    linear family, comparison, winner importances, saved pipeline."""
    from ..plans.modelling import modelling_chain
    from ..sources.files import work_dir
    d = model_frame(spark, sf).drop("split")
    table, imp = modelling_chain(d, NUMERIC, CATEGORICAL, TARGET, ["linear", "ridge", "lasso", "tree"],
                                 save_to=work_dir(spark, "models"))
    return table


QUERIES["E3_modelling_chain"] = (e3_modelling_chain, None)


def m10_tree_grid(spark, sf):
    """Decision-tree classifier, grid over depth and minimum
    weight fraction per node, 5 hash folds, AUC; best setting scored on test.
    As Spark ML's evaluator does, a fold is ranked by the positives of a leaf."""
    d = model_frame(spark, sf).persist()
    depths, fractions = [3, 5, 8], [0.0, 0.01]
    got = T.grow(d, "label", NUMERIC, CATEGORICAL, max(depths), fractions, k=5, gini=True)
    mean = {}
    for depth in depths:
        for w in fractions:
            folds = []
            for i, tree in enumerate(got.trees):
                if tree.held != T.TEST and tree.min_weight == w:
                    end, (n, s, _, _) = tree.ends(depth, prune=True), got.scores[i]
                    folds.append(T.auc([tree.s[e] for e in end], s, n - s))
            mean[depth, w] = sum(folds) / len(folds)
    depth, w = max(mean, key=mean.get)  # the first of equal ones
    i = got.of(T.TEST, w)
    tree = got.trees[i]
    share = [tree.s[e] / max(tree.n[e], 1.0) for e in tree.ends(depth, prune=True)]
    out = E.auc(got.test_scores(i, share), "label", "score").withColumns({
        "model": F.lit("tree"), "max_depth": F.lit(depth), "min_weight_fraction": F.lit(w),
        "cv_best_auc": F.lit(round(mean[depth, w], 6))})
    return _finish(out, d)


QUERIES["M10_M15_tree_grid_cv"] = (m10_tree_grid, None)
