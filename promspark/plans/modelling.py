"""Entry 3: prepared table -> model comparison, explanation, saved model.

split by key hash -> train-fitted median/mode fill -> for every model of a
registry: repeated k-fold CV on train and a test score -> comparison table
(winner = lowest test RMSE) -> importances of the winner -> saved pipeline.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import model as M
from ..operators import split as SP
from ..session import checkpoint_dir


def modelling_chain(prepared: DataFrame, numeric: list[str], categorical: list[str], target: str,
                    models: list[str], k: int = 5, repeats: int = 1, save_to: str | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    spark = prepared.sparkSession
    checkpoint_dir(spark, allow_local=True)
    d = SP.random_split(prepared.where(F.col(target).isNotNull()), "record_id", 80)
    train = d.where(F.col("split") == "train")
    d = I.apply_fill(I.apply_fill(d, I.fit_median(train, numeric)), I.fit_mode(train, categorical)).persist()
    try:
        train = d.where(F.col("split") == "train")
        rows = M.score_regressors(d, models, numeric, categorical, target, k=k, repeats=repeats)
        table = spark.createDataFrame([(r[0], r[2], *r[4:]) for r in rows], "model string, cv_rmse double, cv_r2 double, test_mae double, "
                                                                             "test_rmse double, test_r2 double")
        table = table.withColumn("rank", F.row_number().over(Window.orderBy("test_rmse", "model")))
        winner = min(rows, key=lambda r: (r[6], r[0]))[0]
        stats = train.agg(F.stddev_pop(target).alias("s"), F.count(F.lit(1)).alias("n")).first()
        fitted = {winner: M.fit_pipeline(train, M.regressors(stats["s"], stats["n"])[winner](), numeric, categorical, target)}
        names = M.feature_names(fitted[winner], numeric, categorical)
        imp = M.importances(fitted[winner], names, k=10).withColumn("model", F.lit(winner))
        if save_to:
            M.save_model(fitted[winner], os.path.join(save_to, winner))
        return table.checkpoint(eager=True), imp.checkpoint(eager=True)
    finally:
        d.unpersist()
