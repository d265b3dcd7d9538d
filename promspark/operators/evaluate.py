"""Model evaluation as aggregates over (label, prediction / score) frames
(M18-M23, M25, M30, M31).

ROC and precision-recall curves are built over the *distinct scores*
(a grouped count table), with running sums over ranges of that table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import quantile_bins
from .running import running_sums


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R^2 (1 - SSE/SST) and n."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    e = y - p
    aggs = [F.count(F.lit(1)).alias("n"), _r6(F.avg(F.abs(e))).alias("mae"),
            _r6(F.sqrt(F.avg(e * e))).alias("rmse"),
            _r6(F.lit(1.0) - F.sum(e * e) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(F.lit(1)))).alias("r2")]
    src = df.where(y.isNotNull() & p.isNotNull())
    return src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts and shares of (actual, predicted)."""
    c = df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", _r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M22."""
    return df.agg(_r6(F.avg((F.col(label).cast("int") == F.col(pred).cast("int")).cast("double"))).alias("accuracy"))


def _thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: positives, negatives, and the positives and negatives with a higher score.

    The base is read once, into the count table of distinct scores; both running sums
    go over ranges of that table (``running_sums``), so no task holds all of it."""
    y = F.col(label).cast("int")
    per = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy((-F.col(score).cast("double")).alias("v")) \
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return running_sums(per, ["v"], {"pos": "pos_above", "neg": "neg_above"})


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """For every distinct score threshold t (predict
    positive when score >= t): tp, fp, fn, tn, tpr, fpr, precision, recall,
    and the base rate, the precision of a model without skill."""
    t = _thresholds(df, label, score)
    total = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    c = t.select((-F.col("v")).alias("threshold"), (F.col("pos_above") + F.col("pos")).alias("tp"),
                 (F.col("neg_above") + F.col("neg")).alias("fp"))
    c = c.withColumns({"__P": F.lit(total["p"]).cast("long"), "__N": F.lit(total["n"]).cast("long")})
    return c.select("threshold", "tp", "fp", (F.col("__P") - F.col("tp")).alias("fn"),
                    (F.col("__N") - F.col("fp")).alias("tn"),
                    _r6(F.try_divide(F.col("tp"), F.col("__P"))).alias("tpr"), _r6(F.try_divide(F.col("fp"), F.col("__N"))).alias("fpr"),
                    _r6(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    _r6(F.try_divide(F.col("tp"), F.col("__P"))).alias("recall"),
                    _r6(F.col("__P") / (F.col("__P") + F.col("__N"))).alias("base_rate"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC, the share of (positive, negative) pairs in which the
    positive has the higher score, ties counting half; exact counts."""
    t = _thresholds(df, label, score)
    pairs = t.agg(F.sum(F.col("neg").cast("decimal(20,0)") * (2 * F.col("pos_above") + F.col("pos")).cast("decimal(18,0)")).alias("won"),
                  F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    return pairs.select(_r6(F.col("won").cast("double") / 2 / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auc"))


def base_rate(df: DataFrame, label: str) -> DataFrame:
    """Share of positives, the precision of a model without skill."""
    return df.agg(_r6(F.avg(F.col(label).cast("double"))).alias("base_rate"))


def residual_summary(df: DataFrame, label: str, pred: str, bins: int = 10) -> DataFrame:
    """Residual mean, population std, and counts per equal-width bin."""
    from .profile import histogram
    r = df.select((F.col(label) - F.col(pred)).cast("double").alias("residual")).where(F.col("residual").isNotNull())
    h = histogram(r, "residual", bins)
    s = r.agg(_r6(F.avg("residual")).alias("mean"), _r6(F.stddev_pop("residual")).alias("std")).first()
    return h.withColumns({"mean": F.lit(s["mean"]).cast("double"), "std": F.lit(s["std"]).cast("double")})


def provider_funnel(df: DataFrame, provider: str, outcome: str, deciles: int = 10, z: float = 1.96) -> DataFrame:
    """Providers grouped by volume decile; funnel limits around the
    overall rate p: p +- z * sqrt(p (1 - p) / n) per provider."""
    per = df.groupBy(provider).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate"))
    p = df.agg(F.avg(F.col(outcome).cast("double")).alias("p")).first()["p"]
    j = quantile_bins(per, "n", deciles, "volume_decile").withColumn("__p", F.lit(p).cast("double"))
    se = F.sqrt(F.col("__p") * (1 - F.col("__p")) / F.col("n"))
    return j.select(provider, "n", "volume_decile", _r6(F.col("rate")).alias("rate"),
                    _r6(F.col("__p") - z * se).alias("lower"), _r6(F.col("__p") + z * se).alias("upper"),
                    ((F.col("rate") < F.col("__p") - z * se) | (F.col("rate") > F.col("__p") + z * se)).alias("outside"))
