"""Imputation fitted on train and applied to any split.

Fitted state is a handful of numbers per column (medians, modes, regression
coefficients), read from bounded aggregates; applying it is a projection.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of
from .chained import ChainedImputer  # noqa: F401  (P04)
from .profile import missing_report
from .quantiles import grouped_percentiles


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column_name", "value").where(F.col("value").isNotNull())


def fit_median(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column on train (value-count pre-aggregation)."""
    med = grouped_percentiles(_long_numeric(train, cols), ["column_name"], "value", [0.5], ["median"])
    return {r["column_name"]: r["median"] for r in med.collect()}


def fit_mode(train: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column on train; ties -> smallest."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column_name", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # numeric columns order ties numerically
    order_val = F.col("value").try_cast("double")
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), order_val.asc_nulls_last(), "value")
    top = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1)
    types = dict(train.dtypes)
    out = {}
    for r in top.collect():
        v = r["value"]
        t = types[r["column_name"]]
        out[r["column_name"]] = (int(float(v)) if t in ("int", "bigint", "smallint", "tinyint")
                                 else float(v) if t in ("double", "float") else v)
    return out


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """P01-P03 apply: coalesce each column with its fitted value."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in values.items() if c in types})


def indicator_columns(train: DataFrame, cols: Sequence[str], threshold_pct: float = 2.0) -> list[str]:
    """Columns whose missing share on train is above the threshold."""
    rep = missing_report(train, cols).where(F.col("pct_missing") > threshold_pct)
    return sorted(r["column_name"] for r in rep.select("column_name").collect())


class ReplaceSentinel(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that turns a sentinel code into null in the input
    columns (the ``sentinel`` parameter is honoured)."""

    sentinel = Param(Params._dummy(), "sentinel", "code meaning missing", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, sentinel=9.0):
        super().__init__()
        self._setDefault(sentinel=9.0)
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.getOrDefault(self.sentinel)
        return dataset.withColumns({c: F.when(F.col(c) != F.lit(s), F.col(c))
                                    for c in self.getOrDefault(self.inputCols)})


def imputation_check(df: DataFrame, cols: Sequence[str], by: str = "split") -> DataFrame:
    """Remaining nulls per column per split (expected all zero)."""
    return missing_report(df, cols, by=[by]).select(by, "column_name", "n_missing")


def donor_fill(train: DataFrame, df: DataFrame, target: str, donor_key: str, ranges: int | None = None) -> DataFrame:
    """A missing ``target`` takes the most frequent target value among
    train rows whose ``donor_key`` is nearest (ties -> smaller key; of equally
    frequent values the smallest).  A row without a key keeps its gap.

    The mode per distinct key comes from a count table; the keys of the rows
    with a gap meet it in an as-of join over key ranges, so a continuous key
    is no different from a score of few values.  Rows without a gap are not
    shuffled."""
    counts = train.where(F.col(target).isNotNull() & F.col(donor_key).isNotNull()) \
        .groupBy(F.col(donor_key).cast("double").alias("__key"), F.col(target).alias("__donor")).agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("__key").agg(F.min(F.struct(-F.col("n"), F.col("__donor"))).alias("m")).select("__key", "m.__donor")
    gaps = df.where(F.col(target).isNull()).withColumn("__key", F.col(donor_key).cast("double"))
    filled = gaps.join(as_of(gaps, modes, "__key", "__donor", ranges=ranges), "__key", "left").withColumn(target, F.col("__donor"))
    return df.where(F.col(target).isNotNull()).unionByName(filled.select(*df.columns))
