"""Reproducible splits and folds (P07, P08, W04, M16 folds).

Assignment depends only on the record key (md5 of the key), never on
partitioning or task order, so a re-run after executor loss or on a
different layout gives the same split.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import join_keys_null_safe


def key_hash(key: str) -> Column:
    """First 32 bits of md5(key) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")


def random_split(df: DataFrame, key: str = "record_id", train_pct: int = 80,
                 col: str = "split") -> DataFrame:
    """Hash threshold split: hash % 100 < train_pct -> train."""
    return df.withColumn(col, F.when(key_hash(key) % 100 < train_pct, "train").otherwise("test"))


def folds(df: DataFrame, k: int = 5, key: str = "record_id", repeat: int = 0,
          col: str = "fold") -> DataFrame:
    """Fold number 0..k-1 from the key hash; ``repeat`` salts the
    hash so repeated k-fold gets independent assignments."""
    h = key_hash(key) if repeat == 0 else F.conv(F.substring(
        F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{repeat}"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(col, (h % k).cast("int"))


def stratified_split(df: DataFrame, strata: Sequence[str], key: str = "record_id",
                     train_share: float = 0.7, col: str = "split", buckets: int = 65536) -> DataFrame:
    """Exactly floor(train_share * n_s) rows of each stratum s go to
    train, chosen by ascending (key hash, key).

    Equivalent to ``row_number() over (partition by stratum order by hash)
    <= share * n`` but without sorting a whole stratum in one task: rows are
    bucketed by the top 16 bits of the hash; a (stratum, bucket) count table
    (bounded by strata x buckets) locates the boundary bucket of every
    stratum, one row each, which is what the rows are joined with; only rows
    of that one bucket (1/65536 of the stratum) are ranked by a window."""
    strata = list(strata)
    h = key_hash(key)
    b = (h * buckets / F.lit(2 ** 32)).cast("int")
    x = df.withColumns({"__h": h, "__b": b})
    counts = x.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*strata)
    bounds = counts.select(*strata, "__b", "__c",
                           F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before"),
                           # exact decimal share: floor(90 * 0.7) must be 63, not 62.999...
                           F.floor(F.sum("__c").over(wt) * F.lit(Decimal(str(train_share)))).alias("__k"))
    # the last bucket that gives rows to train, and how many; none if the share rounds to no row
    edge = bounds.where(F.col("__before") < F.col("__k")).groupBy(*strata).agg(
        F.max("__b").alias("__edge"), F.max_by(F.col("__k") - F.col("__before"), "__b").alias("__need"))
    j = join_keys_null_safe(x, edge, strata, "left").withColumn("__edge", F.coalesce("__edge", F.lit(-1)))
    wb = Window.partitionBy(*strata).orderBy("__h", key)
    boundary = j.where(F.col("__b") == F.col("__edge")).withColumn("__r", F.row_number().over(wb)) \
        .withColumn(col, F.when(F.col("__r") <= F.col("__need"), "train").otherwise("test")).drop("__r")
    rest = j.where(F.col("__b") != F.col("__edge")).withColumn(col, F.when(F.col("__b") < F.col("__edge"), "train").otherwise("test"))
    return rest.unionByName(boundary).drop("__h", "__b", "__edge", "__need")


def standard_scaler_fit(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std (as sklearn) per column on train; the
    fitted state is two numbers per column."""
    row = train.agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                    *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}


def standard_scaler_apply(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in params.items()})
