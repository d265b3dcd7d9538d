"""Three prepared variants of one split, scores and target recomputed
from the filled items: keep nulls / median + mode / chained equations (MICE).

The split table is written; the fills are projections of it.  Whoever reads the variants many times writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import stored_prom
from ..operators import clean
from ..operators import impute as I
from ..operators import split as SP
from ..session import written_table

ITEMS = [*cat.oks_items("t0"), *cat.oks_items("t1")]
NUMERIC = [*ITEMS, *cat.eq5d_dims("t0"), *cat.eq5d_dims("t1"), "t0_eq_vas", "t1_eq_vas"]
CATEGORICAL = ["t0_symptom_period", "t0_living_arrangements", "t0_disability", "t0_assisted", "t0_previous_surgery", "age_band", "gender"]
COMPLETE = [*cat.COMORBIDITIES]  # predictors of the chained equations only
CLIP = {c: (0, 4) for c in ITEMS} | {c: (1, 3) for t in ("t0", "t1") for c in cat.eq5d_dims(t)} | {"t0_eq_vas": (0, 100), "t1_eq_vas": (0, 100)}


def with_target(df: DataFrame) -> DataFrame:
    """Oxford scores from the items, and their difference; null where an item is."""
    sums = {f"oks_{t}_score": sum((F.col(c) for c in cat.oks_items(t)), F.lit(0.0)) for t in ("t0", "t1")}
    return df.withColumns(sums).withColumn("target", F.col("oks_t1_score") - F.col("oks_t0_score"))


def split_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.apply_roles(stored_prom(spark, sf_dir)).select("record_id", *NUMERIC, *CATEGORICAL, *COMPLETE)
    return SP.random_split(df.withColumns({c: F.col(c).cast("double") for c in NUMERIC}), "record_id", 80)


COLUMNS = ["record_id", "split", "variant", *NUMERIC, *CATEGORICAL, "oks_t0_score", "oks_t1_score", "target"]


def simple_variants(df: DataFrame) -> DataFrame:
    """Keep nulls, and median + mode fitted on train."""
    train = df.where(F.col("split") == "train")
    filled = I.apply_fill(df, I.fit_median(train, NUMERIC) | I.fit_mode(train, CATEGORICAL))
    both = {"keep_nulls": df, "median_mode": filled}
    a, b = (with_target(d).withColumn("variant", F.lit(v)).select(*COLUMNS) for v, d in both.items())
    return a.unionByName(b)


def mice_variant(df: DataFrame, rounds: int = 10) -> DataFrame:
    """Chained equations over every column, categoricals coded and decoded; fitted on train."""
    mice = I.ChainedImputer([*NUMERIC, *CATEGORICAL, *COMPLETE], rounds=rounds, clip=CLIP, categorical=CATEGORICAL)
    filled = mice.fit(df.where(F.col("split") == "train"), labels_from=df).transform(df)
    return with_target(filled).withColumn("variant", F.lit("mice")).select(*COLUMNS)


def prepared_variants(spark: SparkSession, sf_dir: str, rounds: int = 10) -> DataFrame:
    df = written_table(split_frame(spark, sf_dir))
    return simple_variants(df).unionByName(mice_variant(df, rounds))
