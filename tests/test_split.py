from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from promspark.operators import split as SP


def test_random_split_layout_independent(prom):
    a = SP.random_split(prom.repartition(1), "record_id", 80).select("record_id", "split")
    b = SP.random_split(prom.repartition(7), "record_id", 80).select("record_id", "split")
    assert a.exceptAll(b).count() == 0
    n = prom.count()
    t = a.where(F.col("split") == "train").count()
    assert 0.7 * n < t < 0.9 * n


def test_stratified_split_exact_counts_match_row_number(prom):
    strata = ["procedure", "age_band"]
    got = SP.stratified_split(prom, strata, "record_id", 0.7, buckets=16)
    assert got.count() == prom.count()
    h = SP.key_hash("record_id")
    w = Window.partitionBy(*strata).orderBy(h, "record_id")
    ref = prom.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*strata))) \
        .withColumn("split", F.when(F.row_number().over(w) <= F.floor(F.col("__n") * F.lit(Decimal("0.7"))),
                                    "train").otherwise("test"))
    a = got.select("record_id", "split")
    b = ref.select("record_id", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_cover_each_row_once(prom):
    f = SP.folds(prom, 5, "record_id")
    assert f.where((F.col("fold") < 0) | (F.col("fold") > 4)).count() == 0
    assert f.count() == prom.count()
