from pyspark.sql import functions as F

from promspark import catalog as cat
from promspark.operators import clean


def test_role_scoped_sentinels(spark):
    cols = ["oks_t0_pain", "t0_eq_vas", "oks_t0_score", "diabetes", "age_band", "t0_assisted"]
    df = spark.createDataFrame([(9, 9, 9, 9, "*", 9), (2, 999, 30, 1, "50 to 59", 2), (None, 50, None, None, "", 1)],
                               "oks_t0_pain int, t0_eq_vas int, oks_t0_score int, diabetes int, age_band string, t0_assisted int")
    out = [tuple(r) for r in clean.apply_roles(df, cat.prom_catalog()).select(*cols).collect()]
    # item 9 -> null, VAS 9 legal, score 9 legal, comorbidity 9 -> 0, '*' -> null
    assert out == [(None, 9, 9, 0, None, None), (2, None, 30, 1, "50 to 59", 2), (None, 50, None, 0, None, 1)]


def test_all_sentinels_deletes_legal_nines(spark):
    df = spark.createDataFrame([(9, 999, "*"), (3, 9, "x")], "a int, b int, s string")
    assert [tuple(r) for r in clean.all_sentinels_to_null(df).collect()] == [(None, None, None), (3, None, "x")]


def test_deletion_audit_invariant(prom):
    df = clean.apply_roles(prom)
    steps = [("items", cat.oks_items("t0")), ("dims", cat.eq5d_dims("t0")), ("demo", ["age_band", "gender"])]
    kept, audit = clean.deletion_audit(df, steps)
    rows = audit.orderBy("ord").collect()
    start = df.count()
    assert rows[0]["before"] == start
    assert sum(r["removed"] for r in rows) + rows[-1]["left"] == start
    assert kept.count() == rows[-1]["left"]
    for a, b in zip(rows, rows[1:]):
        assert a["left"] == b["before"]


def test_auto_recode_binary9(spark):
    df = spark.createDataFrame([(1, 1, 1), (9, 2, 9), (1, 9, 3)], "a int, b int, c int")
    out = [tuple(r) for r in clean.auto_recode_binary9(df).collect()]
    assert out == [(1, 1, 1), (0, 2, 9), (1, 9, 3)]


def test_columns_containing(spark):
    df = spark.createDataFrame([(1, 9), (2, 3)], "a int, b int")
    assert [r[0] for r in clean.columns_containing(df, 9).collect()] == ["b"]


def test_cross_source_duplicates_ignore_source(spark):
    df = spark.createDataFrame([("x", 1, "A", "p1"), ("x", 1, "B", "p2"), ("y", 2, "A", "p1")],
                               "k string, v int, source string, provider string")
    out = clean.cross_source_duplicates(df, "source", ignore=["provider"]).collect()
    assert [(r.k, r.v, r.n_sources) for r in out] == [("x", 1, 2)]


def test_cross_source_duplicates_with_nulls(spark):
    rows = [(None, "a", "A"), ("a", None, "B"), (None, None, "A"), (None, None, "B"), (None, None, "B"), ("c", "c", None), ("c", "c", "A"), ("d", "d", "A"), ("d", "d", "A")]
    df = spark.createDataFrame(rows, "k string, v string, source string")
    out = clean.cross_source_duplicates(df, "source")
    assert out.columns == ["k", "v", "n_sources", "copies"]
    assert [tuple(r) for r in out.collect()] == [(None, None, 2, 3)]
    assert clean.cross_source_duplicates(df.limit(0), "source").count() == 0


def test_recode_idempotent(prom):
    once = clean.apply_roles(prom)
    twice = clean.apply_roles(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_cross_source_rows_are_dealt_to_more_tasks_as_they_get_more(spark, monkeypatch):
    df = spark.range(300).selectExpr("id % 100 AS k", "IF(id < 200, 'x', 'y') AS source")  # each k: two of x, one of y
    monkeypatch.setattr(clean, "SHARED_ROWS", 30)
    out = clean.cross_source_duplicates(df, "source")
    assert out.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, out.collect())) == [(k, 2, 3) for k in range(100)]
