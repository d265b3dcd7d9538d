import os

from pyspark.sql import functions as F

from promspark.sources import files as S


def test_zip_roundtrip_and_per_file_separator(prom, spark):
    base = S.work_dir(spark, "test")
    cols = ["record_id", "year", "age_band", "oks_t0_score"]
    S.write_zip_csv(prom.select(*cols), os.path.join(base, "zips", "deep"), partitions=3).collect()
    # a leftover temporary file of an unfinished (retried) writer attempt
    import shutil
    zdir = os.path.join(base, "zips", "deep").replace("file:", "")
    first = sorted(f for f in os.listdir(zdir) if f.endswith(".zip"))[0]
    shutil.copy(os.path.join(zdir, first), os.path.join(zdir, "_tmp-" + first))
    back = S.read_zip_csv(spark, os.path.join(base, "zips"), cols)
    assert back.count() == prom.count()
    assert back.where(F.col("member").startswith("._")).count() == 0
    S.write_csv(prom.select(*cols), os.path.join(base, "semi"), ";")
    got = S.read_csv(spark, os.path.join(base, "semi"), ";", null_value="*")
    assert got.columns == cols
    assert got.where(F.col("age_band").isNull()).count() == prom.where(F.col("age_band") == "*").count()


def test_coerce_numeric_is_ansi_safe(spark):
    df = spark.createDataFrame([("1",), ("*",), ("nan",), ("2.5",)], "v string")
    assert [r.v for r in S.coerce_numeric(df, ["v"]).collect()] == [1.0, None, None, 2.5]


def test_collect_roundtrip_types_and_values(prom, spark):
    from promspark import catalog as cat
    from promspark.plans.collect import collect_topic
    from promspark.queries.schema import raw_header
    base = S.work_dir(spark, "collect-test")
    raw = prom.toDF(*[raw_header(c) for c in prom.columns])
    specs = []
    for y in cat.YEARS:
        sep = ";" if y == "2016/17" else ","
        path = os.path.join(base, y.replace("/", "_"))
        S.write_csv(raw.where(F.col("Year") == y), path, sep)
        specs.append(S.FileSpec(path, "csv", sep, tag=y))
    got = collect_topic(spark, specs, os.path.join(base, "out"))
    types = dict(got.table.dtypes)
    assert types["oks_t0_pain"] == "tinyint" and types["t0_eq_vas"] == "smallint"
    assert set(prom.columns) == set(got.table.columns)
    cols = prom.columns
    a = got.table.select(*[F.col(c).cast("string") for c in cols])
    b = prom.select(*[F.col(c).cast("string") for c in cols])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert got.schema_report.where(~F.col("present")).count() == 0


def test_collect_keeps_decimals_and_text_and_makes_row_ids(spark, tmp_path):
    """Decimals stay, rows get ids, files may order their columns differently, and text in a number column raises."""
    import pytest

    from promspark.plans.collect import collect_topic
    (tmp_path / "a.csv").write_text("Pre-Op Q Score,Provider Code,Post-Op Q EQ5D Index\n9,RX1,0.796\n12.0,RX2,-0.016\n,RX3,\n")
    (tmp_path / "b.csv").write_text("Post-Op Q EQ5D Index;Provider Code;Pre-Op Q Score\n1;RX1;40\n")
    specs = [S.FileSpec(str(tmp_path / "a.csv"), "csv", ",", tag="1"), S.FileSpec(str(tmp_path / "b.csv"), "csv", ";", tag="2")]
    t = collect_topic(spark, specs, str(tmp_path / "out")).table
    rows = sorted((r.provider_code, r.t0_score, r.t1_eq5d_index) for r in t.where("year = '1'").collect())
    assert rows == [("RX1", 9, 0.796), ("RX2", 12, -0.016), ("RX3", None, None)]
    assert dict(t.dtypes)["t0_score"] == "tinyint" and dict(t.dtypes)["t1_eq5d_index"] == "double"
    assert t.select("record_id").distinct().count() == 4
    two = t.where("year = '2'").first()
    assert (two.provider_code, two.t0_score, two.t1_eq5d_index) == ("RX1", 40, 1.0)
    with pytest.raises(ValueError, match="provider_code"):
        collect_topic(spark, specs, str(tmp_path / "out2"), text_columns=())


def test_manifest_reads_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n")
    (tmp_path / "b.csv").write_text("y,z,x\nb,9,2\n")
    specs = [S.FileSpec(str(tmp_path / n), "csv", ",", tag=n) for n in ("a.csv", "b.csv")]
    got = S.read_manifest(spark, specs, schema=S.string_schema(["x", "y"]))
    assert sorted((r.x, r.y, r.source) for r in got.collect()) == [("1", "a", "a.csv"), ("2", "b", "b.csv")]


def test_row_ids_do_not_depend_on_splits(spark, tmp_path):
    from promspark.plans.collect import collect_topic
    sizes = {"a": 4000, "b": 0, "c": 1, "d": 2500}
    want, n = {}, 0
    for name, rows in sizes.items():
        (tmp_path / f"{name}.csv").write_text("Provider Code,Pre-Op Q Score\n" + "".join(f"{name}{k},{k % 49}\n" for k in range(rows)))
        want |= {f"{name}{k}": n + k for k in range(rows)}
        n += rows
    specs = [S.FileSpec(str(tmp_path / f"{name}.csv"), tag=name) for name in reversed(sizes)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, size in enumerate(("134217728", "3000", "17000")):
            for c in before:
                spark.conf.set(c, size)
            rows = collect_topic(spark, specs, str(tmp_path / f"out{k}")).table.collect()
            assert {r.provider_code: r.record_id for r in rows} == want and len(rows) == n
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_manifest_numbers_rows_of_csv_and_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{k},a\n" for k in range(500)))
    spark.range(500, 900, 1, 1).selectExpr("CAST(id AS STRING) x", "'b' y").coalesce(1).write.parquet(str(tmp_path / "b"))
    specs = [S.FileSpec(str(tmp_path / "b"), "parquet", tag="b"), S.FileSpec(str(tmp_path / "a.csv"), tag="a")]
    got = S.read_manifest(spark, specs, schema=S.string_schema(["x"]), id_col="row")
    assert got.columns[-1] == "row" and not set(S.PLACE) & set(got.columns)
    assert sorted((r.row, int(r.x)) for r in got.collect()) == [(k, k) for k in range(900)]
