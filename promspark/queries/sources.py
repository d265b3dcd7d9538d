"""Driver queries for sources and sinks.

Each query writes the PROM view of ``orders`` to files under the session's
shared checkpoint folder in the reference's raw shapes (one file per year,
one with ';', suppressed values as '*', ZIP archives, gzip parquet), reads
them back with the source operators and aggregates; the oracle computes the
same aggregate directly from the tables, so a match is a round-trip check.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import stored_prom
from ..sources import files as S
from ..operators.split import random_split
from ._sql import ctes, r6
from .impute import HASH_SQL

COLS = ["record_id", "provider_code", "year", "procedure", "age_band", "gender",
        "oks_t0_pain", "oks_t0_score", "t0_eq_vas"]
AGG_SQL = f"""SELECT year, COUNT(*) AS n, COUNT(age_band) AS n_age, CAST(SUM(oks_t0_score) AS BIGINT) AS sum_score,
  {r6('AVG(t0_eq_vas)')} AS mean_vas, COUNT(DISTINCT provider_code) AS n_providers FROM src GROUP BY year"""


def _agg(df):
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("age_band").alias("n_age"),
                                  F.sum("oks_t0_score").alias("sum_score"),
                                  F.round(F.avg("t0_eq_vas"), 6).alias("mean_vas"),
                                  F.count_distinct("provider_code").alias("n_providers"))


def _write_yearly_csv(spark, sf):
    """One CSV folder per year; 2016/17 uses ';' (as one source file does)."""
    base = S.work_dir(spark, "csv")
    prom = stored_prom(spark, sf).select(*COLS)
    specs = []
    for y in cat.YEARS:
        sep = ";" if y == "2016/17" else ","
        path = os.path.join(base, y.replace("/", "_"))
        S.write_csv(prom.where(F.col("year") == y), path, sep)              # S11
        specs.append(S.FileSpec(path, "csv", sep, tag=y, null_value="*"))
    return specs


def s01_s02_s03_s07_csv_roundtrip(spark, sf):
    specs = _write_yearly_csv(spark, sf)
    cols = S.header(spark, specs[0].path, specs[0].sep)                      # S04
    raw = S.read_manifest(spark, specs, schema=S.string_schema(cols))       # S01 + S03 + S07 (+ S02 '*')
    typed = S.coerce_numeric(raw, ["record_id", "oks_t0_pain", "oks_t0_score", "t0_eq_vas"], "bigint")
    return _agg(typed.drop("source"))


SQL_S01 = ctes(f"src AS (SELECT {', '.join(COLS[:4])}, CASE WHEN age_band = '*' THEN NULL ELSE age_band END AS age_band, "
               f"oks_t0_score, t0_eq_vas FROM prom)") + AGG_SQL


def s04_header(spark, sf):
    specs = _write_yearly_csv(spark, sf)
    names = [(i, c) for s in specs for i, c in enumerate(S.header(spark, s.path, s.sep))]
    return spark.createDataFrame(names, "position int, column_name string").groupBy("position", "column_name") \
        .agg(F.count(F.lit(1)).alias("files"))


SQL_S04 = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', CAST(3 AS BIGINT))" for i, c in enumerate(COLS)) + \
    ") t(position, column_name, files)"


def s05_s06_zip(spark, sf):
    base = S.work_dir(spark, "zip")
    prom = stored_prom(spark, sf).select(*COLS)
    for y in cat.YEARS:                                                        # nested folders, found recursively
        S.write_zip_csv(prom.where(F.col("year") == y), os.path.join(base, y.replace("/", "_"), "nested"),
                        partitions=2).collect()
    raw = S.read_zip_csv(spark, base, COLS)                                    # S05 + S06
    raw = raw.withColumn("age_band", F.when(F.col("age_band") != "*", F.col("age_band")))
    typed = S.coerce_numeric(raw, ["oks_t0_score", "t0_eq_vas"], "bigint")
    return _agg(typed)


SQL_S05 = ctes(f"src AS (SELECT year, provider_code, CASE WHEN age_band = '*' THEN NULL ELSE age_band END AS age_band, "
               f"oks_t0_score, t0_eq_vas FROM prom)") + AGG_SQL


def s08_s09_s10_parquet_roundtrip(spark, sf):
    path = S.work_dir(spark, "parquet")
    S.write_parquet(stored_prom(spark, sf), path, "gzip", partition_by=["year"])  # S10
    back = spark.read.parquet(path).select(*COLS)                              # S09 + S08 projection
    return _agg(back)


SQL_S08 = ctes("src AS (SELECT * FROM prom)") + AGG_SQL


def s12_s13_registry_paired(spark, sf):
    base = S.work_dir(spark, "registry")
    prom = random_split(stored_prom(spark, sf), "record_id", 80)
    reg = {}
    for proc in cat.PROCEDURES:
        label = proc.split()[0].lower()
        for split in ("train", "test"):
            part = prom.where((F.col("procedure") == proc) & (F.col("split") == split))
            S.write_paired(part, ["year", "oks_t0_score", "t0_eq_vas"], "oks_t1_score",
                           os.path.join(base, label, split))                   # S13
            reg.setdefault(label, {})[split] = os.path.join(base, label, split, "features")
        reg[label]["drop"] = ["t0_eq_vas"] if label == "hip" else []
    loaded = S.load_registry(spark, reg)                                       # S12
    paired = S.read_paired(spark, os.path.join(base, "knee", "train"))
    a = loaded.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.count("t0_eq_vas").alias("n_vas"))
    b = paired.agg(F.count("oks_t1_score").alias("n")).first()["n"]
    return a.withColumn("knee_train_targets", F.lit(b).cast("long"))


SQL_S12 = ctes() + """SELECT CASE WHEN procedure = 'Knee Replacement' THEN 'knee' ELSE 'hip' END AS dataset,
  CASE WHEN {h} % 100 < 80 THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n,
  CASE WHEN procedure = 'Knee Replacement' THEN COUNT(t0_eq_vas) ELSE 0 END AS n_vas,
  (SELECT COUNT(oks_t1_score) FROM prom WHERE procedure = 'Knee Replacement' AND {h} % 100 < 80) AS knee_train_targets
FROM prom GROUP BY 1, 2, procedure""".replace("{h}", HASH_SQL)


QUERIES = {
    "S01_S02_S03_S07_S11_csv_roundtrip": (s01_s02_s03_s07_csv_roundtrip, SQL_S01),
    "S04_header_only": (s04_header, SQL_S04),
    "S05_S06_zip_archives": (s05_s06_zip, SQL_S05),
    "S08_S09_S10_parquet_roundtrip": (s08_s09_s10_parquet_roundtrip, SQL_S08),
    "S12_S13_registry_and_paired_files": (s12_s13_registry_paired, SQL_S12),
}


def s14_streaming_prepare(spark, sf):
    """Stateless preparation as a file stream (availableNow trigger) over
    the PROM view written as parquet extracts, then the D08 aggregate."""
    from ..functions import scores as SC
    from ..streaming.prepare_stream import run_prepare_stream, stream_roundtrip_paths
    base = S.work_dir(spark, "stream")
    landing, sink, ckpt = stream_roundtrip_paths(base)
    prom = stored_prom(spark, sf)
    S.write_parquet(prom, landing, "snappy")
    q = run_prepare_stream(spark, landing, prom.schema, sink, ckpt)
    q.awaitTermination()
    out = spark.read.parquet(sink).withColumn("oks_success", SC.success("oks_t1_score", "oks_t0_score"))
    return out.groupBy("procedure", "age_band").agg(F.count(F.lit(1)).alias("n"),
                                                     F.round(F.avg("oks_success").cast("double"), 6).alias("success_rate"))


def _s14_sql():
    from ._sql import scored_cte
    return ctes(scored_cte()) + f"""SELECT procedure, age_band, COUNT(*) AS n,
  {r6('AVG(CAST(COALESCE(oks_t1_score - oks_t0_score >= 6 OR oks_t1_score >= 26, FALSE) AS INTEGER))')} AS success_rate
FROM scored GROUP BY procedure, age_band"""


QUERIES["S14_streaming_prepare"] = (s14_streaming_prepare, _s14_sql())


INDEX_HEADER = "Pre-Op Q EQ5D Index"  # a column with fractions, thousandths of the record number
TEXT_COLUMNS = ["provider_code", "year", "procedure", "age_band", "gender"]


def _collected(spark, sf):
    """The PROM view as yearly CSV files with source-style headers (one file
    ';'-separated, columns in another order), collected into typed gzip parquet."""
    from ..plans.collect import collect_topic
    from .schema import raw_header
    base = S.work_dir(spark, "collect")
    prom = stored_prom(spark, sf)
    raw = prom.toDF(*[raw_header(c) for c in prom.columns]).withColumn(
        INDEX_HEADER, F.round(F.col("record_id") % 1000 / 1000 - F.lit(0.3), 3))
    specs = []
    for y in cat.YEARS:
        sep = ";" if y == "2016/17" else ","
        path = os.path.join(base, "raw", y.replace("/", "_"))
        own = raw.where(F.col("Year") == y)
        S.write_csv(own.select(*own.columns[::-1]) if y == "2016/17" else own, path, sep)
        specs.append(S.FileSpec(path, "csv", sep, tag=y))
    return collect_topic(spark, specs, os.path.join(base, "parquet")).table


def e1_collect_and_prepare(spark, sf):
    """Collect + Entry 1 end to end: the collected table is prepared and the
    deletion audit reported."""
    from ..plans.prepare import prepare
    return prepare(_collected(spark, sf))[1]


def e1_collected_columns(spark, sf):
    """Values and sum of every number column of the collected table, and the
    values of its text columns."""
    table = _collected(spark, sf)
    numbers = [c for c in table.columns if c not in TEXT_COLUMNS]
    wide = table.agg(*[F.struct(F.count(c).alias("n_values"), (F.sum(F.col(c).cast("double")) if c in numbers else F.lit(None).cast("double")).alias("total")).alias(c)
                       for c in table.columns])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.n_values").alias("n_values"), F.round(F.col(f"{c}.total"), 3).alias("total"))
                                           for c in table.columns])).alias("s"))
    return long.select("s.*")


def _e1_columns_sql():
    from ..fixture import column_order
    rows = [f"SELECT '{c}' AS column_name, COUNT({c}) AS n_values, "
            + ("CAST(NULL AS DOUBLE)" if c in TEXT_COLUMNS else f"round(CAST(SUM({c}) AS DOUBLE), 3)") + " AS total FROM prom" for c in column_order()]
    rows.append("SELECT 't0_eq5d_index', COUNT(*), round(SUM(round(record_id % 1000 / 1000.0 - 0.3, 3)), 3) FROM prom")
    return ctes() + " UNION ALL ".join(rows)


def _e1_sql():
    from .prep import _audit_sql
    return _audit_sql()


QUERIES["E1_S_C_collect_and_prepare"] = (e1_collect_and_prepare, _e1_sql())
QUERIES["E1_collected_columns"] = (e1_collected_columns, _e1_columns_sql())
