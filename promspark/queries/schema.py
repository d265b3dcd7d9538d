"""Driver queries for schema and column operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import column_order, stored_prom
from ..operators import schema as C
from ..operators.split import random_split
from ._sql import ctes, r6
from .impute import HASH_SQL

DIM_TITLES = {"mobility": "Mobility", "self_care": "Self-Care", "activity": "Activity",
              "discomfort": "Discomfort", "anxiety": "Anxiety"}


def raw_header(short: str) -> str:
    """Source-file style header for a short column name."""
    def title(s):
        return " ".join(w.capitalize() for w in s.split("_"))
    for t, phase in (("t0", "Pre-Op Q"), ("t1", "Post-Op Q")):
        if short.startswith(f"oks_{t}_"):
            rest = short[len(f"oks_{t}_"):]
            return f"Knee Replacement {phase} {title(rest)}"
        if short == f"{t}_eq_vas":
            return f"{phase} EQ VAS"
        if short.startswith(f"{t}_"):
            rest = short[len(f"{t}_"):]
            return f"{phase} {DIM_TITLES.get(rest, title(rest))}"
    return title(short) if short != "record_id" else "record_id"


def raw_frame(spark, sf):
    df = stored_prom(spark, sf)
    return df.toDF(*[raw_header(c) for c in df.columns])


def c01_c02_clean_names(spark, sf):
    return C.rename_columns(raw_frame(spark, sf), C.short_name)


def _values_per_column(df):
    """(column_name, n_values): non-null values of every column, from one aggregate over the table."""
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "n_values")


def c03_c04_name_table(spark, sf):
    """Old and new names with the values that the renamed table holds under the new one."""
    raw = raw_frame(spark, sf)
    counts = _values_per_column(C.rename_columns(raw, C.prefix_rename)).withColumnRenamed("column_name", "new")
    return C.name_table(raw, C.prefix_rename).join(counts, "new")


def c05_schema_diff(spark, sf):
    p = stored_prom(spark, sf)
    frames = {y: (p.where(F.col("year") == y).drop("t0_eq_vas") if y == "2016/17" else p.where(F.col("year") == y))
              for y in cat.YEARS}
    d = C.schema_diff(frames).groupBy("column_name").agg(
        F.count_if("present").alias("n_files"), F.min(F.col("present").cast("int")).cast("boolean").alias("in_all"))
    values = [_values_per_column(f) for f in frames.values()]
    values = reduce(DataFrame.union, values).groupBy("column_name").agg(F.sum("n_values").alias("n_values"))
    return d.join(values, "column_name")


def c06_type_census(spark, sf):
    p = stored_prom(spark, sf)
    return C.type_census(p).join(_values_per_column(p), "column_name").groupBy("family").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("n_values").alias("n_values"))


NUMERIC = [c for c in column_order() if c not in ("provider_code", "year", "procedure", "age_band", "gender")]


def c07_smallest_types(spark, sf):
    return C.smallest_types(stored_prom(spark, sf), NUMERIC)


SQL_C07 = ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, "
    f"CASE WHEN MAX(CAST({c} <> floor({c}) AS INTEGER)) = 1 THEN 'float' WHEN MIN({c}) >= -128 AND MAX({c}) <= 127 THEN 'tinyint' "
    f"WHEN MIN({c}) >= -32768 AND MAX({c}) <= 32767 THEN 'smallint' WHEN MIN({c}) >= -2147483648 AND MAX({c}) <= 2147483647 THEN 'int' "
    f"ELSE 'bigint' END AS type FROM prom" for c in NUMERIC)


def c08_c09_c10_coerce_tag_key(spark, sf):
    p = stored_prom(spark, sf)
    d = p.select(F.substring("provider_code", 2, 3).try_cast("int").alias("provider_number"),
                 F.col("age_band").try_cast("int").alias("age_number"),
                 C.composite_key("provider_code", "year").alias("lookup_key"),
                 F.lit("Knee").alias("csv_tag"))
    return d.groupBy("csv_tag").agg(F.count_distinct("lookup_key").alias("n_keys"),
                                    F.count("provider_number").alias("n_numeric"),
                                    F.count("age_number").alias("n_age_numeric"),
                                    F.sum("provider_number").alias("sum_provider_number"))


SQL_C08 = ctes() + """SELECT 'Knee' AS csv_tag, COUNT(DISTINCT provider_code || '_' || year) AS n_keys,
  COUNT(TRY_CAST(substr(provider_code, 2, 3) AS INTEGER)) AS n_numeric, COUNT(TRY_CAST(age_band AS INTEGER)) AS n_age_numeric,
  CAST(SUM(TRY_CAST(substr(provider_code, 2, 3) AS INTEGER)) AS BIGINT) AS sum_provider_number FROM prom"""


def c11_c12_c13_c14_projection(spark, sf):
    from ..operators.clean import leakage_safe_columns
    p = stored_prom(spark, sf)
    keep = leakage_safe_columns(p.columns, keep=["oks_t1_score"])
    d = C.keep_columns(C.drop_columns(p, ["t0_living_arrangements", "not_a_column"]), keep)
    return C.numeric_then_strings(d)


def _c11_sql():
    from ..operators.clean import leakage_safe_columns
    keep = [c for c in leakage_safe_columns(column_order(), keep=["oks_t1_score"]) if c != "t0_living_arrangements"]
    return ctes() + f"SELECT {', '.join(keep)} FROM prom"


def c15_align(spark, sf):
    p = random_split(stored_prom(spark, sf), "record_id", 80)
    train = p.where(F.col("split") == "train").select("record_id", "oks_t0_score", "t0_eq_vas", "gender")
    test = p.where(F.col("split") == "test").select("gender", "record_id", "oks_t0_score", "year")
    return C.align_to(test, train)


SQL_C15 = ctes() + f"""SELECT record_id, oks_t0_score, CAST(NULL AS INTEGER) AS t0_eq_vas, gender FROM prom
WHERE NOT ({HASH_SQL} % 100 < 80)"""


def c16_families(spark, sf):
    p = stored_prom(spark, sf)
    fams = C.column_families(p.columns)
    return spark.createDataFrame(fams, "family string, column_name string").join(_values_per_column(p), "column_name") \
        .groupBy("family").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_values").alias("n_values"))


def c17_strings(spark, sf):
    return C.all_strings(stored_prom(spark, sf).select("record_id", "oks_t0_score", "t0_eq_vas", "year"))


SQL_C17 = ctes() + """SELECT CAST(record_id AS VARCHAR) AS record_id, CAST(oks_t0_score AS VARCHAR) AS oks_t0_score,
  CAST(t0_eq_vas AS VARCHAR) AS t0_eq_vas, year FROM prom"""


QUERIES = {
    "C01_C02_clean_short_names": (c01_c02_clean_names, ctes() + "SELECT * FROM prom"),
    "C03_C04_prefix_rename_table": (c03_c04_name_table, None),
    "C05_schema_diff": (c05_schema_diff, None),   # oracles set below
    "C06_type_census": (c06_type_census, None),
    "C07_smallest_types": (c07_smallest_types, SQL_C07),
    "C08_C09_C10_coerce_tag_key": (c08_c09_c10_coerce_tag_key, SQL_C08),
    "C11_C12_C13_C14_P10_projection": (c11_c12_c13_c14_projection, _c11_sql()),
    "C15_align_columns": (c15_align, SQL_C15),
    "C16_column_families": (c16_families, None),
    "C17_cast_to_string": (c17_strings, SQL_C17),
}


def _values_sql(where: str = "", skip: tuple = ()) -> str:
    """(column_name, n_values) of the fixture columns."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS n_values FROM prom{where}" for c in column_order() if c not in skip)


def _c05_sql():
    parts = [f"SELECT * FROM ({_values_sql(f' WHERE year = {chr(39)}{y}{chr(39)}', ('t0_eq_vas',) if y == '2016/17' else ())})" for y in cat.YEARS]
    return ctes() + f"""SELECT column_name, COUNT(*) AS n_files, COUNT(*) = {len(cat.YEARS)} AS in_all, CAST(SUM(n_values) AS BIGINT) AS n_values
FROM ({' UNION ALL '.join(parts)}) GROUP BY column_name"""


def _c06_sql():
    from ..fixture import prom_sql
    return ctes() + f"""SELECT CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE')
  OR column_type LIKE 'DECIMAL%' THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'string' ELSE 'other' END AS family,
  COUNT(*) AS n_columns, CAST(SUM(n_values) AS BIGINT) AS n_values
FROM (DESCRIBE ({prom_sql()})) d JOIN ({_values_sql()}) v USING (column_name) GROUP BY 1"""


def _c16_sql():
    return ctes() + f"""SELECT CASE WHEN column_name IN ('record_id', 'provider_code', 'year', 'procedure') THEN 'key'
  WHEN column_name IN ('age_band', 'gender') THEN 'demographic'
  WHEN regexp_matches(column_name, '^oks_t[01]_score$') THEN 'score_' || column_name[5:6]
  WHEN starts_with(column_name, 'oks_') THEN 'item_' || column_name[5:6]
  WHEN regexp_matches(column_name, '^t[01]_eq_vas$') THEN 'vas_' || column_name[1:2]
  WHEN regexp_matches(column_name, '^t[01]_(mobility|self_care|activity|discomfort|anxiety)$') THEN 'eq5d_dim_' || column_name[1:2]
  WHEN column_name IN ('t0_assisted', 't0_previous_surgery', 't0_disability') THEN 'yes_no'
  WHEN starts_with(column_name, 't0_') THEN 'category' ELSE 'comorbidity' END AS family,
  COUNT(*) AS n_columns, CAST(SUM(n_values) AS BIGINT) AS n_values FROM ({_values_sql()}) GROUP BY 1"""


QUERIES["C16_column_families"] = (c16_families, _c16_sql())
QUERIES["C05_schema_diff"] = (c05_schema_diff, _c05_sql())
QUERIES["C06_type_census"] = (c06_type_census, _c06_sql())


def _c03_sql():
    """The new names from the fixture's short names, not from the rules."""
    def new(short: str) -> str:
        head = raw_header(short).replace(" ", "_")
        for t, phase in (("t0", "Pre-Op_Q_"), ("t1", "Post-Op_Q_")):
            if short.startswith(f"oks_{t}_"):
                return f"{t}_KR_" + head.split(phase)[1]
            if short.startswith(f"{t}_"):
                return f"{t}_" + head.split(phase)[1]
        return head

    rows = " UNION ALL ".join(f"SELECT '{raw_header(c)}' AS old, '{new(c)}' AS new, COUNT({c}) AS n_values FROM prom" for c in column_order())
    return ctes() + rows


QUERIES["C03_C04_prefix_rename_table"] = (c03_c04_name_table, _c03_sql())
