"""Driver queries for preparation: sentinels, recodes, scores, outcomes.

Each entry: key -> (spark callable (spark, sf_dir) -> DataFrame, DuckDB SQL).
Inputs are the PROM-shaped view over ``orders`` (whole table).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import stored_prom
from ..functions import recode, scores
from ..operators import clean
from ..plans.prepare import prepare
from ._sql import all_not_null, any_null, ctes, eq5d_index_sql, r6, scored_cte

T0, T1 = cat.oks_items("t0"), cat.oks_items("t1")


def cleaned(spark, sf):
    return clean.apply_roles(stored_prom(spark, sf))


def scored(spark, sf):
    df = clean.delete_listwise(cleaned(spark, sf), T0)
    return df.withColumns({
        "oks_t0_score": scores.backfill_score("oks_t0_score", T0),
        "oks_t1_score": scores.backfill_score("oks_t1_score", T1, guard=True),
    })


def _r6(c):
    return F.round(c.cast("double"), 6)


# -- minimum slice: who benefits from surgery --------------------------------

def success_by_group(spark, sf):
    df = scored(spark, sf).withColumns({
        "oks_gain": scores.gain("oks_t1_score", "oks_t0_score"),
        "oks_success": scores.success("oks_t1_score", "oks_t0_score"),
    })
    return (df.groupBy("procedure", "age_band")
            .agg(F.count(F.lit(1)).alias("n"),
                 _r6(F.avg("oks_success")).alias("success_rate"),
                 _r6(F.avg("oks_gain")).alias("mean_gain"),
                 F.count("oks_gain").alias("n_with_gain")))


SQL_SUCCESS_BY_GROUP = ctes(scored_cte()) + f"""
SELECT procedure, age_band, COUNT(*) AS n,
       {r6('AVG(success)')} AS success_rate,
       {r6('AVG(gain)')} AS mean_gain,
       COUNT(gain) AS n_with_gain
FROM (SELECT *, oks_t1_score - oks_t0_score AS gain,
             CAST(COALESCE(oks_t1_score - oks_t0_score >= 6 OR oks_t1_score >= 26, FALSE) AS INTEGER) AS success
      FROM scored) s
GROUP BY procedure, age_band
"""


QUERIES = {
    "D08_success_by_group": (success_by_group, SQL_SUCCESS_BY_GROUP),
}


# -- F: filters, sentinels, recodes ------------------------------------------

from ..fixture import column_order  # noqa: E402
from ..operators import encode  # noqa: E402
from ._sql import roles_select  # noqa: E402

CATALOG = cat.prom_catalog()
NUMERIC_FIXTURE = [c for c in column_order() if c not in
                   ("provider_code", "year", "procedure", "age_band", "gender")]
STRING_FIXTURE = ["provider_code", "year", "procedure", "age_band", "gender"]


def f01_all_sentinels(spark, sf):
    return clean.all_sentinels_to_null(stored_prom(spark, sf))


SQL_F01 = ctes() + "SELECT\n  " + ",\n  ".join(
    [f"CASE WHEN {c} IN (9, 999) THEN NULL ELSE {c} END AS {c}" for c in NUMERIC_FIXTURE] +
    [f"CASE WHEN {c} IN ('*', '') THEN NULL ELSE {c} END AS {c}" for c in STRING_FIXTURE]) + "\nFROM prom"


def f02_role_sentinels(spark, sf):
    return cleaned(spark, sf)


SQL_F02 = ctes() + "SELECT * FROM clean"


def f03_columns_with_9(spark, sf):
    return clean.columns_containing(stored_prom(spark, sf), 9, NUMERIC_FIXTURE)


SQL_F03 = ctes() + "SELECT column_name FROM (\n  SELECT " + ",\n  ".join(
    f"MAX(CASE WHEN {c} = 9 THEN 1 ELSE 0 END) AS {c}" for c in NUMERIC_FIXTURE) + \
    "\n  FROM prom) UNPIVOT (hit FOR column_name IN (" + ", ".join(NUMERIC_FIXTURE) + ")) WHERE hit = 1"


def f04_auto_recode(spark, sf):
    return clean.auto_recode_binary9(stored_prom(spark, sf), cols=NUMERIC_FIXTURE)


SQL_F04 = ctes("st AS (SELECT " + ",\n ".join(
    f"COUNT(DISTINCT {c}) = 2 AND MAX(CASE WHEN {c} = 9 THEN 1 ELSE 0 END) = 1 AS {c}__pick"
    for c in NUMERIC_FIXTURE) + " FROM prom)") + "SELECT\n  " + ",\n  ".join(
    [f"CASE WHEN st.{c}__pick AND prom.{c} = 9 THEN 0 ELSE prom.{c} END AS {c}" for c in NUMERIC_FIXTURE] +
    [f"prom.{c} AS {c}" for c in STRING_FIXTURE]) + "\nFROM prom, st"


def f05_f07_recodes(spark, sf):
    df = stored_prom(spark, sf)
    return df.select("record_id",
                     recode.presence("t0_assisted").alias("assisted_presence"),
                     recode.yes_no(recode.null_if_in("t0_assisted", [9])).alias("assisted_01"),
                     recode.yes_no(recode.null_if_in("t0_previous_surgery", [9]), as_boolean=True)
                     .alias("previous_surgery_bool"),
                     recode.comorbidity_flag("diabetes").alias("diabetes_flag"))


SQL_F05_F07 = ctes() + """
SELECT record_id,
  CAST(CASE WHEN t0_assisted IS NULL THEN 1 WHEN t0_assisted = 9 THEN 0 ELSE 1 END AS INTEGER) AS assisted_presence,
  CASE WHEN t0_assisted = 9 THEN NULL WHEN t0_assisted = 2 THEN 0 ELSE t0_assisted END AS assisted_01,
  CASE WHEN t0_previous_surgery = 9 THEN NULL ELSE (CASE WHEN t0_previous_surgery = 2 THEN 0 ELSE t0_previous_surgery END) = 1 END AS previous_surgery_bool,
  CAST(CASE WHEN diabetes IS NULL OR diabetes = 9 THEN 0 ELSE diabetes END AS INTEGER) AS diabetes_flag
FROM prom"""


def f08_f13_labels(spark, sf):
    df = cleaned(spark, sf)
    return df.select("record_id",
                     recode.map_codes(recode.fill_constant("gender", "9"), cat.GENDER_LABELS).alias("gender_label"),
                     recode.map_codes(recode.fill_constant("t0_living_arrangements", 9), cat.LIVING_LABELS)
                     .alias("living_label"),
                     recode.fill_constant("t0_disability", 9).alias("disability_filled"))


def _sql_map(expr, mapping, quote):
    whens = " ".join(f"WHEN {expr} = {quote}{k}{quote} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE CAST({expr} AS VARCHAR) END"


SQL_F08_F13 = ctes() + f"""
SELECT record_id,
  {_sql_map("COALESCE(gender, '9')", cat.GENDER_LABELS, "'")} AS gender_label,
  {_sql_map("COALESCE(t0_living_arrangements, 9)", cat.LIVING_LABELS, "")} AS living_label,
  COALESCE(t0_disability, 9) AS disability_filled
FROM clean"""


def f10_deletion_audit(spark, sf):
    _, audit = prepare(stored_prom(spark, sf))
    return audit


def _audit_sql():
    steps = [("pre-op items complete", cat.oks_items("t0")), ("pre-op EQ-5D complete", cat.eq5d_dims("t0")),
             ("symptom period known", ["t0_symptom_period"]), ("age and gender known", ["age_band", "gender"])]
    conds, parts = [], []
    for i, (name, cols) in enumerate(steps):
        conds.append(all_not_null(cols))
        parts.append(f"COUNT(*) FILTER (WHERE {' AND '.join(conds)}) AS n{i + 1}")
    sel = ",\n  ".join(["COUNT(*) AS n0"] + parts)
    rows = " UNION ALL\n".join(
        f"SELECT '{name}' AS step, {i + 1} AS ord, n{i} AS before, n{i} - n{i + 1} AS removed, n{i + 1} AS \"left\" FROM c"
        for i, (name, _) in enumerate(steps))
    return ctes(f"c AS (SELECT {sel} FROM clean)") + rows


def f09_f19_analysis_rows(spark, sf):
    df, _ = prepare(stored_prom(spark, sf))
    return clean.valid_target(df, "oks_t1_score").groupBy("procedure" if "procedure" in df.columns else "year") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("oks_success").alias("n_success"))


def f11_mask_filter(spark, sf):
    df = stored_prom(spark, sf)
    return (df.where((F.col("procedure") == "Knee Replacement") & F.col("year").isin("2017/18", "2018/19"))
            .select("record_id", "provider_code", "year"))


SQL_F11 = ctes() + """SELECT record_id, provider_code, year FROM prom
WHERE procedure = 'Knee Replacement' AND year IN ('2017/18', '2018/19')"""


def f12_pairwise_complete(spark, sf):
    df = cleaned(spark, sf)
    pairs = [("oks_t0_score", "t0_eq_vas"), ("oks_t1_score", "t1_eq_vas"), ("t0_eq_vas", "t1_eq_vas")]
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"),
                     F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))
            for x, y in pairs]
    return (df.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
            .groupBy("x", "y").agg(F.sum("n").alias("n"))
            .withColumn("enough", F.col("n") >= 30))


SQL_F12 = ctes() + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, COUNT(*) AS n, COUNT(*) >= 30 AS enough FROM clean "
    f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    for x, y in [("oks_t0_score", "t0_eq_vas"), ("oks_t1_score", "t1_eq_vas"), ("t0_eq_vas", "t1_eq_vas")])


def f14_duplicate_rows(spark, sf):
    """Whole rows over all columns; rows of line number 1 are added again, as lineitem has no equal rows."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return clean.duplicate_rows(li.union(li.where(F.col("l_linenumber") == 1)))


SQL_F14 = """SELECT *, COUNT(*) AS copies FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
GROUP BY ALL HAVING COUNT(*) > 1"""


def f15_cross_source(spark, sf):
    """All columns but procedure (the source) and provider; the knee records of one year are added once
    more as hip records of another provider, as the fixture has no record in two sources."""
    df = stored_prom(spark, sf)
    again = df.where((F.col("procedure") == "Knee Replacement") & (F.col("year") == "2016/17")).withColumns(
        {"procedure": F.lit("Hip Replacement"), "provider_code": F.lit("P999")})
    return clean.cross_source_duplicates(df.union(again), "procedure", ignore=["provider_code"])


SQL_F15 = ctes() + """SELECT * EXCLUDE (procedure, provider_code), COUNT(DISTINCT procedure) AS n_sources, COUNT(*) AS copies
FROM (SELECT * FROM prom UNION ALL SELECT * REPLACE ('Hip Replacement' AS procedure, 'P999' AS provider_code) FROM prom
      WHERE procedure = 'Knee Replacement' AND year = '2016/17')
GROUP BY ALL HAVING COUNT(DISTINCT procedure) > 1"""


def f16_contains(spark, sf):
    df = stored_prom(spark, sf)
    return (df.where(recode.contains_ci("procedure", "KNEE") & recode.contains_ci("provider_code", "p01"))
            .groupBy("provider_code").agg(F.count(F.lit(1)).alias("n")))


SQL_F16 = ctes() + """SELECT provider_code, COUNT(*) AS n FROM prom
WHERE lower(procedure) LIKE '%knee%' AND lower(provider_code) LIKE '%p01%' GROUP BY provider_code"""


def f17_profile_domain(spark, sf):
    df = stored_prom(spark, sf).select(scores.eq5d_profile(cat.eq5d_dims("t0")).alias("profile"))
    return (df.groupBy(recode.is_valid_profile("profile").alias("valid"))
            .agg(F.count(F.lit(1)).alias("n")))


SQL_F17 = ctes() + f"""SELECT regexp_full_match(profile, '[123]{{5}}') AS valid, COUNT(*) AS n
FROM (SELECT {' || '.join(f'CAST({d} AS VARCHAR)' for d in cat.eq5d_dims('t0'))} AS profile FROM prom)
GROUP BY 1"""


def f18_label_sort(spark, sf):
    df = cleaned(spark, sf).select("age_band").where(F.col("age_band").isNotNull()).distinct()
    k = recode.label_sort_key("age_band")
    from pyspark.sql import Window
    return df.select("age_band", k[0].alias("lo"), k[1].alias("hi"),
                     F.dense_rank().over(Window.orderBy(k[0], k[1])).alias("position"))


SQL_F18 = ctes() + """SELECT age_band, lo, hi, CAST(dense_rank() OVER (ORDER BY lo, hi) AS INTEGER) AS position FROM (
  SELECT DISTINCT age_band,
    CAST(regexp_extract_all(age_band, '(\\d+)', 1)[1] AS INTEGER) AS lo,
    CAST(regexp_extract_all(age_band, '(\\d+)', 1)[2] AS INTEGER) AS hi
  FROM clean WHERE age_band IS NOT NULL)"""


QUERIES.update({
    "F01_all_sentinels_null": (f01_all_sentinels, SQL_F01),
    "F02_role_sentinels": (f02_role_sentinels, SQL_F02),
    "F03_columns_with_code": (f03_columns_with_9, SQL_F03),
    "F04_auto_recode_binary9": (f04_auto_recode, SQL_F04),
    "F05_F06_F07_recodes": (f05_f07_recodes, SQL_F05_F07),
    "F08_F13_labels_and_fills": (f08_f13_labels, SQL_F08_F13),
    "F09_F10_deletion_audit": (f10_deletion_audit, _audit_sql()),
    "F11_mask_filter": (f11_mask_filter, SQL_F11),
    "F12_pairwise_complete": (f12_pairwise_complete, SQL_F12),
    "F14_duplicate_rows": (f14_duplicate_rows, SQL_F14),
    "F15_cross_source_duplicates": (f15_cross_source, SQL_F15),
    "F16_contains_ci": (f16_contains, SQL_F16),
    "F17_profile_domain": (f17_profile_domain, SQL_F17),
    "F18_label_sort_key": (f18_label_sort, SQL_F18),
})


def _f19_sql():
    steps = [cat.oks_items("t0"), cat.eq5d_dims("t0"), ["t0_symptom_period"], ["age_band", "gender"]]
    cond = " AND ".join(all_not_null(s) for s in steps)
    return ctes() + f"""SELECT procedure, COUNT(*) AS n, CAST(SUM(success) AS BIGINT) AS n_success FROM (
  SELECT procedure, t1s,
    CAST(COALESCE(t1s - t0s >= 6 OR t1s >= 26, FALSE) AS INTEGER) AS success FROM (
    SELECT procedure, CAST(COALESCE(oks_t0_score, {' + '.join(T0)}) AS INTEGER) AS t0s,
      CAST(CASE WHEN {any_null(T1)} THEN NULL ELSE COALESCE(oks_t1_score, {' + '.join(T1)}) END AS INTEGER) AS t1s
    FROM clean WHERE {cond})) WHERE t1s IS NOT NULL GROUP BY procedure"""


QUERIES["F19_valid_target_after_prepare"] = (f09_f19_analysis_rows, _f19_sql())
