"""Driver queries for splitting, scaling and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import stored_prom
from ..functions import scores
from ..operators import impute as I
from ..operators import split as SP
from ._sql import ctes, r6, scored_cte
from .prep import T0, T1, cleaned, scored

HASH_SQL = "('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 8))::BIGINT"
MEDIAN_COLS = ["t0_eq_vas", "t1_eq_vas", "oks_t1_score"]
MODE_COLS = ["t0_symptom_period", "t0_disability", "t0_assisted", "t1_mobility"]


def _split(spark, sf):
    d = scored(spark, sf).withColumn("oks_success", scores.success("oks_t1_score", "oks_t0_score"))
    return SP.random_split(d, "record_id", 80)


SPLIT_CTE = scored_cte() + f""",
sp AS (SELECT *, CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS split,
  CAST(COALESCE(oks_t1_score - oks_t0_score >= 6 OR oks_t1_score >= 26, FALSE) AS INTEGER) AS oks_success FROM scored)"""


def p07_a25_split_summary(spark, sf):
    d = _split(spark, sf)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("oks_t1_score"), 6).alias("target_mean"),
                                  F.round(F.stddev_samp("oks_t1_score"), 6).alias("target_std"),
                                  F.round(F.avg("oks_success"), 6).alias("success_rate"))


SQL_P07 = ctes(SPLIT_CTE) + f"""SELECT split, COUNT(*) AS n, {r6('AVG(oks_t1_score)')} AS target_mean,
  {r6('STDDEV_SAMP(oks_t1_score)')} AS target_std, {r6('AVG(oks_success)')} AS success_rate FROM sp GROUP BY split"""


def p08_stratified(spark, sf):
    d = SP.stratified_split(scored(spark, sf), ["procedure", "age_band"], "record_id", 0.7)
    return d.groupBy("procedure", "age_band", "split").agg(F.count(F.lit(1)).alias("n"),
                                                            F.sum("record_id").alias("key_sum"))


SQL_P08 = ctes(scored_cte()) + f"""SELECT procedure, age_band, split, COUNT(*) AS n, CAST(SUM(record_id) AS BIGINT) AS key_sum FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY procedure, age_band ORDER BY {HASH_SQL}, record_id)
                      <= floor(COUNT(*) OVER (PARTITION BY procedure, age_band) * 0.7) THEN 'train' ELSE 'test' END AS split
  FROM scored) GROUP BY procedure, age_band, split"""


def _fill_frames(spark, sf):
    d = _split(spark, sf)
    train = d.where(F.col("split") == "train")
    med = I.fit_median(train, MEDIAN_COLS)
    mode = I.fit_mode(train, MODE_COLS)
    return d, I.apply_fill(I.apply_fill(d, med), mode)


def p01_p02_median_mode(spark, sf):
    _, filled = _fill_frames(spark, sf)
    return filled.where(F.col("split") == "test").select("record_id", *MEDIAN_COLS, *MODE_COLS)


def _fill_sql():
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in MEDIAN_COLS)
    modes = ", ".join(f"(SELECT {c} FROM sp WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS {c}"
                      for c in MODE_COLS)
    return (f"med AS (SELECT {med} FROM sp WHERE split = 'train'),\nmo AS (SELECT {modes}),\n"
            f"filled AS (SELECT sp.record_id, sp.split, " +
            ", ".join(f"COALESCE(CAST(sp.{c} AS DOUBLE), med.{c}) AS {c}" if c != "oks_t1_score" else
                      f"CAST(COALESCE(CAST(sp.{c} AS DOUBLE), med.{c}) AS INTEGER) AS {c}" for c in MEDIAN_COLS) + ", " +
            ", ".join(f"COALESCE(sp.{c}, mo.{c}) AS {c}" for c in MODE_COLS) + " FROM sp, med, mo)")


def _p01_sql():
    cols = ", ".join(
        (f"CAST({c} AS INTEGER) AS {c}" if c in ("t0_eq_vas", "t1_eq_vas") else c) for c in MEDIAN_COLS)
    return ctes(SPLIT_CTE, _fill_sql()) + f"SELECT record_id, {cols}, {', '.join(MODE_COLS)} FROM filled WHERE split = 'test'"


def p14_check(spark, sf):
    _, filled = _fill_frames(spark, sf)
    return I.imputation_check(filled, MEDIAN_COLS + MODE_COLS, "split")


def _p14_sql():
    cols = MEDIAN_COLS + MODE_COLS
    aggs = ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in cols)
    return ctes(SPLIT_CTE, _fill_sql()) + f"""SELECT split, column_name, n_missing FROM (SELECT split, {aggs} FROM filled GROUP BY split)
UNPIVOT (n_missing FOR column_name IN ({', '.join(cols)}))"""


SCALE_COLS = ["oks_t0_score", "t0_eq_vas", "t0_mobility"]


def p05_scaling(spark, sf):
    d = _split(spark, sf)
    params = SP.standard_scaler_fit(d.where(F.col("split") == "train"), SCALE_COLS)
    out = SP.standard_scaler_apply(d.where(F.col("split") == "test").select("record_id", *SCALE_COLS), params)
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in SCALE_COLS])


SQL_P05 = ctes(SPLIT_CTE, "st AS (SELECT " + ", ".join(
    f"AVG({c}) AS {c}_m, STDDEV_POP({c}) AS {c}_s" for c in SCALE_COLS) + " FROM sp WHERE split = 'train')") + \
    "SELECT record_id, " + ", ".join(f"{r6(f'({c} - {c}_m) / CASE WHEN {c}_s = 0 OR {c}_s IS NULL THEN 1.0 ELSE {c}_s END')} AS {c}"
                                     for c in SCALE_COLS) + " FROM sp, st WHERE split = 'test'"

IND_COLS = T1 + ["t0_eq_vas", "t1_eq_vas", "t0_mobility", "t0_symptom_period", "oks_t1_score"]


def p09_indicators(spark, sf):
    """Indicator columns for features above 2 % missing on train, applied to
    the whole table; reported as (column_name, n_flagged)."""
    train = SP.random_split(cleaned(spark, sf), "record_id", 80).where(F.col("split") == "train")
    chosen = I.indicator_columns(train, IND_COLS, 2.0)
    df = cleaned(spark, sf).select(*[F.col(c).isNull().cast("int").alias(c + "_is_missing") for c in chosen])
    wide = df.agg(*[F.sum(c + "_is_missing").alias(c) for c in chosen])
    return wide.unpivot([], chosen, "column_name", "n_flagged")


def _p09_sql():
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_flagged, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL AND {HASH_SQL} % 100 < 80) * 100.0 / COUNT(*) FILTER (WHERE {HASH_SQL} % 100 < 80) AS pct FROM clean"
        for c in IND_COLS)
    return ctes() + f"SELECT column_name, n_flagged FROM ({parts}) WHERE pct > 2.0"


def p12_replace_sentinel(spark, sf):
    stage = I.ReplaceSentinel(inputCols=T0[:4], sentinel=9.0)
    return stage.transform(stored_prom(spark, sf).select("record_id", *T0[:4]))


SQL_P12 = ctes() + "SELECT record_id, " + ", ".join(f"CASE WHEN {c} <> 9 THEN {c} END AS {c}" for c in T0[:4]) + " FROM prom"


def p13_donor_fill(spark, sf):
    d = scored(spark, sf).withColumn("gain", scores.gain("oks_t1_score", "oks_t0_score"))
    d = SP.random_split(d, "record_id", 80)
    train = d.where(F.col("split") == "train")
    test = d.where(F.col("split") == "test").select("record_id", "gain", "age_band")
    return I.donor_fill(train, test, "age_band", "gain")


SQL_P13 = ctes(scored_cte(), f"""g AS (SELECT *, oks_t1_score - oks_t0_score AS gain,
  CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM scored),
modes AS (SELECT gain AS mk, arg_min(age_band, rk) AS mode FROM (
  SELECT gain, age_band, row_number() OVER (PARTITION BY gain ORDER BY COUNT(*) DESC, age_band) AS rk
  FROM g WHERE split = 'train' AND age_band IS NOT NULL AND gain IS NOT NULL GROUP BY gain, age_band) GROUP BY gain),
pick AS (SELECT k, (SELECT mode FROM modes ORDER BY abs(k - mk), mk LIMIT 1) AS donor
  FROM (SELECT DISTINCT gain AS k FROM g WHERE split = 'test' AND gain IS NOT NULL))""") + \
    """SELECT record_id, gain, COALESCE(age_band, donor) AS age_band FROM g LEFT JOIN pick ON g.gain = pick.k WHERE split = 'test'"""


def p13_donor_continuous(spark, sf):
    """A continuous key: the order priority of the training order with the nearest total price."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    d = SP.random_split(orders.withColumnRenamed("o_orderkey", "record_id"), "record_id", 80)
    d = d.withColumn("o_orderpriority", F.when(F.col("record_id") % 7 != 0, F.col("o_orderpriority")))
    return I.donor_fill(d.where(F.col("split") == "train"), d, "o_orderpriority", "o_totalprice")


SQL_P13_CONTINUOUS = f"""WITH d AS (SELECT o_orderkey AS record_id, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS given FROM orders),
g AS (SELECT *, CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM d),
modes AS (SELECT mk, given AS mode FROM (SELECT o_totalprice AS mk, given, row_number() OVER (PARTITION BY o_totalprice ORDER BY COUNT(*) DESC, given) AS rk
  FROM g WHERE split = 'train' AND given IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_totalprice, given) WHERE rk = 1),
low AS (SELECT record_id, o_totalprice, given, split, mk AS lk, mode AS lm FROM g ASOF LEFT JOIN modes ON g.o_totalprice >= modes.mk),
both_sides AS (SELECT low.*, mk AS hk, mode AS hm FROM low ASOF LEFT JOIN modes ON low.o_totalprice <= modes.mk)
SELECT record_id, o_totalprice, split, COALESCE(given, CASE WHEN hk IS NULL OR o_totalprice - lk <= hk - o_totalprice THEN lm ELSE hm END) AS o_orderpriority
FROM both_sides"""


def _variant_report(v):
    """Per variant and split: rows, rows without a target, target mean and deviation, cells still missing."""
    from ..plans.variants import CATEGORICAL, NUMERIC
    gaps = sum((F.col(c).isNull().cast("long") for c in [*NUMERIC, *CATEGORICAL]), F.lit(0))
    return v.groupBy("variant", "split").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("n_target"),
                                             F.round(F.avg("target"), 6).alias("target_mean"), F.round(F.stddev_samp("target"), 6).alias("target_std"),
                                             F.sum(gaps).alias("missing_cells"), F.round(F.avg("t0_eq_vas"), 6).alias("vas_mean"),
                                             F.round(F.avg(F.col("t0_symptom_period").cast("double")), 6).alias("symptom_mean"))


def p04_p11_mice(spark, sf):
    from ..plans.variants import prepared_variants
    return _variant_report(prepared_variants(spark, sf))


def p11_simple_variants(spark, sf):
    """The two variants without a model."""
    from ..plans.variants import simple_variants, split_frame
    from ..session import written_table
    return _variant_report(simple_variants(written_table(split_frame(spark, sf))))


def _p11_sql():
    from ..plans.variants import CATEGORICAL, NUMERIC
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC)
    modes = ", ".join(f"(SELECT {c} FROM vs WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS {c}" for c in CATEGORICAL)
    filled = ", ".join([f"COALESCE(vs.{c}, med.{c}) AS {c}" for c in NUMERIC] + [f"COALESCE(vs.{c}, mo.{c}) AS {c}" for c in CATEGORICAL])
    total = {t: " + ".join(cat.oks_items(t)) for t in ("t0", "t1")}
    gaps = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in [*NUMERIC, *CATEGORICAL])
    return ctes(f"vs AS (SELECT record_id, {numbers}, {', '.join(CATEGORICAL)}, CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM clean)",
                f"med AS (SELECT {med} FROM vs WHERE split = 'train')", f"mo AS (SELECT {modes})",
                f"filled AS (SELECT vs.record_id, {filled}, vs.split FROM vs, med, mo)",
                "variants AS (SELECT *, 'keep_nulls' AS variant FROM vs UNION ALL BY NAME SELECT *, 'median_mode' AS variant FROM filled)",
                f"t AS (SELECT *, ({total['t1']}) - ({total['t0']}) AS target FROM variants)") + f"""SELECT variant, split, COUNT(*) AS n, COUNT(target) AS n_target,
  {r6('AVG(target)')} AS target_mean, {r6('STDDEV_SAMP(target)')} AS target_std, CAST(SUM({gaps}) AS BIGINT) AS missing_cells,
  {r6('AVG(t0_eq_vas)')} AS vas_mean, {r6('AVG(t0_symptom_period)')} AS symptom_mean FROM t GROUP BY variant, split"""


def p04_two_columns(spark, sf):
    """Chained equations of the two VAS columns, ten rounds, fitted on train: every row that lacked a value."""
    df = SP.random_split(cleaned(spark, sf).select("record_id", "t0_eq_vas", "t1_eq_vas"), "record_id", 80)
    found = I.ChainedImputer(["t0_eq_vas", "t1_eq_vas"], rounds=10, alpha=1.0).fit(df.where(F.col("split") == "train"))
    gaps = df.where(F.col("t0_eq_vas").isNull() | F.col("t1_eq_vas").isNull())
    return found.transform(gaps).select("record_id", "split", F.round("t0_eq_vas", 6).alias("t0_eq_vas"), F.round("t1_eq_vas", 6).alias("t1_eq_vas"))


# The rounds as a recursion over four coefficients: x = a + b y, y = c + d x.  Filled rows enter the sums of the
# other regression through the moments of their observed column: n, s, q per kind of row.
SQL_P04 = ctes(f"v AS (SELECT record_id, CAST(t0_eq_vas AS DOUBLE) AS x, CAST(t1_eq_vas AS DOUBLE) AS y, CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM clean)",
               """m AS (SELECT AVG(x) AS mx, AVG(y) AS my, COUNT(*) - COUNT(x) <= COUNT(*) - COUNT(y) AS x_first FROM v WHERE split = 'train'),
u AS (SELECT CASE WHEN x_first THEN x ELSE y END AS x, CASE WHEN x_first THEN y ELSE x END AS y, CASE WHEN x_first THEN mx ELSE my END AS mx,
             CASE WHEN x_first THEN my ELSE mx END AS my FROM v, m WHERE split = 'train'),
s AS (SELECT any_value(mx) AS mx, any_value(my) AS my,
  COUNT(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n, SUM(x) FILTER (WHERE y IS NOT NULL) AS sx, SUM(y) FILTER (WHERE x IS NOT NULL) AS sy,
  SUM(x * x) FILTER (WHERE y IS NOT NULL) AS sxx, SUM(y * y) FILTER (WHERE x IS NOT NULL) AS syy, SUM(x * y) AS sxy,
  COUNT(*) FILTER (WHERE y IS NULL AND x IS NOT NULL) AS nx, COALESCE(SUM(x) FILTER (WHERE y IS NULL), 0) AS ox, COALESCE(SUM(x * x) FILTER (WHERE y IS NULL), 0) AS oxx,
  COUNT(*) FILTER (WHERE x IS NULL AND y IS NOT NULL) AS ny, COALESCE(SUM(y) FILTER (WHERE x IS NULL), 0) AS oy, COALESCE(SUM(y * y) FILTER (WHERE x IS NULL), 0) AS oyy FROM u),
r AS (SELECT 0 AS round, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, my AS c, 0.0::DOUBLE AS d FROM s
  UNION ALL
  SELECT round + 1, a2, b2, (ty + 0.0 - d2 * tx) / tn AS c, d2 AS d FROM (
    SELECT *, (txy - tx * ty / tn) / (txx - tx * tx / tn + 1) AS d2 FROM (
      SELECT *, n + ny AS tn, sx + ny * a2 + b2 * oy AS tx, sy + oy AS ty, sxx + ny * a2 * a2 + 2 * a2 * b2 * oy + b2 * b2 * oyy AS txx, sxy + a2 * oy + b2 * oyy AS txy FROM (
        SELECT *, (px - b2 * py) / pn AS a2 FROM (
          SELECT *, (pxy - px * py / pn) / (pyy - py * py / pn + 1) AS b2 FROM (
            SELECT r.*, s.*, n + nx AS pn, sx + ox AS px, sy + nx * c + d * ox AS py, syy + nx * c * c + 2 * c * d * ox + d * d * oxx AS pyy, sxy + c * ox + d * oxx AS pxy FROM r, s WHERE round < 10)))))),
f AS (SELECT r.*, s.mx, s.my FROM r, s WHERE round > 0)""").replace("WITH ", "WITH RECURSIVE ", 1)
# a row without both: x starts at its mean, y at its mean, and each round replays both equations
SQL_P04 += f""",
steps AS (SELECT list(struct_pack(a, b, c, d) ORDER BY round) AS l, any_value(mx) AS mx, any_value(my) AS my FROM f),
last AS (SELECT * FROM f WHERE round = 10),
done AS (SELECT record_id, split, x_first, CASE WHEN x_first THEN x ELSE y END AS p, CASE WHEN x_first THEN y ELSE x END AS q FROM v, m WHERE x IS NULL OR y IS NULL),
e AS (SELECT done.*, CASE WHEN p IS NULL AND q IS NULL THEN list_reduce(list_prepend(struct_pack(a := 0.0::DOUBLE, b := 0.0::DOUBLE, c := steps.my, d := 0.0::DOUBLE), l),
        lambda z, t: struct_pack(a := t.a + t.b * z.c, b := 0.0::DOUBLE, c := t.c + t.d * (t.a + t.b * z.c), d := 0.0::DOUBLE)) END AS z, last.a, last.b, last.c, last.d FROM done, steps, last),
g AS (SELECT record_id, split, x_first, COALESCE(p, CASE WHEN q IS NULL THEN z.a ELSE a + b * q END) AS p, COALESCE(q, CASE WHEN p IS NULL THEN z.c ELSE c + d * p END) AS q FROM e)
SELECT record_id, split, {r6('CASE WHEN x_first THEN p ELSE q END')} AS t0_eq_vas, {r6('CASE WHEN x_first THEN q ELSE p END')} AS t1_eq_vas FROM g"""


def p01_median_continuous(spark, sf):
    """Medians of columns with about as many values as rows."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    found = I.fit_median(li, ["l_extendedprice", "l_quantity", "l_orderkey"])
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "column_name string, median double")


SQL_P01_CONTINUOUS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median FROM lineitem"
                                        for c in ("l_extendedprice", "l_quantity", "l_orderkey"))


QUERIES = {
    "P01_median_continuous": (p01_median_continuous, SQL_P01_CONTINUOUS),
    "P07_W04_A25_split_summary": (p07_a25_split_summary, SQL_P07),
    "P08_stratified_split": (p08_stratified, SQL_P08),
    "P01_P02_P03_median_mode_fill": (p01_p02_median_mode, _p01_sql()),
    "P14_imputation_check": (p14_check, _p14_sql()),
    "P05_standard_scaling": (p05_scaling, SQL_P05),
    "P12_replace_sentinel_stage": (p12_replace_sentinel, SQL_P12),
    "P09_indicator_columns": (p09_indicators, _p09_sql()),
    "P13_donor_fill": (p13_donor_fill, SQL_P13),
    "P13_donor_fill_continuous": (p13_donor_continuous, SQL_P13_CONTINUOUS),
    "P04_P11_prepared_variants": (p04_p11_mice, None),
    "P11_variants_without_model": (p11_simple_variants, _p11_sql()),
    "P04_chained_two_columns": (p04_two_columns, SQL_P04),
}
