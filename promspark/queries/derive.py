"""Driver queries for derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import stored_prom
from ..functions import recode, scores
from ..operators import encode
from ._sql import all_not_null, any_null, ctes, eq5d_index_sql, items_sum, r6, scored_cte
from .prep import T0, T1, cleaned, scored


def _r6(c):
    return F.round(c.cast("double"), 6)


def d01_d02_scores(spark, sf):
    df = cleaned(spark, sf)
    return df.select("record_id",
                     scores.backfill_score("oks_t0_score", T0).alias("t0_filled"),
                     scores.backfill_score("oks_t1_score", T1, guard=True).alias("t1_complete_only"),
                     scores.oxford_score(T0).alias("t0_strict_sum"),
                     scores.oxford_score(T0, "skip").alias("t0_skip_sum"))


SQL_D01_D02 = ctes() + f"""SELECT record_id,
  CAST(COALESCE(oks_t0_score, {items_sum('t0')}) AS INTEGER) AS t0_filled,
  CAST(CASE WHEN {any_null(T1)} THEN NULL ELSE COALESCE(oks_t1_score, {items_sum('t1')}) END AS INTEGER) AS t1_complete_only,
  CAST({items_sum('t0')} AS INTEGER) AS t0_strict_sum,
  CAST({' + '.join(f'COALESCE({c}, 0)' for c in T0)} AS INTEGER) AS t0_skip_sum
FROM clean"""


def d03_d04_eq5d(spark, sf):
    df = cleaned(spark, sf)
    d0, d1 = cat.eq5d_dims("t0"), cat.eq5d_dims("t1")
    # an index is on record for two thirds of the rows; the others take the derived one
    recorded = F.when(F.col("record_id") % 3 > 0, F.round(F.col("record_id") % 1000 / 1000, 3))
    return df.select("record_id",
                     scores.eq5d_profile(d0).alias("t0_profile"),
                     scores.eq5d_index(d0).alias("t0_index"),
                     scores.eq5d_index(d0, legacy=True).alias("t0_index_legacy"),
                     scores.eq5d_profile(d1).alias("t1_profile"),
                     scores.fill_index(recorded, d1).alias("t1_index"))


def _profile_sql(t):
    return " || ".join(f"CAST({d} AS VARCHAR)" for d in cat.eq5d_dims(t))


SQL_D03_D04 = ctes() + f"""SELECT record_id,
  {_profile_sql('t0')} AS t0_profile,
  {eq5d_index_sql('t0')} AS t0_index,
  {eq5d_index_sql('t0', legacy=True)} AS t0_index_legacy,
  {_profile_sql('t1')} AS t1_profile,
  CASE WHEN record_id % 3 > 0 THEN round(record_id % 1000 / 1000.0, 3) ELSE {eq5d_index_sql('t1')} END AS t1_index
FROM clean"""


def d06_index_verification(spark, sf):
    d0 = cat.eq5d_dims("t0")
    df = cleaned(spark, sf).select(scores.eq5d_index(d0).alias("published"),
                                   scores.eq5d_index(d0, legacy=True).alias("legacy"))
    diff = F.abs(F.col("legacy") - F.col("published"))
    return df.agg(F.count("published").alias("n"),
                  _r6(F.avg(diff)).alias("mean_diff"), _r6(F.max(diff)).alias("max_diff"),
                  _r6(F.min(diff)).alias("min_diff"),
                  F.count_if(diff < 1e-6).alias("exact_matches"))


SQL_D06 = ctes() + f"""SELECT COUNT(published) AS n, {r6('AVG(d)')} AS mean_diff, {r6('MAX(d)')} AS max_diff,
  {r6('MIN(d)')} AS min_diff, COUNT(*) FILTER (WHERE d < 1e-6) AS exact_matches
FROM (SELECT published, ABS(legacy - published) AS d FROM (
  SELECT {eq5d_index_sql('t0')} AS published, {eq5d_index_sql('t0', legacy=True)} AS legacy FROM clean))"""


def d07_d12_outcomes(spark, sf):
    df = scored(spark, sf)
    g = scores.gain("oks_t1_score", "oks_t0_score")
    p1, f1 = scores.pain_total("t1"), scores.functioning_total("t1")
    pain_good, func_good = scores.cutoff_flag(p1, cat.CUT_OFF_PAIN), scores.cutoff_flag(f1, cat.CUT_OFF_FUNCTIONING)
    return df.select("record_id", g.alias("gain"),
                     scores.good_outcome("oks_t1_score", g).alias("good_outcome"),
                     scores.pain_total("t0").alias("t0_pain_total"),
                     scores.functioning_total("t0").alias("t0_functioning_total"),
                     p1.alias("t1_pain_total"), f1.alias("t1_functioning_total"),
                     scores.cutoff_flag(scores.pain_total("t0"), cat.CUT_OFF_PAIN).alias("t0_pain_good"),
                     pain_good.alias("t1_pain_good"), func_good.alias("t1_functioning_good"),
                     (pain_good & func_good).alias("y_binary"), (~(pain_good & func_good)).alias("y_inverse"))


def _func_sql(t):
    return " + ".join(f"COALESCE(oks_{t}_{i}, 0)" for i in cat.KNEE_ITEMS if "pain" not in i)


SQL_D07_D12 = ctes(scored_cte()) + f"""SELECT record_id, gain,
  COALESCE(oks_t1_score > 43 OR gain > 13, FALSE) AS good_outcome,
  t0_pain_total, t0_functioning_total, t1_pain_total, t1_functioning_total,
  COALESCE(t0_pain_total >= 4, FALSE) AS t0_pain_good,
  pg AS t1_pain_good, fg AS t1_functioning_good, pg AND fg AS y_binary, NOT (pg AND fg) AS y_inverse
FROM (SELECT *, COALESCE(t1_pain_total >= 4, FALSE) AS pg, COALESCE(t1_functioning_total >= 26, FALSE) AS fg FROM (
  SELECT record_id, oks_t1_score, oks_t1_score - oks_t0_score AS gain,
    CAST(oks_t0_pain + oks_t0_night_pain AS INTEGER) AS t0_pain_total,
    CAST({_func_sql('t0')} AS INTEGER) AS t0_functioning_total,
    CAST(oks_t1_pain + oks_t1_night_pain AS INTEGER) AS t1_pain_total,
    CAST({_func_sql('t1')} AS INTEGER) AS t1_functioning_total
  FROM scored))"""

MISS_COLS = T1 + ["t0_eq_vas", "t1_eq_vas"]


def d13_d15_counts_and_missing(spark, sf):
    df = cleaned(spark, sf)
    return encode.missing_indicators(
        df.select("record_id", "t0_eq_vas", "t1_eq_vas",
                  scores.comorbidity_count().alias("n_comorbidities"),
                  _r6(scores.missing_share(MISS_COLS)).alias("missing_share"),
                  scores.any_missing(MISS_COLS).alias("any_missing")),
        ["t0_eq_vas", "t1_eq_vas"]).drop("t0_eq_vas", "t1_eq_vas")


SQL_D13_D15 = ctes() + f"""SELECT record_id,
  CAST({' + '.join(cat.COMORBIDITIES)} AS INTEGER) AS n_comorbidities,
  {r6('(' + ' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in MISS_COLS) + f') / {float(len(MISS_COLS))}')} AS missing_share,
  ({any_null(MISS_COLS)}) AS any_missing,
  CAST(t0_eq_vas IS NULL AS INTEGER) AS t0_eq_vas_is_missing,
  CAST(t1_eq_vas IS NULL AS INTEGER) AS t1_eq_vas_is_missing
FROM clean"""


def d16_d18_label_encode(spark, sf):
    df = cleaned(spark, sf).select("record_id", "age_band", "year", "provider_code")
    return encode.label_encode(df, ["age_band", "year", "provider_code"],
                               orders={"age_band": cat.AGE_BANDS})


SQL_D16_D18 = ctes() + f"""SELECT record_id,
  CASE age_band {' '.join(f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(cat.AGE_BANDS))} END AS age_band,
  CAST(dense_rank() OVER (ORDER BY year) AS INTEGER) AS year,
  CAST(dense_rank() OVER (ORDER BY provider_code) AS INTEGER) AS provider_code
FROM clean"""


def d17_decode(spark, sf):
    enc = d16_d18_label_encode(spark, sf)
    k = len(cat.AGE_BANDS)
    per = enc.groupBy("provider_code").agg(_r6(F.avg("age_band")).alias("mean_code"))
    table = encode.code_table(enc, "x", order=cat.AGE_BANDS).withColumnRenamed("x", "decoded") \
        .withColumnRenamed("x_code", "code")
    dec = per.withColumn("code", encode.decode_rounded("mean_code", table, "decoded", k))
    return dec.join(table, "code", "left").select("provider_code", "mean_code", "code", "decoded")


SQL_D17 = ctes(f"""enc AS (SELECT provider_code,
  CASE age_band {' '.join(f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(cat.AGE_BANDS))} END AS code FROM clean)""") + \
    f"""SELECT provider_code, mean_code, code,
  CASE code {' '.join(f"WHEN {i + 1} THEN '{b}'" for i, b in enumerate(cat.AGE_BANDS))} END AS decoded
FROM (SELECT CAST(dense_rank() OVER (ORDER BY provider_code) AS INTEGER) AS provider_code, mean_code,
        CAST(GREATEST(1, LEAST({len(cat.AGE_BANDS)}, ROUND(mean_code))) AS INTEGER) AS code
      FROM (SELECT provider_code, {r6('AVG(code)')} AS mean_code FROM enc GROUP BY provider_code))"""

LIVING_CODES = ["1", "2", "3", "4", "9"]


def d19_one_hot(spark, sf):
    df = cleaned(spark, sf).select("record_id", recode.fill_constant("t0_living_arrangements", 9).alias("living"))
    return encode.one_hot(df, "living", LIVING_CODES)


SQL_D19 = ctes() + "SELECT record_id, " + ", ".join(
    f"CAST(COALESCE(t0_living_arrangements, 9) = {v} AS INTEGER) AS living_{v}" for v in LIVING_CODES) + " FROM clean"


def d20_equal_width(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice")
    b = encode.equal_width_bins(li, "l_extendedprice", 10, "bin")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"),
                                F.max("l_extendedprice").alias("hi"))


SQL_D20 = """WITH mm AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT l_extendedprice, CAST(GREATEST(1, LEAST(10, CEIL((l_extendedprice - lo) / ((hi - lo) / 10)))) AS INTEGER) AS bin
      FROM lineitem, mm)
SELECT bin, COUNT(*) AS n, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM b GROUP BY bin"""


def d21_quantile_bins(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice")
    b = encode.quantile_bins(li, "l_extendedprice", 10, "qbin")
    return b.groupBy("qbin").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"),
                                 F.max("l_extendedprice").alias("hi"))


SQL_D21 = """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice,
    [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM lineitem),
b AS (SELECT l_extendedprice, CAST(1 + len(list_filter(edges[2:len(edges) - 1], lambda v: l_extendedprice > v)) AS INTEGER) AS qbin
      FROM lineitem, e)
SELECT qbin, COUNT(*) AS n, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM b GROUP BY qbin"""


def d24_change_gap(spark, sf):
    df = scored(spark, sf).where(F.col("oks_t1_score").isNotNull()) \
        .withColumn("gain", scores.gain("oks_t1_score", "oks_t0_score"))
    g = df.groupBy("procedure", "year", "age_band").agg(
        F.avg("oks_t0_score").alias("pre"), F.avg("oks_t1_score").alias("post"), F.avg("gain").alias("recorded"))
    return g.select("procedure", "year", "age_band",
                    _r6(scores.recorded_change_gap("recorded", "post", "pre")).alias("gap"),
                    _r6(F.col("recorded")).alias("mean_gain"))


SQL_D24 = ctes(scored_cte()) + f"""SELECT procedure, year, age_band, {r6('post - pre - recorded')} AS gap,
  {r6('recorded')} AS mean_gain
FROM (SELECT procedure, year, age_band, AVG(oks_t0_score) AS pre, AVG(oks_t1_score) AS post,
        AVG(oks_t1_score - oks_t0_score) AS recorded
      FROM scored WHERE oks_t1_score IS NOT NULL GROUP BY procedure, year, age_band)"""


QUERIES = {
    "D01_D02_score_fill": (d01_d02_scores, SQL_D01_D02),
    "D03_D04_eq5d_profile_index": (d03_d04_eq5d, SQL_D03_D04),
    "D05_D06_index_verification": (d06_index_verification, SQL_D06),
    "D07_D12_gain_and_outcomes": (d07_d12_outcomes, SQL_D07_D12),
    "D13_D15_counts_missing_flags": (d13_d15_counts_and_missing, SQL_D13_D15),
    "D16_D18_label_encode": (d16_d18_label_encode, SQL_D16_D18),
    "D17_decode_rounded": (d17_decode, SQL_D17),
    "D19_one_hot": (d19_one_hot, SQL_D19),
    "D20_equal_width_bins": (d20_equal_width, SQL_D20),
    "D21_quantile_bins": (d21_quantile_bins, SQL_D21),
    "D23_D24_change_gap": (d24_change_gap, SQL_D24),
}
