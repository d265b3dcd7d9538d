"""Driver queries for profiling aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import column_order, stored_prom
from ..functions import scores
from ..operators import profile as P
from ._sql import ctes, r6, scored_cte
from .prep import T0, T1, cleaned, scored

ALL = column_order()
NUM_COLS = ["oks_t0_score", "oks_t1_score", "t0_eq_vas", "t1_eq_vas", "oks_t0_pain"]
STR_COLS = ["age_band", "gender", "year", "provider_code", "procedure"]
VC_COLS = ["age_band", "gender", "year", "t0_symptom_period", "provider_code"]


def _unpivot_sql(src: str, cols, value_type="VARCHAR", ids=()):
    ids_sql = "".join(f"{i}, " for i in ids)
    sel = ", ".join(f"CAST({c} AS {value_type}) AS {c}" for c in cols)
    return (f"(SELECT * FROM (SELECT {ids_sql}{sel} FROM {src}) "
            f"UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(cols)})))")


def _missing_sql(src, cols, by=(), sentinels=None):
    sentinels = sentinels or {}

    def cond(c):
        s = f"{c} IS NULL"
        if c in sentinels:
            vals = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in sentinels[c])
            s += f" OR {c} IN ({vals})"
        return s
    by_sel = "".join(f"{b}, " for b in by)
    aggs = ", ".join(f"COUNT(*) FILTER (WHERE {cond(c)}) AS {c}" for c in cols)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return (f"SELECT {by_sel}column_name, n, n_missing, "
            f"ROUND(CAST(n_missing AS DOUBLE) * 100.0 / n, 6) AS pct_missing, "
            f"ROUND(100.0 - CAST(n_missing AS DOUBLE) * 100.0 / n, 6) AS pct_complete FROM "
            f"(SELECT {by_sel}COUNT(*) AS n, {aggs} FROM {src}{group}) "
            f"UNPIVOT (n_missing FOR column_name IN ({', '.join(cols)}))")


def a01_missing(spark, sf):
    return P.missing_report(cleaned(spark, sf), ALL)


def a02_sentinel_missing(spark, sf):
    sent = {c: [9] for c in T0 + T1 + cat.eq5d_dims("t0") + cat.eq5d_dims("t1")}
    sent.update({"t0_eq_vas": [999], "t1_eq_vas": [999], "age_band": ["*", ""], "gender": ["*", ""]})
    return P.missing_report(stored_prom(spark, sf), list(sent), sentinels=sent)


_SENT = {c: [9] for c in T0 + T1 + cat.eq5d_dims("t0") + cat.eq5d_dims("t1")}
_SENT.update({"t0_eq_vas": [999], "t1_eq_vas": [999], "age_band": ["*", ""], "gender": ["*", ""]})


def a03_total_missing(spark, sf):
    return P.total_missing(cleaned(spark, sf), ALL)


SQL_A03 = ctes() + f"""SELECT missing_cells, total_cells, ROUND(CAST(missing_cells AS DOUBLE) * 100.0 / total_cells, 6) AS pct_missing
FROM (SELECT CAST(SUM({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in ALL)}) AS BIGINT) AS missing_cells,
             COUNT(*) * {len(ALL)} AS total_cells FROM clean)"""


def a04_missing_by_group(spark, sf):
    return P.missing_report(cleaned(spark, sf), T1 + ["t1_eq_vas"], by=["procedure"])


def a05_value_counts(spark, sf):
    return P.value_counts(cleaned(spark, sf), VC_COLS, top=10)


SQL_A05 = ctes() + f"""SELECT column_name, value, n, share FROM (
  SELECT column_name, value, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY column_name), 6) AS share,
         row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk
  FROM (SELECT column_name, value, COUNT(*) AS n FROM {_unpivot_sql('clean', VC_COLS)} WHERE value IS NOT NULL
        GROUP BY column_name, value)) WHERE rk <= 10"""


def a06_boolean_counts(spark, sf):
    return P.boolean_counts(cleaned(spark, sf), cat.COMORBIDITIES)


SQL_A06 = ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} = 1) AS n_true, COUNT(*) FILTER (WHERE {c} = 0) AS n_false, "
    f"ROUND(CAST(COUNT(*) FILTER (WHERE {c} = 1) AS DOUBLE) / COUNT(*) FILTER (WHERE {c} IN (0, 1)), 6) AS share_true FROM clean"
    for c in cat.COMORBIDITIES)

A07_COLS = ["gender", "year", "t0_assisted", "procedure", "provider_code", "t0_symptom_period"]


def a07_distinct(spark, sf):
    return P.distinct_values(cleaned(spark, sf), A07_COLS, max_values=4)


SQL_A07 = ctes() + f"""SELECT column_name, COUNT(*) AS n_unique,
  CASE WHEN COUNT(*) <= 4 THEN array_to_string(list_sort(list(value)), ',') END AS "values"
FROM (SELECT DISTINCT column_name, value FROM {_unpivot_sql('clean', A07_COLS)} WHERE value IS NOT NULL)
GROUP BY column_name"""


def a08_prevalence(spark, sf):
    return P.prevalence(cleaned(spark, sf), cat.COMORBIDITIES)


SQL_A08 = ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r6(f'AVG(CAST({c} AS DOUBLE))')} AS prevalence FROM clean" for c in cat.COMORBIDITIES)


def _describe_sql(src, cols, by=()):
    keys = ", ".join([*by, "column_name"])
    return (f"SELECT {keys}, COUNT(*) AS count, {r6('AVG(value)')} AS mean, {r6('STDDEV_SAMP(value)')} AS std, "
            f"MIN(value) AS min, MAX(value) AS max, {r6('quantile_cont(value, 0.25)')} AS q25, "
            f"{r6('quantile_cont(value, 0.5)')} AS median, {r6('quantile_cont(value, 0.75)')} AS q75 "
            f"FROM {_unpivot_sql(src, cols, 'DOUBLE', by)} WHERE value IS NOT NULL GROUP BY {keys}")


def a09_describe(spark, sf):
    return P.describe(cleaned(spark, sf), NUM_COLS)


def a10_describe_strings(spark, sf):
    return P.describe_strings(cleaned(spark, sf), STR_COLS)


SQL_A10 = ctes() + f"""SELECT column_name, CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS unique,
  arg_min(value, rk) AS top, arg_min(n, rk) AS freq FROM (
  SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk
  FROM (SELECT column_name, value, COUNT(*) AS n FROM {_unpivot_sql('clean', STR_COLS)} WHERE value IS NOT NULL
        GROUP BY column_name, value)) GROUP BY column_name"""


def a11_grouped_describe(spark, sf):
    return P.describe(cleaned(spark, sf), ["oks_t0_score", "t0_eq_vas"], by=["procedure"])


# Equality-like aggregate: procedure, year, dimension, value with improved /
# unchanged / worsened by the sign of the gain and exact gain percentiles.

def equality_table(spark, sf):
    df = scored(spark, sf).where(F.col("oks_t1_score").isNotNull()) \
        .withColumn("gain", scores.gain("oks_t1_score", "oks_t0_score"))
    dims = df.select("procedure", "year", "gain", "oks_t0_score", "oks_t1_score",
                     F.explode(F.array(F.struct(F.lit("Age").alias("dimension"), F.col("age_band").alias("value")),
                                       F.struct(F.lit("Gender").alias("dimension"), F.col("gender").alias("value"))))
                     .alias("d")).select("*", "d.*").drop("d").where(F.col("value").isNotNull())
    return dims


def a12_grouped_sums(spark, sf):
    d = equality_table(spark, sf).withColumns({
        "improved": (F.col("gain") > 0).cast("int"), "unchanged": (F.col("gain") == 0).cast("int"),
        "worsened": (F.col("gain") < 0).cast("int")})
    return P.grouped_measures(d, ["procedure", "year", "dimension"], ["improved", "unchanged", "worsened"], ["sum"])


SQL_EQ_BASE = ctes(scored_cte(), """eq AS (
  SELECT procedure, year, oks_t1_score - oks_t0_score AS gain, oks_t0_score, oks_t1_score, 'Age' AS dimension, age_band AS value
  FROM scored WHERE oks_t1_score IS NOT NULL AND age_band IS NOT NULL
  UNION ALL
  SELECT procedure, year, oks_t1_score - oks_t0_score, oks_t0_score, oks_t1_score, 'Gender', gender
  FROM scored WHERE oks_t1_score IS NOT NULL AND gender IS NOT NULL)""")

SQL_A12 = SQL_EQ_BASE + """SELECT procedure, year, dimension,
  CAST(SUM(CAST(gain > 0 AS INTEGER)) AS BIGINT) AS improved_sum, CAST(SUM(CAST(gain = 0 AS INTEGER)) AS BIGINT) AS unchanged_sum,
  CAST(SUM(CAST(gain < 0 AS INTEGER)) AS BIGINT) AS worsened_sum FROM eq GROUP BY procedure, year, dimension"""


def a13_multi_function(spark, sf):
    return P.grouped_measures(equality_table(spark, sf), ["procedure", "dimension", "value"], ["gain"],
                              ["mean", "median", "std", "sum"])


SQL_A13 = SQL_EQ_BASE + f"""SELECT procedure, dimension, value, {r6('AVG(gain)')} AS gain_mean, {r6('MEDIAN(gain)')} AS gain_median,
  {r6('STDDEV_SAMP(gain)')} AS gain_std, CAST(SUM(gain) AS BIGINT) AS gain_sum FROM eq GROUP BY procedure, dimension, value"""


def a14_rate_bottom(spark, sf):
    d = equality_table(spark, sf).withColumns({"improved": (F.col("gain") > 0).cast("int"), "total": F.lit(1)})
    return P.rate_bottom_k(d, ["procedure", "year", "dimension", "value"], "improved", "total", 10)


SQL_A14 = SQL_EQ_BASE + f"""SELECT procedure, year, dimension, value, improved, total, rate FROM (
  SELECT procedure, year, dimension, value, CAST(SUM(CAST(gain > 0 AS INTEGER)) AS BIGINT) AS improved,
         CAST(COUNT(*) AS BIGINT) AS total, {r6('CAST(SUM(CAST(gain > 0 AS INTEGER)) AS DOUBLE) / COUNT(*)')} AS rate
  FROM eq GROUP BY procedure, year, dimension, value)
ORDER BY rate NULLS LAST, procedure, year, dimension, value LIMIT 10"""


def a15_pivot(spark, sf):
    return P.count_pivot(stored_prom(spark, sf), "provider_code", "year", cat.YEARS)


SQL_A15 = ctes() + "SELECT provider_code, " + ", ".join(
    f"COUNT(*) FILTER (WHERE year = '{y}') AS \"{y}\"" for y in cat.YEARS) + " FROM prom GROUP BY provider_code"


def a16_crosstab(spark, sf):
    return P.crosstab_share(cleaned(spark, sf), "age_band", "gender")


SQL_A16 = ctes() + f"""SELECT age_band, gender, COUNT(*) AS n, {r6('CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM clean)')} AS share
FROM clean GROUP BY age_band, gender"""

A17_COLS = T1 + ["t1_eq_vas", "t0_eq_vas", "t0_symptom_period"]


def a17_outcome_by_missing(spark, sf):
    return P.outcome_by_missing(cleaned(spark, sf), A17_COLS, "oks_t0_score")


SQL_A17 = ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
    f"{r6(f'AVG(oks_t0_score) FILTER (WHERE {c} IS NULL)')} AS mean_if_missing, "
    f"{r6(f'AVG(oks_t0_score) FILTER (WHERE {c} IS NOT NULL)')} AS mean_if_present, "
    f"{r6(f'AVG(oks_t0_score) FILTER (WHERE {c} IS NULL) - AVG(oks_t0_score) FILTER (WHERE {c} IS NOT NULL)')} AS difference "
    f"FROM clean" for c in A17_COLS)


def a18_median_order(spark, sf):
    return P.group_median_order(scored(spark, sf), "age_band", "oks_t1_score")


SQL_A18 = ctes(scored_cte()) + f"""SELECT age_band, median, CAST(row_number() OVER (ORDER BY median DESC, age_band NULLS LAST) AS INTEGER) AS rank
FROM (SELECT age_band, {r6('MEDIAN(oks_t1_score)')} AS median FROM scored WHERE oks_t1_score IS NOT NULL GROUP BY age_band)"""


def a19_size_vs_outcome(spark, sf):
    d = scored(spark, sf).withColumn("gain", scores.gain("oks_t1_score", "oks_t0_score"))
    return P.size_vs_outcome(d, "provider_code", "gain")


SQL_A19 = ctes(scored_cte()) + f"""SELECT provider_code, COUNT(*) AS n, {r6('AVG(oks_t1_score - oks_t0_score)')} AS mean_outcome
FROM scored GROUP BY provider_code"""


def a20_histogram(spark, sf):
    return P.histogram(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice", 20)


SQL_A20 = f"""WITH mm AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem)
SELECT bin, COUNT(*) AS n, {r6('ANY_VALUE(lo) + bin * ANY_VALUE((hi - lo) / 20)')} AS left_edge FROM (
  SELECT lo, hi, CAST(CASE WHEN (hi - lo) / 20 = 0 THEN 0 ELSE LEAST(19, FLOOR((l_extendedprice - lo) / ((hi - lo) / 20))) END AS INTEGER) AS bin
  FROM lineitem, mm WHERE l_extendedprice IS NOT NULL) GROUP BY bin"""


def a21_binned_2d(spark, sf):
    return P.binned_2d(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_quantity", "l_extendedprice", 10)


def _bin_sql(c, lo, hi, k):
    return (f"CAST(CASE WHEN ({hi} - {lo}) / {k} = 0 THEN 0 ELSE LEAST({k - 1}, FLOOR(({c} - {lo}) / (({hi} - {lo}) / {k}))) END AS INTEGER)")


SQL_A21 = f"""WITH mm AS (SELECT MIN(l_quantity) AS xl, MAX(l_quantity) AS xh, MIN(l_extendedprice) AS yl, MAX(l_extendedprice) AS yh FROM lineitem)
SELECT xbin, ybin, COUNT(*) AS n FROM (
  SELECT {_bin_sql('l_quantity', 'xl', 'xh', 10)} AS xbin, {_bin_sql('l_extendedprice', 'yl', 'yh', 10)} AS ybin
  FROM lineitem, mm WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) GROUP BY xbin, ybin"""


def a22_box(spark, sf):
    d = scored(spark, sf).withColumn("gain", scores.gain("oks_t1_score", "oks_t0_score"))
    return P.box_stats(d, ["age_band"], "gain")


SQL_A22 = ctes(scored_cte(), """g AS (SELECT age_band, oks_t1_score - oks_t0_score AS gain FROM scored WHERE oks_t1_score IS NOT NULL),
q AS (SELECT age_band, quantile_cont(gain, 0.25) AS q1, quantile_cont(gain, 0.5) AS median, quantile_cont(gain, 0.75) AS q3 FROM g GROUP BY age_band)""") + \
    f"""SELECT g.age_band, COUNT(*) AS n, {r6('ANY_VALUE(q1)')} AS q1, {r6('ANY_VALUE(median)')} AS median, {r6('ANY_VALUE(q3)')} AS q3,
  {r6('MIN(gain) FILTER (WHERE gain >= q1 - 1.5 * (q3 - q1) AND gain <= q3 + 1.5 * (q3 - q1))')} AS whisker_low,
  {r6('MAX(gain) FILTER (WHERE gain >= q1 - 1.5 * (q3 - q1) AND gain <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  COUNT(*) FILTER (WHERE NOT (gain >= q1 - 1.5 * (q3 - q1) AND gain <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM g JOIN q ON g.age_band IS NOT DISTINCT FROM q.age_band GROUP BY g.age_band"""

A23_COLS = T0 + ["t0_eq_vas", "t1_eq_vas"]


def a23_rank_std(spark, sf):
    return P.rank_by_std(cleaned(spark, sf), A23_COLS)


SQL_A23 = ctes() + f"""SELECT column_name, std, CAST(row_number() OVER (ORDER BY std DESC NULLS LAST, column_name) AS INTEGER) AS rank FROM (
  """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r6(f'STDDEV_SAMP({c})')} AS std FROM clean" for c in A23_COLS) + ")"


def a24_dataset_summary(spark, sf):
    d = scored(spark, sf).select("procedure", *T0, "t0_eq_vas", "oks_t1_score")
    frames = {p: d.where(F.col("procedure") == p).drop("procedure") for p in cat.PROCEDURES}
    return P.dataset_summary(frames, "oks_t1_score")


SQL_A24 = ctes(scored_cte()) + " UNION ALL ".join(
    f"SELECT '{p}' AS dataset, COUNT(*) AS rows, {len(T0) + 1} AS features, "
    f"CAST(SUM({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in T0 + ['t0_eq_vas'])}) AS BIGINT) AS missing_cells, "
    f"{r6('AVG(oks_t1_score)')} AS target_mean, {r6('STDDEV_SAMP(oks_t1_score)')} AS target_std FROM scored WHERE procedure = '{p}'"
    for p in cat.PROCEDURES)


def a26_group_mean_fill(spark, sf):
    d = P.group_mean_fill(cleaned(spark, sf).select("record_id", "age_band", "t0_eq_vas"), "t0_eq_vas", ["age_band"])
    return d.select("record_id", F.round("t0_eq_vas", 6).alias("t0_eq_vas"))


SQL_A26 = ctes() + f"""SELECT record_id, {r6('COALESCE(CAST(t0_eq_vas AS DOUBLE), AVG(t0_eq_vas) OVER (PARTITION BY age_band))')} AS t0_eq_vas FROM clean"""

A27_COLS = ["t0_eq_vas", "t1_eq_vas", "oks_t0_pain", "oks_t1_stairs", "diabetes"]


def a27_before_after(spark, sf):
    return P.compare_frames(stored_prom(spark, sf), cleaned(spark, sf), A27_COLS)


SQL_A27 = ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM prom) AS missing_before, "
    f"(SELECT {r6(f'AVG({c})')} FROM prom) AS mean_before, (SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM clean) AS missing_after, "
    f"(SELECT {r6(f'AVG({c})')} FROM clean) AS mean_after" for c in A27_COLS)

A28_EXPECTED = T0[:3] + ["t0_eq5d_index", "t0_eq_vas", "revision_flag"]


def a28_expected(spark, sf):
    return P.expected_columns(cleaned(spark, sf), A28_EXPECTED)


SQL_A28 = ctes() + " UNION ALL ".join(
    (f"SELECT '{c}' AS column_name, TRUE AS present, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM clean"
     if c in ALL else f"SELECT '{c}' AS column_name, FALSE AS present, CAST(NULL AS BIGINT) AS n_missing")
    for c in A28_EXPECTED)


QUERIES = {
    "A01_missing_report": (a01_missing, ctes() + _missing_sql("clean", ALL)),
    "A02_sentinel_missing": (a02_sentinel_missing, ctes() + _missing_sql("prom", list(_SENT), sentinels=_SENT)),
    "A03_total_missing": (a03_total_missing, SQL_A03),
    "A04_missing_by_group": (a04_missing_by_group, ctes() + _missing_sql("clean", T1 + ["t1_eq_vas"], by=["procedure"])),
    "A05_value_counts_top10": (a05_value_counts, SQL_A05),
    "A06_boolean_counts": (a06_boolean_counts, SQL_A06),
    "A07_distinct_values": (a07_distinct, SQL_A07),
    "A08_prevalence": (a08_prevalence, SQL_A08),
    "A09_describe": (a09_describe, ctes() + _describe_sql("clean", NUM_COLS)),
    "A10_describe_strings": (a10_describe_strings, SQL_A10),
    "A11_grouped_describe": (a11_grouped_describe, ctes() + _describe_sql("clean", ["oks_t0_score", "t0_eq_vas"], ["procedure"])),
    "A12_grouped_sums": (a12_grouped_sums, SQL_A12),
    "A13_multi_function_agg": (a13_multi_function, SQL_A13),
    "A14_rate_bottom10": (a14_rate_bottom, SQL_A14),
    "A15_count_pivot": (a15_pivot, SQL_A15),
    "A16_crosstab_share": (a16_crosstab, SQL_A16),
    "A17_outcome_by_missing": (a17_outcome_by_missing, SQL_A17),
    "A18_group_median_order": (a18_median_order, SQL_A18),
    "A19_size_vs_outcome": (a19_size_vs_outcome, SQL_A19),
    "A20_histogram": (a20_histogram, SQL_A20),
    "A21_binned_2d": (a21_binned_2d, SQL_A21),
    "A22_box_stats": (a22_box, SQL_A22),
    "A23_rank_by_std": (a23_rank_std, SQL_A23),
    "A24_dataset_summary": (a24_dataset_summary, SQL_A24),
    "A26_group_mean_fill": (a26_group_mean_fill, SQL_A26),
    "A27_before_after": (a27_before_after, SQL_A27),
    "A28_expected_columns": (a28_expected, SQL_A28),
}


def a09_price_quantiles(spark, sf):
    """Quartiles and tails of a column with about as many values as rows, per group."""
    from ..operators.quantiles import grouped_percentiles
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    out = grouped_percentiles(li, ["l_returnflag", "l_linestatus"], "price", [0.01, 0.25, 0.5, 0.75, 0.99], ["p01", "p25", "p50", "p75", "p99"])
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("p01", "p25", "p50", "p75", "p99")])


SQL_A09_PRICE = "SELECT l_returnflag, l_linestatus, " + ", ".join(
    f"ROUND(quantile_cont(CAST(l_extendedprice AS DOUBLE), {q}), 6) AS {n}" for q, n in ((0.01, "p01"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.99, "p99"))) + \
    " FROM lineitem GROUP BY l_returnflag, l_linestatus"

QUERIES["A09_price_quantiles_by_group"] = (a09_price_quantiles, SQL_A09_PRICE)
