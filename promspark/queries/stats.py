"""Driver queries for statistics.

Oracles cover the statistics; p-values have no SQL equivalent (no t or
chi-square CDF in DuckDB), so the queries that add them are rows-only and
the CDF is unit-tested against published table values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions import scores
from ..operators import stats as S
from ..operators.encode import missing_indicators
from ._sql import ctes, r6, scored_cte
from .prep import T0, T1, cleaned, scored

FEATURES = T0 + ["oks_t0_score", "t0_eq_vas", "t0_symptom_period", "t0_mobility", "t0_discomfort"]
OUTCOME = "oks_t1_score"


def _scored_gain(spark, sf):
    return scored(spark, sf).withColumns({"gain": scores.gain("oks_t1_score", "oks_t0_score"),
                                          "oks_success": scores.success("oks_t1_score", "oks_t0_score")})


SCORED_GAIN_SQL = scored_cte() + """,
sg AS (SELECT *, oks_t1_score - oks_t0_score AS gain,
  CAST(COALESCE(oks_t1_score - oks_t0_score >= 6 OR oks_t1_score >= 26, FALSE) AS INTEGER) AS oks_success FROM scored)"""


def t01_pearson(spark, sf):
    return S.pearson(cleaned(spark, sf), ["t0_eq_vas", "t1_eq_vas", "t0_mobility"], "oks_t0_score", with_p=False)


SQL_T01 = ctes() + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r6(f'corr({f}, oks_t0_score)')} AS r, COUNT(*) AS n FROM clean "
    f"WHERE {f} IS NOT NULL AND oks_t0_score IS NOT NULL" for f in ["t0_eq_vas", "t1_eq_vas", "t0_mobility"])


def _rank_sql(x, part):
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + "
            f"(COUNT(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)")


def _spearman_sql(src, features, outcome, min_n=30, where=""):
    sel = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in features)
    return f"""SELECT feature, {r6('corr(rx, ry)')} AS r, COUNT(*) AS n FROM (
  SELECT feature, {_rank_sql('x', 'feature')} AS rx, {_rank_sql('y', 'feature')} AS ry FROM (
    SELECT * FROM (SELECT CAST({outcome} AS DOUBLE) AS y, {sel} FROM {src} {where})
    UNPIVOT (x FOR feature IN ({', '.join(features)})) WHERE x IS NOT NULL AND y IS NOT NULL))
GROUP BY feature HAVING COUNT(*) >= {min_n}"""


def t02_t18_spearman(spark, sf):
    return S.spearman(scored(spark, sf), FEATURES, OUTCOME, with_p=False)


def t02_t18_spearman_p(spark, sf):
    return S.spearman(scored(spark, sf), FEATURES, OUTCOME, with_p=True)


def t04_spearman_matrix(spark, sf):
    return S.corr_matrix(scored(spark, sf).select(T0), T0, "spearman")


def _matrix_sql(src, cols, ranked: bool):
    if ranked:
        inner = "SELECT " + ", ".join(f"{_rank_sql(c, '1')} AS {c}" for c in cols) + \
            f" FROM {src} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols)
    else:
        inner = f"SELECT {', '.join(cols)} FROM {src}"
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return f"m AS ({inner})", " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM m"
        for a, b in pairs)


def _pairwise_spearman_sql(src, cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, {r6('corr(rx, ry)')} AS r, COUNT(*) AS n FROM (
  SELECT {_rank_sql(a, '1')} AS rx, {_rank_sql(b, '1')} AS ry FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


PEARSON_COLS = ["oks_t0_score", "oks_t1_score", "t0_eq_vas", "t1_eq_vas", "t0_mobility", "t1_mobility"]


def t05_pearson_matrix(spark, sf):
    return S.corr_matrix(cleaned(spark, sf), PEARSON_COLS, "pearson")


MISS_COLS = T1[:6] + ["t0_eq_vas", "t1_eq_vas", "t0_mobility", "t1_anxiety", "oks_t0_score", "oks_t1_score"]
MISS_FLAGS = [c + "_is_missing" for c in MISS_COLS]


def _miss_matrix(spark, sf):
    df = missing_indicators(cleaned(spark, sf).select(MISS_COLS), MISS_COLS)
    return S.corr_matrix(df, MISS_FLAGS, "pearson")


def t06_strong_pairs(spark, sf):
    return S.strong_pairs(_miss_matrix(spark, sf), 0.3)


def t07_matrix_summary(spark, sf):
    return S.matrix_summary(_miss_matrix(spark, sf), 0.3)


_MISS_CTE = "mi AS (SELECT " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_is_missing" for c in MISS_COLS) + " FROM clean)"


def t08_ols(spark, sf):
    return S.ols(scored(spark, sf), "oks_t0_score", "oks_t1_score", with_p=False)


SQL_T08 = ctes(scored_cte()) + f"""SELECT {r6('regr_slope(oks_t1_score, oks_t0_score)')} AS slope,
  {r6('regr_intercept(oks_t1_score, oks_t0_score)')} AS intercept, {r6('corr(oks_t1_score, oks_t0_score)')} AS r,
  {r6('regr_r2(oks_t1_score, oks_t0_score)')} AS r2, CAST(regr_count(oks_t1_score, oks_t0_score) AS BIGINT) AS n FROM scored"""


def t09_t10_t17_effects(spark, sf):
    return S.group_effects(_scored_gain(spark, sf), cat.COMORBIDITIES, "gain", with_p=False)


def _welch_sql(src, flags, target, pos=1):
    parts = []
    for f in flags:
        on, off = f"{f} = {pos} AND {target} IS NOT NULL", f"{f} <> {pos} AND {target} IS NOT NULL"
        parts.append(f"""SELECT '{f}' AS feature, COUNT(*) FILTER (WHERE {on}) AS n1, AVG({target}) FILTER (WHERE {on}) AS m1,
  VAR_SAMP({target}) FILTER (WHERE {on}) AS v1, COUNT(*) FILTER (WHERE {off}) AS n0,
  AVG({target}) FILTER (WHERE {off}) AS m0, VAR_SAMP({target}) FILTER (WHERE {off}) AS v0 FROM {src}""")
    se2 = "(v1 / n1 + v0 / n0)"
    return f"""SELECT feature, n1 AS n_present, n0 AS n_absent, {r6('m1')} AS mean_present, {r6('m0')} AS mean_absent,
  {r6('m1 - m0')} AS difference, {r6(f'(m1 - m0) / sqrt({se2})')} AS t,
  {r6(f'{se2} * {se2} / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1))')} AS df,
  {r6('CASE WHEN sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) > 0 THEN (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) END')} AS cohens_d
FROM ({' UNION ALL '.join(parts)})"""


def t11_chi2(spark, sf):
    return S.chi2_2x2(_scored_gain(spark, sf), cat.COMORBIDITIES, "oks_success", with_p=False)


def _chi2_sql(src, flags, target):
    parts = []
    for f in flags:
        cells = ", ".join(f"CAST(COUNT(*) FILTER (WHERE {f} = {a} AND {target} = {b}) AS DOUBLE) AS c{a}{b}"
                          for a in (0, 1) for b in (0, 1))
        parts.append(f"SELECT '{f}' AS feature, {cells} FROM {src}")
    terms = []
    for o, r, k in (("c00", "(c00 + c01)", "(c00 + c10)"), ("c01", "(c00 + c01)", "(c01 + c11)"),
                    ("c10", "(c10 + c11)", "(c00 + c10)"), ("c11", "(c10 + c11)", "(c01 + c11)")):
        e = f"({r} * {k} / (c00 + c01 + c10 + c11))"
        terms.append(f"power(greatest(0.0, abs({o} - {e}) - 0.5), 2) / {e}")
    chi = " + ".join(terms)
    valid = "(c00 + c01) > 0 AND (c10 + c11) > 0 AND (c00 + c10) > 0 AND (c01 + c11) > 0"
    return f"""SELECT feature, CAST(c00 + c01 + c10 + c11 AS BIGINT) AS n, {r6(f'CASE WHEN {valid} THEN {chi} END')} AS chi2,
  {r6(f'CASE WHEN {valid} THEN sqrt(({chi}) / (c00 + c01 + c10 + c11)) END')} AS cramers_v
FROM ({' UNION ALL '.join(parts)})"""


def t12_chi2_scores(spark, sf):
    return S.chi2_scores(_scored_gain(spark, sf), T0, "oks_success", with_p=False)


def _chi2_scores_sql(src, feats, label):
    sums = ", ".join(f"SUM(CAST({f} AS DOUBLE)) AS {f}" for f in feats)
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r6(f'SUM(power({f} - nc / n * {f}_tot, 2) / (nc / n * {f}_tot))')} AS chi2, "
        f"ANY_VALUE(k) - 1 AS df FROM j" for f in feats)
    tots = ", ".join(f"SUM({f}) AS {f}_tot" for f in feats)
    return (f"pc AS (SELECT {label}, COUNT(*) AS nc, {sums} FROM {src} GROUP BY {label}),\n"
            f"tot AS (SELECT SUM(nc) AS n, COUNT(*) AS k, {tots} FROM pc),\n"
            f"j AS (SELECT * FROM pc, tot)\n{parts}")


def t15_f_regression(spark, sf):
    return S.f_regression(scored(spark, sf), FEATURES, OUTCOME, k=5)


def _f_sql(src, feats, target, k):
    pr = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, corr({f}, {target}) AS r, COUNT(*) FILTER (WHERE {f} IS NOT NULL AND {target} IS NOT NULL) AS n FROM {src}"
        for f in feats)
    return f"""SELECT * FROM (SELECT feature, {r6('r')} AS r, n, f_score, CAST(row_number() OVER (ORDER BY f_score DESC, feature) AS INTEGER) AS rank
  FROM (SELECT *, {r6('r * r / (1 - r * r) * (n - 2)')} AS f_score FROM ({pr}))) WHERE rank <= {k}"""


ADVICE_TEXT = ["gender", "age_band", "procedure"]
ADVICE_COLS = ADVICE_TEXT + ["t0_assisted", "t0_eq_vas", "t1_eq_vas", "oks_t1_score", "t1_mobility", "oks_t0_pain", "t0_symptom_period"]


def t16_advice(spark, sf):
    return S.imputation_advice(cleaned(spark, sf), ADVICE_COLS)


def _advice_sql():
    parts = []
    for c in ADVICE_COLS:
        if c in ADVICE_TEXT:
            v, skew, text = f"CASE WHEN {c} NOT IN ('', '*') THEN {c} END", "CAST(NULL AS DOUBLE)", "TRUE"
        else:
            v, text = f"CASE WHEN {c} <> 999 THEN {c} END", "FALSE"
            mean = f"(SELECT AVG({v}) FROM clean)"
            skew = f"AVG(power({v} - {mean}, 3)) / power(AVG(power({v} - {mean}, 2)), 1.5)"
        parts.append(f"""SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*) AS missing_pct,
  COUNT(DISTINCT {v}) AS n_unique, {skew} AS skewness, {text} AS is_text FROM clean""")
    return ctes() + f"""SELECT column_name, {r6('missing_pct')} AS missing_pct, n_unique, {r6('skewness')} AS skewness,
  CASE WHEN missing_pct > 50.0 THEN 'drop' WHEN is_text OR n_unique = 2 THEN 'mode'
       WHEN abs(skewness) > 1.0 THEN 'median' ELSE 'mean' END AS strategy
FROM ({' UNION ALL '.join(parts)})"""


def cohort_rankings(spark, sf):
    """Spearman tables of both cohorts from one pass (procedure as a key)."""
    return S.spearman(scored(spark, sf), FEATURES, OUTCOME, with_p=False, by=["procedure"])


def t19_cross_cohort(spark, sf):
    r = cohort_rankings(spark, sf)
    knee = r.where(F.col("procedure") == "Knee Replacement")
    hip = r.where(F.col("procedure") == "Hip Replacement")
    j = knee.select("feature", F.col("r").alias("r_knee")).join(hip.select("feature", F.col("r").alias("r_hip")),
                                                                  "feature", "inner")
    return j.agg(F.count(F.lit(1)).alias("shared_features"),
                 F.round(F.corr("r_knee", "r_hip"), 6).alias("agreement_r"),
                 F.round(F.regr_slope("r_hip", "r_knee"), 6).alias("slope"),
                 F.round(F.regr_intercept("r_hip", "r_knee"), 6).alias("intercept"))


def t20_missing_vs_target(spark, sf):
    return S.missing_vs_target(cleaned(spark, sf), MISS_COLS[:-2], "oks_t0_score", with_p=False)


def t20_fdr_report(spark, sf):
    r = S.missing_vs_target(cleaned(spark, sf), MISS_COLS[:-2], "oks_t0_score", with_p=True)
    return r.withColumn("shortlist", F.col("reject") & (F.abs(F.col("cohens_d")) >= 0.1))


def t13_t14_effects_fdr(spark, sf):
    eff = S.group_effects(_scored_gain(spark, sf), cat.COMORBIDITIES, "gain", with_p=True)
    adj = S.bh_adjust(eff, "p_value", 0.05)
    return adj.withColumn("shortlist", F.col("reject") & (F.abs(F.col("cohens_d")) >= 0.1))


def t21_nzv(spark, sf):
    return S.near_zero_variance(cleaned(spark, sf), ["t0_eq_vas", "oks_t0_pain", "diabetes", "t0_assisted"], 0.0)


SQL_T21 = ctes() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r6(f'VAR_SAMP({c})')} AS variance, VAR_SAMP({c}) <= 0.0 AS near_zero FROM clean"
    for c in ["t0_eq_vas", "oks_t0_pain", "diabetes", "t0_assisted"])


QUERIES = {
    "T01_pearson_pairs": (t01_pearson, SQL_T01),
    "T02_T18_spearman_ranked": (t02_t18_spearman, ctes(scored_cte()) + _spearman_sql("scored", FEATURES, OUTCOME)),
    "T02_T18_D22_spearman_with_p": (t02_t18_spearman_p, None),
    "T04_spearman_matrix": (t04_spearman_matrix, ctes(scored_cte()) + _pairwise_spearman_sql("scored", T0)),
    "T05_pearson_matrix": (t05_pearson_matrix, ctes(_matrix_sql("clean", PEARSON_COLS, False)[0]) + _matrix_sql("clean", PEARSON_COLS, False)[1]),
    "T06_W05_missingness_strong_pairs": (t06_strong_pairs, ctes(_MISS_CTE, _matrix_sql("mi", MISS_FLAGS, False)[0], "mm AS (" + _matrix_sql("mi", MISS_FLAGS, False)[1] + ")") + "SELECT * FROM mm WHERE abs(r) > 0.3"),
    "T07_matrix_summary": (t07_matrix_summary, ctes(_MISS_CTE, _matrix_sql("mi", MISS_FLAGS, False)[0], "mm AS (" + _matrix_sql("mi", MISS_FLAGS, False)[1] + ")") +
        f"""SELECT COUNT(r) AS n_pairs, COUNT(*) FILTER (WHERE r > 0.3) AS n_strong_pos, COUNT(*) FILTER (WHERE r < -0.3) AS n_strong_neg,
  {r6('AVG(r)')} AS mean_r, {r6('AVG(abs(r))')} AS mean_abs_r FROM mm"""),
    "T08_ols": (t08_ols, SQL_T08),
    "T09_T10_T17_binary_effects": (t09_t10_t17_effects, ctes(SCORED_GAIN_SQL) + _welch_sql("sg", cat.COMORBIDITIES, "gain")),
    "T11_chi2_yates_cramer": (t11_chi2, ctes(SCORED_GAIN_SQL) + _chi2_sql("sg", cat.COMORBIDITIES, "oks_success")),
    "T12_chi2_feature_scores": (t12_chi2_scores, ctes(SCORED_GAIN_SQL, _chi2_scores_sql("sg", T0, "oks_success"))),
    "T13_T14_effects_fdr_shortlist": (t13_t14_effects_fdr, None),
    "T15_f_regression_top5": (t15_f_regression, ctes(scored_cte()) + _f_sql("scored", FEATURES, OUTCOME, 5)),
    "T16_imputation_advice": (t16_advice, _advice_sql()),
    "T19_cross_cohort_agreement": (t19_cross_cohort, ctes(scored_cte(),
        f"k AS ({_spearman_sql('scored', FEATURES, OUTCOME, where=chr(32) + 'WHERE procedure = ' + chr(39) + 'Knee Replacement' + chr(39))})",
        f"h AS ({_spearman_sql('scored', FEATURES, OUTCOME, where=chr(32) + 'WHERE procedure = ' + chr(39) + 'Hip Replacement' + chr(39))})") +
        f"""SELECT COUNT(*) AS shared_features, {r6('corr(k.r, h.r)')} AS agreement_r, {r6('regr_slope(h.r, k.r)')} AS slope,
  {r6('regr_intercept(h.r, k.r)')} AS intercept FROM k JOIN h ON k.feature = h.feature"""),
    "T20_missing_vs_target": (t20_missing_vs_target, None),  # oracle set below
    "T20_T13_T14_fdr_report": (t20_fdr_report, None),
    "T21_near_zero_variance": (t21_nzv, SQL_T21),
}


# -- T03 Kendall, T22 patterns ---------------------------------------------------

def t03_kendall(spark, sf):
    return S.kendall_tau_b(cleaned(spark, sf), "t0_eq_vas", "oks_t0_score", with_p=False)


def t03_kendall_continuous(spark, sf):
    """Balance and total spending of customers: as many levels as rows."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.sum("o_totalprice").cast("decimal(18,2)").alias("spent"))
    c = spark.read.parquet(f"{sf}/customer.parquet").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return S.kendall_tau_b(c, "c_acctbal", "spent", with_p=False)


SQL_T03_CONTINUOUS = f"""WITH o AS (SELECT o_custkey, CAST(SUM(o_totalprice) AS DECIMAL(18,2)) AS spent FROM orders GROUP BY 1),
r AS (SELECT CAST(c_acctbal AS DOUBLE) AS x, CAST(spent AS DOUBLE) AS y FROM customer JOIN o ON c_custkey = o_custkey),
s AS (SELECT CAST(SUM(sign(b.y - a.y)) AS DOUBLE) AS s FROM r a JOIN r b ON a.x < b.x),
tot AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM r),
tx AS (SELECT SUM(t * (t - 1) / 2) AS tie, SUM(t * (t - 1) * (t - 2)) AS t0, SUM(t * (t - 1) * (2 * t + 5)) AS t1 FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS t FROM r GROUP BY x)),
ty AS (SELECT SUM(t * (t - 1) / 2) AS tie, SUM(t * (t - 1) * (t - 2)) AS t0, SUM(t * (t - 1) * (2 * t + 5)) AS t1 FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS t FROM r GROUP BY y))
SELECT 'c_acctbal' AS x, 'spent' AS y, CAST(n AS BIGINT) AS n, s,
  {r6('s / sqrt((n * (n - 1) / 2 - tx.tie) * (n * (n - 1) / 2 - ty.tie))')} AS tau_b,
  {r6('s / sqrt((n * (n - 1) * (2 * n + 5) - tx.t1 - ty.t1) / 18 + 2 * tx.tie * ty.tie / (n * (n - 1)) + tx.t0 * ty.t0 / (9 * n * (n - 1) * (n - 2)))')} AS z
FROM s, tot, tx, ty"""


def t03_kendall_p(spark, sf):
    return S.kendall_tau_b(cleaned(spark, sf), "t0_eq_vas", "oks_t0_score", with_p=True)


def _ties_sql(name, col):
    return (f"{name} AS (SELECT SUM(t * (t - 1) / 2) AS tie, SUM(t * (t - 1) * (t - 2)) AS t0, "
            f"SUM(t * (t - 1) * (2 * t + 5)) AS t1 FROM (SELECT CAST(SUM(n) AS DOUBLE) AS t FROM c GROUP BY {col}))")


SQL_T03 = ctes("""c AS (SELECT CAST(t0_eq_vas AS DOUBLE) AS x, CAST(oks_t0_score AS DOUBLE) AS y, COUNT(*) AS n FROM clean
  WHERE t0_eq_vas IS NOT NULL AND oks_t0_score IS NOT NULL GROUP BY 1, 2)""",
               "s AS (SELECT CAST(SUM(a.n * b.n * sign(b.y - a.y)) AS DOUBLE) AS s FROM c a JOIN c b ON a.x < b.x)",
               "tot AS (SELECT CAST(SUM(n) AS DOUBLE) AS n FROM c)", _ties_sql("tx", "x"), _ties_sql("ty", "y")) + \
    f"""SELECT 't0_eq_vas' AS x, 'oks_t0_score' AS y, CAST(n AS BIGINT) AS n, s,
  {r6('s / sqrt((n * (n - 1) / 2 - tx.tie) * (n * (n - 1) / 2 - ty.tie))')} AS tau_b,
  {r6('s / sqrt((n * (n - 1) * (2 * n + 5) - tx.t1 - ty.t1) / 18 + (2 * tx.tie * ty.tie) / (n * (n - 1)) + tx.t0 * ty.t0 / (9 * n * (n - 1) * (n - 2)))')} AS z
FROM s, tot, tx, ty"""

PATTERN_COLS = MISS_COLS


def t22_patterns(spark, sf):
    return S.missing_patterns(cleaned(spark, sf), PATTERN_COLS, top=10)


SQL_T22 = ctes() + f"""SELECT * FROM (SELECT mask, n, n_missing_cols, missing_share,
  CAST(row_number() OVER (ORDER BY n DESC, mask) AS INTEGER) AS rank FROM (
  SELECT mask, COUNT(*) AS n, CAST(length(replace(mask, '0', '')) AS INTEGER) AS n_missing_cols,
    {r6(f"length(replace(mask, '0', '')) / {float(len(MISS_COLS))}")} AS missing_share
  FROM (SELECT {' || '.join(f'CAST(CAST({c} IS NULL AS INTEGER) AS VARCHAR)' for c in MISS_COLS)} AS mask FROM clean)
  GROUP BY mask)) WHERE rank <= 10"""


def t22_clusters(spark, sf):
    return S.pattern_clusters(cleaned(spark, sf), PATTERN_COLS, k=4)


QUERIES.update({
    "T03_kendall_tau_b": (t03_kendall, SQL_T03),
    "T03_kendall_continuous": (t03_kendall_continuous, SQL_T03_CONTINUOUS),
    "T03_kendall_with_p": (t03_kendall_p, None),
    "T22_missingness_patterns": (t22_patterns, SQL_T22),
    "T22_pattern_clusters": (t22_clusters, None),
})


def d22_strength(spark, sf):
    r = S.spearman(scored(spark, sf), FEATURES, OUTCOME, with_p=False)
    from ..functions.scores import strength_label
    return r.select("feature", "r", strength_label("r").alias("strength"))


SQL_D22 = ctes(scored_cte()) + f"""SELECT feature, r, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate'
  WHEN abs(r) >= 0.2 THEN 'Weak' WHEN r IS NOT NULL THEN 'Negligible' END AS strength
FROM ({_spearman_sql('scored', FEATURES, OUTCOME)})"""

QUERIES["D22_strength_labels"] = (d22_strength, SQL_D22)


def _t20_sql():
    cols = MISS_COLS[:-2]
    flags_cte = "mv AS (SELECT oks_t0_score, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in cols) + " FROM clean)"
    inner = _welch_sql("mv", cols, "oks_t0_score")
    return ctes(flags_cte) + f"""SELECT feature, n_present AS missing_count, n_absent AS present_count,
  mean_present AS target_mean_missing, mean_absent AS target_mean_present, difference, t, df, cohens_d
FROM ({inner}) WHERE n_present >= 10 AND n_absent > 0"""


QUERIES["T20_missing_vs_target"] = (t20_missing_vs_target, _t20_sql())


def e2_correlation_report(spark, sf):
    """Entry 2 as one job: the top-15 table of knee vs hip rankings."""
    from ..plans.correlation_report import correlation_report
    rep = correlation_report(scored(spark, sf), FEATURES, OUTCOME)
    return rep.top15


def e2_effects(spark, sf):
    from ..plans.correlation_report import correlation_report
    return correlation_report(scored(spark, sf), FEATURES, OUTCOME).effects


QUERIES["E2_J07_correlation_top15"] = (e2_correlation_report, None)
QUERIES["E2_T17_T13_effects_table"] = (e2_effects, None)


def _e2_sql():
    knee = _spearman_sql("scored", FEATURES, OUTCOME, where=" WHERE procedure = 'Knee Replacement'")
    hip = _spearman_sql("scored", FEATURES, OUTCOME, where=" WHERE procedure = 'Hip Replacement'")
    return ctes(scored_cte(),
                f"k AS (SELECT feature, r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS position FROM ({knee}))",
                f"h AS (SELECT feature, r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS position FROM ({hip}))") + \
        """SELECT CAST(COALESCE(k.position, h.position) AS INTEGER) AS position, k.feature AS knee_feature, k.r AS knee_r,
  h.feature AS hip_feature, h.r AS hip_r
FROM (SELECT * FROM k WHERE position <= 15) k FULL JOIN (SELECT * FROM h WHERE position <= 15) h ON k.position = h.position"""


QUERIES["E2_J07_correlation_top15"] = (e2_correlation_report, _e2_sql())


def t20_binary_target(spark, sf):
    d = _scored_gain(spark, sf)
    return S.missing_vs_target(d, ["t0_eq_vas", "t1_eq_vas", "t0_mobility", "t1_anxiety", "t0_symptom_period"],
                               "oks_success", kind="binary", with_p=False)


def _t20b_sql():
    cols = ["t0_eq_vas", "t1_eq_vas", "t0_mobility", "t1_anxiety", "t0_symptom_period"]
    mv = "mb AS (SELECT oks_success, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in cols) + " FROM sg)"
    cnt = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(SUM({c}) AS BIGINT) AS missing_count FROM mb" for c in cols)
    return ctes(SCORED_GAIN_SQL, mv) + f"""SELECT x.feature, x.n, x.chi2, x.cramers_v, m.missing_count
FROM ({_chi2_sql("mb", cols, "oks_success")}) x JOIN ({cnt}) m ON x.feature = m.feature
WHERE m.missing_count >= 10 AND m.missing_count < x.n"""


QUERIES["T20_binary_target_chi2"] = (t20_binary_target, _t20b_sql())
