"""Association statistics (T01-T22) as DataFrame jobs.

Shape of every test: one wide aggregate for all features (moments, counts,
co-moments), ``unpivot`` / ``explode`` to one row per feature, then the
statistic and its p-value on that small table.  Rank statistics rank each
feature's *distinct values* (a per-(feature, value) count table with a
running sum), then join the ranks back by equi-join, so no window ever
spans base rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_p_value, corr_t, t_p_value
from ..functions.scores import significance_stars
from .running import running_before


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _explode_rows(wide: DataFrame, rows: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


# -- ranks ---------------------------------------------------------------------

def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank",
               buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Average rank (ties get the mean of their positions) per distinct
    value within ``by`` groups: (by..., value, rank).  Runs over the
    distinct-value count table, never over rows (see ``running_before``).
    ``weight`` = a count column when ``df`` is already a count table."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(n.alias("__c"))
    c = running_before(counts, value, "__c", by, buckets)
    return c.select(*by, value, (F.col("__before") + (F.col("__c") + 1) / 2.0).alias(name))


def with_ranks(df: DataFrame, cols: Sequence[str], suffix: str = "__rank") -> DataFrame:
    """Append average-rank columns for each column.  One unpivot + one rank
    table for all columns (distinct values only); each column joins its
    slice back by equi-join (the slices share one exchange)."""
    cols = list(cols)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, "__col", "__v").where(F.col("__v").isNotNull())
    # the rank table (distinct values only) is materialised once in the
    # shared checkpoint folder; otherwise each column's filtered slice would
    # be pushed down and rebuild it
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession, allow_local=True)
    ranks = rank_table(long, "__v", ["__col"], "__r").checkpoint(eager=True)
    out = df
    for c in cols:
        r = ranks.where(F.col("__col") == c).select(F.col("__v").alias(f"__k_{c}"), F.col("__r").alias(c + suffix))
        out = out.join(r, F.col(c).cast("double") == F.col(f"__k_{c}"), "left").drop(f"__k_{c}")
    return out


def _feature_long(df: DataFrame, features: Sequence[str], outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, x, y) on pairwise-complete rows, one scan."""
    base = df.select(*by, F.col(outcome).cast("double").alias("__y"),
                     *[F.col(f).cast("double").alias(f) for f in features])
    long = base.unpivot([*by, "__y"], list(features), "feature", "x")
    return long.where(F.col("x").isNotNull() & F.col("__y").isNotNull()).withColumnRenamed("__y", "y")


# -- correlations ----------------------------------------------------------------

def pearson(df: DataFrame, features: Sequence[str], outcome: str, with_p: bool = True) -> DataFrame:
    """Pearson r and n for each feature against the outcome on
    pairwise-complete rows (Spark ``corr`` skips rows with a null side)."""
    return _with_corr_p(_pearson(df, features, outcome), with_p)


def _pearson(df: DataFrame, features: Sequence[str], outcome: str) -> DataFrame:
    """(feature, r, n) at full precision."""
    aggs = []
    for f in features:
        both = F.col(f).isNotNull() & F.col(outcome).isNotNull()
        aggs += [F.corr(F.col(f).cast("double"), F.col(outcome).cast("double")).alias(f"{f}__r"),
                 F.count_if(both).alias(f"{f}__n")]
    wide = df.agg(*aggs)
    return _explode_rows(wide, [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__r").alias("r"),
                                         F.col(f"{f}__n").alias("n")) for f in features])


def _with_corr_p(out: DataFrame, with_p: bool) -> DataFrame:
    """The p-value comes from r as computed; r is rounded last."""
    if with_p:
        t = corr_t(F.col("r"), F.col("n"))
        out = out.withColumn("p_value", t_p_value(t, F.col("n") - 2)) \
            .withColumn("stars", significance_stars("p_value"))
    return out.withColumn("r", _r6(F.col("r")))


def _weighted_rank_corr(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman rho per ``keys`` group from a (keys..., x, y, n) count table:
    ranks from weighted running sums, then the count-weighted Pearson
    correlation of the ranks over the cells (equal to Pearson over rows,
    because every row of a cell has the same pair of ranks)."""
    keys = list(keys)
    rx = rank_table(cells, "x", keys, "rx", weight="n")
    ry = rank_table(cells, "y", keys, "ry", weight="n")
    c = cells.join(rx, [*keys, "x"]).join(ry, [*keys, "y"])
    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = c.groupBy(*keys).agg(F.sum(n).alias("s"), F.sum(n * a).alias("sx"), F.sum(n * b).alias("sy"),
                                F.sum(n * a * a).alias("sxx"), F.sum(n * b * b).alias("syy"),
                                F.sum(n * a * b).alias("sxy"))
    s0, sx, sy = F.col("s"), F.col("sx"), F.col("sy")
    den = F.sqrt((s0 * F.col("sxx") - sx * sx) * (s0 * F.col("syy") - sy * sy))
    return sums.select(*keys, F.when(den > 0, (s0 * F.col("sxy") - sx * sy) / den).alias("r"),
                       F.col("s").cast("long").alias("n"))


def spearman(df: DataFrame, features: Sequence[str], outcome: str, min_n: int = 30,
             with_p: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Spearman rho per feature vs outcome, ranks computed on each
    feature's pairwise-complete rows; features with n < min_n are left out.
    ``by`` gives one table per group (e.g. per cohort) from the same pass.

    Base rows are read once, into a (by..., feature, x, y) count table
    (checkpointed: it feeds both rank tables and the final sums)."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession, allow_local=True)
    by = list(by)
    long = _feature_long(df, features, outcome, by)
    cells = long.groupBy(*by, "feature", "x", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    out = _weighted_rank_corr(cells, [*by, "feature"]).where(F.col("n") >= min_n)
    return _with_corr_p(out, with_p)


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman matrix (a, b, r, n) for all a < b, as
    ``DataFrame.corr(method='spearman')`` in pandas.  Each row contributes
    one (pair, x, y) entry per pair where both are present; partial
    aggregation collapses them map-side into a (pair, x, y) count table, and
    every pair is ranked on its own complete rows."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession, allow_local=True)
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                 F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                        for a, b in pairs])
    long = df.select(F.explode(entries).alias("e")).select("e.*") \
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cells = long.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return _weighted_rank_corr(cells, ["a", "b"]).select("a", "b", _r6(F.col("r")).alias("r"), "n")


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix (a, b, r, n) for all pairs a < b.

    Pearson and Spearman are pairwise complete; ``spearman_listwise`` ranks
    each column once on the rows complete for all ``cols`` and takes Pearson
    of the ranks in one aggregate."""
    cols = list(cols)
    src = df
    if method == "spearman":
        return spearman_matrix(df, cols)
    if method == "spearman_listwise":
        src = with_ranks(df.na.drop(subset=cols), cols)
        use = {c: c + "__rank" for c in cols}
    elif method == "pearson":
        use = {c: c for c in cols}
    else:
        raise ValueError(method)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for a, b in pairs:
        aggs += [F.corr(F.col(use[a]).cast("double"), F.col(use[b]).cast("double")).alias(f"{a}__{b}__r"),
                 F.count_if(F.col(use[a]).isNotNull() & F.col(use[b]).isNotNull()).alias(f"{a}__{b}__n")]
    wide = src.agg(*aggs)
    return _explode_rows(wide, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                         _r6(F.col(f"{a}__{b}__r")).alias("r"),
                                         F.col(f"{a}__{b}__n").alias("n")) for a, b in pairs])


def strong_pairs(matrix: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold."""
    return matrix.where(F.abs(F.col("r")) > threshold)


def matrix_summary(matrix: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Number of pairs, strong positive / negative, signed and absolute
    mean (the notebook calls the signed mean 'average absolute')."""
    r = F.col("r")
    return matrix.agg(F.count(r).alias("n_pairs"), F.count_if(r > threshold).alias("n_strong_pos"),
                      F.count_if(r < -threshold).alias("n_strong_neg"),
                      _r6(F.avg(r)).alias("mean_r"), _r6(F.avg(F.abs(r))).alias("mean_abs_r"))


def ols(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """T08 / M01 with one feature: slope, intercept, r, r2, n, p."""
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.agg(_r6(F.regr_slope(yy, xx)).alias("slope"), _r6(F.regr_intercept(yy, xx)).alias("intercept"),
                 F.corr(xx, yy).alias("r"), _r6(F.regr_r2(yy, xx)).alias("r2"),
                 F.regr_count(yy, xx).alias("n"))
    return _with_corr_p(out, with_p)


# -- group comparisons -------------------------------------------------------------

def group_effects(df: DataFrame, flags: Sequence[str], target: str, positive=1,
                  with_p: bool = True) -> DataFrame:
    """For every binary flag, target mean / sd / n where the
    flag is set vs not, difference, Welch t and df, Cohen's d (pooled sd).
    One aggregate for all flags."""
    y = F.col(target).cast("double")
    aggs = []
    for f in flags:
        on = (F.col(f) == positive) & y.isNotNull()
        off = (F.col(f) != positive) & y.isNotNull()
        aggs += [F.count_if(on).alias(f"{f}__n1"), F.avg(F.when(on, y)).alias(f"{f}__m1"),
                 F.var_samp(F.when(on, y)).alias(f"{f}__v1"),
                 F.count_if(off).alias(f"{f}__n0"), F.avg(F.when(off, y)).alias(f"{f}__m0"),
                 F.var_samp(F.when(off, y)).alias(f"{f}__v0")]
    wide = df.agg(*aggs)
    cols = ["n1", "m1", "v1", "n0", "m0", "v0"]
    long = _explode_rows(wide, [F.struct(F.lit(f).alias("feature"),
                                         *[F.col(f"{f}__{c}").alias(c) for c in cols]) for f in flags])
    return welch_table(long, with_p)


def welch_table(long: DataFrame, with_p: bool = True) -> DataFrame:
    """Welch t, df and Cohen's d from (n1, m1, v1, n0, m0, v0) rows."""
    n1, m1, v1, n0, m0, v0 = (F.col(c) for c in ["n1", "m1", "v1", "n0", "m0", "v0"])
    se2 = v1 / n1 + v0 / n0
    t = (m1 - m0) / F.sqrt(se2)
    dfw = se2 * se2 / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v0 / n0) * (v0 / n0) / (n0 - 1))
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
    out = long.select("feature", n1.alias("n_present"), n0.alias("n_absent"),
                      _r6(m1).alias("mean_present"), _r6(m0).alias("mean_absent"),
                      _r6(m1 - m0).alias("difference"), _r6(t).alias("t"), _r6(dfw).alias("df"),
                      _r6(F.when(pooled > 0, (m1 - m0) / pooled)).alias("cohens_d"))
    if with_p:
        out = out.withColumn("p_value", t_p_value(F.col("t"), F.col("df"))) \
            .withColumn("stars", significance_stars("p_value"))
    return out


def chi2_2x2(df: DataFrame, flags: Sequence[str], target: str, yates: bool = True,
             with_p: bool = True) -> DataFrame:
    """Chi-square of each 0/1 flag against a 0/1 target (2x2, Yates
    continuity correction as scipy applies by default), Cramér's V = sqrt(chi2/n)."""
    y = F.col(target).cast("int")
    aggs = []
    for f in flags:
        x = F.col(f).cast("int")
        for a in (0, 1):
            for b in (0, 1):
                aggs.append(F.count_if((x == a) & (y == b)).alias(f"{f}__{a}{b}"))
    wide = df.agg(*aggs)
    long = _explode_rows(wide, [F.struct(F.lit(f).alias("feature"),
                                         *[F.col(f"{f}__{a}{b}").cast("double").alias(f"c{a}{b}")
                                           for a in (0, 1) for b in (0, 1)]) for f in flags])
    c00, c01, c10, c11 = (F.col(c) for c in ["c00", "c01", "c10", "c11"])
    n = c00 + c01 + c10 + c11
    r0, r1, k0, k1 = c00 + c01, c10 + c11, c00 + c10, c01 + c11
    terms = []
    for obs, rr, kk in ((c00, r0, k0), (c01, r0, k1), (c10, r1, k0), (c11, r1, k1)):
        exp = rr * kk / n
        dev = F.abs(obs - exp)
        if yates:
            dev = F.greatest(F.lit(0.0), dev - 0.5)
        terms.append(dev * dev / exp)
    chi2 = terms[0] + terms[1] + terms[2] + terms[3]
    valid = (r0 > 0) & (r1 > 0) & (k0 > 0) & (k1 > 0)
    out = long.select("feature", n.cast("long").alias("n"), _r6(F.when(valid, chi2)).alias("chi2"),
                      _r6(F.when(valid, F.sqrt(chi2 / n))).alias("cramers_v"))
    if with_p:
        out = out.withColumn("p_value", chi2_p_value(F.col("chi2"), F.lit(1)))
    return out


def chi2_scores(df: DataFrame, features: Sequence[str], label: str, with_p: bool = True) -> DataFrame:
    """Chi-square score of non-negative features against a class label
    (observed = feature sum per class, expected = class share x feature
    total; df = classes - 1)."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"),
                                      *[F.sum(F.col(f).cast("double")).alias(f) for f in features])
    # totals over the (small) per-class table by a window, not a join
    wall = Window.partitionBy()
    j = per_class.select("*", F.sum("__nc").over(wall).alias("__n"), F.count(F.lit(1)).over(wall).alias("__k"),
                         *[F.sum(f).over(wall).alias(f"{f}__tot") for f in features])
    aggs = []
    for f in features:
        exp = F.col("__nc") / F.col("__n") * F.col(f"{f}__tot")
        aggs.append(F.sum((F.col(f) - exp) * (F.col(f) - exp) / exp).alias(f))
    wide = j.groupBy("__k").agg(*aggs)
    long = _explode_rows(wide, [F.struct(F.lit(f).alias("feature"), _r6(F.col(f)).alias("chi2"),
                                         (F.col("__k") - 1).alias("df")) for f in features])
    if with_p:
        long = long.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("df")))
    return long


def bh_adjust(df: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p (monotone, capped at 1) and the
    reject flag.  Runs on a result table (one row per test)."""
    w_rank = Window.partitionBy(*by).orderBy(F.col(p).asc(), "feature")
    w_all = Window.partitionBy(*by)
    ranked = df.where(F.col(p).isNotNull()).withColumn("__rank", F.row_number().over(w_rank)) \
        .withColumn("__m", F.count(F.lit(1)).over(w_all))
    raw = F.col(p) * F.col("__m") / F.col("__rank")
    w_cummin = Window.partitionBy(*by).orderBy(F.col("__rank").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adj = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min(raw).over(w_cummin)))
    return adj.withColumn("reject", F.col("p_adj") <= alpha).drop("__rank", "__m")


def f_regression(df: DataFrame, features: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature (univariate linear
    regression test); ``k`` keeps the best k."""
    out = _pearson(df, features, target).withColumn("f_score", F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2))
    # F comes from r as computed; equal features (whose F differs in the last digits only) rank by name
    out = out.withColumns({"r": _r6(F.col("r")), "f_score": _r6(F.col("f_score"))})
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f_score"), "feature")))
    return out.where(F.col("rank") <= k) if k else out


def imputation_advice(df: DataFrame, cols: Sequence[str], drop_above: float = 50.0,
                      skew_limit: float = 1.0) -> DataFrame:
    """Missing %, distinct values, population skewness and the suggested
    strategy: drop > 50 % missing, mode for string and two-valued columns,
    median if |skew| > 1, else mean.  Sentinels ('' and '*', 999) are left out
    of values and moments.  Moments in one aggregate; distinct values from a
    (column, value) table that partial aggregation collapses map-side."""
    text = {c for c, t in df.dtypes if t == "string"}

    def value(c: str) -> Column:
        return F.when(~F.col(c).isin("", "*"), F.col(c)) if c in text else F.when(F.col(c) != 999, F.col(c).cast("double"))

    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__m"), F.count(F.lit(1)).alias(f"{c}__n"),
                 (F.lit(None).cast("double") if c in text else F.skewness(value(c))).alias(f"{c}__s")]
    wide = df.agg(*aggs)
    long = _explode_rows(wide, [F.struct(F.lit(c).alias("column_name"), F.lit(c in text).alias("is_text"),
                                         (F.col(f"{c}__m") * 100.0 / F.col(f"{c}__n")).alias("missing_pct"),
                                         F.col(f"{c}__s").alias("skewness")) for c in cols])
    values = df.select(*[value(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "v")
    unique = values.where(F.col("v").isNotNull()).distinct().groupBy("column_name").agg(F.count("v").alias("n_unique"))
    out = long.join(unique, "column_name", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    strategy = (F.when(F.col("missing_pct") > drop_above, "drop").when(F.col("is_text") | (F.col("n_unique") == 2), "mode")
                .when(F.abs(F.col("skewness")) > skew_limit, "median").otherwise("mean"))
    return out.select("column_name", _r6(F.col("missing_pct")).alias("missing_pct"), "n_unique", _r6(F.col("skewness")).alias("skewness"),
                      strategy.alias("strategy"))


def near_zero_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Sample variance per column and whether it is at most ``threshold``."""
    wide = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column_name", "variance")
    return long.select("column_name", _r6(F.col("variance")).alias("variance"),
                       (F.col("variance") <= threshold).alias("near_zero"))


def missing_vs_target(df: DataFrame, cols: Sequence[str], target: str, kind: str = "continuous",
                      min_missing: int = 10, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """For each column's missingness mask: counts, target means by mask,
    difference; Welch t + Cohen's d (continuous target) or Yates chi-square +
    Cramér's V (binary target); columns with < min_missing missing or a
    constant mask are skipped; BH over the tested columns."""
    flags = [f"{c}__miss" for c in cols]
    masked = df.select(F.col(target), *[F.col(c).isNull().cast("int").alias(f"{c}__miss") for c in cols])
    if kind == "continuous":
        res = group_effects(masked, flags, target, positive=1, with_p=with_p)
        res = res.withColumnRenamed("n_present", "missing_count").withColumnRenamed("n_absent", "present_count") \
            .withColumnRenamed("mean_present", "target_mean_missing").withColumnRenamed("mean_absent", "target_mean_present")
    else:
        res = chi2_2x2(masked, flags, target, with_p=with_p)
        counts = masked.agg(*[F.sum(f).alias(f) for f in flags])
        cnt = counts.unpivot([], flags, "feature", "missing_count")
        res = res.join(cnt, "feature")
    res = res.withColumn("feature", F.regexp_replace("feature", "__miss$", ""))
    res = res.where((F.col("missing_count") >= min_missing) &
                    (F.col("missing_count") < F.col("n") if kind != "continuous" else F.col("present_count") > 0))
    if with_p:
        res = bh_adjust(res, "p_value", alpha)
    return res


# -- Kendall tau-b without pair enumeration --------------------------------------

def _concordance(cells: DataFrame, small: int) -> DataFrame:
    """S = concordant - discordant pairs of a count table (x, y, n), one row.

    Distinct x are numbered in order.  Two numbers differ first at one binary
    digit, so every pair of rows with different x meets at exactly one level,
    in the group of the digits above it, one row left (0) and one right (1).
    There a right row counts the left rows with smaller y less those with
    larger y, from a running sum over y: a plain window in groups of up to
    ``small`` y values, ranges of y in larger ones.  Rows: the count table
    times the digits of the number of levels."""
    numbered = running_before(cells.select("x").distinct().withColumn("one", F.lit(1)), "x", "one").withColumnRenamed("__before", "xr")
    levels = max(1, int(numbered.agg(F.coalesce(F.max("xr"), F.lit(0))).first()[0]).bit_length())
    long = cells.join(numbered.select("x", F.col("xr").cast("long").alias("xr")), "x") \
        .select("xr", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    right = F.expr("shiftright(xr, level) & 1") == 1
    per = long.groupBy("level", F.expr("shiftright(xr, level + 1)").alias("above"), "y").agg(
        F.sum(F.when(~right, F.col("n")).otherwise(0)).alias("wl"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("wr"))
    keys = ["level", "above"]
    sizes = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum("wl").alias("left"), F.sum("wr").alias("right")) \
        .where((F.col("left") > 0) & (F.col("right") > 0))
    per = per.join(sizes.drop("right"), keys).checkpoint(eager=True)
    w = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    near = per.where(F.col("size") <= small).withColumn("__before", F.coalesce(F.sum("wl").over(w), F.lit(0)))
    far = running_before(per.where(F.col("size") > small), "y", "wl", keys)
    both = near.unionByName(far.select(*near.columns))
    return both.agg(F.coalesce(F.sum(F.col("wr").cast("double") * (2 * F.col("__before") + F.col("wl") - F.col("left"))), F.lit(0.0)).alias("S"))


def kendall_tau_b(df: DataFrame, x: str, y: str, with_p: bool = True, small: int = 100_000) -> DataFrame:
    """Kendall tau-b with tie correction, exact, for ordinal and
    continuous columns: one shuffle of the rows to the (x, y) count table,
    then ``_concordance``.  The p-value is the asymptotic normal one with the
    tie-corrected variance."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession, allow_local=True)
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    cells = df.where(xx.isNotNull() & yy.isNotNull()).groupBy(xx.alias("x"), yy.alias("y")) \
        .agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    srow = _concordance(cells, small).first()
    tx = cells.groupBy("x").agg(F.sum("n").cast("double").alias("t"))
    ty = cells.groupBy("y").agg(F.sum("n").cast("double").alias("t"))

    def ties(d, p):
        t = F.col("t")
        return d.agg(F.sum(t * (t - 1) / 2).alias(f"{p}tie"), F.sum(t * (t - 1) * (t - 2)).alias(f"{p}0"),
                     F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{p}1"))
    xrow, yrow = ties(tx, "x").first(), ties(ty, "y").first()
    n, S = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).first()["n"], srow["S"]
    if n < 2:  # no pair
        return df.sparkSession.createDataFrame([(x, y, int(n), 0.0, None, None)], "x string, y string, n long, s double, tau_b double, z double") \
            .withColumns({"p_value": F.lit(None).cast("double")} if with_p else {})
    n0 = n * (n - 1) / 2
    tau = S / ((n0 - xrow["xtie"]) * (n0 - yrow["ytie"])) ** 0.5 if n0 > max(xrow["xtie"], yrow["ytie"]) else None
    m = n * (n - 1)
    var = ((m * (2 * n + 5) - xrow["x1"] - yrow["y1"]) / 18 + (2 * xrow["xtie"] * yrow["ytie"]) / m
           + xrow["x0"] * yrow["y0"] / (9 * m * (n - 2))) if n > 2 else None
    z = S / var ** 0.5 if var else None
    spark = df.sparkSession
    out = spark.createDataFrame([(x, y, int(n), float(S), tau, z)],
                                "x string, y string, n long, s double, tau_b double, z double")
    out = out.withColumns({"tau_b": _r6(F.col("tau_b")), "z": _r6(F.col("z"))})
    if with_p:
        from ..functions.distributions import z_p_value
        out = out.withColumn("p_value", z_p_value(F.col("z")))
    return out


# -- missingness patterns -----------------------------------------------------------

def missing_patterns(df: DataFrame, cols: Sequence[str], top: int | None = 10) -> DataFrame:
    """Rows grouped by their missingness mask (bit string over
    ``cols``): size, share of missing cells in the mask, rank by size."""
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    g = df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    nmiss = F.length(F.regexp_replace("mask", "0", ""))
    g = g.withColumns({"n_missing_cols": nmiss.cast("int"),
                       "missing_share": _r6(nmiss / F.lit(float(len(cols))))})
    w = Window.orderBy(F.desc("n"), "mask")
    g = g.withColumn("rank", F.row_number().over(w))
    return g.where(F.col("rank") <= top) if top else g


def pattern_clusters(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42) -> DataFrame:
    """T22 (re-aimed from UMAP + DBSCAN): weighted k-means over the distinct
    masks (weight = rows with that mask), so the clustering input is the
    pattern table, not the rows; result per cluster: rows, masks, mean
    missing share, and the most frequently missing columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    bits = df.groupBy(*[F.col(c).isNull().cast("double").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("w"))
    vec = VectorAssembler(inputCols=list(cols), outputCol="features").transform(bits)
    km = KMeans(k=k, seed=seed, weightCol="w", featuresCol="features").fit(vec)
    pred = km.transform(vec)
    agg = pred.groupBy("prediction").agg(
        F.sum("w").alias("rows"), F.count(F.lit(1)).alias("masks"),
        _r6(F.sum(F.col("w") * sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)) / F.sum("w")).alias("mean_missing_share"),
        *[_r6(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in cols])
    long = agg.unpivot(["prediction", "rows", "masks", "mean_missing_share"], list(cols), "column_name", "share")
    w = Window.partitionBy("prediction").orderBy(F.desc("share"), "column_name")
    top = long.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 10) \
        .groupBy("prediction", "rows", "masks", "mean_missing_share") \
        .agg(F.array_join(F.collect_list("column_name"), ",").alias("top_columns"))
    return top.withColumnRenamed("prediction", "cluster")
