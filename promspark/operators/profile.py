"""Profiling aggregates.

Wide reports are one aggregate over all columns followed by ``unpivot``
(never one job per column).  Per-value tables are grouped after a single
``unpivot`` so partial aggregation collapses repeated values map-side; a
hot value therefore costs one hash entry per task.  Nothing here collects
an unbounded set: distinct-value samples are capped by rank, not by
``collect_set`` over the whole column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import grouped_percentiles


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def join_keys_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                        how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a null key matches a null key (group
    tables produced by ``groupBy`` keep a null group)."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_keys_null_safe needs at least one key")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def _long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), value_type: str = "string"
          ) -> DataFrame:
    """(ids..., column_name, value) with every value cast to one type."""
    cast = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), "column_name", "value")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
                   sentinels: dict[str, Sequence] | None = None) -> DataFrame:
    """Missing count and share per column (per group).

    ``sentinels`` = {column: codes} also counts those codes as missing (A02).
    Result: [by...], column_name, n, n_missing, pct_missing, pct_complete."""
    cols = list(cols or [c for c in df.columns if c not in by])
    sentinels = sentinels or {}

    def miss(c):
        cond = F.col(c).isNull()
        if c in sentinels:
            cond = cond | F.col(c).isin(list(sentinels[c]))
        return F.count_if(cond)

    aggs = [F.count(F.lit(1)).alias("__n")] + [miss(c).alias(c) for c in cols]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    long = wide.unpivot([*by, "__n"], cols, "column_name", "n_missing")
    return long.select(*by, "column_name", F.col("__n").alias("n"), "n_missing",
                       _r6(F.col("n_missing") * 100.0 / F.col("__n")).alias("pct_missing"),
                       _r6(F.lit(100.0) - F.col("n_missing") * 100.0 / F.col("__n")).alias("pct_complete"))


def total_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing cells in total and as a share of all cells."""
    cols = list(cols or df.columns)
    cells = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.sum(cells).alias("missing_cells"),
                  (F.count(F.lit(1)) * len(cols)).alias("total_cells")) \
        .withColumn("pct_missing", _r6(F.col("missing_cells") * 100.0 / F.col("total_cells")))


def value_counts(df: DataFrame, cols: Sequence[str], top: int | None = None) -> DataFrame:
    """(column_name, value, n, share); ``top`` keeps the k most frequent
    values per column (ties broken by value).  Nulls are not counted, as in
    pandas ``value_counts``."""
    long = _long(df, cols).where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("column_name").agg(F.sum("n").alias("__tot"))
    out = counts.join(tot, "column_name").withColumn("share", _r6(F.col("n") / F.col("__tot"))).drop("__tot")
    if top:
        w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
        out = out.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= top).drop("__rk")
    return out


def boolean_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count and share of 1/0 (true/false) per flag column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("int")
        aggs += [F.count_if(x == 1).alias(f"{c}__1"), F.count_if(x == 0).alias(f"{c}__0")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__1").alias("n_true"),
                     F.col(f"{c}__0").alias("n_false")) for c in cols]
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return long.withColumn("share_true", _r6(F.col("n_true") / (F.col("n_true") + F.col("n_false"))))


def distinct_values(df: DataFrame, cols: Sequence[str], max_values: int = 4) -> DataFrame:
    """n_unique per column and, when n_unique <= max_values, the sorted
    values.  Counting is a grouped aggregate; the sample is a per-column
    top-k (``row_number`` filter, planned as a window group limit) so no
    task ever holds more than ``max_values`` values of a column."""
    pairs = _long(df, cols).where(F.col("value").isNotNull()).distinct()
    n = pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    w = Window.partitionBy("column_name").orderBy("value")
    first = (pairs.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= max_values)
             .groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("__vals")))
    return n.join(first, "column_name", "left").select(
        "column_name", "n_unique",
        F.when(F.col("n_unique") <= max_values, F.array_join("__vals", ",")).alias("values"))


def prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Mean of 0/1 flags per column."""
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    return wide.unpivot([], list(flags), "column_name", "prevalence") \
        .withColumn("prevalence", _r6(F.col("prevalence")))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std (sample), min, q25, median, q75, max per
    column (per group), exact quantiles.  One unpivot; quantiles run over
    (group, column, value) counts, so the buffer is the number of distinct
    values, and moments are partial aggregates."""
    long = _long(df, cols, by, "double").where(F.col("value").isNotNull())
    keys = [*by, "column_name"]
    mom = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), _r6(F.avg("value")).alias("mean"),
                                  _r6(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"),
                                  F.max("value").alias("max"))
    q = grouped_percentiles(long, keys, "value", [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    q = q.select(*keys, *[_r6(F.col(c)).alias(c) for c in ("q25", "median", "q75")])
    return join_keys_null_safe(mom, q, keys, "left")


def describe_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: count, unique, top (most frequent, ties -> smallest), freq."""
    vc = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = vc.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") == 1) \
        .select("column_name", F.col("value").alias("top"), F.col("n").alias("freq"))
    tot = vc.groupBy("column_name").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
    return tot.join(top, "column_name")


def grouped_measures(df: DataFrame, by: Sequence[str], measures: Sequence[str],
                     funcs: Sequence[str] = ("sum",)) -> DataFrame:
    """Several functions over several measures per group.

    Medians run over (group, value) counts, so repeats collapse map-side."""
    fmap = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    aggs = []
    for m in measures:
        for f in funcs:
            if f != "median":
                c = fmap[f](m)
                aggs.append((_r6(c) if f in ("mean", "std") else c).alias(f"{m}_{f}"))
    out = df.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    for m in measures if "median" in funcs else ():
        q = grouped_percentiles(df, by, m, [0.5], [f"{m}_median"])
        out = join_keys_null_safe(out, q.withColumn(f"{m}_median", _r6(F.col(f"{m}_median"))), list(by), "left")
    return out.select(*by, *[f"{m}_{f}" for m in measures for f in funcs])


def rate_bottom_k(df: DataFrame, by: Sequence[str], num: str, den: str, k: int = 10) -> DataFrame:
    """rate = sum(num) / sum(den) per group, then the k lowest rates."""
    g = df.groupBy(*by).agg(F.sum(num).alias(num), F.sum(den).alias(den))
    g = g.withColumn("rate", _r6(F.try_divide(F.col(num).cast("double"), F.col(den))))
    return g.orderBy(F.asc_nulls_last("rate"), *by).limit(k)


def count_pivot(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` x ``col`` with ``col`` values as columns (values
    given, so no extra pass to discover them)."""
    return df.groupBy(row).pivot(col, list(values)).count().fillna(0)


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) and their share of the whole table."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # the total is a window over the (small) cell table
    return counts.withColumn("share", _r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def outcome_by_missing(df: DataFrame, cols: Sequence[str], outcome: str) -> DataFrame:
    """Mean outcome where each column is missing / present, and the gap.
    One pass for all columns."""
    y = F.col(outcome).cast("double")
    aggs = []
    for c in cols:
        aggs += [F.avg(F.when(F.col(c).isNull(), y)).alias(f"{c}__m"),
                 F.avg(F.when(F.col(c).isNotNull(), y)).alias(f"{c}__p"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n_missing"),
                     F.col(f"{c}__m").alias("mean_if_missing"), F.col(f"{c}__p").alias("mean_if_present"))
            for c in cols]
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return long.select("column_name", "n_missing", _r6(F.col("mean_if_missing")).alias("mean_if_missing"),
                       _r6(F.col("mean_if_present")).alias("mean_if_present"),
                       _r6(F.col("mean_if_missing") - F.col("mean_if_present")).alias("difference"))


def group_median_order(df: DataFrame, by: str, col: str) -> DataFrame:
    """Groups ordered by their median (rank 1 = highest)."""
    med = grouped_percentiles(df, [by], col, [0.5], ["median"])
    w = Window.orderBy(F.desc("median"), F.asc_nulls_last(by))
    return med.withColumn("median", _r6(F.col("median"))).withColumn("rank", F.row_number().over(w))


def size_vs_outcome(df: DataFrame, by: str, outcome: str) -> DataFrame:
    """Group size and mean outcome."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), _r6(F.avg(outcome)).alias("mean_outcome"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram counts over [min, max] (last bin closed)."""
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo = F.lit(mm["lo"]).cast("double")
    w = (F.lit(mm["hi"]).cast("double") - lo) / F.lit(bins)
    x = F.col(col)
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((x - lo) / w)))
    j = df.where(x.isNotNull()).withColumn("bin", b.cast("int"))
    return j.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).withColumn("left_edge", _r6(lo + F.col("bin") * w))


def binned_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Square-grid density; empty cells are absent."""
    mm = df.agg(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh")).first()

    def idx(c, lo, hi):
        lo, hi = F.lit(mm[lo]).cast("double"), F.lit(mm[hi]).cast("double")
        w = (hi - lo) / F.lit(bins)
        return F.when(w == 0, F.lit(0)).otherwise(
            F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / w))).cast("int")
    j = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return j.groupBy(idx(x, "xl", "xh").alias("xbin"), idx(y, "yl", "yh").alias("ybin")) \
        .agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """q1, median, q3, whiskers at the most extreme values within
    1.5 IQR, n and number of outliers per group.

    Rows are counted per (group, value) once; quartiles, whiskers and the
    outlier count all run on that count table, so a hot group collapses
    map-side and the value expression is evaluated once per row."""
    by = list(by)
    if not by:
        return box_stats(df.withColumn("__all", F.lit(1)), ["__all"], col).drop("__all")
    x = F.col(col)
    counted = df.where(x.isNotNull()).groupBy(*by, x.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    q = counted.groupBy(*by).agg(
        F.percentile(F.col("__v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__n")).alias("__q"))
    q = q.select(*by, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"))
    j = join_keys_null_safe(counted, q, by)
    v, iqr = F.col("__v"), F.col("q3") - F.col("q1")
    inside = (v >= F.col("q1") - 1.5 * iqr) & (v <= F.col("q3") + 1.5 * iqr)
    agg = j.groupBy(*by).agg(F.sum("__n").alias("n"),
                             F.min(F.when(inside, v)).alias("whisker_low"),
                             F.max(F.when(inside, v)).alias("whisker_high"),
                             F.coalesce(F.sum(F.when(~inside, F.col("__n"))), F.lit(0)).alias("n_outliers"),
                             F.first("q1").alias("q1"), F.first("median").alias("median"),
                             F.first("q3").alias("q3"))
    return agg.select(*by, "n", *[_r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
                      _r6(F.col("whisker_low")).alias("whisker_low"),
                      _r6(F.col("whisker_high")).alias("whisker_high"), "n_outliers")


def rank_by_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample standard deviation per column, ranked (1 = largest)."""
    wide = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column_name", "std").withColumn("std", _r6(F.col("std")))
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("std"), "column_name")))


def dataset_summary(frames: dict[str, DataFrame], target: str) -> DataFrame:
    """One row per dataset: rows, features, missing cells, target stats."""
    out = None
    for name, df in frames.items():
        feats = [c for c in df.columns if c != target]
        cells = sum((F.col(c).isNull().cast("long") for c in feats), F.lit(0).cast("long"))
        row = df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"),
                     F.lit(len(feats)).alias("features"), F.sum(cells).alias("missing_cells"),
                     _r6(F.avg(target)).alias("target_mean"), _r6(F.stddev_samp(target)).alias("target_std"))
        out = row if out is None else out.unionByName(row)
    return out


def group_mean_fill(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Missing values take their group's mean.  The means are a grouped
    (partial) aggregate joined back, not a window, so a hot group is never
    held in one task."""
    means = df.groupBy(*by).agg(F.avg(col).alias("__mean"))
    return join_keys_null_safe(df, means, by, "left") \
        .withColumn(col, F.coalesce(F.col(col).cast("double"), F.col("__mean"))).drop("__mean")


def compare_frames(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing counts and means before and after, per column."""
    def stats(df, tag):
        aggs = []
        for c in cols:
            aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__m"), F.avg(F.col(c).cast("double")).alias(f"{c}__a")]
        wide = df.agg(*aggs)
        rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__m").alias(f"missing_{tag}"),
                         _r6(F.col(f"{c}__a")).alias(f"mean_{tag}")) for c in cols]
        return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return stats(before, "before").join(stats(after, "after"), "column_name", "full")


def expected_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """For each expected column: present?, null count (null when absent)."""
    present = [c for c in expected if c in df.columns]
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present]) if present else None
    rows = []
    for c in expected:
        if c in present:
            rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(True).alias("present"),
                                 F.col(c).alias("n_missing")))
        else:
            rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(False).alias("present"),
                                 F.lit(None).cast("long").alias("n_missing")))
    base = wide if wide is not None else df.sparkSession.range(1)
    return base.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
