"""Exact quantiles that do not funnel a column through one task.

Spark's ``percentile`` is exact but keeps every distinct value of a group
in one aggregation buffer; for a global quantile of a continuous column
that is one task holding the whole column.  ``exact_quantiles`` instead
selects order statistics by histogram refinement:

1. one aggregate: n, min, max;
2. a histogram with count, min and max per bin (``bins`` rows) locates the
   bin of every needed rank;
3. a bin with more than one value is refined on its own observed range, all
   bins in question in one job, until the rank's value is known.

Every driver-side read is bounded by ``bins`` rows per needed rank, never by
the row count.  Interpolation is linear between order statistics, equal to
pandas ``quantile`` / SQL ``quantile_cont`` / Spark ``percentile``.

``grouped_percentiles`` does the same for all groups of a table at once, from
running sums over ranges of the (group, value) count table.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums


def _ranks_needed(n: int, probs: Sequence[float]) -> dict[float, tuple[int, int, float]]:
    out = {}
    for p in probs:
        h = (n - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        out[p] = (lo, hi, h - lo)
    return out


def _select_ranks(df: DataFrame, col: str, ranks: list[int], lo: float, hi: float, bins: int) -> dict[int, float]:
    """Values at 0-based ``ranks`` of a column with smallest value lo and largest hi.

    Each level is one job for all ranks: a histogram with count, min and max
    per bin of every range still in question.  A rank whose bin holds one
    value, or that is the bin's first or last row, is known; the others go on
    in the range between their bin's min and max.  Bins follow the order of
    the values, so these observed ranges never overlap and no row is lost at
    a computed edge.  What is read is at most ``bins`` rows per range."""
    x = F.col(col)
    out: dict[int, float] = {}
    # ranges in question: (min, max, ranks below the range, ranks wanted)
    open_ranges = [(lo, hi, 0, sorted(ranks))]
    while open_ranges:
        for lo, hi, below, wanted in open_ranges:
            if lo == hi:
                out.update({r: lo for r in wanted})
        open_ranges = [r for r in open_ranges if r[0] < r[1]]
        if not open_ranges:
            break
        which, bin_of = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (lo, hi, _, _) in enumerate(open_ranges):
            inside = (x >= lo) & (x <= hi)
            width = max(hi / bins - lo / bins, 5e-324)
            which = F.when(inside, k).otherwise(which)
            bin_of = F.when(inside, F.when(x == lo, 0).when(x == hi, bins - 1).otherwise(
                F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"))))).otherwise(bin_of)
        rows = df.select(x.alias("v"), which.alias("k"), bin_of.alias("b")).where(F.col("k").isNotNull()) \
            .groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        following = []
        for k, (_, _, below, wanted) in enumerate(open_ranges):
            start = below
            for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["b"]):
                mine = [w for w in wanted if start <= w < start + r["n"]]
                for w in mine:
                    if w == start or r["lo"] == r["hi"]:
                        out[w] = float(r["lo"])
                    elif w == start + r["n"] - 1:
                        out[w] = float(r["hi"])
                rest = [w for w in mine if w not in out]
                if rest:
                    following.append((float(r["lo"]), float(r["hi"]), start, rest))
                start += r["n"]
        open_ranges = following
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], bins: int = 4096) -> dict[float, float | None]:
    """Exact linear-interpolated quantiles of a numeric column (nulls ignored).

    The one-column projection is persisted for the few passes (spilling to
    disk if needed) so the upstream plan runs once."""
    x = F.col(col)
    base = df.select(x.cast("double").alias(col)).where(x.isNotNull() & ~F.isnan(x.cast("double"))).persist()
    try:
        st = base.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        n = st["n"]
        if not n:
            return {p: None for p in probs}
        need = _ranks_needed(n, probs)
        ranks = sorted({r for lo, hi, _ in need.values() for r in (lo, hi)})
        vals = _select_ranks(base, col, ranks, float(st["lo"]), float(st["hi"]), bins)
        return {p: vals[lo] + f * (vals[hi] - vals[lo]) for p, (lo, hi, f) in need.items()}
    finally:
        base.unpersist()


def grouped_percentiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float],
                        names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles per group, for all groups and shares together.

    Rows are counted per (group, value); running sums over ranges of that table give every value the ranks it
    takes, and the values at the needed ranks are picked by a plain aggregate.  No task holds the distinct values
    of a group, however many there are.  Null groups are a group; null values are ignored."""
    by, keys = list(by), list(by) or ["__all"]
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    rows = df.where(F.col(col).isNotNull())
    rows = rows.select(*by, F.col(col).alias("__v")) if by else rows.select(F.lit(0).alias("__all"), F.col(col).alias("__v"))
    counted = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sums(counted, ["__v"], {"__n": "__before"}, keys)
    sizes = placed.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sum("__n").alias("__size"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    here = placed.join(sizes, same).drop(*(f"__k{i}" for i in range(len(keys))))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col("__v").cast("double")))

    place = [(F.col("__size") - 1) * F.lit(float(p)) for p in probs]
    picked = here.groupBy(*keys, "__size").agg(*[at(f(h)).alias(f"__{n}{i}") for i, h in enumerate(place) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    out = []
    for i, (h, name) in enumerate(zip(place, names)):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi).alias(name))
    return picked.select(*by, *out)
