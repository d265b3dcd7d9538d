"""Derived scores and outcomes as native Column expressions.

Null semantics: Spark ``+`` propagates null, which is the guarded
"complete responses only" behaviour; ``skip_nulls=True`` gives the pandas
horizontal sum that counts a missing item as 0.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as cat
from .recode import ColumnOrName, _c


def row_sum(cols: Sequence[ColumnOrName], skip_nulls: bool = False) -> Column:
    parts = [_c(c) for c in cols]
    if skip_nulls:
        parts = [F.coalesce(p, F.lit(0)) for p in parts]
    return reduce(add, parts)


def oxford_score(items: Sequence[ColumnOrName], partial: str = "null") -> Column:
    """Sum of the 12 items.

    ``partial='null'`` gives null when any item is missing (complete
    responses only); ``partial='skip'`` counts missing items as 0.
    """
    if partial not in ("null", "skip"):
        raise ValueError("partial must be 'null' or 'skip'")
    return row_sum(items, skip_nulls=(partial == "skip")).cast("int")


def backfill_score(recorded: ColumnOrName, items: Sequence[ColumnOrName],
                   guard: bool = False) -> Column:
    """Keep the recorded score, fill it from the items where null.

    D02 (``guard=True``): a row with any missing item gets a null score even
    if one was recorded, so partial responses never count.
    """
    filled = F.coalesce(_c(recorded), oxford_score(items)).cast("int")
    if guard:
        return F.when(~any_missing(items), filled)
    return filled


def eq5d_profile(dims: Sequence[ColumnOrName]) -> Column:
    """Five levels concatenated ('11223'); null when any level is null."""
    return reduce(lambda a, b: F.concat(a, b), [_c(d).cast("int").cast("string") for d in dims])


def _levels_from_profile(profile: ColumnOrName) -> list[Column]:
    p = _c(profile).cast("string")
    return [F.substring(p, i, 1).try_cast("int") for i in range(1, 6)]


def eq5d_index(dims: Sequence[ColumnOrName] | None = None, profile: ColumnOrName | None = None,
               legacy: bool = False, digits: int = 6) -> Column:
    """EQ-5D-3L utility, UK value set.

    index = 1 - (constant + sum of dimension decrements + N3 if any level is 3).
    The published set applies the constant only when some level is above 1
    (so 11111 = 1.0); ``legacy=True`` always subtracts it, as one notebook does.
    Null unless all five levels are in 1..3.
    """
    if (dims is None) == (profile is None):
        raise ValueError("give dims or profile")
    levels = [_c(d) for d in dims] if dims is not None else _levels_from_profile(profile)
    if len(levels) != 5:
        raise ValueError("EQ-5D-3L has five dimensions")
    weights = [cat.EQ5D_WEIGHTS[d] for d in cat.EQ5D_DIMS]
    decrement = reduce(add, [F.when(lv == 2, F.lit(w2)).when(lv == 3, F.lit(w3)).otherwise(F.lit(0.0))
                             for lv, (w2, w3) in zip(levels, weights)])
    any3 = reduce(or_, [lv == 3 for lv in levels])
    any_above1 = reduce(or_, [lv > 1 for lv in levels])
    const = F.lit(cat.EQ5D_CONSTANT) if legacy else F.when(any_above1, F.lit(cat.EQ5D_CONSTANT)).otherwise(F.lit(0.0))
    value = F.lit(1.0) - (const + decrement + F.when(any3, F.lit(cat.EQ5D_N3)).otherwise(F.lit(0.0)))
    valid = reduce(lambda a, b: a & b, [lv.isin(1, 2, 3) for lv in levels])
    if profile is not None:
        valid = valid & _c(profile).cast("string").rlike("^[123]{5}$")
    return F.when(valid, F.round(value, digits))


def fill_index(index: ColumnOrName, dims: Sequence[ColumnOrName], legacy: bool = False) -> Column:
    """Recorded index, else derived from the dimensions."""
    return F.coalesce(_c(index), eq5d_index(dims, legacy=legacy))


def gain(post: ColumnOrName, pre: ColumnOrName) -> Column:
    """Health gain = post - pre."""
    return _c(post) - _c(pre)


def success(post: ColumnOrName, pre: ColumnOrName, mcid: int = cat.MCID_SUCCESS,
            abs_min: int = cat.ABS_SUCCESS) -> Column:
    """1 if gain >= mcid or post >= abs_min; unknown (null) counts as 0."""
    cond = (gain(post, pre) >= mcid) | (_c(post) >= abs_min)
    return F.coalesce(cond, F.lit(False)).cast("int")


def good_outcome(post: ColumnOrName, delta: ColumnOrName, abs_threshold: int = cat.GOOD_ABS,
                 mcid: int = cat.GOOD_MCID) -> Column:
    """Post > abs_threshold or gain > mcid (a comparison with null is False)."""
    return F.coalesce((_c(post) > abs_threshold) | (_c(delta) > mcid), F.lit(False))


def pain_total(t: str = "t0") -> Column:
    """Pain + night pain (null if either is null)."""
    return row_sum([f"oks_{t}_{i}" for i in cat.PAIN_ITEMS]).cast("int")


def functioning_total(t: str = "t0", items: Sequence[str] | None = None) -> Column:
    """The ten non-pain items; skips nulls like a pandas row sum."""
    names = [i for i in (items or cat.KNEE_ITEMS) if "pain" not in i]
    return row_sum([f"oks_{t}_{i}" for i in names], skip_nulls=True).cast("int")


def cutoff_flag(total: ColumnOrName, cut: int) -> Column:
    """Total >= cut; a null total is False."""
    return F.coalesce(_c(total) >= cut, F.lit(False))


def comorbidity_count(cols: Sequence[ColumnOrName] = tuple(cat.COMORBIDITIES)) -> Column:
    """Number of comorbidities per row (flags already 0/1)."""
    return row_sum(cols, skip_nulls=True).cast("int")


def missing_count(cols: Sequence[ColumnOrName]) -> Column:
    return reduce(add, [_c(c).isNull().cast("int") for c in cols])


def missing_share(cols: Sequence[ColumnOrName]) -> Column:
    """Share of missing cells in the row."""
    return missing_count(cols) / F.lit(float(len(cols)))


def any_missing(cols: Sequence[ColumnOrName]) -> Column:
    """The row has at least one missing cell."""
    return reduce(or_, [_c(c).isNull() for c in cols])


def missing_indicator(col: str, suffix: str = "_is_missing") -> Column:
    """0/1 indicator column."""
    return F.col(col).isNull().cast("int").alias(col + suffix)


def significance_stars(p: ColumnOrName) -> Column:
    """*** p < 0.001, ** < 0.01, * < 0.05, else ns."""
    p = _c(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .when(p.isNotNull(), "ns"))


def strength_label(r: ColumnOrName) -> Column:
    """|r| >= 0.7 Strong, >= 0.4 Moderate, >= 0.2 Weak, else Negligible."""
    a = F.abs(_c(r))
    return (F.when(a >= 0.7, "Strong").when(a >= 0.4, "Moderate").when(a >= 0.2, "Weak")
            .when(a.isNotNull(), "Negligible"))


def recorded_change_gap(recorded: ColumnOrName, post: ColumnOrName, pre: ColumnOrName) -> Column:
    """Recomputed post - pre minus the recorded change."""
    return _c(post) - _c(pre) - _c(recorded)
