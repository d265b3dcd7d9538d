"""Row-wise recodes as native Column expressions.

All of these stay inside whole-stage codegen; none is a Python UDF, so they
work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from itertools import chain
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_if_in(col: ColumnOrName, codes: Iterable) -> Column:
    """the listed codes become null, everything else passes."""
    codes = list(codes)
    c = _c(col)
    if not codes:
        return c
    return F.when(~c.isin(codes), c)


def presence(col: ColumnOrName, absent_code: int = 9, null_as: int = 1) -> Column:
    """``absent_code`` -> 0, any other value -> 1; null -> ``null_as``.

    The notebooks map null to 1 through ``otherwise`` (kept as the default).
    """
    c = _c(col)
    return (F.when(c.isNull(), F.lit(null_as)).when(c == absent_code, F.lit(0))
            .otherwise(F.lit(1))).cast("int")


def comorbidity_flag(col: ColumnOrName, absent_code: int = 9) -> Column:
    """1 present; the 'not reported' code and null become 0."""
    c = _c(col)
    return F.coalesce(F.when(c != absent_code, c), F.lit(0)).cast("int")


def yes_no(col: ColumnOrName, no_code: int = 2, as_boolean: bool = False) -> Column:
    """1 = yes, ``no_code`` -> 0 (or a boolean)."""
    c = _c(col)
    out = F.when(c == no_code, F.lit(0)).otherwise(c)
    return (out == 1) if as_boolean else out


def map_codes(col: ColumnOrName, mapping: dict, passthrough: bool = True) -> Column:
    """code -> label through a literal map; unknown codes pass through."""
    c = _c(col)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    looked = m[c]
    return F.coalesce(looked, c.cast("string")) if passthrough else looked


def fill_constant(col: ColumnOrName, value) -> Column:
    """Missing becomes an explicit category or constant."""
    return F.coalesce(_c(col), F.lit(value))


def is_valid_profile(col: ColumnOrName) -> Column:
    """five digits, each 1-3."""
    return _c(col).cast("string").rlike("^[123]{5}$")


def label_sort_key(col: ColumnOrName) -> Column:
    """numbers in a label as an int array ('50 to 59' -> [50, 59])."""
    nums = F.regexp_extract_all(_c(col), F.lit(r"(\d+)"), 1)
    return F.transform(nums, lambda x: x.cast("int"))


def contains_ci(col: ColumnOrName, needle: str) -> Column:
    """F16: case-insensitive containment."""
    return F.lower(_c(col)).contains(needle.lower())
