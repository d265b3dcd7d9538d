"""As-of join: the value at the nearest key, without one task that holds all keys.

Both key lists are dealt to ranges of the key (``running.ordered_parts``).
Inside a range the nearest donor before and after a key are running last
values, one window in each direction (a frame to the end of a partition would
read the rest of it for every row).  The first and last donor of each range
are one small row; carried over the ranges without a donor, they stand in at
the borders.  What one task holds is a range, or a row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import ordered_parts

DIRECTIONS = ("nearest", "backward", "forward")


def _last(column: str, *order, by: tuple[str, ...] = (), up_to: int = 0):
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, up_to)
    return F.last(column, ignorenulls=True).over(w)


def as_of(keys: DataFrame, donors: DataFrame, key: str, value: str, direction: str = "nearest",
          ranges: int | None = None) -> DataFrame:
    """The distinct non-null keys of ``keys`` with ``donor_key`` and ``value`` of the donor with the nearest key:
    of all, of those not above (``backward``) or not below (``forward``) the key.  An equal key is nearest; of two
    at the same distance the smaller one is taken; null where there is no such donor.  Donors with a null key or
    value do not count, and donor keys should be distinct (of equal ones the smaller value is taken).  Keys are
    numbers; NaN is a key above all others."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    wanted = keys.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct().withColumn("__want", F.lit(True))
    given = donors.select(F.col(key).alias("__k"), F.col(value).alias("__v")).where(F.col("__k").isNotNull() & F.col("__v").isNotNull()) \
        .groupBy("__k").agg(F.min("__v").alias("__v"))
    both = wanted.join(given, "__k", "full").withColumn("__d", F.when(F.col("__v").isNotNull(), F.struct("__k", "__v"))).drop("__v")
    parts = ordered_parts(both, ["__k"], ranges)
    ends = parts.groupBy("__part").agg(F.min("__d").alias("__first"), F.max("__d").alias("__last"))
    ends = ends.select("__part", _last("__last", "__part", up_to=-1).alias("__before"), _last("__first", F.desc("__part"), up_to=-1).alias("__after"))
    rows = parts.join(ends, "__part").withColumns({
        "__low": F.coalesce(_last("__d", "__k", by=("__part",)), "__before"),
        "__high": F.coalesce(_last("__d", F.desc("__k"), by=("__part",)), "__after")}).where("__want")
    low, high = F.col("__low"), F.col("__high")
    pick = {"backward": low, "forward": high,
            "nearest": F.when(high.isNull() | (low.isNotNull() & (F.col("__k") - low["__k"] <= high["__k"] - F.col("__k"))), low).otherwise(high)}[direction]
    return rows.select(F.col("__k").alias(key), pick.alias("__p")).select(key, F.col("__p")["__k"].alias("donor_key"), F.col("__p")["__v"].alias(value))
