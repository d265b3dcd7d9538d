"""Running sums over an order that no task has to hold whole.

Rows are dealt to ranges of the order with ``repartitionByRange`` (Spark
samples the bounds; they are in no expression of the plan), written once with
the number of their range, and summed per (group, range).  The sums of the
ranges before it enter each (group, range) as a first row, so one window per
(group, range) gives the exact running sum.  A group with a third of all rows
spreads over as many ranges as its size asks for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table


def ordered_parts(df: DataFrame, order: Sequence[str], ranges: int | None = None, part: str = "__part") -> DataFrame:
    """``df`` as a written table with the number of each row's range of ``order``: a row of a lower
    range comes before (or ties with) every row of a higher one.  As many ranges as shuffle partitions,
    which are sized to the input, unless ``ranges`` is given."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return written_table(dealt.withColumn(part, F.spark_partition_id()))


def running_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, str], by: Sequence[str] = (),
                 ranges: int | None = None) -> DataFrame:
    """``df`` with, for each (column, name) of ``sums``, the sum of the column over the rows of the same
    ``by`` group that come earlier in ``order`` (ascending, nulls first); 0 for the first.  Null groups
    are a group.  ``order`` should tell rows apart; the order of equal rows is arbitrary."""
    by, order = list(by), list(order)
    parts = ordered_parts(df, [*by, *order], ranges).withColumn("__row", F.lit(True))
    totals = parts.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums)])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*by, "__part", F.lit(False).alias("__row"),
                          *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__w{i}") for i in range(len(sums))])
    kinds = dict(heads.dtypes)
    rows = parts.withColumns({f"__w{i}": F.col(c).cast(kinds[f"__w{i}"]) for i, c in enumerate(sums)})
    inside = Window.partitionBy(*by, "__part").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(heads, allowMissingColumns=True)
    both = both.withColumns({name: F.sum(f"__w{i}").over(inside) for i, name in enumerate(sums.values())})
    return both.where("__row").drop("__row", "__part", *(f"__w{i}" for i in range(len(sums))))


def running_before(counts: DataFrame, value: str, weight: str, by: Sequence[str] = (),
                   ranges: int | None = None) -> DataFrame:
    """Sum of ``weight`` over all rows of the same ``by`` group with a smaller ``value`` (values are
    distinct within a group) -> column ``__before``."""
    return running_sums(counts, [value], {weight: "__before"}, by, ranges)
