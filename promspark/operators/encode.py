"""Label encodings and bins.

Code tables are built from the distinct labels (bounded by the column's
cardinality, not by the rows) and joined back by equi-join; AQE turns the
join into a broadcast when the runtime size of the table is small, so no
unchecked ``broadcast()`` hint is needed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def missing_indicators(df: DataFrame, cols: Sequence[str], suffix: str = "_is_missing") -> DataFrame:
    """Append 0/1 missingness indicators."""
    return df.withColumns({c + suffix: F.col(c).isNull().cast("int") for c in cols})


def code_table(df: DataFrame, col: str, order: Sequence[str] | None = None,
               start: int = 1) -> DataFrame:
    """(label, code): explicit order when given, else sorted labels; codes
    from ``start``.  Nulls get no code."""
    if order is not None:
        spark = df.sparkSession
        return spark.createDataFrame([(str(v), i + start) for i, v in enumerate(order)],
                                     f"{col} string, {col}_code int")
    labels = df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    # one window over the distinct labels of a categorical column (bounded
    # by its cardinality, not by rows)
    w = Window.orderBy(col)
    return labels.select(col, (F.dense_rank().over(w) + (start - 1)).cast("int").alias(f"{col}_code"))


def label_encode(df: DataFrame, cols: Sequence[str], orders: dict[str, Sequence[str]] | None = None,
                 start: int = 1) -> DataFrame:
    """Replace labels by ordered integer codes (from ``start``)."""
    orders = orders or {}
    out = df
    for c in cols:
        table = code_table(df, c, orders.get(c), start)
        out = (out.withColumn(c, F.col(c).cast("string"))
               .join(table, on=c, how="left")
               .drop(c).withColumnRenamed(f"{c}_code", c))
    return out.select(*df.columns)


def decode_rounded(code: str, table: DataFrame, label_col: str, k: int, start: int = 1):
    """An imputed (real) code back to a label: round, clip to the code
    range, look up."""
    return F.greatest(F.lit(start), F.least(F.lit(start + k - 1), F.round(F.col(code)).cast("int")))


def one_hot(df: DataFrame, col: str, categories: Sequence[str], prefix: str | None = None,
            drop: bool = True) -> DataFrame:
    """One indicator per known category; unknown values are all-zero."""
    prefix = prefix or col
    out = df.withColumns({f"{prefix}_{v}".replace(" ", "_").replace("/", "_"):
                          (F.col(col).cast("string") == str(v)).cast("int") for v in categories})
    out = out.fillna(0, subset=[f"{prefix}_{v}".replace(" ", "_").replace("/", "_") for v in categories])
    return out.drop(col) if drop else out


def equal_width_bins(df: DataFrame, col: str, k: int = 10, name: str | None = None) -> DataFrame:
    """``pd.cut(x, k)`` semantics: right-closed bins of equal width over
    [min, max], the lowest edge widened so min falls in bin 1.  Bin numbers
    1..k.  min/max come from one aggregate row and enter the plan as literals."""
    name = name or f"{col}_bin"
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if mm["lo"] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    lo, hi = F.lit(mm["lo"]).cast("double"), F.lit(mm["hi"]).cast("double")
    x = F.col(col)
    w = (hi - lo) / F.lit(k)
    raw = F.ceil((x - lo) / w)
    b = F.when(x.isNull(), None).when(w == 0, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(k), raw))).cast("int")
    return df.withColumn(name, b)


def quantile_edges(df: DataFrame, col: str, q: int = 10) -> list[float]:
    """Distinct exact quantile edges at 0, 1/q, ..., 1."""
    probs = [i / q for i in range(q + 1)]
    vals = exact_quantiles(df, col, probs)
    edges: list[float] = []
    for p in probs:
        v = vals[p]
        if v is not None and (not edges or v != edges[-1]):
            edges.append(v)
    return edges


def quantile_bins(df: DataFrame, col: str, q: int = 10, name: str | None = None) -> DataFrame:
    """``pd.qcut(x, q, duplicates='drop')`` semantics: right-closed
    bins on exact quantile edges, the minimum in bin 1; numbers from 1."""
    name = name or f"{col}_qbin"
    edges = quantile_edges(df, col, q)
    x = F.col(col)
    inner = edges[1:-1]
    b = F.lit(1)
    for e in inner:
        b = b + (x > F.lit(e)).cast("int")
    return df.withColumn(name, F.when(x.isNotNull(), b.cast("int")))
