"""Joins, set operations, ordering and top-k.

Joins are equi-joins; which side is broadcast is left to Catalyst/AQE
(runtime size), so a growing side is never forced into memory.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_aligned(frames: Sequence[DataFrame], tags: Sequence[str] | None = None,
                  tag_col: str = "source") -> DataFrame:
    """Union by name, missing columns become typed nulls; an
    optional tag column records where each row came from."""
    if tags is not None:
        frames = [f.withColumn(tag_col, F.lit(t)) for f, t in zip(frames, tags)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def outer_align(left: DataFrame, right: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Full outer alignment of two grouped results on their key."""
    return left.join(right, key if isinstance(key, list) else [key], "full")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top-k per group; ``row_number() <= k`` is planned with a window
    group limit, so each task keeps at most k rows per group before the
    shuffle and a hot group never arrives whole in one task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def semi_join_top(df: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in a (small, top-k) key list."""
    return df.join(keys_df.select(key), key, "left_semi")


def align_target(features: DataFrame, target: DataFrame, key: str = "record_id") -> DataFrame:
    """Attach the target to feature rows by key (left join)."""
    return features.join(target, key, "left")


def rank_position_join(a: DataFrame, b: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column],
                       k: int, prefix_a: str = "a_", prefix_b: str = "b_") -> DataFrame:
    """Top-k of two lists side by side, joined on rank position."""
    def ranked(df, order, prefix):
        top = df.orderBy(*order).limit(k)
        top = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
        return top.select("position", *[F.col(c).alias(prefix + c) for c in df.columns])
    return ranked(a, order_a, prefix_a).join(ranked(b, order_b, prefix_b), "position", "full")


def set_ops(a: DataFrame, b: DataFrame, col: str = "name") -> DataFrame:
    """Union / intersection / differences / symmetric difference of two
    one-column sets, as (name, in_a, in_b, set) rows."""
    a1 = a.select(F.col(col).alias(col)).distinct().withColumn("in_a", F.lit(True))
    b1 = b.select(F.col(col).alias(col)).distinct().withColumn("in_b", F.lit(True))
    j = a1.join(b1, col, "full").fillna(False, subset=["in_a", "in_b"])
    return j.withColumn("set", F.when(F.col("in_a") & F.col("in_b"), "both")
                        .when(F.col("in_a"), "only_a").otherwise("only_b"))


def explicit_order(df: DataFrame, col: str, order: Sequence[str], name: str = "order") -> DataFrame:
    """An order column from an explicit category list (unknown -> last)."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i + 1))])
    return df.withColumn(name, F.coalesce(m[F.col(col)], F.lit(len(order) + 1)))
