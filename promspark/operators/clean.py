"""Frame-level filters, sentinel policies and deletion audit.

Every function returns a lazy DataFrame.  Where a decision depends on the
data (F03, F04) it is taken from one aggregate row whose size is bounded
by the number of columns, never by the number of rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as cat
from ..functions.recode import comorbidity_flag, null_if_in
from ..session import written_table

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
SHARED_ROWS = 50_000  # rows of a task that groups rows by all their values


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def all_sentinels_to_null(df: DataFrame, numeric_codes: Sequence = (9, 999),
                          string_codes: Sequence[str] = tuple(cat.STRING_MISSING),
                          exclude: Iterable[str] = ()) -> DataFrame:
    """every numeric column loses the numeric codes, every string column
    the string codes.  Deletes legal 9s in scores and VAS; prefer F02."""
    nums, strs = set(numeric_columns(df, exclude)), set(string_columns(df, exclude))
    return df.select(*[
        null_if_in(c, numeric_codes).alias(c) if c in nums else
        null_if_in(c, string_codes).alias(c) if c in strs else F.col(c)
        for c in df.columns])


def apply_roles(df: DataFrame, catalog: cat.Catalog | None = None) -> DataFrame:
    """F02 + F06: role-scoped missing codes.  Items, dimensions, yes/no and
    categories lose 9; VAS loses 999 (9 stays legal); demographics lose '*'
    and ''; comorbidity 9 means absent and becomes 0.  Unlisted columns pass."""
    catalog = catalog or cat.prom_catalog()
    out = []
    for c in df.columns:
        role = catalog.role_of(c)
        if role is None or not role.missing:
            out.append(F.col(c))
        elif role.absent_as is not None:
            out.append(comorbidity_flag(c).alias(c))
        else:
            out.append(null_if_in(c, role.missing).alias(c))
    return df.select(*out)


def columns_containing(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name) for every column that holds ``value`` somewhere.

    One aggregate over all columns; the result has one row per column."""
    cols = list(cols or numeric_columns(df))
    flags = df.agg(*[F.max((F.col(c) == value).cast("int")).alias(c) for c in cols])
    long = flags.unpivot([], cols, "column_name", "hit")
    return long.where(F.col("hit") == 1).select("column_name")


def auto_recode_binary9(df: DataFrame, code: int = 9, to: int = 0,
                        cols: Sequence[str] | None = None) -> DataFrame:
    """where a column has exactly two distinct values and one is ``code``,
    ``code`` becomes ``to``.

    "Exactly two distinct values, one of them ``code``" is: ``code`` occurs,
    and the other values have min = max.  So one pass of plain aggregates
    decides it for every column (no distinct aggregation, which would expand
    each row once per column); the decision row has three numbers per column."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for c in cols:
        other = F.when(F.col(c) != code, F.col(c))
        aggs += [F.count_if(F.col(c) == code).alias(f"{c}__n"), F.min(other).alias(f"{c}__lo"),
                 F.max(other).alias(f"{c}__hi")]
    st = df.agg(*aggs).first()
    chosen = {c for c in cols if st[f"{c}__n"] > 0 and st[f"{c}__lo"] is not None
              and st[f"{c}__lo"] == st[f"{c}__hi"]}
    return df.select(*[
        F.when(F.col(c) == code, F.lit(to)).otherwise(F.col(c)).alias(c) if c in chosen else F.col(c)
        for c in df.columns])


def delete_listwise(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a null in ``subset`` (all columns when None)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def _complete(cols: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in cols]) if cols else F.lit(True)


def deletion_audit(df: DataFrame, steps: Sequence[tuple[str, Sequence[str] | Column]]
                   ) -> tuple[DataFrame, DataFrame]:
    """F09 + F10: apply deletion steps in order and audit them in one pass.

    ``steps`` = [(name, subset-of-columns or keep-predicate)].  Returns the
    filtered frame and an audit frame (step, ord, before, removed, left)
    computed by one aggregate of cumulative keep conditions.
    Invariant: removed summed over steps + last left = rows at start.
    """
    keeps = [(_complete(s) if not isinstance(s, Column) else F.coalesce(s, F.lit(False)))
             for _, s in steps]
    cumulative = [reduce(and_, keeps[: i + 1]) for i in range(len(keeps))]
    aggs = [F.count(F.lit(1)).alias("n0")] + [F.count_if(c).alias(f"n{i + 1}")
                                              for i, c in enumerate(cumulative)]
    counts = df.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("step"), F.lit(i + 1).alias("ord"),
                     F.col(f"n{i}").alias("before"),
                     (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("removed"),
                     F.col(f"n{i + 1}").alias("left"))
            for i, (name, _) in enumerate(steps)]
    audit = counts.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    kept = df.where(cumulative[-1]) if cumulative else df
    return kept, audit


def pairwise_complete(df: DataFrame, x: str, y: str) -> DataFrame:
    """rows where both x and y are present."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """whole-row (or subset) duplicates with their multiplicity.

    Partial aggregation collapses repeats map-side, so a heavily repeated
    row costs one hash entry per task, not one shuffled row per copy."""
    cols = list(cols or df.columns)
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def cross_source_duplicates(df: DataFrame, source_col: str, ignore: Sequence[str] = ()) -> DataFrame:
    """value combinations that occur in more than one source.

    The source column itself is excluded from the key (a key that contains
    it can never match across sources).  Only 128-bit hashes of the rows are
    grouped over all rows; those seen in more than one source pick the rows
    that are grouped by their values, so equal hashes of other values do no
    harm.  The hash table is joined by its written size, and its counts say
    how many rows it picks: these are dealt by hash to as many tasks as keep
    each at about SHARED_ROWS, whatever the size of the input."""
    key = [c for c in df.columns if c != source_col and c not in set(ignore)]
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in key])  # xxhash64 passes nulls over
    hashed = df.withColumns({"__h1": F.xxhash64(*key, gaps), "__h2": F.xxhash64(F.lit(1), *key, gaps)})
    shared = hashed.groupBy("__h1", "__h2").agg(F.min(source_col).alias("__a"), F.max(source_col).alias("__b"), F.count(F.lit(1)).alias("__n")) \
        .where(F.col("__a") != F.col("__b")).select("__h1", "__h2", "__n")
    shared = written_table(shared)
    parts = 1 + (shared.agg(F.sum("__n")).first()[0] or 0) // SHARED_ROWS
    df = hashed.join(shared.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").repartition(parts, "__h1", "__h2")
    per_source = df.groupBy("__h1", "__h2", *key, source_col).agg(F.count(F.lit(1)).alias("copies"))
    return (per_source.groupBy("__h1", "__h2", *key).agg(F.count(source_col).alias("n_sources"), F.sum("copies").alias("copies"))
            .where(F.col("n_sources") > 1).drop("__h1", "__h2"))


def valid_target(df: DataFrame, target: str) -> DataFrame:
    """rows whose target is known."""
    return df.where(F.col(target).isNotNull())


def leakage_safe_columns(columns: Sequence[str], keep: Sequence[str] = (),
                         drop_prefixes: Sequence[str] = ("t1_", "oks_t1_"),
                         drop_contains: Sequence[str] = ("predicted",),
                         drop_exact: Sequence[str] = ("procedure", "csvyear")) -> list[str]:
    """Post-operative columns leak the outcome; keep only the
    listed outcomes among them."""
    keep = set(keep)
    out = []
    for c in columns:
        lc = c.lower()
        if c in keep:
            out.append(c)
        elif any(lc.startswith(p) for p in drop_prefixes) or any(s in lc for s in drop_contains) \
                or lc in drop_exact:
            continue
        else:
            out.append(c)
    return out


def any_of(cols: Sequence[str], pred) -> Column:
    return reduce(or_, [pred(F.col(c)) for c in cols])
