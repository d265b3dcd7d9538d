"""Schema and column operators.

Name functions are plain string rules applied to ``df.columns`` (a rename
is a projection, no data moves); value-dependent ones (C07) read one
aggregate row bounded by the column count.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as cat

# The column-name rule of the source notebooks (leading
# characters up to the first letter or '_' are dropped, any other character
# outside [0-9a-zA-Z_] becomes '_').
LEADING_JUNK = r"^[^a-zA-Z_]+"
INVALID_CHAR = r"[^0-9a-zA-Z_]"
# Phrase map applied after cleaning (order matters).
SHORT_PHRASES = [("pre_op_q", "t0"), ("post_op_q", "t1"), ("knee_replacement", "oks"), ("hip_replacement", "ohs")]
# Prefix rules of the modelling notebook (first match wins); the knee
# rules are the same for the other procedure.
PREFIX_RULES = [("Pre-Op_Q_", "t0_"), ("Hip_Replacement_Pre-Op_Q_", "t0_HR_"),
                ("Post-Op_Q_", "t1_"), ("Hip_Replacement_Post-Op_Q_", "t1_HR_"),
                ("Knee_Replacement_Pre-Op_Q_", "t0_KR_"), ("Knee_Replacement_Post-Op_Q_", "t1_KR_")]
# Names with the phrase inside lose it and their procedure becomes a prefix.
INNER_PHRASE = "_Post-Op_Q_"
INNER_PREFIXES = [("Hip_Replacement_", "t1_HR_"), ("Knee_Replacement_", "t1_KR_")]
# What is left of post-operative names.
REST_RULES = [("Hip_Replacement_Post-Op", "HR_t1_"), ("Knee_Replacement_Post-Op", "KR_t1_")]


def clean_name(s: str) -> str:
    """Drop leading characters up to the first letter or '_', other
    invalid characters -> '_', lower case."""
    s = re.sub(LEADING_JUNK, "", s.strip())
    return re.sub(INVALID_CHAR, "_", s).lower()


def shorten_name(s: str) -> str:
    """Phrase map (pre_op_q -> t0, ...)."""
    for a, b in SHORT_PHRASES:
        s = s.replace(a, b)
    return s


def short_name(s: str) -> str:
    """C01 + C02 composed as the notebooks do: shorten(clean(shorten(s)))."""
    return shorten_name(clean_name(shorten_name(s)))


def prefix_rename(s: str) -> str:
    """Spaces -> '_', then the first rule that applies: a prefix, the
    phrase inside the name, or what is left of post-operative names."""
    s = s.replace(" ", "_")
    for a, b in PREFIX_RULES:
        if s.startswith(a):
            return b + s[len(a):]
    if INNER_PHRASE in s:
        s = s.replace(INNER_PHRASE, "_")
        return next((b + s[len(a):] for a, b in INNER_PREFIXES if s.startswith(a)), s)
    return next((s.replace(a, b, 1) for a, b in REST_RULES if a in s), s)


def rename_columns(df: DataFrame, fn) -> DataFrame:
    return df.toDF(*[fn(c) for c in df.columns])


def name_table(df: DataFrame, fn) -> DataFrame:
    """(old, new) pairs."""
    spark = df.sparkSession
    return spark.createDataFrame([(c, fn(c)) for c in df.columns], "old string, new string")


def schema_diff(frames: dict[str, DataFrame]) -> DataFrame:
    """(column_name, file, present, type) over N frames; a column is
    'common' when every file has it."""
    spark = next(iter(frames.values())).sparkSession
    allc = sorted({c for f in frames.values() for c in f.columns})
    rows = []
    for name, f in frames.items():
        types = dict(f.dtypes)
        rows += [(c, name, c in types, types.get(c)) for c in allc]
    return spark.createDataFrame(rows, "column_name string, file string, present boolean, type string")


def type_census(df: DataFrame) -> DataFrame:
    """Number of columns per type family."""
    fam = []
    for f in df.schema.fields:
        t = f.dataType
        k = ("numeric" if isinstance(t, (T.NumericType,)) else "string" if isinstance(t, T.StringType) else "other")
        fam.append((f.name, k))
    return df.sparkSession.createDataFrame(fam, "column_name string, family string")


def smallest_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Min / max of every numeric column in one aggregate and the
    smallest type that holds it (byte, short, int, long; float for
    non-integral values)."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}__lo"), F.max(x).alias(f"{c}__hi"),
                 F.max((x != F.floor(x)).cast("int")).alias(f"{c}__frac")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max"),
                     F.col(f"{c}__frac").alias("frac")) for c in cols]
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    lo, hi = F.col("min"), F.col("max")
    t = (F.when(F.col("frac") == 1, "float")
         .when((lo >= -128) & (hi <= 127), "tinyint").when((lo >= -32768) & (hi <= 32767), "smallint")
         .when((lo >= -2147483648) & (hi <= 2147483647), "int").otherwise("bigint"))
    return long.select("column_name", "min", "max", t.alias("type"))


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def composite_key(*cols: str, sep: str = "_"):
    """C10: 'Lookup_Year' style key."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop a list, absent names ignored."""
    return df.drop(*cols)


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep-list projection (present names only, in list order)."""
    return df.select(*[c for c in cols if c in df.columns])


def numeric_then_strings(df: DataFrame) -> DataFrame:
    """C14: numeric columns first, then the rest (a reordering projection)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.select(*num, *[c for c in df.columns if c not in num])


def align_to(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns of ``reference`` in its order; missing ones as typed nulls;
    extra ones dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in reference.schema.fields])


def column_families(columns: Sequence[str], catalog: cat.Catalog | None = None) -> list[tuple[str, str]]:
    """(family, column) by catalogue role, else by prefix."""
    catalog = catalog or cat.prom_catalog()
    out = []
    for c in columns:
        r = catalog.role_of(c)
        fam = r.name if r else ("t1" if c.startswith(("t1_", "oks_t1_")) else "t0" if c.startswith(("t0_", "oks_t0_"))
                                 else "other")
        if r and r.name in ("item", "eq5d_dim", "vas", "score"):
            fam = f"{r.name}_{'t1' if '_t1_' in f'_{c}' else 't0'}"
        out.append((fam, c))
    return out


def all_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C17: cast columns to plain strings."""
    cols = set(cols or df.columns)
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])
