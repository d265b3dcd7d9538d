"""PROM-shaped table derived from ``orders`` by integer arithmetic.

The source data packs are not shipped, so every driver query runs on a
PROM-shaped view of the TPC-H ``orders`` table (FIXTURES.md §4).  Each
column is one SQL expression over ``k = o_orderkey`` and ``c = o_custkey``;
the same text feeds Spark (``F.expr``) and the DuckDB oracle, so both sides
compute the identical table.  The work is a narrow projection of two
columns of ``orders``: no shuffle, and it grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as cat
from .session import written_table

K = "o_orderkey"
C = "o_custkey"


def _case(cond: str, then: str, other: str) -> str:
    return f"CASE WHEN {cond} THEN {then} ELSE {other} END"


def _pick(index_expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index_expr} {whens} END"


def base_columns() -> list[tuple[str, str]]:
    """(name, SQL expression over orders) for every stored column."""
    k, c = K, C
    suppressed = f"({k} * 7 + {c}) % 15 = 0"
    cols: list[tuple[str, str]] = [
        ("record_id", f"CAST({k} AS BIGINT)"),
        ("provider_code", f"'P' || lpad(CAST({c} % 40 AS STRING), 3, '0')"),
        ("year", _pick(f"{k} % 3", cat.YEARS)),
        ("procedure", _case(f"{k} % 2 = 0", f"'{cat.PROCEDURES[0]}'", f"'{cat.PROCEDURES[1]}'")),
        ("age_band", _case(suppressed, "'*'", _pick(f"({k} + {c}) % 6", cat.AGE_BANDS))),
        ("gender", _case(suppressed, "'*'", f"CAST(1 + {c} % 2 AS STRING)")),
    ]
    for t in ("t0", "t1"):
        for i, name in enumerate(cat.KNEE_ITEMS, start=1):
            if t == "t0":
                miss = f"({k} + {13 * i}) % 97 = 0"
                val = f"least(4, greatest(0, {c} % 5 + ({k} * {2 * i + 3} + {c}) % 3 - 1))"
            else:
                miss = f"({k} + {17 * i}) % 89 = 0"
                val = f"least(4, {c} % 5 + ({k} * {i + 5} + {c}) % 4)"
            cols.append((f"oks_{t}_{name}", f"CAST({_case(miss, '9', val)} AS INT)"))
    for t in ("t0", "t1"):
        for i, name in enumerate(cat.EQ5D_DIMS, start=1):
            if t == "t0":
                miss, val = f"({k} + {7 * i}) % 31 = 0", f"1 + ({k} * {i + 2} + {c}) % 3"
            else:
                miss, val = f"({k} + {11 * i}) % 43 = 0", f"1 + ({k} * {i + 5} + {c}) % 3"
            cols.append((f"{t}_{name}", f"CAST({_case(miss, '9', val)} AS INT)"))
    cols.append(("t0_eq_vas", f"CAST({_case(f'{k} % 29 = 0', '999', f'({k} * 37 + {c} * 11) % 101')} AS INT)"))
    cols.append(("t1_eq_vas", f"CAST({_case(f'{k} % 23 = 0 OR {k} % 29 = 0', '999', f'({k} * 41 + {c} * 17) % 101')} AS INT)"))
    for j, name in enumerate(cat.COMORBIDITIES, start=1):
        cols.append((name, f"CAST({_case(f'({k} * {j + 3} + {c}) % 11 = 0', '1', '9')} AS INT)"))
    for name, mod, expr in (("t0_assisted", 97, f"({k} * 3) % 2"),
                            ("t0_previous_surgery", 83, f"({k} * 5) % 2"),
                            ("t0_disability", 17, f"({k} * 7 + {c}) % 2")):
        cols.append((name, f"CAST({_case(f'{k} % {mod} = 0', '9', f'1 + {expr}')} AS INT)"))
    for name, mod, expr in (("t0_symptom_period", 61, f"({k} * 3) % 4"),
                            ("t0_living_arrangements", 47, f"({k} * 5 + {c}) % 4")):
        cols.append((name, f"CAST({_case(f'{k} % {mod} = 0', '9', f'1 + {expr}')} AS INT)"))
    return cols


def score_columns() -> list[tuple[str, str]]:
    """Recorded Oxford scores over the item columns (second projection)."""
    out = []
    for t, mod in (("t0", 53), ("t1", 59)):
        items = cat.oks_items(t)
        any_missing = " OR ".join(f"{i} = 9" for i in items)
        total = " + ".join(items)
        out.append((f"oks_{t}_score",
                    f"CAST({_case(f'{any_missing} OR record_id % {mod} = 0', 'NULL', total)} AS INT)"))
    return out


def column_order() -> list[str]:
    names = [n for n, _ in base_columns()]
    return names + [n for n, _ in score_columns()]


def prom_fixture(orders: DataFrame) -> DataFrame:
    """The PROM table as a Spark DataFrame over an ``orders`` DataFrame."""
    stage = orders.select(*[F.expr(e).alias(n) for n, e in base_columns()])
    return stage.select("*", *[F.expr(e).alias(n) for n, e in score_columns()])


def load_prom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PROM table of a folder as a projection of ``orders``."""
    # Role cleaning makes a CASE of each of 60 columns, and deletion filters on many of them: inferring constraints
    # from such plans takes the optimizer up to a minute a query, and there is nothing to gain without joins.
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return prom_fixture(spark.read.parquet(f"{sf_dir}/orders.parquet"))


_WRITTEN: dict[tuple, DataFrame] = {}


def stored_prom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``load_prom`` read as Parquet columns.

    The table is written once per application and input into the shared folder, as a Collect job would have left
    it; queries then read the columns that they need and push their filters down."""
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")  # as in load_prom
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, *orders.inputFiles())
    if key not in _WRITTEN:
        # two narrow columns are dealt to all cores: a small table may be one file, and the rows get wide
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        _WRITTEN[key] = written_table(prom_fixture(orders.select(K, C).repartition(parts, K)))
    # a frame of the asking session, with column ids of its own
    return spark.read.schema(_WRITTEN[key].schema).parquet(*_WRITTEN[key].inputFiles())


def prom_sql(source: str = "orders") -> str:
    """The same table as SQL text (DuckDB or Spark SQL)."""
    inner = ",\n    ".join(f"{e} AS {n}" for n, e in base_columns())
    outer = ",\n  ".join(f"{e} AS {n}" for n, e in score_columns())
    return f"SELECT *,\n  {outer}\nFROM (\n  SELECT\n    {inner}\n  FROM {source}\n) base"


def with_prom(query: str, name: str = "prom") -> str:
    """Prefix an oracle query with the fixture as a CTE named ``prom``."""
    return f"WITH {name} AS (\n{prom_sql()}\n)\n{query}"
