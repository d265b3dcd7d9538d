"""Helpers that write the DuckDB oracle text.

The oracle is written independently of the Spark code (plain SQL over the
same views); only the fixture definition is shared.
"""

from __future__ import annotations

from .. import catalog as cat
from ..fixture import column_order, prom_sql


def nullif9(c: str) -> str:
    return f"CASE WHEN {c} = 9 THEN NULL ELSE {c} END"


def roles_select(alias: str = "prom") -> str:
    """SELECT list applying the role policy (F02 + F06) in SQL."""
    catalog = cat.prom_catalog()
    parts = []
    for c in column_order():
        role = catalog.role_of(c)
        if role is None or not role.missing:
            parts.append(c)
        elif role.absent_as is not None:
            parts.append(f"CAST(CASE WHEN {c} IS NULL OR {c} = 9 THEN 0 ELSE {c} END AS INTEGER) AS {c}")
        elif role.name == "vas":
            parts.append(f"CASE WHEN {c} = 999 THEN NULL ELSE {c} END AS {c}")
        elif role.name == "demographic":
            parts.append(f"CASE WHEN {c} IN ('*', '') THEN NULL ELSE {c} END AS {c}")
        else:
            parts.append(f"{nullif9(c)} AS {c}")
    return ",\n  ".join(parts)


def ctes(*extra: str) -> str:
    """WITH prom (fixture), clean (roles applied) [, extra CTEs]."""
    body = [f"prom AS (\n{prom_sql()}\n)", f"clean AS (\nSELECT\n  {roles_select()}\nFROM prom\n)"]
    body += list(extra)
    return "WITH " + ",\n".join(body) + "\n"


def items_sum(t: str) -> str:
    return " + ".join(cat.oks_items(t))


def all_not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def any_null(cols) -> str:
    return " OR ".join(f"{c} IS NULL" for c in cols)


def scored_cte(src: str = "clean", name: str = "scored") -> str:
    """Back-filled scores (D01 pre, D02 post) over complete pre-op items."""
    t0, t1 = cat.oks_items("t0"), cat.oks_items("t1")
    return (f"{name} AS (\nSELECT * REPLACE (\n"
            f"  CAST(COALESCE(oks_t0_score, {items_sum('t0')}) AS INTEGER) AS oks_t0_score,\n"
            f"  CAST(CASE WHEN {any_null(t1)} THEN NULL ELSE COALESCE(oks_t1_score, {items_sum('t1')}) END AS INTEGER) AS oks_t1_score)\n"
            f"FROM {src} WHERE {all_not_null(t0)}\n)")


def eq5d_index_sql(t: str, legacy: bool = False) -> str:
    dims = cat.eq5d_dims(t)
    dec = " + ".join(
        f"CASE WHEN {d} = 2 THEN {cat.EQ5D_WEIGHTS[n][0]} WHEN {d} = 3 THEN {cat.EQ5D_WEIGHTS[n][1]} ELSE 0.0 END"
        for d, n in zip(dims, cat.EQ5D_DIMS))
    any3 = " OR ".join(f"{d} = 3" for d in dims)
    above1 = " OR ".join(f"{d} > 1" for d in dims)
    const = f"{cat.EQ5D_CONSTANT}" if legacy else f"CASE WHEN {above1} THEN {cat.EQ5D_CONSTANT} ELSE 0.0 END"
    valid = " AND ".join(f"{d} IN (1, 2, 3)" for d in dims)
    return (f"CASE WHEN {valid} THEN ROUND(CAST(1.0 - ({const} + {dec} + "
            f"CASE WHEN {any3} THEN {cat.EQ5D_N3} ELSE 0.0 END) AS DOUBLE), 6) END")


def r6(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6)"
