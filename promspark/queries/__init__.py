"""

Each module exposes ``QUERIES = {key: (callable(spark, sf_dir), sql or None)}``.
A ``None`` oracle means the result is not expressible in SQL (iterative or
model-based); the driver then checks rows only and tests/ hold the
invariants.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["prep", "derive", "profile", "stats", "relate", "impute", "model", "sources", "schema"]


def registry() -> dict:
    out: dict = {}
    for m in MODULES:
        mod = import_module(f"{__name__}.{m}")
        for k, v in mod.QUERIES.items():
            if k in out:
                raise KeyError(f"duplicate query key {k}")
            out[k] = v
    return out
