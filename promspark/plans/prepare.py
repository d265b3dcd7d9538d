"""Entry 1: raw PROM table -> analysis table, with a deletion audit.

One lazy plan: scan -> project -> filter -> project.  No shuffle; the audit
is a second, single aggregate job over the same scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions import recode, scores
from ..operators import clean


def derive_scores(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """D01/D02 + D03-D05 + D07/D08 on a role-cleaned frame."""
    t0_items, t1_items = cat.oks_items("t0", items), cat.oks_items("t1", items)
    out = df.withColumns({
        "oks_t0_score": scores.backfill_score("oks_t0_score", t0_items),
        "oks_t1_score": scores.backfill_score("oks_t1_score", t1_items, guard=True),
    })
    out = out.withColumns({
        "t0_eq5d_profile": scores.eq5d_profile(cat.eq5d_dims("t0")),
        "t1_eq5d_profile": scores.eq5d_profile(cat.eq5d_dims("t1")),
        "t0_eq5d_index": scores.eq5d_index(cat.eq5d_dims("t0")),
        "t1_eq5d_index": scores.eq5d_index(cat.eq5d_dims("t1")),
        "oks_gain": scores.gain("oks_t1_score", "oks_t0_score"),
        "oks_success": scores.success("oks_t1_score", "oks_t0_score"),
    })
    return out


OUTCOMES = ["oks_t1_score", "t1_eq_vas", "t1_eq5d_index", "t1_eq5d_profile", "oks_gain", "oks_success"]


def prepare(prom: DataFrame, catalog: cat.Catalog | None = None, items: list[str] | None = None,
            disability_missing: int = 9, keep_post: bool = False) -> tuple[DataFrame, DataFrame]:
    """The final preparation job.  Returns (analysis table, deletion audit)."""
    catalog = catalog or cat.prom_catalog(items)
    df = clean.apply_roles(prom, catalog)                               # F02 + F06
    steps = [
        ("pre-op items complete", cat.oks_items("t0", items)),            # F09
        ("pre-op EQ-5D complete", cat.eq5d_dims("t0")),
        ("symptom period known", ["t0_symptom_period"]),
        ("age and gender known", ["age_band", "gender"]),
    ]
    df, audit = clean.deletion_audit(df, steps)                         # F10
    df = derive_scores(df, items)
    df = df.withColumns({                                               # F13, F07, F08
        "t0_living_arrangements": recode.fill_constant("t0_living_arrangements", 9),
        "t0_disability": recode.fill_constant("t0_disability", disability_missing),
        "t0_assisted": recode.yes_no("t0_assisted"),
        "t0_previous_surgery": recode.yes_no("t0_previous_surgery"),
        "gender": recode.map_codes("gender", cat.GENDER_LABELS),
        "living_label": recode.map_codes("t0_living_arrangements", cat.LIVING_LABELS),
    })
    if not keep_post:                                                   # C11 leakage filter
        df = df.select(*clean.leakage_safe_columns(df.columns, keep=OUTCOMES,
                                                   drop_exact=("csvyear",)))
    return df, audit
