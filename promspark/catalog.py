"""Column-role catalogue: the single source of truth for names, codes and
missing-value policy of a PROM (patient-reported outcome) table.

Column names follow the short form used after renaming: ``t0_`` before
surgery, ``t1_`` six months after, ``oks_`` for the Oxford items and score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the published instruments and the source data
# dictionary; stated plainly, in natural order).
# ---------------------------------------------------------------------------

# Oxford Knee Score items, questionnaire order.  Each item 0-4, 9 = missing.
KNEE_ITEMS = ["pain", "night_pain", "washing", "transport", "walking", "standing",
              "limping", "kneeling", "work", "confidence", "shopping", "stairs"]
# Oxford Hip Score replaces kneeling and confidence by sudden pain and dressing.
HIP_ITEMS = ["pain", "sudden_pain", "night_pain", "washing", "transport", "dressing",
             "shopping", "walking", "limping", "stairs", "standing", "work"]
# Items that form the pain total; the other ten form the functioning total.
PAIN_ITEMS = ["pain", "night_pain"]

# EQ-5D-3L dimensions, questionnaire order; levels 1-3, 9 = missing.
EQ5D_DIMS = ["mobility", "self_care", "activity", "discomfort", "anxiety"]

# Comorbidity flags: 1 = present, 9 = not reported (means absent).
COMORBIDITIES = ["heart_disease", "high_bp", "stroke", "circulation", "lung_disease",
                 "diabetes", "kidney_disease", "nervous_system", "liver_disease",
                 "cancer", "depression", "arthritis"]

# EQ-5D-3L UK time-trade-off value set (Dolan 1997).
EQ5D_CONSTANT = 0.081
EQ5D_N3 = 0.269
EQ5D_WEIGHTS = {               # dimension: (level 2, level 3)
    "mobility": (0.069, 0.314),
    "self_care": (0.104, 0.214),
    "activity": (0.036, 0.094),
    "discomfort": (0.123, 0.386),
    "anxiety": (0.071, 0.236),
}

# Code -> label maps.
AGE_BANDS = ["40 to 49", "50 to 59", "60 to 69", "70 to 79", "80 to 89", "90 to 120"]
YEARS = ["2016/17", "2017/18", "2018/19"]
PROCEDURES = ["Knee Replacement", "Hip Replacement"]
GENDER_LABELS = {"1": "Male", "2": "Female", "9": "Not known"}
LIVING_LABELS = {1: "Living with partner/spouse/family/friends", 2: "Alone",
                 3: "Living in a nursing home, hospital or other long-term care home",
                 4: "Other", 9: "Not Specified"}
YES_NO_LABELS = {1: "Yes", 2: "No"}

# Outcome thresholds.
MCID_SUCCESS = 6          # success: gain >= 6 or post score >= 26
ABS_SUCCESS = 26
GOOD_ABS = 43             # good outcome: post score > 43 or gain > 13
GOOD_MCID = 13
CUT_OFF_PAIN = 4          # pain total at least 4 = good
CUT_OFF_FUNCTIONING = 26  # functioning total at least 26 = good

# Missing-value codes.
ITEM_MISSING = 9
VAS_MISSING = 999
SUPPRESSED = "*"
STRING_MISSING = ["*", ""]


def oks_items(t: str = "t0", items: list[str] | None = None) -> list[str]:
    return [f"oks_{t}_{i}" for i in (items or KNEE_ITEMS)]


def eq5d_dims(t: str = "t0") -> list[str]:
    return [f"{t}_{d}" for d in EQ5D_DIMS]


# ---------------------------------------------------------------------------
# Roles
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Role:
    name: str
    missing: tuple = ()          # values that mean "missing" for this role
    absent_as: int | None = None  # value that replaces a missing code (9 -> 0)


@dataclass
class Catalog:
    """Maps each column to a role; roles carry the sentinel policy."""

    roles: dict[str, Role] = field(default_factory=dict)

    def columns(self, role: str, present: list[str] | None = None) -> list[str]:
        cols = [c for c, r in self.roles.items() if r.name == role]
        return [c for c in cols if present is None or c in present]

    def role_of(self, col: str) -> Role | None:
        return self.roles.get(col)


ITEM = Role("item", (ITEM_MISSING,))
SCORE = Role("score", ())                  # 9 is a legal score
DIM = Role("eq5d_dim", (ITEM_MISSING,))
VAS = Role("vas", (VAS_MISSING,))          # 9 is a legal VAS value
COMORB = Role("comorbidity", (ITEM_MISSING,), absent_as=0)
YES_NO = Role("yes_no", (ITEM_MISSING,))
CATEGORY = Role("category", (ITEM_MISSING,))
DEMOGRAPHIC = Role("demographic", tuple(STRING_MISSING))
KEY = Role("key", ())


def prom_catalog(items: list[str] | None = None) -> Catalog:
    roles: dict[str, Role] = {"record_id": KEY, "provider_code": KEY, "year": KEY,
                              "procedure": KEY, "age_band": DEMOGRAPHIC, "gender": DEMOGRAPHIC}
    for t in ("t0", "t1"):
        for c in oks_items(t, items):
            roles[c] = ITEM
        for c in eq5d_dims(t):
            roles[c] = DIM
        roles[f"{t}_eq_vas"] = VAS
        roles[f"oks_{t}_score"] = SCORE
    for c in COMORBIDITIES:
        roles[c] = COMORB
    for c in ("t0_assisted", "t0_previous_surgery", "t0_disability"):
        roles[c] = YES_NO
    for c in ("t0_symptom_period", "t0_living_arrangements"):
        roles[c] = CATEGORY
    return Catalog(roles)
