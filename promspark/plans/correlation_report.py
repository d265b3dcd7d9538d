"""Entry 2: analysis tables -> ranked association tables.

hip and knee cohorts -> numeric feature list (no post-op leakage) ->
Spearman rho, n, p, stars, strength per feature and cohort -> Welch /
Cohen's d table for the comorbidity flags -> cross-cohort agreement on the
shared features -> top-15 of both rankings side by side.  Every step is an
aggregate over the cohorts; p-values are computed on the result rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as cat
from ..functions.scores import strength_label
from ..operators import relate, stats


@dataclass
class CorrelationReport:
    rankings: DataFrame      # cohort, feature, r, n, p_value, stars, strength
    effects: DataFrame       # cohort, feature, Welch / Cohen's d / p / BH
    agreement: DataFrame     # shared features, r between cohorts, slope, intercept
    top15: DataFrame         # position, knee feature / r, hip feature / r


def correlation_report(prepared: DataFrame, features: list[str], outcome: str = "oks_t1_score",
                       cohort_col: str = "procedure") -> CorrelationReport:
    y = F.col(outcome)
    # both cohorts from one pass over the rows (cohort is a key of the count table)
    both = stats.spearman(prepared, features, outcome, by=[cohort_col]).withColumn("strength", strength_label("r"))
    ranks = {"knee": both.where(F.col(cohort_col) == cat.PROCEDURES[0]).drop(cohort_col),
             "hip": both.where(F.col(cohort_col) == cat.PROCEDURES[1]).drop(cohort_col)}
    rankings = relate.union_aligned(list(ranks.values()), list(ranks), "cohort")
    gained = prepared.withColumn("__gain", y - F.col("oks_t0_score"))
    effects = stats.bh_adjust(stats.group_effects(gained, cat.COMORBIDITIES, "__gain"), "p_value")
    pair = ranks["knee"].select("feature", F.col("r").alias("r_knee")) \
        .join(ranks["hip"].select("feature", F.col("r").alias("r_hip")), "feature")
    agreement = pair.agg(F.count(F.lit(1)).alias("shared_features"),
                         F.round(F.corr("r_knee", "r_hip"), 6).alias("agreement_r"),
                         F.round(F.regr_slope("r_hip", "r_knee"), 6).alias("slope"),
                         F.round(F.regr_intercept("r_hip", "r_knee"), 6).alias("intercept"))
    top15 = relate.rank_position_join(ranks["knee"].select("feature", "r"), ranks["hip"].select("feature", "r"),
                                      [F.desc(F.abs(F.col("r"))), F.asc("feature")],
                                      [F.desc(F.abs(F.col("r"))), F.asc("feature")], 15, "knee_", "hip_")
    return CorrelationReport(rankings, effects, agreement, top15)
