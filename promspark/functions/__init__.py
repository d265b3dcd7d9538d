"""Column functions: recodes, scores, outcomes, distributions."""

from .recode import (comorbidity_flag, contains_ci, fill_constant, is_valid_profile,  # noqa: F401
                     label_sort_key, map_codes, null_if_in, presence, yes_no)
from .scores import (any_missing, backfill_score, comorbidity_count, cutoff_flag,  # noqa: F401
                     eq5d_index, eq5d_profile, fill_index, functioning_total, gain,
                     good_outcome, missing_count, missing_indicator, missing_share,
                     oxford_score, pain_total, recorded_change_gap, row_sum,
                     significance_stars, strength_label, success)
