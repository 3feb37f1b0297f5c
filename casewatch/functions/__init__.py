"""Column functions. Each takes columns (or names) and returns a column built from Spark built-ins."""

from casewatch.functions.metrics import with_metrics, zero_correct
from casewatch.functions.numbers import (
    clip_probability, format_or_ci, format_p, log_odds, logistic, odds, order_key, pct, ratio,
    risk_category, zero_fill,
)
from casewatch.functions.reports import (
    age_band, age_band_cut, age_to_years, country_use, event_year, first_class_label,
    indication_dummy, indication_group, is_outcome, region5, serious_label, serious_row, sex3,
    sex_cat, sex_male, sex_unknown, truthy, tto_bin, tto_days,
)
from casewatch.functions.text import (
    contains_any, flag_name, flag_slug, in_dictionary, join_terms, matched_labels, norm_text,
    register_norm, safe_double, upper_trim,
)
