"""Case profiles behind the descriptive tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions import reports as R
from casewatch.functions.text import safe_double, upper_trim
from casewatch.operators.cases import case_table, level_code, level_label, report_age
from casewatch.operators.exposure import Dictionary, case_flags, flag_columns, in_roles
from casewatch.operators.filters import target_rows, with_roles

SEX_LEVELS = ("F", "M", "Other")


def case_profile(
    reports: DataFrame,
    dictionary: Dictionary = D.DRUG_CLASSES,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
    grain: str = "case",
    country: bool = True,
) -> DataFrame:
    """Flags, sex3, age_years, year and country_use per case, or per report row with `grain="row"`.

    Row grain repeats a case as often as it was reported and carries the case-level flags.
    """
    attributes = {
        "sex3": R.sex3("sex"),
        "age_years": report_age(reports),
        "year": R.event_year("event_dt"),
    }
    if country:
        reporter = "reporter_country" if "reporter_country" in reports.columns else F.lit(None).cast("string")
        occurrence = "occr_country" if "occr_country" in reports.columns else "country"
        attributes["country_use"] = R.country_use(occurrence, reporter)
    if grain == "row":
        flags = case_flags(reports, dictionary, how, roles)
        rows = reports.select("case_id", *[c.alias(name) for name, c in attributes.items()])
        return rows.join(flags, "case_id", "left")
    if grain != "case":
        raise ValueError(f"grain must be 'case' or 'row', not {grain!r}")
    picks = dict(attributes)
    picks["sex3"] = level_code(attributes["sex3"], SEX_LEVELS, F.col("sex"))
    cases = case_table(reports, flag_columns(dictionary, how, roles), None, picks)
    return cases.withColumn("sex3", F.coalesce(level_label(F.col("sex3"), SEX_LEVELS), F.lit("Other")))


def onset_cases(
    reports: DataFrame,
    dictionary: Dictionary = D.DRUG_CLASSES,
    outcomes: Iterable[int] = tuple(D.OUTCOME_TERMS),
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> DataFrame:
    """Suspect-role rows per case: flags, outcome, shortest onset and its bin."""
    outcome = F.col("outcome") if "outcome" in reports.columns else R.is_outcome("pt_code", outcomes)
    days = F.col("tto_days") if "tto_days" in reports.columns else R.tto_days("tto_pair", "tto_primary", "tto_any")
    cases = case_table(
        reports.filter(in_roles(roles)), flag_columns(dictionary, how, None), {"outcome": outcome}, {"tto_days": days},
    )
    return cases.withColumn("tto_bin", R.tto_bin("tto_days"))


def molecule_rows(
    reports: DataFrame,
    molecules: Iterable[str] = D.DESCRIBED_MOLECULES,
    roles: Iterable[str] = D.SUSPECT_ROLES,
    grain: str = "case",
) -> DataFrame:
    """Second source: (molecule, sex_cat, age, age_group, country) per distinct case and molecule, or per row."""
    rows = target_rows(with_roles(reports, roles), molecules).select(
        "case_id",
        F.upper("drug").alias("molecule"),
        R.sex_cat("sex").alias("sex_cat"),
        safe_double("age").alias("age"),
        R.age_band_cut(safe_double("age")).alias("age_group"),
        upper_trim("country").alias("country"),
    )
    return rows.distinct() if grain == "case" else rows
