"""Case-level model features from a report table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions import reports as R
from casewatch.functions.text import upper_trim
from casewatch.operators.cases import age_code, age_level, case_table, level_code, level_label, value_code, value_position
from casewatch.operators.exposure import Dictionary, flag_columns, in_roles
from casewatch.operators.filters import any_exposure, non_serious, target_rows

SEX_LEVELS = ("F", "M", "Other")
MODEL_SEXES = ("Female", "Male", "Unknown")


def every_word(dictionary: Dictionary) -> list[str]:
    return [word for words in dictionary.values() for word in words]


def case_features(
    reports: DataFrame,
    dictionary: Dictionary = D.DRUG_CLASSES,
    outcomes: Iterable[int] = tuple(D.OUTCOME_TERMS),
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
    prefix: str = "flag_",
    rows: str = "drug",
    nonserious_only: bool = False,
    extra: Sequence[str] = (),
    sex_levels: Sequence[str] = SEX_LEVELS,
    by_value: bool = False,
) -> DataFrame:
    """One row per case: outcome, exposure flags, sex, age band, indication group, seriousness.

    `rows` says which report rows count: "drug" keeps rows naming a dictionary drug, so the outcome
    must be reported with one; "drug_or_outcome" keeps outcome rows of any drug as well and then
    drops cases without exposure. `extra` names columns (year, onset days, ...) of which one value per
    case is kept. Missing sex and age stay null. `sex_levels` (female, male, other) names the levels, and so the
    model terms; `MODEL_SEXES` are those of the locked models and portraits. `by_value`: how one value represents a case (`value_code`).
    """
    outcomes = list(outcomes)
    if rows not in ("drug", "drug_or_outcome"):
        raise ValueError(f"rows must be 'drug' or 'drug_or_outcome', not {rows!r}")
    kept = target_rows(reports.filter(in_roles(roles)), every_word(dictionary),
                       outcomes if rows == "drug_or_outcome" else None)
    flags = flag_columns(dictionary, "exact", None, prefix)
    anys = {"outcome": R.is_outcome("pt_code", outcomes)}
    if "serious" in reports.columns:
        dtype = reports.schema["serious"].dataType
        anys["serious"] = R.truthy("serious", dtype)
    indication = R.indication_group(upper_trim("indication"))
    picks = {
        "_sex": level_code(R.sex3(upper_trim("sex"), sex_levels), sex_levels, F.col("sex"), by_value),
        "_age": age_code(reports, by_value),
        "_indication": level_code(indication, D.INDICATION_LEVELS, F.col("indication"), by_value),
        **{name: F.col(name) for name in extra},
    }
    cases = case_table(kept, flags, anys, picks)
    if rows == "drug_or_outcome":
        cases = any_exposure(cases, list(flags))
    if nonserious_only and "serious" in cases.columns:
        cases = non_serious(cases)
    return cases.select(
        "case_id", "outcome", *flags,
        level_label(F.col("_sex"), sex_levels).alias("sex"),
        age_level(reports, F.col("_age")).alias("age_cat"),
        F.coalesce(level_label(F.col("_indication"), D.INDICATION_LEVELS), F.lit("Other")).alias("indication_grp"),
        *(["serious"] if "serious" in cases.columns else []),
        *extra,
    )


def portable_features(
    reports: DataFrame,
    source: str,
    dictionary: Dictionary = D.VALIDATION_MOLECULES,
    outcomes: Iterable[int] = tuple(D.OUTCOME_TERMS),
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
    nonserious_only: bool = True,
    by_value: bool = False,
) -> DataFrame:
    """The dummy columns a locked molecule-level model uses, the same for every source."""
    outcomes = list(outcomes)
    kept = target_rows(reports.filter(in_roles(roles)), every_word(dictionary), outcomes)
    flags = flag_columns(dictionary, "exact", None, "flag_mol_")
    anys = {"outcome": R.is_outcome("pt_code", outcomes)}
    if "serious" in reports.columns:
        anys["serious"] = R.truthy("serious", reports.schema["serious"].dataType)
    male_first = F.when(R.sex_male("sex") == 1, 2).when(R.sex_unknown("sex") == 1, 3).otherwise(1)
    picks = {
        "_sex": value_code(male_first, F.col("sex"), by_value),
        "_age": age_code(reports, by_value),
        "_indication": level_code(
            R.indication_group(upper_trim("indication")), D.INDICATION_LEVELS, F.col("indication"), by_value
        ),
    }
    cases = any_exposure(case_table(kept, flags, anys, picks), list(flags))
    if nonserious_only and "serious" in cases.columns:
        cases = non_serious(cases)
    return cases.select(
        F.col("case_id").cast("string").alias("caseid"),
        "outcome",
        F.coalesce(value_position(F.col("_sex")) == 2, F.lit(False)).cast("int").alias("sexMale"),
        F.coalesce(value_position(F.col("_sex")) == 3, F.lit(False)).cast("int").alias("sexUnknown"),
        (age_level(reports, F.col("_age")) == "40-64").cast("int").alias("age_cat40.64"),
        F.coalesce(value_position(F.col("_indication")) == 2, F.lit(False)).cast("int").alias("indication_grpTransplantation"),
        *flags,
        F.lit(source).alias("source"),
    )
