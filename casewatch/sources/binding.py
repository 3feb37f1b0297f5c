"""Bind differently named physical columns to one logical schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logical:
    """A logical column: the first physical candidate present is used.

    With `by_row` it is a chain: each row takes the first candidate that is not null there. `unique_like` names a
    fragment to look for when no candidate is present; it must then match one column only. `optional` columns that are
    absent become null. A column is left out where one of the logical columns in `unless` is bound to a physical one.
    """

    name: str
    candidates: tuple[str, ...]
    dtype: str | None = None
    optional: bool = False
    unique_like: str | None = None
    omit: bool = False  # leave an absent optional column out instead of binding nulls
    by_row: bool = False
    unless: tuple[str, ...] = ()


# The seriousness sub-flags of a report.
SERIOUS_FLAGS = (
    "serious_death", "serious_life_threat", "serious_hospitalization", "serious_disability", "serious_congenital_anomaly",
    "serious_other",
)
# Physical column names, first match wins.
FIRST_SOURCE = (
    Logical("case_id", ("primaryid", "caseid")),
    Logical("drug", ("drugname",), "string"),
    Logical("role", ("role_cod",), "string"),
    Logical("pt_code", ("pt_code",), "bigint"),
    Logical("pt", ("pt",), "string", optional=True),
    Logical("hlt", ("hlt_name",), "string", optional=True),
    Logical("hlgt", ("hlgt_name",), "string", optional=True),
    Logical("soc", ("soc_name",), "string", optional=True),
    Logical("sex", ("sex_raw", "sex_std", "sex"), "string", optional=True),
    Logical("age_years", ("age_years_raw", "age_years"), "double", optional=True),
    Logical("age", ("age",), "string", optional=True),
    Logical("age_unit", ("age_cod",), "string", optional=True),
    Logical("age_group", ("age_group",), "string", optional=True, omit=True, unless=("age_years", "age")),
    Logical("indication", ("indi_pt_norm", "indi_pt"), "string", optional=True, by_row=True),
    Logical("region", ("region",), "string", optional=True),
    Logical("occr_country", ("occr_country",), "string", optional=True),
    Logical("reporter_country", ("reporter_country",), "string", optional=True),
    Logical("event_dt", ("event_dt",), "string", optional=True),
    Logical("year", ("year",), "int", optional=True),
    Logical("serious", ("serious_flag",), optional=True),
    *(Logical(name, (name,), "int", optional=True, omit=True) for name in SERIOUS_FLAGS),
)
ONSET_SOURCE = (
    Logical("case_id", ("primaryid",)),
    Logical("drug", ("drugname_u",), "string"),
    Logical("role", ("role_cod_u",), "string"),
    Logical("pt", ("pt_u",), "string"),
    Logical("pt_code", ("meddra_pt_code",), "bigint"),
    Logical("tto_pair", ("tto_onset_days_psss",), "double"),
    Logical("tto_primary", ("tto_onset_days_ps",), "double", optional=True),
    Logical("tto_any", ("tto_onset_days_any",), "double", optional=True),
)
SECOND_SOURCE = (
    Logical("case_id", ("ID",)),
    Logical("drug", ("DRUG_MOLECULE",), "string"),
    Logical("drug_class", ("DRUG_CLASS_STD",), "string", optional=True),
    Logical("role", ("ROLE_STD",), "string"),
    Logical("pt_code", ("PT_CODE",), "bigint"),
    Logical("sex", ("SEX",), "string"),
    Logical("age", ("AGE_NUM",), "string"),
    Logical("country", ("COUNTRY_USE",), "string"),
)
PORTABLE_SOURCE = (
    Logical("case_id", ("id_case", "caseid", "case_id", "PRIMARYID", "primaryid", "ID")),
    Logical("pt_code", ("pt_code", "PT_CODE", "ptcode"), "bigint"),
    Logical("drug", ("DRUG_MOLECULE", "drugname", "DRUGNAME", "drugname_en", "DRUGNAME_EN"), "string"),
    Logical("sex", ("sex_raw", "sex_std", "sex", "SEX_STD", "SEX"), "string"),
    Logical("age", ("age_years_raw", "age_years", "AGE_YEARS", "age", "AGE"), "string", optional=True),
    Logical("age_group", ("age_group_raw", "age_group", "AGE_GROUP"), "string", optional=True, omit=True, unless=("age",)),
    Logical("year", ("year_raw", "year", "YEAR"), "int", optional=True),
    Logical("serious", ("serious_flag",), optional=True, unique_like="serious"),
    Logical(
        "indication",
        ("indi_pt_norm_raw", "indi_pt_norm", "INDI_PT_NORM", "INDI_PT_NORM_RAW", "INDI_PT_NAME_EN",
         "indi_pt_name_en", "INDICATION_GROUP"),
        "string",
    ),
    Logical("role", ("role_cod", "ROLE_COD", "ROLE_STD"), "string", optional=True),
)


def resolve_all(columns: Sequence[str], logical: Logical, case_sensitive: bool = False) -> list[str]:
    """Physical names for a logical column that are present, best first; empty when an optional one is absent."""
    fold = (lambda s: s) if case_sensitive else str.lower
    present = {}
    for column in columns:
        present.setdefault(fold(column), column)
    found = list(dict.fromkeys(present[fold(c)] for c in logical.candidates if fold(c) in present))
    if found:
        return found
    if logical.unique_like:
        hits = [c for c in columns if logical.unique_like.lower() in c.lower()]
        if len(hits) == 1:
            return hits
        if len(hits) > 1:
            raise ValueError(f"{logical.name}: several columns look like it: {', '.join(hits)}")
    if logical.optional:
        return []
    raise ValueError(f"{logical.name}: none of {', '.join(logical.candidates)} is present")


def resolve(columns: Sequence[str], logical: Logical, case_sensitive: bool = False) -> str | None:
    """Physical name for a logical column, or None when an optional one is absent."""
    return next(iter(resolve_all(columns, logical, case_sensitive)), None)


def bind_columns(
    df: DataFrame, spec: Sequence[Logical], case_sensitive: bool = False, traced: Sequence[str] = ()
) -> DataFrame:
    """One projection with the logical names; reads the schema only, so no job runs.

    For each logical column in `traced`, `<name>_from` says which physical column gave the row its value (null where
    none did).
    """
    hits = {x.name: resolve_all(df.columns, x, case_sensitive) for x in spec}
    if unknown := set(traced) - set(hits):
        raise ValueError(f"no logical columns: {', '.join(sorted(unknown))}")

    def typed(logical: Logical, hit: str) -> Column:
        column = F.col(f"`{hit}`")
        if logical.dtype == "string":
            return column.cast("string")
        return column.try_cast(logical.dtype) if logical.dtype else column

    out = []
    for logical in spec:
        found = hits[logical.name] if logical.by_row else hits[logical.name][:1]
        if (logical.omit and not found) or any(hits.get(other) for other in logical.unless):
            continue
        values = [typed(logical, hit) for hit in found] or [F.lit(None).cast(logical.dtype or "string")]
        out.append(F.coalesce(*values).alias(logical.name))
        if logical.name in traced:
            given = [F.when(v.isNotNull(), F.lit(hit)) for v, hit in zip(values, found)]
            out.append(F.coalesce(*given, F.lit(None).cast("string")).alias(f"{logical.name}_from"))
    return df.select(*out)
