"""One row per case."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions import reports as R
from casewatch.functions.numbers import order_key
from casewatch.functions.text import safe_double
from casewatch.sources.binding import SERIOUS_FLAGS
from casewatch.operators.exposure import Dictionary, flag_columns
from casewatch.operators.folds import text_hash


def universe(reports: DataFrame) -> DataFrame:
    return reports.select("case_id").distinct()


def representative(value: Column, order: Column | None = None) -> Column:
    """One non-null value per group, the same on every run: smallest, or the one first in `order`."""
    if order is None:
        return F.min(value)
    return F.min_by(value, F.when(value.isNotNull(), order))


def value_code(position: Column, raw: Column, by_value: bool = False) -> Column:
    """A reported value as one number, of which the smallest represents a case; null where `raw` is.

    By default it is the position (below 16) of the level, so the first level wins. With `by_value` a hash of the
    raw text stands before it, which picks one of the values without favouring a level. Aggregating numbers keeps
    the case table a hash aggregate; text would need a sort.
    """
    code = text_hash(raw.cast("string")) * 16 + position if by_value else position
    return F.when(raw.isNotNull(), code)


def value_position(code: Column) -> Column:
    return (code % 16).cast("int")


def level_code(label: Column, levels: Sequence[str], raw: Column, by_value: bool = False) -> Column:
    return value_code(order_key(label, levels), raw, by_value)


def level_label(code: Column, levels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in levels]), value_position(code) - 1)


def case_table(
    reports: DataFrame,
    flags: Mapping[str, Column] | None = None,
    anys: Mapping[str, Column] | None = None,
    picks: Mapping[str, Column] | None = None,
    keys: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Group the report rows once: `max` of 0/1 columns, smallest non-null value of the others.

    This replaces a universe joined to one table per attribute, and combines map-side, so a case
    holding a large share of all rows costs one row per task.
    """
    aggregates = [F.max(c).alias(name) for name, c in {**(flags or {}), **(anys or {})}.items()]
    aggregates += [representative(c).alias(name) for name, c in (picks or {}).items()]
    return reports.groupBy(*keys).agg(*aggregates)


def report_age(df: DataFrame) -> Column:
    """Age in years: a column that holds years first, else the raw age, converted when the table has a unit."""
    raw = R.age_to_years("age", "age_unit") if "age_unit" in df.columns else safe_double("age")
    return F.coalesce(F.col("age_years"), raw) if "age_years" in df.columns else raw


def age_code(df: DataFrame, by_value: bool = False) -> Column:
    """What represents the age of a row in a case table: years, or the level's code where the source has bands only."""
    if "age_group" not in df.columns:
        return report_age(df)
    band = F.trim("age_group")
    return level_code(band, D.AGE_LEVELS, F.when(band.isin(list(D.AGE_LEVELS)), band), by_value)


def age_level(df: DataFrame, code: Column) -> Column:
    """The age band from an aggregated `age_code` of the same reports; labels that are no band count as missing."""
    return level_label(code, D.AGE_LEVELS) if "age_group" in df.columns else R.age_band(code)


def subgroup_universe(
    reports: DataFrame,
    dictionary: Dictionary = D.DRUG_CLASSES,
    outcomes: Iterable[int] = tuple(D.OUTCOME_TERMS),
    how: str = "exact",
    roles: Iterable[str] | None = None,
    serious_flags: Sequence[str] | None = None,
    multi: bool = False,
    by_value: bool = False,
) -> DataFrame:
    """Case universe for subgroup signals: groups, exposure flags, outcome.

    `by_value`: how one value represents a case that reports several (`value_code`).

    Seriousness comes from `serious_flags`, by default the sub-flags that the table has; without any it is null.
    With `multi`, a case reported with several sexes or regions yields one row per combination.
    """
    if serious_flags is None:
        serious_flags = [name for name in SERIOUS_FLAGS if name in reports.columns]
    sex_levels = ("F", "M", "Other")
    groups = {
        "sex_grp": (R.sex3("sex"), F.col("sex"), sex_levels),
        "region_grp": (R.region5("region"), F.col("region"), D.REGION_LEVELS),
    }
    indication = level_code(R.indication_group("indication"), D.INDICATION_LEVELS, F.col("indication"), by_value)
    picks = {"_indication": indication, "_age": age_code(reports, by_value)}
    flags = flag_columns(dictionary, how, roles, prefix="exposed_")
    anys = {
        "_serious": R.serious_row(serious_flags).cast("int") if serious_flags else F.lit(None).cast("int"),
        "outcome": R.is_outcome("pt_code", outcomes),
    }
    if not multi:
        picks |= {f"_{name}": level_code(label, levels, source, by_value)
                  for name, (label, source, levels) in groups.items()}
    cases = case_table(reports, flags, anys, picks)
    if multi:
        combos = reports.select("case_id", *[label.alias(name) for name, (label, _, _) in groups.items()]).distinct()
        cases = cases.join(combos, "case_id")
        group_columns = [F.col(name) for name in groups]
    else:
        group_columns = [
            F.coalesce(level_label(F.col(f"_{name}"), levels), F.lit(levels[-1])).alias(name)
            for name, (_, _, levels) in groups.items()
        ]
    return cases.select(
        "case_id",
        *group_columns,
        age_level(reports, F.col("_age")).alias("age_group"),
        F.coalesce(level_label(F.col("_indication"), D.INDICATION_LEVELS), F.lit("Other")).alias("indication_grp"),
        F.when(F.col("_serious").isNotNull(), R.serious_label("_serious")).alias("serious_grp"),
        *flags,
        "outcome",
    )


def with_flag(cases: DataFrame, flagged: DataFrame, name: str) -> DataFrame:
    """Left join a set of cases as a 0/1 column."""
    marks = flagged.select("case_id").distinct().withColumn("_hit", F.lit(1))
    return cases.join(marks, "case_id", "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def stratum_defaults(df: DataFrame) -> DataFrame:
    """Missing group labels become the catch-all group; age stays missing."""
    return df.fillna(
        {"sex_grp": "Other", "region_grp": "OTHER", "indication_grp": "Other", "serious_grp": "Non-serious"}
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, the missing value included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def outcome_by_code_or_name(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Outcome flag by term code, falling back to the term name."""
    codes = lookup.filter("code IS NOT NULL").select(F.col("code").alias("_code")).distinct()
    names = lookup.filter("name IS NOT NULL AND name <> ''").select(F.upper("name").alias("_name")).distinct()
    return (
        rows.join(codes, F.col("pt_code") == F.col("_code"), "left")
        .join(names, F.upper("pt") == F.col("_name"), "left")
        .withColumn("outcome", F.coalesce(F.col("_code").isNotNull() | F.col("_name").isNotNull(), F.lit(False)).cast("int"))
        .drop("_code", "_name")
    )
