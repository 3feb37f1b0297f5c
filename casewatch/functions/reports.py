"""Report attributes: age, sex, date, place, indication, seriousness, onset."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch import defaults as D
from casewatch.functions.text import as_col, contains_any, safe_double, shortest_words, upper_trim


def age_to_years(age: Column | str, unit: Column | str) -> Column:
    """Age in years; null when the age is not a number or the unit is unknown."""
    value = safe_double(age)
    code = F.upper(F.coalesce(as_col(unit).cast("string"), F.lit("")))
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for spellings, per_year in D.AGE_UNITS:
        years = value * F.lit(10.0) if per_year == 0.1 else value / F.lit(per_year)
        out = out.when(code.isin(list(spellings)), years)
    return out


def age_band(age: Column | str) -> Column:
    """Closed bands over whole years: 39.5 and 64.5 fall between bands and give null, as do ages <= 0."""
    a = as_col(age)
    return (
        F.when(a <= 0, F.lit(None).cast("string"))
        .when(a < 18, "<18")
        .when(a.between(18, 39), "18-39")
        .when(a.between(40, 64), "40-64")
        .when(a >= 65, "65+")
    )


def age_band_cut(age: Column | str) -> Column:
    """Left-closed cuts at 18, 40 and 65: no gaps."""
    a = as_col(age)
    return F.when(a < 18, "<18").when(a < 40, "18-39").when(a < 65, "40-64").when(a.isNotNull(), "65+")


def sex3(c: Column | str, labels: Sequence[str] = ("F", "M", "Other")) -> Column:
    text = F.upper(F.coalesce(as_col(c), F.lit("")))
    return (
        F.when(text.isin(list(D.FEMALE_WORDS)), labels[0])
        .when(text.isin(list(D.MALE_WORDS)), labels[1])
        .otherwise(labels[2])
    )


def sex_cat(c: Column | str) -> Column:
    """Second-source spellings, including Japanese."""
    text = upper_trim(c)
    return (
        F.when(text.isin("M", "MALE", "男性"), "Male")
        .when(text.isin("F", "FEMALE", "女性"), "Female")
        .otherwise("Other/Unknown")
    )


def sex_male(c: Column | str) -> Column:
    return F.coalesce(upper_trim(c).isin("M", "MALE"), F.lit(False)).cast("int")


def sex_unknown(c: Column | str) -> Column:
    """1 when the sex is given but is neither male nor female; null counts as 0."""
    return F.coalesce(~upper_trim(c).isin("M", "MALE", "F", "FEMALE"), F.lit(False)).cast("int")


def event_year(c: Column | str) -> Column:
    text = as_col(c).cast("string")
    return F.when(text.rlike("^[0-9]{8}$"), F.substring(text, 1, 4).try_cast("int"))


def country_use(occurrence: Column | str, reporter: Column | str) -> Column:
    return F.coalesce(F.nullif(as_col(occurrence), F.lit("")), as_col(reporter))


def region5(c: Column | str) -> Column:
    text = F.upper(as_col(c))
    return F.when(text.isin(list(D.REGION_LEVELS[:4])), text).otherwise(D.REGION_LEVELS[4])


def indication_group(
    c: Column | str,
    transplant: Iterable[str] = D.TRANSPLANT_WORDS,
    autoimmune: Iterable[str] = D.AUTOIMMUNE_WORDS,
    whole_word: bool = False,
) -> Column:
    """Three groups by keyword, transplant first. Keywords match inside words unless `whole_word`."""
    text = F.upper(as_col(c))
    other, tx, ai = D.INDICATION_LEVELS

    def named(words: Iterable[str]) -> Column:
        if whole_word:
            return text.rlike(rf"\b({'|'.join(words)})\b")
        return contains_any(text, shortest_words(words))

    return F.when(named(transplant), tx).when(named(autoimmune), ai).otherwise(other)


def indication_dummy(group: Column | str) -> Column:
    return (as_col(group) == D.INDICATION_LEVELS[1]).cast("int")


def serious_row(flags: Iterable[Column | str]) -> Column:
    """True when any of the sub-flags is above zero in sum; nulls count as zero."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(as_col(flag).try_cast("int"), F.lit(0))
    return total > 0


def serious_label(flag: Column | str) -> Column:
    return F.when(as_col(flag) == 1, D.SERIOUS_LEVELS[0]).otherwise(D.SERIOUS_LEVELS[1])


def truthy(c: Column | str, dtype: T.DataType) -> Column:
    """1 for 1 / '1' / 'Y' / 'YES' / 'TRUE' / true, else 0. Text is case-sensitive; the column type decides."""
    value = as_col(c)
    if isinstance(dtype, T.BooleanType):
        hit = value
    elif isinstance(dtype, T.StringType):
        hit = value.isin("1", "Y", "YES", "TRUE")
    else:
        hit = value == 1
    return F.coalesce(hit, F.lit(False)).cast("int")


def tto_days(*days_by_priority: Column | str) -> Column:
    return F.coalesce(*[as_col(c) for c in days_by_priority])


def tto_bin(days: Column | str) -> Column:
    d = as_col(days)
    out = F.when(d.isNull(), D.ONSET_MISSING)
    for upper, label in D.ONSET_BINS:
        out = out.when(d <= upper, label)
    return out.otherwise(D.ONSET_LAST)


def first_class_label(flags: Mapping[str, Column | str]) -> Column:
    """Label of the first flag set, in mapping order; null when none is."""
    return F.coalesce(*[F.when(as_col(flag) == 1, F.lit(label)) for label, flag in flags.items()])


def is_outcome(code: Column | str, codes: Iterable[int] = tuple(D.OUTCOME_TERMS)) -> Column:
    return F.coalesce(as_col(code).isin(list(codes)), F.lit(False)).cast("int")
