"""Row filters and guards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions.text import as_col, in_dictionary


def with_roles(df: DataFrame, roles: Iterable[str] = D.SUSPECT_ROLES, role: str = "role") -> DataFrame:
    return df.filter(F.upper(role).isin(list(roles)))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.length(column) > 0)


def target_rows(df: DataFrame, drugs: Iterable[str], codes: Iterable[int] | None = None) -> DataFrame:
    """Rows of a target drug or, when codes are given, of an outcome code."""
    hit = in_dictionary("drug", drugs)
    if codes is not None:
        hit = hit | F.col("pt_code").isin(list(codes))
    return df.filter(hit)


def any_exposure(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(F.col(flag), F.lit(0))
    return df.filter(total > 0)


def non_serious(df: DataFrame, flag: str = "serious") -> DataFrame:
    return df.filter(F.col(flag).isNull() | (F.col(flag) == 0))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def complete_case_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total, kept and dropped row counts of `complete_cases`, in one pass."""
    complete = F.lit(True)
    for column in columns:
        complete = complete & F.col(column).isNotNull()
    counts = df.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(complete).alias("n_keep"))
    return counts.withColumn("n_drop", F.col("n_all") - F.col("n_keep"))


def valid_age(df: DataFrame, age: str = "age") -> DataFrame:
    return df.filter(F.col(age) > 0)


def is_finite(c: Column | str) -> Column:
    value = as_col(c).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_pairs(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.filter(is_finite(y) & is_finite(p))


def drop_terms(df: DataFrame, terms: Iterable[str] = ("(Intercept)", "id_case"), term: str = "term") -> DataFrame:
    return df.filter(~F.col(term).isin(list(terms)))


def require_two_classes(df: DataFrame, y: str = "y") -> DataFrame:
    """Raise unless the 0/1 column holds both values; runs one small aggregate."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    if low is None or low == high:
        raise ValueError(f"{y} has fewer than two values; no model can be fitted")
    return df
