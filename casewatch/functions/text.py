"""Text normalisation and dictionary matching."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """Upper case, anything but letters, digits, space, '-' and '+' to a space, spaces collapsed, trimmed.

    A run of other characters and spaces becomes one space, so a single pass over the text does both.
    """
    return F.trim(F.regexp_replace(F.upper(F.coalesce(as_col(c), F.lit(""))), r"[^A-Z0-9\-+]+", " "))


def register_norm(spark: SparkSession, name: str = "norm_text") -> None:
    """The same normalisation as a temporary SQL function."""
    spark.sql(
        rf"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING
        RETURN trim(regexp_replace(upper(coalesce(s, '')), r'[^A-Z0-9\-+]+', ' '))"""
    )


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(as_col(c).cast("string")))


def safe_double(c: Column | str) -> Column:
    """Number or null. The pattern keeps Java-only spellings such as '12d' from counting as numbers."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def contains_any(c: Column | str, keywords: Iterable[str]) -> Column:
    """True when any keyword occurs inside the text; false for null."""
    text = F.coalesce(as_col(c), F.lit(""))
    return reduce(lambda left, right: left | right, [F.contains(text, F.lit(k)) for k in keywords])


def shortest_words(words: Iterable[str]) -> list[str]:
    """Words that contain no other word of the list: a substring test needs only these."""
    words = list(dict.fromkeys(words))
    return [w for w in words if not any(other != w and other in w for other in words)]


def in_dictionary(c: Column | str, keys: Iterable[str]) -> Column:
    """True when the upper-cased text equals a key; false for null."""
    return F.coalesce(F.upper(as_col(c)).isin(list(keys)), F.lit(False))


def match(c: Column | str, keywords: Iterable[str], how: str) -> Column:
    if how == "contains":
        return contains_any(F.upper(as_col(c)), shortest_words(keywords))
    if how == "exact":
        return in_dictionary(c, keywords)
    raise ValueError(f"how must be 'contains' or 'exact', not {how!r}")


def matched_labels(c: Column | str, dictionary: Mapping[str, Iterable[str]], how: str = "contains") -> Column:
    """Array of all dictionary labels the text matches, evaluated inside the scan stage (no join)."""
    return F.array_compact(
        F.array(*[F.when(match(c, words, how), F.lit(label)) for label, words in dictionary.items()])
    )


def join_terms(terms: Column | str) -> Column:
    """Terms of an array joined by ';', nulls skipped."""
    return F.array_join(as_col(terms), ";")


def flag_name(label: str, prefix: str = "flag_") -> str:
    """Column name for a label: lower case, runs of other characters to '_'."""
    return prefix + re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")


def flag_slug(c: Column | str, prefix: str = "flag_") -> Column:
    slug = F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]+", "_")
    return F.concat(F.lit(prefix), F.regexp_replace(slug, r"^_+|_+$", ""))
