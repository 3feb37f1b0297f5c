"""Which cases are exposed to which class or drug."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions.text import flag_name, match, matched_labels

Dictionary = Mapping[str, Iterable[str]]


def in_roles(roles: Iterable[str] | None, role: str = "role") -> Column:
    return F.lit(True) if roles is None else F.coalesce(F.upper(role).isin(list(roles)), F.lit(False))


def flag_columns(
    dictionary: Dictionary,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
    prefix: str = "flag_",
    drug: str = "drug",
) -> dict[str, Column]:
    """Row-level 0/1 exposure columns, evaluated in the scan stage.

    A dictionary is configuration and becomes literals in the plan, so neither a join nor a shuffle
    on drug names (a few of which hold most rows) is needed.
    """
    suspect = in_roles(roles)
    return {
        flag_name(label, prefix): (suspect & match(drug, words, how)).cast("int")
        for label, words in dictionary.items()
    }


def flag_labels(dictionary: Dictionary, prefix: str = "flag_") -> dict[str, str]:
    return {flag_name(label, prefix): label for label in dictionary}


def suspect_pairs(reports: DataFrame, roles: Iterable[str] | None = D.SUSPECT_ROLES) -> DataFrame:
    """Distinct (case, drug) in the given roles, empty names dropped."""
    return (
        reports.filter(in_roles(roles) & (F.length("drug") > 0)).select("case_id", "drug").distinct()
    )


def class_exposures(
    reports: DataFrame,
    dictionary: Dictionary,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> DataFrame:
    """Distinct (case_id, exposure) with one row per dictionary label the case is exposed to."""
    labels = matched_labels("drug", dictionary, how)
    return (
        reports.filter(in_roles(roles) & (F.length("drug") > 0))
        .select("case_id", F.explode(labels).alias("exposure"))
        .distinct()
    )


def drug_exposures(
    reports: DataFrame,
    dictionary: Dictionary,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> DataFrame:
    """Distinct (case_id, exposure = drug name) of the drugs that match any dictionary label."""
    every_word = [word for words in dictionary.values() for word in words]
    return (
        reports.filter(in_roles(roles) & (F.length("drug") > 0) & match("drug", every_word, how))
        .select("case_id", F.col("drug").alias("exposure"))
        .distinct()
    )


GRAM = 3


def _grams(text: str, shortest: int) -> Column:
    """Distinct substrings of `shortest` to GRAM characters; a text shorter than GRAM is its own longest gram."""
    sizes = F.sequence(F.least(F.lit(shortest), F.length(text)), F.least(F.lit(GRAM), F.length(text)))
    of_size = F.transform(
        sizes, lambda size: F.transform(
            F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(F.col(text), i, size)
        )
    )
    return F.array_distinct(F.flatten(of_size))


def rarest_grams(keys: DataFrame, grams: DataFrame) -> DataFrame:
    """(_key, _gram): for each key the one of its grams that the fewest names have.

    `grams` holds (_drug, _gram) of the names. Keys with a gram that no name has are left out: no name contains them.
    """
    parts = keys.select("_key").distinct().select("_key", F.explode(_grams("_key", GRAM)).alias("_gram"))
    wanted = grams.join(parts.select("_gram").distinct(), "_gram", "left_semi")
    sizes = wanted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_names"))
    rarest = F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("_names"), "_gram"))
    best = parts.join(sizes, "_gram", "left").groupBy("_key").agg(rarest.alias("_best"))
    return best.filter("_best._names > 0").select("_key", F.col("_best._gram").alias("_gram"))


def name_candidates(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(_drug, _key) pairs of which the key's rarest gram occurs in the name: all pairs that can match, few others."""
    grams = names.select("_drug", F.explode(_grams("_drug", 1)).alias("_gram"))
    return grams.join(rarest_grams(keys, grams), "_gram").select("_drug", "_key")


def upper_keys(lookup: DataFrame) -> DataFrame:
    return lookup.select(F.upper("key").alias("_key"), "label").filter(F.length("_key") > 0).distinct()


def distinct_names(reports: DataFrame) -> DataFrame:
    return reports.select(F.upper("drug").alias("_drug")).filter(F.length("_drug") > 0).distinct()


def join_dictionary(reports: DataFrame, lookup: DataFrame, how: str = "exact") -> DataFrame:
    """Rows joined to a lookup table (key, label): the form for dictionaries too large to be literals.

    `exact` is an equi-join on the upper-cased name. `contains` first tags the distinct names, then joins
    the tags back, so substring tests grow with the vocabulary and not with the rows. Candidate keys
    of a name are found by an equi-join on the key's rarest gram of three letters, so keys that share a
    beginning with many names do not meet them all.
    """
    upper = reports.withColumn("_drug", F.upper("drug"))
    keys = upper_keys(lookup)
    if how == "exact":
        return upper.join(keys, F.col("_drug") == F.col("_key")).drop("_drug", "_key")
    matched = name_candidates(distinct_names(reports), keys).filter(F.contains("_drug", "_key"))
    tags = matched.join(keys, "_key").select("_drug", "label").distinct()
    return upper.join(tags, "_drug").drop("_drug")


def exposed_rows(reports: DataFrame, exposed: DataFrame) -> DataFrame:
    """Rows of the cases present in `exposed`."""
    return reports.join(exposed, "case_id", "left_semi")


def case_flags(
    reports: DataFrame,
    dictionary: Dictionary,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> DataFrame:
    """One row per case with a 0/1 column per label: one conditional aggregate, combined map-side."""
    flags = flag_columns(dictionary, how, roles)
    return reports.groupBy("case_id").agg(*[F.max(c).alias(name) for name, c in flags.items()])


def exposed_flags(
    reports: DataFrame,
    dictionary: Dictionary,
    how: str = "contains",
    roles: Iterable[str] | None = D.SUSPECT_ROLES,
) -> DataFrame:
    """`case_flags` of the exposed cases only: rows without a match are dropped before the aggregate."""
    every_word = [word for words in dictionary.values() for word in words]
    matching = reports.filter(in_roles(roles) & match("drug", every_word, how))
    return case_flags(matching, dictionary, how, None)


def text_flags(df: DataFrame, text: str, dictionary: Dictionary) -> DataFrame:
    """Flags from a column that already holds all drug names of a case."""
    return df.select(
        "case_id",
        *[match(text, words, "contains").cast("int").alias(flag_name(label)) for label, words in dictionary.items()],
    )


def exposure_counts(flagged: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Number of flagged rows per exposure; aggregates wide, then turns the single row into long form."""
    sums = flagged.agg(*[F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias(flag) for flag in labels])
    return long_form(sums, [], labels, {"n": lambda flag: F.col(flag)})


def long_form(wide: DataFrame, keys: list[str], labels: Mapping[str, str], values: Mapping) -> DataFrame:
    """Rows (keys, exposure, values...) from one wide aggregate row per key.

    `values` maps an output name to a function of the flag name giving that flag's column.
    """
    entries = [
        F.struct(F.lit(label).alias("exposure"), *[make(flag).alias(name) for name, make in values.items()])
        for flag, label in labels.items()
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))
