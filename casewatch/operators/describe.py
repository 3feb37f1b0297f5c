"""Descriptive tables by exposure. Inputs hold one row per case, or report rows for row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.functions.numbers import pct, ratio
from casewatch.functions.reports import first_class_label
from casewatch.operators.exposure import long_form
from casewatch.operators.ranking import quantiles_of_counts

Labels = Mapping[str, str]


def count_by(df: DataFrame, labels: Labels, column: str, n: str = "n") -> DataFrame:
    """Rows per exposure and value of a column (a null value is a group); empty pairs dropped."""
    wide = df.groupBy(column).agg(*[F.sum(flag).cast("bigint").alias(flag) for flag in labels])
    return long_form(wide, [column], labels, {n: lambda f: F.col(f)}).filter(F.col(n) > 0)


def quantiles_by(df: DataFrame, labels: Labels, value: str) -> DataFrame:
    """Non-missing count, median, first and third quartile of a value per exposure.

    Writes the distinct values with their counts once.
    """
    wide = df.filter(F.col(value).isNotNull()).groupBy(value).agg(
        *[F.sum(flag).cast("bigint").alias(flag) for flag in labels]
    )
    counts = long_form(wide, [value], labels, {"n": lambda f: F.col(f)}).filter("n > 0")
    found = quantiles_of_counts(counts, value, (0.25, 0.5, 0.75), ["exposure"])
    return found.select(
        "exposure", "n", F.get("q", 1).alias("median"), F.get("q", 0).alias("q1"), F.get("q", 2).alias("q3")
    )


def moments_by(df: DataFrame, labels: Labels, value: str) -> DataFrame:
    """Non-missing count, mean and sample standard deviation of a value per exposure."""
    def held(flag: str) -> Column:
        return F.when(F.col(flag) == 1, F.col(value))

    aggregates = []
    for flag in labels:
        aggregates += [
            F.count(held(flag)).alias(f"_n_{flag}"),
            F.avg(held(flag)).alias(f"_m_{flag}"),
            F.stddev_samp(held(flag)).alias(f"_s_{flag}"),
        ]
    return long_form(df.agg(*aggregates), [], labels, {
        "n": lambda f: F.col(f"_n_{f}"), "mean": lambda f: F.col(f"_m_{f}"), "sd": lambda f: F.col(f"_s_{f}"),
    })


def yearly_counts(df: DataFrame, labels: Labels, year: str = "year") -> DataFrame:
    return count_by(df.filter(F.col(year).isNotNull()), labels, year)


def shares(df: DataFrame, group: str, category: str) -> DataFrame:
    """Count per group and category with the group total and the share within the group."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("n_total", total).withColumn("share", ratio("n", "n_total"))


def top_categories(df: DataFrame, group: str, category: str, k: int = 10) -> DataFrame:
    """The k most frequent categories per group, ties in category order, with the share of all group rows.

    Rows without a category count towards the group total only.
    """
    within = Window.partitionBy(group)
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    named = counts.withColumn("n_total", F.sum("n").over(within)).filter(F.length(category) > 0)
    rank = F.row_number().over(within.orderBy(F.desc("n"), category))
    best = named.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
    return best.withColumn("share", ratio("n", "n_total"))


def onset_table(cases: DataFrame, labels: Labels, bin_column: str = "tto_bin", outcome: str = "outcome") -> DataFrame:
    """Reports, outcome cases and outcome rate per first matching class and onset bin."""
    first = first_class_label({label: F.col(flag) for flag, label in labels.items()})
    return (
        cases.withColumn("exposure", first)
        .filter(F.col("exposure").isNotNull())
        .groupBy("exposure", bin_column)
        .agg(F.count(F.lit(1)).alias("total_reports"), F.sum(outcome).cast("bigint").alias("outcome_cases"))
        .withColumn("rate_pct", pct("outcome_cases", "total_reports"))
    )


def stack_tables(tables: Mapping[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Result tables below each other with a tag; columns missing in one become null."""
    out = None
    for name, table in tables.items():
        tagged = table.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def preview(df: DataFrame, order: Sequence[Column | str], n: int = 20) -> DataFrame:
    """First n rows in the given order."""
    return df.orderBy(*order).limit(n)
