"""Exact cumulative sums and quantiles that never sort all values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.session import stored


def running_totals(
    collapsed: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add `<x>_upto` (sum of x over values <= this one) and `<x>_all` (group total) for each x in `sums`.

    `collapsed` holds one row per (by, value). Rows are dealt to `ranges` partitions (by default one per shuffle
    partition) by group and value and written with the number of their partition, so that every reader sees the same
    ranges. Sums run inside a range and start from the totals of the group's ranges before; a row's cost does not
    depend on the number of ranges, and only one row per group and range meets in a window over all ranges.
    """
    if ranges is None:
        ranges = int(collapsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = collapsed.repartitionByRange(max(ranges, 1), *by, value)
    placed = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [*by, "_range"]
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = placed.groupBy(*keys).agg(*[F.sum(x).alias(f"_in_{x}") for x in sums]).select(
        *keys,
        *[F.coalesce(F.sum(f"_in_{x}").over(below), F.lit(0)).alias(f"_below_{x}") for x in sums],
        *[F.sum(f"_in_{x}").over(whole).alias(f"{x}_all") for x in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(starts, keys)
        .withColumns({f"{x}_upto": F.sum(x).over(inside) + F.col(f"_below_{x}") for x in sums})
        .drop("_range", *[f"_below_{x}" for x in sums])
    )


def quantiles_of_counts(
    collapsed: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), n: str = "n"
) -> DataFrame:
    """Continuous quantiles (linear between order statistics, type 7) from (by, value, count) rows.

    Result: (by, n, q array in the order of `probabilities`).
    """
    ranked = running_totals(collapsed, value, [n], by)
    first, upto = F.col(f"{n}_upto") - F.col(n), F.col(f"{n}_upto")
    total = F.col(f"{n}_all")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < upto), F.col(value)))

    parts = []
    for i, probability in enumerate(probabilities):
        low = F.floor((total - 1) * F.lit(float(probability)))
        parts += [at(low).alias(f"_lo{i}"), at(F.least(low + 1, total - 1)).alias(f"_hi{i}")]
    picked = ranked.groupBy(*by).agg(F.max(total).alias("n"), *parts)

    def between(i: int, probability: float) -> Column:
        position = (F.col("n") - 1) * F.lit(float(probability))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return low + (position - F.floor(position)) * (high - low)

    return picked.select(
        *by, "n", F.array(*[between(i, p) for i, p in enumerate(probabilities)]).alias("q")
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of a column, nulls ignored, from the distinct values with their counts."""
    collapsed = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(collapsed, value, probabilities, by)
