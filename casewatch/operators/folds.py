"""Reproducible fold assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.functions.text import as_col


def text_hash(text: Column) -> Column:
    """32-bit hash of a text that any engine with MD5 reproduces."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def fold_hash(key: Column | str, seed: int) -> Column:
    return text_hash(F.concat(as_col(key).cast("string"), F.lit(f":{seed}")))


def fold_of(key: Column | str, k: int, seed: int = 20251121) -> Column:
    """Fold 1..k of a key; no shuffle, and stable when rows are added."""
    return (F.pmod(fold_hash(key, seed), F.lit(k)) + 1).cast("int")


def balanced_folds(df: DataFrame, key: str, k: int, seed: int = 20251121) -> DataFrame:
    """Folds whose sizes differ by at most one: rank in hash order, modulo k.

    The rank is taken inside equal hash ranges, at least 256 and as many as shuffle partitions, and shifted by the
    sizes of the ranges below. The input is read twice, so pass a written table when its plan is long.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max((partitions - 1).bit_length(), 8)
    hashed = df.withColumn("_hash", fold_hash(key, seed)).withColumn("_range", F.shiftright("_hash", 32 - bits))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", key))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    rank = F.col("_start") + F.col("_inside") - 1
    return (
        hashed.withColumn("_inside", inside)
        .join(starts, "_range")
        .withColumn("fold", (F.pmod(rank, F.lit(k)) + 1).cast("int"))
        .drop("_hash", "_range", "_inside", "_start")
    )
