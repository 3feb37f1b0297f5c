"""Parquet and CSV files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.sources.binding import Logical, bind_columns


def read_reports(
    spark: SparkSession, path: str, spec: Sequence[Logical] | None = None, case_sensitive: bool = False, traced: Sequence[str] = ()
) -> DataFrame:
    """Report table from parquet, bound to logical columns when a spec is given (`traced`: see `bind_columns`)."""
    raw = spark.read.parquet(path)
    return bind_columns(raw, spec, case_sensitive, traced) if spec else raw


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Write `df` beside `path`, then put it in its place.

    A run that fails while writing leaves the old result as it was. The old folder is set aside by a rename and goes
    only when the new one is in place; if that fails, it is put back.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = (hadoop(target.getParent(), f".{target.getName()}-{kind}-{mark}") for kind in ("new", "old"))
    try:
        df.write.format(form).options(**options).save(new.toString())
    except Exception:
        files.delete(new, True)
        raise
    had = files.exists(target)
    if had and not files.rename(target, old):
        files.delete(new, True)
        raise OSError(f"{path} cannot be set aside")
    if not files.rename(new, target):
        if had:
            files.rename(old, target)
        raise OSError(f"{path} cannot be replaced; the new result is in {new.toString()}")
    if had:
        files.delete(old, True)


def write_table(df: DataFrame, path: str) -> None:
    """Result table as CSV part files with a header, in the order of the rows; replaces an older one as a whole."""
    replace(df, path, "csv", header=True)


def buckets_for(rows: int, least: int = 8, rows_a_bucket: int = 150_000) -> int:
    """Number of buckets that grows with the rows, so that a bucket does not."""
    return max(least, -(-rows // rows_a_bucket))


def write_by_case(df: DataFrame, table: str, path: str, buckets: int, key: str = "case_id") -> DataFrame:
    """Report table stored in buckets of the case id: case-level groupings and joins of it need no shuffle.

    Choose the buckets so that one fits a task (`buckets_for`); tables that are to be joined take the same number.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, key)  # one file a bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def profile(df: DataFrame, flags: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """Row count and sum of each flag, overall or by a column."""
    sums = [F.sum(flag).cast("bigint").alias(flag) for flag in flags]
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), *sums)
