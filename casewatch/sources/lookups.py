"""Small side tables: dictionaries and code lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.functions.text import safe_double, upper_trim


def read_lookup(
    spark: SparkSession,
    path: str,
    code_like: str = r"code|pt_code|meddra",
    name_like: str = r"pt$|pt_name|preferred",
) -> DataFrame:
    """CSV list as (code, name): columns are found by header pattern, names upper-cased.

    Empty names become null so that they never match an empty term.
    """
    raw = spark.read.csv(path, header=True)

    def find(pattern: str, taken: str | None = None) -> str | None:
        return next((c for c in raw.columns if c != taken and re.search(pattern, c, re.IGNORECASE)), None)

    code = find(code_like)
    name = find(name_like, taken=code)
    if code is None and name is None:
        raise ValueError(f"no code or name column among {', '.join(raw.columns)}")
    code_col = safe_double(F.col(f"`{code}`")).cast("bigint") if code else F.lit(None).cast("bigint")
    name_col = F.nullif(upper_trim(F.col(f"`{name}`")), F.lit("")) if name else F.lit(None).cast("string")
    return raw.select(code_col.alias("code"), name_col.alias("name")).distinct()


def lookup_from_dict(spark: SparkSession, mapping: Mapping[str, Iterable]) -> DataFrame:
    """label -> keys as rows (key, label)."""
    rows = [(key, label) for label, keys in mapping.items() for key in keys]
    key_type = "bigint" if rows and isinstance(rows[0][0], int) else "string"
    return spark.createDataFrame(rows, f"key {key_type}, label string")


def keep_classes(lookup: DataFrame, classes: Iterable[str], label: str = "label") -> DataFrame:
    return lookup.filter(F.col(label).isin(list(classes)))

