"""Locked model records: named by the hash of all that defines the model, verified when read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from casewatch.sources.specs import ModelSpec

FIELDS = ("family", "link", "alpha", "seed", "folds", "terms", "dictionary", "levels", "penalties", "lambda_min", "lambda_1se", "coefficients")


class LockMismatch(ValueError):
    """A record does not say what its name says, or is not about the given dictionary or levels."""


def _canonical(record: Mapping[str, object]) -> str:
    """One text per record: object keys sorted, list order kept, numbers in their shortest exact form."""
    return json.dumps(record, sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def lock_id(record: Mapping[str, object]) -> str:
    return hashlib.sha256(_canonical(record).encode()).hexdigest()


def as_lists(named: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    return {k: list(v) for k, v in named.items()}


def write_lock(spark: SparkSession, record: Mapping[str, object], folder: str) -> str:
    """Write the record below `folder` under its hash and return the hash; a record that is there stays."""
    if missing := set(FIELDS) - set(record):
        raise ValueError(f"the record lacks {', '.join(sorted(missing))}")
    name = lock_id(record)
    spark.createDataFrame([(_canonical(record),)], "value string").coalesce(1).write.mode("ignore").text(f"{folder.rstrip('/')}/{name}")
    return name


def read_lock(
    spark: SparkSession, folder: str, name: str, dictionary: Mapping[str, Sequence[str]] | None = None,
    levels: Mapping[str, Sequence[str]] | None = None,
) -> dict:
    """The record of that name. Refused if its content has another hash, or if a dictionary or level order that the
    caller is about to use differs from the one it was fitted with (the order of names in a dictionary is free, that
    of levels is not)."""
    lines = [r["value"] for r in spark.read.text(f"{folder.rstrip('/')}/{name}").limit(2).collect()]
    if len(lines) != 1:
        raise LockMismatch(f"{name}: not one record")
    record = json.loads(lines[0])
    if lock_id(record) != name:
        raise LockMismatch(f"{name}: the content has the hash {lock_id(record)}")
    if dictionary is not None:
        sets = lambda d: {k: sorted(v) for k, v in d.items()}
        if sets(as_lists(dictionary)) != sets(record["dictionary"]):
            raise LockMismatch(f"{name}: fitted with another dictionary")
    if levels is not None and as_lists(levels) != record["levels"]:
        raise LockMismatch(f"{name}: fitted with other levels or in another order")
    return record


def locked_spec(record: Mapping[str, object], rule: str = "1se") -> ModelSpec:
    """Intercept and coefficients of the record at the penalty chosen by `rule`, with the record's hash."""
    fitted = record["coefficients"][rule]
    return ModelSpec(fitted["intercept"], dict(zip(record["terms"], fitted["beta"])), model_id=lock_id(record), training_meta={"rule": rule})


def penalty_rows(record: Mapping[str, object], spark: SparkSession):
    """(i, lambda, is_min, is_1se): the penalties of the path in order."""
    rows = [(i, p, p == record["lambda_min"], p == record["lambda_1se"]) for i, p in enumerate(record["penalties"])]
    return spark.createDataFrame(rows, "i int, lambda double, is_min boolean, is_1se boolean").withColumn("lock_id", F.lit(lock_id(record)))
