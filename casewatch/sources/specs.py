"""Locked model specs and run manifests as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEC_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("coefficients", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("training_meta", T.MapType(T.StringType(), T.StringType())),
])


@dataclass(frozen=True)
class ModelSpec:
    """Intercept and named coefficients of a logistic model."""

    intercept: float
    coefficients: Mapping[str, float]
    model_id: str = "model"
    family: str = "binomial"
    link: str = "logit"
    training_meta: Mapping[str, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (
            self.model_id, self.family, self.link, float(self.intercept),
            {k: float(v) for k, v in self.coefficients.items()}, dict(self.training_meta),
        )
        return spark.createDataFrame([row], SPEC_SCHEMA)


def spec_from_frame(spec: DataFrame) -> ModelSpec:
    """The one row of a spec table as an object; a spec holds one number per model term."""
    row = spec.select("model_id", "family", "link", "intercept", "coefficients", "training_meta").first()
    if row is None or not row["coefficients"]:
        raise ValueError("the model spec has no coefficients")
    return ModelSpec(
        intercept=row["intercept"] or 0.0,
        coefficients=row["coefficients"],
        model_id=row["model_id"] or "model",
        family=row["family"] or "binomial",
        link=row["link"] or "logit",
        training_meta=row["training_meta"] or {},
    )


def write_spec(spec: DataFrame, path: str) -> None:
    spec.write.mode("overwrite").json(path)


def read_spec(spark: SparkSession, path: str) -> ModelSpec:
    """Spec from JSON (single or multi line); a missing intercept is 0, missing coefficients an error."""
    raw = spark.read.schema(SPEC_SCHEMA).json(path, multiLine=True)
    return spec_from_frame(raw.withColumn("intercept", F.coalesce("intercept", F.lit(0.0))))


def write_manifest(spark: SparkSession, manifest: Mapping[str, object], path: str) -> None:
    """Run manifest: one JSON line."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").write.mode(
        "overwrite"
    ).text(path)
