"""Score a locked model on several sources and compare it with the observed outcome."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.functions.numbers import clip_probability
from casewatch.operators.describe import stack_tables
from casewatch.operators.evaluate import calibration_table, metric_summary
from casewatch.operators.scoring import score
from casewatch.sources.specs import ModelSpec, write_manifest


def predictions(features: DataFrame, spec: ModelSpec) -> DataFrame:
    """(ID, outcome, prob, eta) for a feature table."""
    named = features.withColumnRenamed("caseid", "ID") if "ID" not in features.columns else features
    for required in ("ID", "outcome"):
        if required not in named.columns:
            raise ValueError(f"the feature table has no {required} column")
    return score(named, spec, ("ID", "outcome")).select("ID", "outcome", "prob", "eta")


def clipped(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("outcome").alias("y"), clip_probability("prob").alias("p"))


def validate(features: Mapping[str, DataFrame], spec: ModelSpec) -> DataFrame:
    """Metrics of all sources: (dataset, metric, value)."""
    tables = {
        tag: metric_summary(clipped(predictions(table, spec)), tag).drop("dataset")
        for tag, table in features.items()
    }
    return stack_tables(tables).select("dataset", "metric", "value")


def validation_bins(features: DataFrame, spec: ModelSpec, bins: int = 10) -> DataFrame:
    return calibration_table(clipped(predictions(features, spec)), bins=bins, closed="left")


def validation_manifest(
    spark: SparkSession, spec: ModelSpec, scored: Mapping[str, DataFrame], path: str, inputs: Mapping[str, str]
) -> None:
    """Write what was scored with which model; counts rows of each source."""
    write_manifest(
        spark,
        {
            "timestamp": datetime.now(timezone.utc).isoformat(),
            "model_id": spec.model_id,
            "inputs": dict(inputs),
            "n_rows_scored": {tag: df.count() for tag, df in scored.items()},
            "features_used": len(spec.coefficients),
            "locked_feature_names": list(spec.coefficients),
        },
        path,
    )
