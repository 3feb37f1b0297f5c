"""Locked models: build a spec from a refit table, score cases, draw up risk portraits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions.numbers import logistic, risk_category, zero_fill
from casewatch.functions.text import join_terms
from casewatch.operators.filters import drop_terms
from casewatch.sources.specs import ModelSpec

INTERCEPT = "(Intercept)"

# Model terms a molecule-level portrait expects.
PORTRAIT_TERMS = (
    "flag_mol_cyclosporine", "flag_mol_everolimus", "flag_mol_temsirolimus", "sexMale", "age_cat18.39",
    "age_cat40.64", "age_cat65.", "indication_grpTransplantation", "indication_grpAutoimmune.diseases",
)
# Portrait levels and the model term each one uses; None is the baseline.
PORTRAIT_MOLECULES = {
    "None": None, "Tacrolimus": "flag_mol_tacrolimus", "Cyclosporine": "flag_mol_cyclosporine",
    "Everolimus": "flag_mol_everolimus", "Sirolimus": "flag_mol_sirolimus",
    "Temsirolimus": "flag_mol_temsirolimus",
}
PORTRAIT_SEXES = {"Female": None, "Male": "sexMale", "Unknown": "sexUnknown"}
PORTRAIT_AGES = {"<18": None, "18-39": "age_cat18.39", "40-64": "age_cat40.64", "65+": "age_cat65."}
PORTRAIT_INDICATIONS = {
    "Other": None, "Transplantation": "indication_grpTransplantation",
    "Autoimmune diseases": "indication_grpAutoimmune.diseases",
}


def lock_spec(refit: DataFrame, model_id: str = "model", meta: Mapping[str, str] | None = None) -> DataFrame:
    """One-row spec from a refit table (term, OR): intercept and coefficients as log odds ratios.

    Fails when the intercept or every other term is missing. The table has one row per model term.
    """
    beta = F.ln("OR")
    intercept = F.max(F.when(F.col("term") == INTERCEPT, beta))
    entry = F.when(~F.col("term").isin(INTERCEPT, "id_case"), F.struct("term", beta.alias("beta")))
    entries = F.array_sort(F.collect_list(entry))
    meta_map = F.create_map(*[F.lit(x) for pair in (meta or {}).items() for x in pair]) if meta else F.expr(
        "map()"
    )
    return refit.agg(intercept.alias("_b0"), entries.alias("_terms")).select(
        F.lit(model_id).alias("model_id"),
        F.lit("binomial").alias("family"),
        F.lit("logit").alias("link"),
        F.coalesce("_b0", F.raise_error("the refit table has no (Intercept) row").cast("double")).alias("intercept"),
        F.when(F.size("_terms") > 0, F.map_from_entries("_terms"))
        .otherwise(F.raise_error("the refit table has no covariates").cast("map<string,double>"))
        .alias("coefficients"),
        meta_map.cast("map<string,string>").alias("training_meta"),
    )


def recalibrate(spec: DataFrame, baseline_risk: float) -> DataFrame:
    """Replace the intercept by the log odds of an assumed baseline risk."""
    return spec.withColumn("intercept", F.ln(F.lit(baseline_risk) / F.lit(1.0 - baseline_risk)))


def linear_predictor(spec: ModelSpec) -> Column:
    total = F.lit(0.0)
    for name, beta in spec.coefficients.items():
        total = total + F.col(f"`{name}`") * F.lit(float(beta))
    return total + F.lit(float(spec.intercept))


def score(df: DataFrame, spec: ModelSpec, keep: Sequence[str] = ("case_id", "outcome")) -> DataFrame:
    """Linear predictor and probability per row; absent or null features count as 0."""
    filled = zero_fill(df, spec.coefficients)
    return filled.select(*keep, linear_predictor(spec).alias("eta")).withColumn("prob", logistic("eta"))


def absent_terms(spec: DataFrame, expected: Iterable[str] = PORTRAIT_TERMS) -> DataFrame:
    """Expected terms the model does not have."""
    known = F.map_keys("coefficients")
    wanted = F.array(*[F.lit(t) for t in expected])
    return spec.select(F.explode(F.array_except(wanted, known)).alias("term"))


def present_terms(coefficients: DataFrame, names: DataFrame, term: str = "term") -> DataFrame:
    """Coefficient rows whose term is among the feature names."""
    return coefficients.join(names.select(term).distinct(), term, "left_semi")


def missing_names(names: DataFrame, coefficients: DataFrame, term: str = "term") -> DataFrame:
    return names.select(term).distinct().join(coefficients, term, "left_anti")


def portraits(
    spec: DataFrame,
    molecules: Mapping[str, str | None] = PORTRAIT_MOLECULES,
    sexes: Mapping[str, str | None] = PORTRAIT_SEXES,
    ages: Mapping[str, str | None] = PORTRAIT_AGES,
    indications: Mapping[str, str | None] = PORTRAIT_INDICATIONS,
    include_sex_unknown: bool = True,
) -> DataFrame:
    """Combined odds ratio and absolute risk for every combination of levels.

    The grid comes from exploding literal level lists. A molecule term the model lacks stays in
    `terms_used` with no effect, other absent terms are left out, and the unknown-sex level is
    drawn only when the model has it. A model term of the sex, age or indication factor that no
    level stands for is an error: its effect would be lost.
    """
    beta = F.col("coefficients")
    lost = F.array_except(
        F.filter(F.map_keys(beta), lambda t: t.rlike("^(sex|age_cat|indication_grp)")),
        F.array(*[F.lit(t) for m in (sexes, ages, indications) for t in m.values() if t], F.lit("")),
    )
    checked = F.when(F.size(lost) == 0, beta).otherwise(
        F.raise_error(F.concat(F.lit("no portrait level for "), F.concat_ws(", ", lost))).cast("map<string,double>")
    )

    def levels(name: str, mapping: Mapping[str, str | None]) -> Column:
        entry = [
            F.struct(F.lit(label).alias(name), F.lit(term).cast("string").alias(f"_{name}"))
            for label, term in mapping.items()
        ]
        return F.inline(F.array(*entry))

    grid = spec.select("intercept", checked.alias("coefficients"))
    for name, mapping in (
        ("molecule", molecules), ("sex", sexes), ("age", ages), ("indication", indications)
    ):
        grid = grid.select("*", levels(name, mapping))
    unknown_ok = (F.col("sex") != "Unknown") | (
        F.array_contains(F.map_keys(beta), "sexUnknown") if include_sex_unknown else F.lit(False)
    )

    def known(term: str) -> Column:
        return F.when(F.array_contains(F.map_keys(beta), F.col(term)), F.col(term))

    terms = F.array(F.col("_molecule"), known("_sex"), known("_age"), known("_indication"))
    total = F.lit(0.0)
    for i in range(4):
        total = total + F.coalesce(F.try_element_at(beta, F.coalesce(F.get("_terms", i), F.lit(""))), F.lit(0.0))
    drawn = (
        grid.filter(unknown_ok)
        .withColumn("_terms", terms)
        .withColumn("logOR_combo", total)
        .withColumn("OR_combo", F.exp("logOR_combo"))
        .withColumn("risk_abs", logistic(F.col("intercept") + F.col("logOR_combo")))
    )
    return drawn.select(
        "sex", "age", "indication", "molecule", join_terms("_terms").alias("terms_used"),
        "logOR_combo", "OR_combo", "risk_abs", risk_category("risk_abs").alias("risk_cat"),
    )
