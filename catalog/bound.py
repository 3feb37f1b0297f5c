"""Queries over written tables with the sources' own column names, read through the bindings."""

from pyspark.sql import functions as F

from casewatch import sources as SRC
from casewatch.functions.reports import age_band_cut
from casewatch.functions.text import safe_double
from casewatch.operators import describe as DS
from casewatch.plans import case_features as CF
from casewatch.plans.carrier import DEMO_CLASSES, DEMO_MOLECULES, DEMO_OUTCOMES, report_table
from casewatch.plans.characteristics import onset_cases
from casewatch.session import scratch_path
from catalog.carrier_sql import CARRIER, band_of
from catalog.describe import LABELS, ONSET_SQL
from catalog.models import BOTH_ROWS, DRUG_ROWS, PORTABLE
from catalog.registry import counted, query
from catalog.signals import AGE_OF

# Logical name of the derived report table, physical name of the first and of the onset source.
FIRST_NAMES = {
    "case_id": "primaryid", "drug": "drugname", "role": "role_cod", "pt_code": "pt_code", "pt": "pt", "hlt": "hlt_name", "hlgt": "hlgt_name",
    "soc": "soc_name", "sex": "sex", "region": "region", "event_dt": "event_dt",
}
ONSET_NAMES = {"case_id": "primaryid", "drug": "drugname_u", "role": "role_cod_u", "pt": "pt_u", "pt_code": "meddra_pt_code", "tto_days": "tto_onset_days_psss"}


def written(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def first_source(spark, sf_dir, spec=SRC.FIRST_SOURCE, categorical_age=False, traced=()):
    """The report table written under physical names, read back. The normalised indication is missing in some rows;
    the original one too, in others. With `categorical_age` there are age bands only, some of them no known band."""
    m = report_table(spark, sf_dir)
    indications = [
        F.when(F.col("pt_code") % 3 != 0, F.col("indication")).alias("indi_pt_norm"),
        F.when(F.col("pt_code") % 5 != 0, F.lower("indication")).alias("indi_pt"),
    ]
    band = F.when(F.col("pt_code") % 11 == 0, "unknown").otherwise(F.concat(F.lit(" "), age_band_cut(safe_double("age"))))
    ages = [band.alias("age_group")] if categorical_age else [F.col("age"), F.col("age_unit").alias("age_cod")]
    serious = F.when(F.col("serious_death") == 1, "Y").alias("serious_flag")
    raw = m.select(*[F.col(k).alias(v) for k, v in FIRST_NAMES.items()], *indications, *ages, serious)
    return SRC.read_reports(spark, written(raw, "first-source"), spec, traced=traced)


BY_ROW = "CASE WHEN pt_code % 3 <> 0 AND indication IS NOT NULL THEN indication WHEN pt_code % 5 <> 0 THEN lower(indication) END"


@query(CARRIER + f"""
SELECT indication, CASE WHEN indication IS NULL THEN NULL WHEN indication = upper(indication) THEN 'indi_pt_norm' ELSE 'indi_pt' END AS indication_from,
 count(*) AS n FROM (SELECT {BY_ROW} AS indication FROM m) GROUP BY ALL""")
def indications_by_row(spark, sf_dir):
    return counted(first_source(spark, sf_dir, traced=("indication",)), "indication", "indication_from")


ROWS_BY_ROW = f", f AS (SELECT * REPLACE (upper({BY_ROW}) AS indication) FROM m)" + DRUG_ROWS.replace("FROM m WHERE", "FROM f WHERE")


@query(CARRIER + ROWS_BY_ROW + " SELECT * EXCLUDE (tto_days, sx2) FROM c")
def case_features_first_source(spark, sf_dir):
    return CF.case_features(first_source(spark, sf_dir), DEMO_MOLECULES, DEMO_OUTCOMES, prefix="flag_mol_")


def band_sql(rows: str) -> str:
    """Features of a source with age bands only: the smallest known band of a case."""
    number = "try_cast(nullif(age, '') AS DOUBLE)"
    code = f"CASE WHEN pt_code % 11 = 0 OR {number} IS NULL THEN NULL WHEN {number} < 18 THEN 1 WHEN {number} < 40 THEN 2 WHEN {number} < 65 THEN 3 ELSE 4 END"
    rows = rows.replace(f"min({AGE_OF}) AS age", f"min({code}) AS age")
    rows = rows.replace(band_of("age"), "CASE age WHEN 1 THEN '<18' WHEN 2 THEN '18-39' WHEN 3 THEN '40-64' WHEN 4 THEN '65+' END")
    return rows.replace("FROM m WHERE", "FROM f WHERE")


# Only the normalised indication is a candidate of the portable source; the first source goes on by row.
NORM_ONLY = ", f AS (SELECT * REPLACE (CASE WHEN pt_code % 3 <> 0 THEN indication END AS indication) FROM m)"


@query(CARRIER + f", f AS (SELECT * REPLACE (upper({BY_ROW}) AS indication) FROM m)" + band_sql(DRUG_ROWS) + " SELECT * EXCLUDE (tto_days, sx2) FROM c")
def case_features_age_bands(spark, sf_dir):
    return CF.case_features(first_source(spark, sf_dir, categorical_age=True), DEMO_MOLECULES, DEMO_OUTCOMES, prefix="flag_mol_")


@query(CARRIER + NORM_ONLY + band_sql(BOTH_ROWS) + PORTABLE)
def portable_features_age_bands(spark, sf_dir):
    reports = first_source(spark, sf_dir, SRC.PORTABLE_SOURCE, categorical_age=True)
    return CF.portable_features(reports, "first", DEMO_MOLECULES, DEMO_OUTCOMES)


@query(ONSET_SQL)
def onset_table_onset_source(spark, sf_dir):
    m = report_table(spark, sf_dir)
    path = written(m.select(*[F.col(k).alias(v) for k, v in ONSET_NAMES.items()]), "onset-source")
    return DS.onset_table(onset_cases(SRC.read_reports(spark, path, SRC.ONSET_SOURCE), DEMO_CLASSES, DEMO_OUTCOMES), LABELS)
