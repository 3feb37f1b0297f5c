"""Descriptive tables."""

from pyspark.sql import functions as F

from casewatch.operators import describe as DS
from casewatch.operators import exposure as E
from casewatch.operators.cases import frequency
from casewatch.operators.folds import balanced_folds, fold_of
from casewatch.operators.ranking import exact_quantiles
from casewatch.plans.carrier import DEMO_CLASSES, DEMO_OUTCOMES, report_table
from casewatch.plans.characteristics import case_profile, molecule_rows, onset_cases
from catalog.carrier_sql import CARRIER, OUTCOME, CLASS_TESTS, flag_list, flags_sql, r6, stacked
from catalog.registry import counted, query, rounded
from catalog.scalars import TTO_BIN
from catalog.signals import AGE_OF

LABELS = E.flag_labels(DEMO_CLASSES)
MOLECULES = ("RED WIDGET", "OLD ROD", "HOT GEAR", "BLUE RING")
PROFILE = f""", p AS (SELECT case_id, {flag_list(CLASS_TESTS)},
  coalesce(min(CASE WHEN upper(sex) IN ('F', 'FEMALE', '2') THEN 'F' WHEN upper(sex) IN ('M', 'MALE', '1') THEN 'M' END), 'Other') AS sex3,
  min({AGE_OF}) AS age_years, min(CAST(substr(event_dt, 1, 4) AS INTEGER)) AS year, min(country) AS country_use
  FROM m GROUP BY 1)"""


def cases(spark, sf_dir, country=False):
    return case_profile(report_table(spark, sf_dir), DEMO_CLASSES, country=country)


AGE_SELECT = f"""count(age_years) AS n, {r6('quantile_cont(age_years, 0.5)')} AS median,
 {r6('quantile_cont(age_years, 0.25)')} AS q1, {r6('quantile_cont(age_years, 0.75)')} AS q3"""


@query(CARRIER + PROFILE + " " + stacked(AGE_SELECT, "p"))
def age_quartiles(spark, sf_dir):
    return rounded(DS.quantiles_by(cases(spark, sf_dir), LABELS, "age_years"), "median", "q1", "q3")


@query(CARRIER + PROFILE + " " + stacked(
    f"count(age_years) AS n, {r6('avg(age_years)')} AS mean, {r6('stddev_samp(age_years)')} AS sd", "p"))
def age_mean_sd(spark, sf_dir):
    return rounded(DS.moments_by(cases(spark, sf_dir), LABELS, "age_years"), "mean", "sd")


@query(CARRIER + PROFILE + ", x AS (" + stacked("sex3", "p") + ") SELECT exposure, sex3, count(*) AS n FROM x GROUP BY 1, 2")
def sex_distribution(spark, sf_dir):
    return DS.count_by(cases(spark, sf_dir), LABELS, "sex3")


@query(CARRIER + PROFILE + ", x AS (" + stacked("country_use", "p") + """)
SELECT exposure, country_use, count(*) AS case_count FROM x WHERE country_use <> '' GROUP BY 1, 2
ORDER BY exposure, case_count DESC, country_use""")
def country_distribution(spark, sf_dir):
    profile = cases(spark, sf_dir, country=True).filter(F.length("country_use") > 0)
    table = DS.count_by(profile, LABELS, "country_use", "case_count")
    return table.orderBy("exposure", F.desc("case_count"), "country_use")


@query(CARRIER + PROFILE + ", x AS (" + stacked("year", "p") + """)
SELECT exposure, year, count(*) AS n FROM x WHERE year IS NOT NULL GROUP BY 1, 2""")
def yearly_counts(spark, sf_dir):
    return DS.yearly_counts(cases(spark, sf_dir), LABELS)


@query(CARRIER + f""", f AS ({flags_sql()}),
 p AS (SELECT CASE WHEN upper(sex) IN ('F', 'FEMALE', '2') THEN 'F' WHEN upper(sex) IN ('M', 'MALE', '1') THEN 'M' ELSE 'Other' END
  AS sex3, f.* FROM m LEFT JOIN f USING (case_id)), x AS (""" + stacked("sex3", "p") + """)
SELECT exposure, sex3, count(*) AS n FROM x GROUP BY 1, 2""")
def sex_distribution_by_row(spark, sf_dir):
    rows = case_profile(report_table(spark, sf_dir), DEMO_CLASSES, grain="row", country=False)
    return DS.count_by(rows, LABELS, "sex3")


MOLECULE_SQL = """, r AS (SELECT DISTINCT case_id, upper(drug) AS molecule, CASE WHEN upper(sex) IN ('M', 'MALE') THEN 'Male'
  WHEN upper(sex) IN ('F', 'FEMALE') THEN 'Female' ELSE 'Other/Unknown' END AS sex_cat, try_cast(nullif(age, '') AS DOUBLE) AS age,
  upper(country) AS country FROM m WHERE role IN ('PS', 'SS') AND upper(drug) IN ('RED WIDGET', 'OLD ROD', 'HOT GEAR', 'BLUE RING'))"""


def molecules(spark, sf_dir, grain="case"):
    return molecule_rows(report_table(spark, sf_dir), MOLECULES, grain=grain)


@query(CARRIER + MOLECULE_SQL + f""" SELECT molecule, sex_cat, count(*) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY molecule) AS BIGINT) AS n_total,
  {r6('count(*) / (sum(count(*)) OVER (PARTITION BY molecule))')} AS share FROM r GROUP BY 1, 2""")
def molecule_sex_shares(spark, sf_dir):
    return rounded(DS.shares(molecules(spark, sf_dir), "molecule", "sex_cat"), "share")


@query(CARRIER + MOLECULE_SQL + f""" SELECT molecule, CASE WHEN age < 18 THEN '<18' WHEN age < 40 THEN '18-39'
  WHEN age < 65 THEN '40-64' ELSE '65+' END AS age_group, count(*) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY molecule) AS BIGINT) AS n_total,
  {r6('count(*) / (sum(count(*)) OVER (PARTITION BY molecule))')} AS share FROM r WHERE age > 0 GROUP BY 1, 2""")
def molecule_age_group_shares(spark, sf_dir):
    rows = molecules(spark, sf_dir).filter("age > 0")
    return rounded(DS.shares(rows, "molecule", "age_group"), "share")


@query(CARRIER + MOLECULE_SQL + f""" SELECT molecule, count(*) AS n, {r6('quantile_cont(age, 0.5)')} AS median,
  {r6('quantile_cont(age, 0.25)')} AS q1, {r6('quantile_cont(age, 0.75)')} AS q3 FROM r WHERE age > 0 GROUP BY 1""")
def molecule_age_quartiles(spark, sf_dir):
    rows = molecules(spark, sf_dir).filter("age > 0")
    found = exact_quantiles(rows, "age", (0.25, 0.5, 0.75), ["molecule"])
    named = found.select("molecule", "n", F.get("q", 1).alias("median"), F.get("q", 0).alias("q1"), F.get("q", 2).alias("q3"))
    return rounded(named, "median", "q1", "q3")


@query(CARRIER + MOLECULE_SQL + f""", k AS (SELECT molecule, country, count(*) AS n FROM r WHERE country <> '' GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY molecule ORDER BY n DESC, country) AS rn FROM k),
 t AS (SELECT molecule, count(*) AS n_total FROM r GROUP BY 1)
 SELECT molecule, country, n, n_total, {r6('n / n_total')} AS share FROM o JOIN t USING (molecule) WHERE rn <= 10""")
def molecule_top_countries(spark, sf_dir):
    return rounded(DS.top_categories(molecules(spark, sf_dir), "molecule", "country"), "share")


@query(CARRIER + """ SELECT upper(drug) AS molecule, count(*) AS n FROM m WHERE role IN ('PS', 'SS')
  AND upper(drug) IN ('RED WIDGET', 'OLD ROD', 'HOT GEAR', 'BLUE RING') GROUP BY 1""")
def molecule_row_counts(spark, sf_dir):
    return frequency(molecules(spark, sf_dir, "row"), "molecule")


ONSET = f""", c AS (SELECT case_id, {flag_list(CLASS_TESTS, 'TRUE')}, min(tto_days) AS tto,
  max(CASE WHEN {OUTCOME} THEN 1 ELSE 0 END) AS outcome FROM m WHERE role IN ('PS', 'SS') GROUP BY 1),
 l AS (SELECT CASE WHEN flag_class_a = 1 THEN 'Class A' WHEN flag_class_b = 1 THEN 'Class B' WHEN flag_class_c = 1 THEN 'Class C' END
  AS exposure, {TTO_BIN.format('tto')} AS tto_bin, outcome FROM c)"""


ONSET_SQL = CARRIER + ONSET + """ SELECT exposure, tto_bin, count(*) AS total_reports, CAST(sum(outcome) AS BIGINT) AS outcome_cases,
  round(100.0 * sum(outcome) / nullif(count(*), 0), 2) AS rate_pct FROM l WHERE exposure IS NOT NULL GROUP BY 1, 2"""


@query(ONSET_SQL)
def onset_table(spark, sf_dir):
    return DS.onset_table(onset_cases(report_table(spark, sf_dir), DEMO_CLASSES, DEMO_OUTCOMES), LABELS)


@query(CARRIER + """ SELECT 'drugs' AS dataset, drug AS name, NULL AS region, count(*) AS n FROM m GROUP BY drug
 UNION ALL SELECT 'places', country, region, count(*) FROM m GROUP BY country, region""")
def stacked_tables(spark, sf_dir):
    m = report_table(spark, sf_dir)
    drugs = counted(m.withColumnRenamed("drug", "name"), "name")
    places = counted(m.withColumnRenamed("country", "name"), "name", "region")
    return DS.stack_tables({"drugs": drugs, "places": places}).select("dataset", "name", "region", "n")


FOLD_HASH = "CAST('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':20251121'), 1, 8) AS BIGINT)"


@query(CARRIER + f" SELECT DISTINCT case_id, CAST({FOLD_HASH} % 10 + 1 AS INTEGER) AS fold FROM m")
def fold_assignment(spark, sf_dir):
    ids = report_table(spark, sf_dir).select("case_id").distinct()
    return ids.withColumn("fold", fold_of("case_id", 10))


@query(CARRIER + f""", u AS (SELECT DISTINCT case_id FROM m)
SELECT case_id, CAST((row_number() OVER (ORDER BY {FOLD_HASH}, case_id) - 1) % 10 + 1 AS INTEGER) AS fold FROM u""")
def balanced_fold_assignment(spark, sf_dir):
    return balanced_folds(report_table(spark, sf_dir).select("case_id").distinct(), "case_id", 10)
