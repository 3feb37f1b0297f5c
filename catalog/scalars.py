"""Column functions over the whole derived report table: every input with its result and row count."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch import functions as fn
from casewatch.operators.cases import stratum_defaults
from casewatch.operators.exposure import flag_columns
from casewatch.plans.carrier import DEMO_CLASSES, DEMO_OUTCOMES, report_table
from catalog.carrier_sql import CARRIER, NORM, TRANSPLANT, AUTOIMMUNE, band_of, flags_sql, r6
from catalog.registry import counted, query, rounded

MESSY = "concat('  ', drug, ' (', lower(hlt), ')/', pt, ' +x- ')"
MESSY_SQL = "'  ' || drug || ' (' || lower(hlt) || ')/' || pt || ' +x- '"


@query(CARRIER + f"""
SELECT raw, {NORM.format('raw')} AS norm, count(*) AS n
FROM (SELECT CASE WHEN case_id % 11 = 0 THEN NULL ELSE {MESSY_SQL} END AS raw FROM m) GROUP BY 1, 2""")
def norm_text(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"CASE WHEN case_id % 11 = 0 THEN NULL ELSE {MESSY} END AS raw"))
    return counted(m.withColumn("norm", fn.norm_text("raw")), "raw", "norm")


@query(CARRIER + f"""
SELECT {NORM.format(MESSY_SQL)} AS norm, count(*) AS n FROM m GROUP BY 1""")
def norm_text_sql_function(spark, sf_dir):
    fn.register_norm(spark)
    m = report_table(spark, sf_dir)
    return counted(m.select(F.expr(f"norm_text({MESSY}) AS norm")), "norm")


AGE_IN = (
    "CASE case_id % 13 WHEN 0 THEN '12x' WHEN 1 THEN '-1' WHEN 2 THEN '39.5' WHEN 3 THEN '1e1' ELSE age END AS age",
    "CASE case_id % 9 WHEN 0 THEN 'yr' WHEN 1 THEN 'MON' WHEN 2 THEN 'WK' WHEN 3 THEN 'DY' WHEN 4 THEN 'DEC' "
    "WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'HR' ELSE age_unit END AS unit",
)
# Age units and the years in one.
AGE_UNITS = """(VALUES ('', 1, 1), ('YR', 1, 1), ('YRS', 1, 1), ('YEAR', 1, 1), ('YEARS', 1, 1), ('MON', 1, 12), ('MONTH', 1, 12),
 ('MONTHS', 1, 12), ('WK', 1, 52), ('WEEK', 1, 52), ('WEEKS', 1, 52), ('DY', 1, 365.25), ('DAY', 1, 365.25), ('DAYS', 1, 365.25),
 ('DEC', 10, 1), ('DECADE', 10, 1)) u(code, times, parts)"""
AGE_YEARS = f"(SELECT try_cast(nullif(age, '') AS DOUBLE) * times::DOUBLE / parts::DOUBLE FROM {AGE_UNITS} WHERE code = upper(coalesce(unit, '')))"


@query(CARRIER + f""", i AS (SELECT {', '.join(AGE_IN)} FROM m)
SELECT age, unit, {r6(AGE_YEARS)} AS years, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def age_to_years(spark, sf_dir):
    m = report_table(spark, sf_dir).select(*[F.expr(e) for e in AGE_IN])
    return counted(rounded(m.withColumn("years", fn.age_to_years("age", "unit")), "years"), "age", "unit", "years")


HALF_AGE = "try_cast(nullif(age, '') AS DOUBLE) / 2 - 1"


@query(CARRIER + f""", i AS (SELECT {HALF_AGE} AS years FROM m)
SELECT years, {band_of('years')} AS band, count(*) AS n FROM i GROUP BY 1, 2""")
def age_band(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{HALF_AGE} AS years"))
    return counted(m.withColumn("band", fn.age_band("years")), "years", "band")


@query(CARRIER + f""", i AS (SELECT {HALF_AGE} AS years FROM m)
SELECT years, CASE WHEN years < 18 THEN '<18' WHEN years < 40 THEN '18-39' WHEN years < 65 THEN '40-64'
  WHEN years IS NOT NULL THEN '65+' END AS band, count(*) AS n FROM i WHERE years > 0 GROUP BY 1, 2""")
def age_band_cut(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{HALF_AGE} AS years")).filter("years > 0")
    return counted(m.withColumn("band", fn.age_band_cut("years")), "years", "band")


@query(CARRIER + """
SELECT sex, CASE WHEN upper(coalesce(sex, '')) IN ('F', 'FEMALE', '2') THEN 'F'
  WHEN upper(coalesce(sex, '')) IN ('M', 'MALE', '1') THEN 'M' ELSE 'Other' END AS grp, count(*) AS n
FROM m GROUP BY 1, 2""")
def sex3(spark, sf_dir):
    return counted(report_table(spark, sf_dir).withColumn("grp", fn.sex3("sex")), "sex", "grp")


SEX_IN = """CASE case_id % 7 WHEN 0 THEN ' 男性 ' WHEN 1 THEN '女性' WHEN 2 THEN 'Female' WHEN 3 THEN '不明'
ELSE sex END AS sex"""


@query(CARRIER + f""", i AS (SELECT {SEX_IN} FROM m)
SELECT sex, CASE WHEN upper(trim(sex)) IN ('M', 'MALE', '男性') THEN 'Male'
  WHEN upper(trim(sex)) IN ('F', 'FEMALE', '女性') THEN 'Female' ELSE 'Other/Unknown' END AS cat, count(*) AS n
FROM i GROUP BY 1, 2""")
def sex_cat(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(SEX_IN))
    return counted(m.withColumn("cat", fn.sex_cat("sex")), "sex", "cat")


@query(CARRIER + f""", i AS (SELECT {SEX_IN} FROM m)
SELECT sex, CASE WHEN upper(trim(sex)) IN ('M', 'MALE') THEN 1 ELSE 0 END AS "sexMale",
  CASE WHEN sex IS NOT NULL AND upper(trim(sex)) NOT IN ('M', 'MALE', 'F', 'FEMALE') THEN 1 ELSE 0 END AS "sexUnknown",
  count(*) AS n FROM i GROUP BY 1, 2, 3""")
def sex_dummies(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(SEX_IN))
    out = m.withColumns({"sexMale": fn.sex_male("sex"), "sexUnknown": fn.sex_unknown("sex")})
    return counted(out, "sex", "sexMale", "sexUnknown")


DATE_IN = "CASE case_id % 5 WHEN 0 THEN substr(event_dt, 1, 6) WHEN 1 THEN NULL WHEN 2 THEN '2001-1-1' ELSE event_dt END"


@query(CARRIER + f""", i AS (SELECT {DATE_IN} AS dt FROM m)
SELECT CASE WHEN regexp_full_match(dt, '[0-9]{{8}}') THEN CAST(substr(dt, 1, 4) AS INTEGER) END AS year, count(*) AS n
FROM i GROUP BY 1""")
def event_year(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{DATE_IN} AS dt"))
    return counted(m.select(fn.event_year("dt").alias("year")), "year")


OCCR_IN = "CASE case_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE country END"


@query(CARRIER + f""", i AS (SELECT {OCCR_IN} AS occr, region AS rep FROM m)
SELECT occr, rep, CASE WHEN occr IS NOT NULL AND occr <> '' THEN occr ELSE rep END AS country_use, count(*) AS n
FROM i GROUP BY 1, 2, 3""")
def country_use(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{OCCR_IN} AS occr"), F.col("region").alias("rep"))
    return counted(m.withColumn("country_use", fn.country_use("occr", "rep")), "occr", "rep", "country_use")


REGION_IN = "CASE case_id % 6 WHEN 0 THEN 'Korea' WHEN 1 THEN '' ELSE lower(region) END"


@query(CARRIER + f""", i AS (SELECT {REGION_IN} AS raw FROM m)
SELECT raw, CASE WHEN upper(raw) IN ('US', 'EUROPE', 'JAPAN', 'CHINA') THEN upper(raw) ELSE 'OTHER' END AS grp,
  count(*) AS n FROM i GROUP BY 1, 2""")
def region5(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{REGION_IN} AS raw"))
    return counted(m.withColumn("grp", fn.region5("raw")), "raw", "grp")


INDI_IN = "CASE WHEN case_id % 4 = 0 THEN drug || ' RA' WHEN case_id % 4 = 1 THEN '' ELSE indication END"


@query(CARRIER + f""", i AS (SELECT {INDI_IN} AS raw FROM m)
SELECT raw, CASE WHEN regexp_matches(upper(raw), '{TRANSPLANT}') THEN 'Transplantation'
  WHEN regexp_matches(upper(raw), '{AUTOIMMUNE}') THEN 'Autoimmune diseases' ELSE 'Other' END AS grp, count(*) AS n
FROM i GROUP BY 1, 2""")
def indication_group(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{INDI_IN} AS raw"))
    return counted(m.withColumn("grp", fn.indication_group("raw")), "raw", "grp")


@query(CARRIER + f""", i AS (SELECT {INDI_IN} AS raw FROM m)
SELECT raw, CASE WHEN regexp_matches(upper(raw), '\\b{TRANSPLANT}\\b') THEN 'Transplantation'
  WHEN regexp_matches(upper(raw), '\\b{AUTOIMMUNE}\\b') THEN 'Autoimmune diseases' ELSE 'Other' END AS grp,
  count(*) AS n FROM i GROUP BY 1, 2""")
def indication_group_whole_word(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{INDI_IN} AS raw"))
    return counted(m.withColumn("grp", fn.indication_group("raw", whole_word=True)), "raw", "grp")


@query(CARRIER + f"""
SELECT CASE WHEN regexp_matches(indication, '{TRANSPLANT}') THEN 1 ELSE 0 END AS dummy, count(*) AS n FROM m GROUP BY 1""")
def indication_dummy(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.select(fn.indication_dummy(fn.indication_group("indication")).alias("dummy")), "dummy")


@query(CARRIER + """
SELECT serious_death, serious_hospitalization,
  coalesce(serious_death, 0) + coalesce(serious_hospitalization, 0) > 0 AS serious, count(*) AS n
FROM m GROUP BY 1, 2, 3""")
def serious_row(spark, sf_dir):
    m = report_table(spark, sf_dir)
    flags = ["serious_death", "serious_hospitalization"]
    return counted(m.withColumn("serious", fn.serious_row(flags)), *flags, "serious")


@query(CARRIER + """
SELECT CASE WHEN serious_death = 1 THEN 'Serious' ELSE 'Non-serious' END AS label, count(*) AS n FROM m GROUP BY 1""")
def serious_label(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.select(fn.serious_label("serious_death").alias("label")), "label")


TRUTH_IN = """CASE case_id % 9 WHEN 0 THEN '1' WHEN 1 THEN 'Y' WHEN 2 THEN 'y' WHEN 3 THEN 'YES' WHEN 4 THEN 'TRUE'
WHEN 5 THEN 'true' WHEN 6 THEN '1.0' WHEN 7 THEN NULL ELSE '0' END"""


@query(CARRIER + f""", i AS (SELECT {TRUTH_IN} AS txt, serious_death AS num, pt_code > 25 AS flag FROM m)
SELECT txt, num, flag, CASE WHEN txt IN ('1', 'Y', 'YES', 'TRUE') THEN 1 ELSE 0 END AS t_text,
  CASE WHEN num = 1 THEN 1 ELSE 0 END AS t_num, CASE WHEN flag THEN 1 ELSE 0 END AS t_flag, count(*) AS n
FROM i GROUP BY 1, 2, 3, 4, 5, 6""")
def truthy(spark, sf_dir):
    m = report_table(spark, sf_dir).select(
        F.expr(f"{TRUTH_IN} AS txt"), F.col("serious_death").alias("num"), (F.col("pt_code") > 25).alias("flag")
    )
    out = m.withColumns({
        "t_text": fn.truthy("txt", T.StringType()), "t_num": fn.truthy("num", T.IntegerType()),
        "t_flag": fn.truthy("flag", T.BooleanType()),
    })
    return counted(out, *out.columns)


TTO_IN = (
    "CASE WHEN case_id % 3 = 0 THEN tto_days END AS a",
    "CASE WHEN case_id % 5 = 0 THEN tto_days + 1 END AS b",
    "CASE WHEN case_id % 2 = 0 THEN tto_days - 40 END AS c",
)
TTO_BIN = """CASE WHEN {0} IS NULL THEN 'Missing' WHEN {0} <= 7 THEN '0-7d' WHEN {0} <= 30 THEN '8-30d'
 WHEN {0} <= 90 THEN '31-90d' WHEN {0} <= 365 THEN '91-365d' ELSE '>365d' END"""


@query(CARRIER + f""", i AS (SELECT {', '.join(TTO_IN)} FROM m)
SELECT coalesce(a, b, c) AS days, count(*) AS n FROM i GROUP BY 1""")
def tto_days(spark, sf_dir):
    m = report_table(spark, sf_dir).select(*[F.expr(e) for e in TTO_IN])
    return counted(m.select(fn.tto_days("a", "b", "c").alias("days")), "days")


@query(CARRIER + f""", i AS (SELECT {', '.join(TTO_IN)} FROM m), d AS (SELECT coalesce(a, b, c) AS days FROM i)
SELECT {TTO_BIN.format('days')} AS bin, count(*) AS n FROM d GROUP BY 1""")
def tto_bin(spark, sf_dir):
    m = report_table(spark, sf_dir).select(*[F.expr(e) for e in TTO_IN])
    return counted(m.select(fn.tto_bin(fn.tto_days("a", "b", "c")).alias("bin")), "bin")


@query(CARRIER + f""", f AS ({flags_sql()})
SELECT CASE WHEN flag_class_a = 1 THEN 'Class A' WHEN flag_class_b = 1 THEN 'Class B'
  WHEN flag_class_c = 1 THEN 'Class C' END AS first_label, count(*) AS n FROM f GROUP BY 1""")
def first_class_label(spark, sf_dir):
    m = report_table(spark, sf_dir)
    flags = flag_columns(DEMO_CLASSES)
    cases = m.groupBy("case_id").agg(*[F.max(c).alias(k) for k, c in flags.items()])
    label = fn.first_class_label(dict(zip(DEMO_CLASSES, flags)))
    return counted(cases.select(label.alias("first_label")), "first_label")


@query(CARRIER + """
SELECT drug, drug LIKE '%OLD%' OR drug LIKE '%RING%' AS hit, count(*) AS n FROM m GROUP BY 1, 2""")
def contains_any(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.withColumn("hit", fn.contains_any("drug", ["OLD", "RING"])), "drug", "hit")


@query(CARRIER + """
SELECT drug, drug IN ('RED WIDGET', 'OLD ROD') AS hit, count(*) AS n FROM m GROUP BY 1, 2""")
def in_dictionary(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.withColumn("hit", fn.in_dictionary(F.lower("drug"), ["RED WIDGET", "OLD ROD"])), "drug", "hit")


@query(CARRIER + """
SELECT pt_code, CASE WHEN pt_code IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS hit, count(*) AS n FROM m GROUP BY 1, 2""")
def is_outcome(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.withColumn("hit", fn.is_outcome("pt_code", DEMO_OUTCOMES)), "pt_code", "hit")


DOUBLE_IN = "CASE case_id % 4 WHEN 0 THEN age WHEN 1 THEN '-' || age || '.25' WHEN 2 THEN drug ELSE NULL END"


@query(CARRIER + f""", i AS (SELECT {DOUBLE_IN} AS raw FROM m)
SELECT raw, try_cast(raw AS DOUBLE) AS value, count(*) AS n FROM i GROUP BY 1, 2""")
def safe_double(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{DOUBLE_IN} AS raw"))
    return counted(m.withColumn("value", fn.safe_double("raw")), "raw", "value")


@query(CARRIER + """
SELECT upper(trim('  ' || lower(country) || ' ')) AS prepared, count(*) AS n FROM m GROUP BY 1""")
def upper_trim(spark, sf_dir):
    m = report_table(spark, sf_dir)
    raw = F.concat(F.lit("  "), F.lower("country"), F.lit(" "))
    return counted(m.select(fn.upper_trim(raw).alias("prepared")), "prepared")


PER_DRUG = """SELECT drug, count(*) AS n, count(*) FILTER (WHERE pt_code IN (1, 2, 3, 4)) AS k FROM m GROUP BY drug"""


def per_drug(spark, sf_dir):
    return report_table(spark, sf_dir).groupBy("drug").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pt_code").isin(*DEMO_OUTCOMES)).alias("k")
    )


@query(CARRIER + f""", d AS ({PER_DRUG})
SELECT drug, n, k, round(100.0 * k / nullif(n, 0), 2) AS pct, {r6('CAST(k AS DOUBLE) / n')} AS ratio FROM d""")
def percentages(spark, sf_dir):
    d = per_drug(spark, sf_dir)
    return rounded(d.withColumns({"pct": fn.pct("k", "n"), "ratio": fn.ratio("k", "n")}), "ratio")


@query(CARRIER + f""", d AS ({PER_DRUG}), o AS (SELECT drug, k * 1.0 / (n - k) AS odds_ratio FROM d WHERE k > 0 AND k < n)
SELECT drug, {r6('ln(odds_ratio)')} AS beta, {r6('exp(ln(odds_ratio))')} AS back,
  {r6('1 / (1 + exp(-ln(odds_ratio)))')} AS p FROM o""")
def log_odds_and_back(spark, sf_dir):
    d = per_drug(spark, sf_dir).filter("k > 0 AND k < n").withColumn("odds_ratio", F.col("k") / (F.col("n") - F.col("k")))
    beta = fn.log_odds("odds_ratio")
    out = d.select("drug", beta.alias("beta"), fn.odds(beta).alias("back"), fn.logistic(beta).alias("p"))
    return rounded(out, "beta", "back", "p")


RISK_IN = "(quantity - 3) / 48.0"


@query(CARRIER + f""", i AS (SELECT {RISK_IN} AS p FROM m)
SELECT {r6('p')} AS p, round(greatest(least(p, 1 - 1e-6), 1e-6), 7) AS clipped, count(*) AS n FROM i GROUP BY 1, 2""")
def clip_probability(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{RISK_IN} AS p"))
    out = rounded(m.withColumn("clipped", F.round(fn.clip_probability("p"), 7)), "p")
    return counted(out, "p", "clipped")


SMALL_RISK = "(quantity - 1) / 500.0"


@query(CARRIER + f""", i AS (SELECT {SMALL_RISK} AS p FROM m)
SELECT {r6('p')} AS p, CASE WHEN p < 0.02 THEN 'Low' WHEN p < 0.05 THEN 'Moderate' WHEN p <= 1 THEN 'High' END AS cat,
  count(*) AS n FROM i GROUP BY 1, 2""")
def risk_category(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr(f"{SMALL_RISK} AS p"))
    return counted(rounded(m.withColumn("cat", fn.risk_category("p")), "p"), "p", "cat")


@query(CARRIER + f""", d AS ({PER_DRUG}), o AS (SELECT drug, n, k, k * 1.0 / n AS r FROM d)
SELECT drug, printf('%.2f [%.2f–%.2f]', r * 7.1234567, r * 3.3333331, r * 11.7777773) AS ci,
  printf('%.3g', r * r * r * r) AS p FROM o""")
def result_text(spark, sf_dir):
    r = F.col("k") / F.col("n")
    return per_drug(spark, sf_dir).select(
        "drug", fn.format_or_ci(r * 7.1234567, r * 3.3333331, r * 11.7777773).alias("ci"),
        fn.format_p(r * r * r * r).alias("p"),
    )


@query(CARRIER + """
SELECT concat_ws(';', sex, region, indication) AS terms, count(*) AS n FROM m GROUP BY 1""")
def join_terms(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.select(fn.join_terms(F.array("sex", "region", "indication")).alias("terms")), "terms")


@query(CARRIER + """
SELECT drug || '/' || pt || '+' AS label,
  'flag_' || trim(regexp_replace(lower(drug || '/' || pt || '+'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, count(*) AS n
FROM m GROUP BY 1, 2""")
def flag_slug(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.concat("drug", F.lit("/"), "pt", F.lit("+")).alias("label"))
    return counted(m.withColumn("slug", fn.flag_slug("label")), "label", "slug")


@query(CARRIER + """
SELECT region, CASE region WHEN 'US' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'JAPAN' THEN 3 ELSE 4 END AS position, count(*) AS n
FROM m GROUP BY 1, 2""")
def order_key(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(m.withColumn("position", fn.order_key("region", ["US", "EUROPE", "JAPAN"])), "region", "position")


@query(CARRIER + """
SELECT coalesce(try_cast(age AS DOUBLE), 0) AS age, coalesce(CAST(serious_death AS DOUBLE), 0) AS serious_death,
  CAST(0 AS DOUBLE) AS absent, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def zero_fill(spark, sf_dir):
    m = report_table(spark, sf_dir).select("age", "serious_death")
    return counted(fn.zero_fill(m, ["age", "serious_death", "absent"]), "age", "serious_death", "absent")


@query(CARRIER + """, i AS (SELECT DISTINCT case_id, sex AS sex_grp, region AS region_grp, indication AS indication_grp,
  CASE WHEN serious_death = 1 THEN 'Serious' END AS serious_grp FROM m)
SELECT coalesce(sex_grp, 'Other') AS sex_grp, coalesce(region_grp, 'OTHER') AS region_grp,
  coalesce(indication_grp, 'Other') AS indication_grp, coalesce(serious_grp, 'Non-serious') AS serious_grp, count(*) AS n
FROM i GROUP BY 1, 2, 3, 4""")
def stratum_default_labels(spark, sf_dir):
    groups = ["sex_grp", "region_grp", "indication_grp", "serious_grp"]
    cases = report_table(spark, sf_dir).select(
        "case_id", F.col("sex").alias("sex_grp"), F.col("region").alias("region_grp"),
        F.col("indication").alias("indication_grp"),
        F.when(F.col("serious_death") == 1, "Serious").alias("serious_grp"),
    ).distinct()
    return counted(stratum_defaults(cases), *groups)
