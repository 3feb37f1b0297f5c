"""Sources, sinks, filters and joins over the derived report table."""

from pyspark.sql import functions as F

from casewatch.operators import cases as C
from casewatch.operators import exposure as E
from casewatch.operators import filters as FL
from casewatch.operators import scoring as S
from casewatch.operators.describe import preview
from casewatch.plans.carrier import DEMO_CLASSES, DEMO_MOLECULES, DEMO_OUTCOMES, TABLES, report_table
from casewatch.session import scratch_path, tune
from casewatch import sources as SRC
from catalog.carrier_sql import CARRIER, CLASS_ROWS, CLASS_TESTS, MOLECULE_TESTS, OUTCOME, flag_list, flags_sql
from catalog.registry import counted, query


@query(CARRIER + """
SELECT role, count(*) AS n_rows, count(DISTINCT case_id) AS n_cases FROM m GROUP BY role""")
def report_scan(spark, sf_dir):
    m = report_table(spark, sf_dir)
    per_case = m.groupBy("role", "case_id").agg(F.count(F.lit(1)).alias("k"))
    return per_case.groupBy("role").agg(F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_cases"))


SECOND_SPEC_SQL = """SELECT CAST(case_id AS BIGINT) AS case_id, drug, NULL AS drug_class, role, pt_code, sex, age, country FROM m"""


def second_source(spark, sf_dir):
    """The report table under the physical names of the second source."""
    m = report_table(spark, sf_dir)
    names = {"case_id": "ID", "drug": "DRUG_MOLECULE", "role": "ROLE_STD", "pt_code": "PT_CODE", "sex": "SEX",
             "age": "AGE_NUM", "country": "COUNTRY_USE", "indication": "INDI_PT_NAME_EN"}
    return m.select(*[F.col(k).alias(v) for k, v in names.items()])


@query(CARRIER + f"""
SELECT drug, role, sex, country, coalesce(drug_class, 'none') AS drug_class, count(*) AS n FROM ({SECOND_SPEC_SQL})
GROUP BY 1, 2, 3, 4, 5""")
def bind_columns(spark, sf_dir):
    bound = SRC.bind_columns(second_source(spark, sf_dir), SRC.SECOND_SOURCE)
    bound = bound.withColumn("drug_class", F.coalesce("drug_class", F.lit("none")))
    return counted(bound, "drug", "role", "sex", "country", "drug_class")


@query(CARRIER + """
SELECT DISTINCT pt_code AS code, upper(pt) AS name FROM m""")
def read_lookup_csv(spark, sf_dir):
    path = scratch_path(spark, "lookup")
    pairs = report_table(spark, sf_dir).select(
        F.col("pt_code").alias("MedDRA_code"), F.lower("pt").alias("preferred_term")
    ).distinct()
    SRC.write_table(pairs, path)
    return SRC.read_lookup(spark, path)


@query(CARRIER + f"""
SELECT d.label, count(*) AS n FROM m JOIN (SELECT * FROM {CLASS_ROWS} v(label, k)) d ON m.drug LIKE '%' || d.k || '%'
WHERE d.label <> 'Class B' GROUP BY 1""")
def lookup_table(spark, sf_dir):
    lookup = SRC.keep_classes(SRC.lookup_from_dict(spark, DEMO_CLASSES), ["Class A", "Class C"])
    return counted(E.join_dictionary(report_table(spark, sf_dir), lookup, how="contains"), "label")


FEATURES_SQL = f"""SELECT case_id, max(CASE WHEN {OUTCOME} THEN 1 ELSE 0 END) AS outcome,
 {flag_list(MOLECULE_TESTS, 'TRUE')} FROM m GROUP BY case_id"""


def simple_features(spark, sf_dir):
    flags = E.flag_columns(DEMO_MOLECULES, "exact", None, "flag_mol_")
    outcome = {"outcome": F.col("pt_code").isin(*DEMO_OUTCOMES).cast("int")}
    return C.case_table(report_table(spark, sf_dir), flags, outcome)


@query(CARRIER + f", f AS ({FEATURES_SQL}) SELECT case_id, outcome, flag_mol_red, flag_mol_blue, flag_mol_old, flag_mol_gear FROM f")
def feature_file_round_trip(spark, sf_dir):
    path = scratch_path(spark, "features")
    SRC.write_features(simple_features(spark, sf_dir), path)
    return SRC.read_features(spark, path).select(
        "case_id", "outcome", "flag_mol_red", "flag_mol_blue", "flag_mol_old", "flag_mol_gear"
    )


@query(CARRIER + """
SELECT country, CAST(count(*) AS VARCHAR) AS n FROM m GROUP BY 1""")
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "table")
    SRC.write_table(counted(report_table(spark, sf_dir), "country"), path)
    return spark.read.csv(path, header=True)


@query(CARRIER + """
SELECT role, count(*) AS n_rows, CAST(sum(coalesce(serious_death, 0)) AS BIGINT) AS serious_death,
  CAST(sum(coalesce(serious_hospitalization, 0)) AS BIGINT) AS serious_hospitalization FROM m GROUP BY role""")
def profile(spark, sf_dir):
    m = report_table(spark, sf_dir).fillna(0, ["serious_death", "serious_hospitalization"])
    return SRC.profile(m, ["serious_death", "serious_hospitalization"], "role")


@query(CARRIER + """
SELECT role, drug, count(*) AS n FROM m WHERE role IN ('PS', 'SS') GROUP BY 1, 2""")
def with_roles(spark, sf_dir):
    return counted(FL.with_roles(report_table(spark, sf_dir)), "role", "drug")


@query(CARRIER + """, i AS (SELECT CASE WHEN case_id % 3 = 0 THEN '' ELSE indication END AS indication FROM m)
SELECT indication, count(*) AS n FROM i WHERE length(indication) > 0 GROUP BY 1""")
def non_empty(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr("CASE WHEN case_id % 3 = 0 THEN '' ELSE indication END AS indication"))
    return counted(FL.non_empty(m, "indication"), "indication")


@query(CARRIER + f"""
SELECT drug, pt_code, count(*) AS n FROM m WHERE drug IN ('RED WIDGET', 'OLD ROD') OR {OUTCOME} GROUP BY 1, 2""")
def target_rows(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return counted(FL.target_rows(m, ["RED WIDGET", "OLD ROD"], DEMO_OUTCOMES), "drug", "pt_code")


@query(CARRIER + f""", f AS ({FEATURES_SQL})
SELECT outcome, count(*) AS n FROM f WHERE flag_mol_red + flag_mol_blue + flag_mol_old + flag_mol_gear > 0 GROUP BY 1""")
def any_exposure(spark, sf_dir):
    flags = ["flag_mol_red", "flag_mol_blue", "flag_mol_old", "flag_mol_gear"]
    return counted(FL.any_exposure(simple_features(spark, sf_dir), flags), "outcome")


@query(CARRIER + """
SELECT role, count(*) AS n FROM m WHERE serious_death IS NULL OR serious_death = 0 GROUP BY 1""")
def non_serious(spark, sf_dir):
    return counted(FL.non_serious(report_table(spark, sf_dir), "serious_death"), "role")


@query(CARRIER + """
SELECT count(*) AS n_all, count(*) FILTER (WHERE sex IS NOT NULL AND region IS NOT NULL AND indication IS NOT NULL) AS n_keep,
  count(*) FILTER (WHERE sex IS NULL OR region IS NULL OR indication IS NULL) AS n_drop FROM m""")
def complete_case_counts(spark, sf_dir):
    return FL.complete_case_counts(report_table(spark, sf_dir), ["sex", "region", "indication"])


@query(CARRIER + """
SELECT sex, region, count(*) AS n FROM m WHERE sex IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2""")
def complete_cases(spark, sf_dir):
    return counted(FL.complete_cases(report_table(spark, sf_dir), ["sex", "region"]), "sex", "region")


@query(CARRIER + """, i AS (SELECT try_cast(age AS DOUBLE) AS age FROM m)
SELECT age, count(*) AS n FROM i WHERE age > 0 GROUP BY 1""")
def valid_age(spark, sf_dir):
    m = report_table(spark, sf_dir).select(F.expr("try_cast(age AS DOUBLE) AS age"))
    return counted(FL.valid_age(m), "age")


@query(CARRIER + """, i AS (SELECT CASE WHEN case_id % 5 <> 0 THEN pt_code END AS y,
  CASE case_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE quantity END AS p FROM m)
SELECT y, count(*) AS n FROM i WHERE y IS NOT NULL AND isfinite(p) GROUP BY 1""")
def finite_pairs(spark, sf_dir):
    m = report_table(spark, sf_dir).select(
        F.expr("CASE WHEN case_id % 5 <> 0 THEN pt_code END AS y"),
        F.expr("""CASE case_id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN NULL
                  ELSE quantity END AS p"""),
    )
    return counted(FL.finite_pairs(m), "y")


@query(CARRIER + f""", f AS ({FEATURES_SQL}) SELECT outcome, count(*) AS n FROM f GROUP BY 1""")
def two_class_guard(spark, sf_dir):
    return counted(FL.require_two_classes(simple_features(spark, sf_dir), "outcome"), "outcome")


@query(CARRIER + """
SELECT hlt AS term, count(*) AS n FROM m WHERE hlt NOT IN ('ECONOMY', 'SMALL') GROUP BY 1""")
def drop_terms(spark, sf_dir):
    m = report_table(spark, sf_dir).withColumn("term", F.col("hlt"))
    return counted(FL.drop_terms(m, ["ECONOMY", "SMALL"]), "term")


EXACT_ROWS = "(VALUES ('red', 'RED WIDGET'), ('red', 'RED GEAR'), ('red', 'RED BOLT'), ('blue', 'BLUE WIDGET'), ('blue', 'BLUE RING'), ('old', 'OLD ROD'), ('old', 'OLD PLATE'), ('old', 'COLD ROD'), ('gear', 'HOT GEAR'), ('gear', 'NEW GEAR'))"


@query(CARRIER + f"""
SELECT d.label, m.role, count(*) AS n FROM m JOIN (SELECT * FROM {EXACT_ROWS} v(label, k)) d ON upper(m.drug) = d.k
GROUP BY 1, 2""")
def join_dictionary_exact(spark, sf_dir):
    lookup = SRC.lookup_from_dict(spark, DEMO_MOLECULES)
    return counted(E.join_dictionary(report_table(spark, sf_dir), lookup, "exact"), "label", "role")


@query(CARRIER + f"""
SELECT label, role, count(*) AS n FROM (SELECT DISTINCT drug AS d, label FROM m JOIN {CLASS_ROWS} v(label, k)
  ON m.drug LIKE '%' || k || '%') JOIN m ON m.drug = d GROUP BY 1, 2""")
def join_dictionary_contains(spark, sf_dir):
    lookup = SRC.lookup_from_dict(spark, DEMO_CLASSES)
    return counted(E.join_dictionary(report_table(spark, sf_dir), lookup, "contains"), "label", "role")


@query("""
WITH v AS (SELECT p_partkey, upper(p_name || ' ' || p_brand || ' ' || p_partkey) AS drug FROM part),
 k AS (SELECT DISTINCT upper(p_brand || ' ' || p_partkey) AS key, p_type AS label FROM part),
 t AS (SELECT DISTINCT p_partkey, label FROM v JOIN k ON contains(drug, key))
SELECT label, l_returnflag AS flag, count(*) AS n FROM lineitem JOIN t ON l_partkey = p_partkey GROUP BY 1, 2""")
def join_dictionary_large(spark, sf_dir):
    """A dictionary with a key for each part, all of which begin alike, met by names that contain several keys."""
    def table(name):
        return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    tune(spark)
    part = table("part")
    key = F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))
    names = part.select("p_partkey", F.concat_ws(" ", "p_name", key).alias("drug"))
    reports = table("lineitem").join(names, F.col("l_partkey") == F.col("p_partkey"))
    lookup = part.select(key.alias("key"), F.col("p_type").alias("label"))
    joined = E.join_dictionary(reports, lookup, "contains")
    return counted(joined.withColumnRenamed("l_returnflag", "flag"), "label", "flag")


@query(CARRIER + """
SELECT role, count(*) AS n FROM m WHERE EXISTS (SELECT 1 FROM m d WHERE d.case_id = m.case_id
  AND d.role IN ('PS', 'SS') AND d.drug LIKE '%OLD%') GROUP BY 1""")
def exposed_rows(spark, sf_dir):
    m = report_table(spark, sf_dir)
    exposed = E.class_exposures(m, {"Class B": ("OLD",)})
    return counted(E.exposed_rows(m, exposed.select("case_id")), "role")


@query(CARRIER + """, l AS (SELECT DISTINCT p_size AS code FROM part WHERE p_brand = 'Brand#7')
SELECT role, count(*) AS n FROM m WHERE pt_code IN (SELECT code FROM l) GROUP BY 1""")
def in_code_table(spark, sf_dir):
    codes = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_brand = 'Brand#7'").select(
        F.col("p_size").cast("bigint").alias("pt_code")
    ).distinct()
    return counted(report_table(spark, sf_dir).join(codes, "pt_code", "left_semi"), "role")


@query(CARRIER + """, u AS (SELECT DISTINCT case_id FROM m), h AS (SELECT DISTINCT case_id FROM m WHERE pt_code IN (1, 2, 3, 4))
SELECT CASE WHEN h.case_id IS NULL THEN 0 ELSE 1 END AS hit, count(*) AS n FROM u LEFT JOIN h USING (case_id) GROUP BY 1""")
def left_join_flag(spark, sf_dir):
    m = report_table(spark, sf_dir)
    hits = m.filter(F.col("pt_code").isin(*DEMO_OUTCOMES))
    return counted(C.with_flag(C.universe(m), hits, "hit"), "hit")


@query(CARRIER + """, codes AS (SELECT DISTINCT p_size AS code FROM part WHERE p_size BETWEEN 6 AND 9),
 names AS (SELECT DISTINCT upper(p_brand) AS name FROM part WHERE p_size <= 5 AND p_brand < 'Brand#2')
SELECT pt_code, pt, CASE WHEN pt_code IN (SELECT code FROM codes) OR upper(pt) IN (SELECT name FROM names) THEN 1 ELSE 0 END
  AS outcome, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def outcome_by_code_or_name(spark, sf_dir):
    # every part is a lookup row: some give a code, some a name, some neither
    lookup = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.when(F.col("p_size").between(6, 9), F.col("p_size")).alias("code"),
        F.when((F.col("p_size") <= 5) & (F.col("p_brand") < "Brand#2"), F.col("p_brand")).alias("name"),
    )
    rows = C.outcome_by_code_or_name(report_table(spark, sf_dir), lookup)
    return counted(rows, "pt_code", "pt", "outcome")


NAME_SQL = """, names AS (SELECT DISTINCT drug AS term FROM m), coefs AS (SELECT drug AS term, count(*) AS coef FROM m
  WHERE pt_code = 7 AND role = 'PS' GROUP BY 1)"""


def names_and_coefs(spark, sf_dir):
    m = report_table(spark, sf_dir)
    names = m.select(F.col("drug").alias("term"))
    coefs = m.filter("pt_code = 7 AND role = 'PS'").groupBy(F.col("drug").alias("term")).agg(
        F.count(F.lit(1)).alias("coef")
    )
    return names, coefs


@query(CARRIER + NAME_SQL + " SELECT coefs.term, coef FROM coefs JOIN names USING (term)")
def present_terms(spark, sf_dir):
    names, coefs = names_and_coefs(spark, sf_dir)
    return S.present_terms(coefs, names)


@query(CARRIER + NAME_SQL + " SELECT term FROM names WHERE term NOT IN (SELECT term FROM coefs)")
def missing_names(spark, sf_dir):
    names, coefs = names_and_coefs(spark, sf_dir)
    return S.missing_names(names, coefs)


@query(CARRIER + """
SELECT drug, pt, count(*) AS n FROM m GROUP BY 1, 2 ORDER BY n DESC, drug, pt LIMIT 20""")
def preview_top(spark, sf_dir):
    return preview(counted(report_table(spark, sf_dir), "drug", "pt"), [F.desc("n"), "drug", "pt"])


@query(CARRIER + """
SELECT indication, count(*) AS n FROM m GROUP BY 1""")
def frequency_with_missing(spark, sf_dir):
    return C.frequency(report_table(spark, sf_dir), "indication")


@query(CARRIER + f""", f AS ({flags_sql()})
SELECT case_id, flag_class_a, flag_class_b, flag_class_c FROM f""")
def case_flags(spark, sf_dir):
    return E.case_flags(report_table(spark, sf_dir), DEMO_CLASSES)


@query(CARRIER + f""", b AS (SELECT case_id, string_agg(drug, '|') AS blob FROM m WHERE role IN ('PS', 'SS') GROUP BY 1)
SELECT case_id, {', '.join(f"CASE WHEN {t.replace('drug', 'blob')} THEN 1 ELSE 0 END AS {k}" for k, t in CLASS_TESTS.items())}
FROM b""")
def case_text_flags(spark, sf_dir):
    # A keyword occurs in the joined drug text of a case exactly when it occurs in one of the names.
    return E.case_flags(FL.with_roles(report_table(spark, sf_dir)), DEMO_CLASSES)


@query(CARRIER + f"""
SELECT case_id, {', '.join(f"CASE WHEN {t} THEN 1 ELSE 0 END AS {k}" for k, t in CLASS_TESTS.items())}
FROM (SELECT case_id, drug || '|' || pt AS drug FROM m)""")
def joined_text_column_flags(spark, sf_dir):
    m = report_table(spark, sf_dir).withColumn("all_drugs", F.concat("drug", F.lit("|"), "pt"))
    return E.text_flags(m, "all_drugs", DEMO_CLASSES)


@query(CARRIER + """
SELECT DISTINCT case_id, drug FROM m WHERE role IN ('PS', 'SS') AND length(drug) > 0""")
def suspect_pairs(spark, sf_dir):
    return E.suspect_pairs(report_table(spark, sf_dir))


@query(CARRIER + f""", f AS ({flags_sql()})
SELECT 'Class A' AS exposure, CAST(sum(flag_class_a) AS BIGINT) AS n FROM f
UNION ALL SELECT 'Class B', CAST(sum(flag_class_b) AS BIGINT) FROM f
UNION ALL SELECT 'Class C', CAST(sum(flag_class_c) AS BIGINT) FROM f""")
def exposure_counts(spark, sf_dir):
    flags = E.case_flags(report_table(spark, sf_dir), DEMO_CLASSES)
    return E.exposure_counts(flags, E.flag_labels(DEMO_CLASSES))
