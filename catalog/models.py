"""Feature builders, design matrix, penalised path, refit, locked models, portraits, validation."""

from pyspark.sql import functions as F

from casewatch import defaults as D
from casewatch.functions import tto_bin, zero_fill
from casewatch.operators import scoring as S
from casewatch.plans import case_features as CF
from casewatch.plans import design as DM
from casewatch.plans import lasso as L
from casewatch.plans import refit as RF
from casewatch.plans import validate as V
from casewatch.plans.carrier import DEMO_MOLECULES, DEMO_OUTCOMES, report_table
from casewatch.session import cut_lineage, scratch_path
from casewatch.sources import locks as LK
from casewatch.sources import (
    PORTABLE_SOURCE, ModelSpec, bind_columns, read_spec, write_manifest, write_spec,
)
from catalog.carrier_sql import AUTOIMMUNE, CARRIER, MOLECULE_TESTS, OUTCOME, TRANSPLANT, band_of, by_value, flag_list, r6
from catalog.evaluation import curve_sql
from catalog.registry import query, rounded
from catalog.signals import AGE_OF
from catalog.scalars import TTO_BIN
from catalog.tables import second_source

MOL_FLAGS = tuple(MOLECULE_TESTS)
ANY_MOLECULE = " OR ".join(MOLECULE_TESTS.values())
FACTORS = {"sex": ("F", "M"), "age_cat": D.AGE_LEVELS, "indication_grp": D.INDICATION_LEVELS}


def with_serious(spark, sf_dir):
    m = report_table(spark, sf_dir)
    return m.withColumn("serious", F.when(F.col("serious_death") == 1, "Y").otherwise(F.lit(None)))


def features(spark, sf_dir, rows="drug", extra=()):
    return CF.case_features(
        with_serious(spark, sf_dir), DEMO_MOLECULES, DEMO_OUTCOMES, prefix="flag_mol_", rows=rows, extra=extra
    )


def feature_sql(rows: str) -> str:
    """One row per case from the kept rows; attributes by smallest level among the given values."""
    return f""", r AS (SELECT * FROM m WHERE role IN ('PS', 'SS') AND ({rows})),
 g AS (SELECT case_id, max(CASE WHEN {OUTCOME} THEN 1 ELSE 0 END) AS outcome, {flag_list(MOLECULE_TESTS, 'TRUE')},
  min(CASE WHEN upper(sex) IN ('F', 'FEMALE', '2') THEN 1 WHEN upper(sex) IN ('M', 'MALE', '1') THEN 2
   WHEN sex IS NOT NULL THEN 3 END) AS sx,
  min(CASE WHEN upper(sex) IN ('M', 'MALE') THEN 2 WHEN sex IS NOT NULL AND upper(sex) NOT IN ('F', 'FEMALE') THEN 3
   WHEN sex IS NOT NULL THEN 1 END) AS sx2, min({AGE_OF}) AS age,
  min(CASE WHEN regexp_matches(indication, '{TRANSPLANT}') THEN 2 WHEN regexp_matches(indication, '{AUTOIMMUNE}') THEN 3
   WHEN indication IS NOT NULL THEN 1 END) AS ig, max(coalesce(serious_death, 0)) AS serious, min(tto_days) AS tto_days FROM r GROUP BY 1),
 c AS (SELECT case_id, outcome, {', '.join(MOL_FLAGS)}, CASE sx WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'Other' END AS sex,
  {band_of('age')} AS age_cat,
  CASE ig WHEN 2 THEN 'Transplantation' WHEN 3 THEN 'Autoimmune diseases' ELSE 'Other' END AS indication_grp, serious, tto_days, sx2
  FROM g)"""


DRUG_ROWS = feature_sql(ANY_MOLECULE)
BOTH_ROWS = feature_sql(f"{OUTCOME} OR {ANY_MOLECULE}")
EXPOSED = " + ".join(MOL_FLAGS) + " > 0"


@query(CARRIER + DRUG_ROWS + " SELECT * EXCLUDE (tto_days, sx2) FROM c")
def case_features(spark, sf_dir):
    return features(spark, sf_dir)


@query(CARRIER + DRUG_ROWS + f" SELECT * EXCLUDE (sx2) FROM c WHERE {EXPOSED}")
def case_features_with_onset(spark, sf_dir):
    return features(spark, sf_dir, extra=("tto_days",))


@query(CARRIER + BOTH_ROWS + f" SELECT * EXCLUDE (tto_days, sx2) FROM c WHERE {EXPOSED}")
def molecule_features_outcome_rows(spark, sf_dir):
    return features(spark, sf_dir, rows="drug_or_outcome")


MERGED_ROWS = ", w AS (SELECT * REPLACE (case_id // 4 AS case_id) FROM m)" + by_value(DRUG_ROWS.replace("FROM m WHERE", "FROM w WHERE"))


@query(CARRIER + MERGED_ROWS + " SELECT * EXCLUDE (tto_days, sx2) FROM c")
def case_features_conflicts(spark, sf_dir):
    # Four neighbouring cases are taken as one, so that a case reports several values of each attribute.
    m = with_serious(spark, sf_dir).withColumn("case_id", F.floor(F.col("case_id") / 4))
    return CF.case_features(m, DEMO_MOLECULES, DEMO_OUTCOMES, prefix="flag_mol_", by_value=True)


PORTABLE = f""" SELECT CAST(case_id AS VARCHAR) AS caseid, outcome, CASE WHEN sx2 = 2 THEN 1 ELSE 0 END AS "sexMale",
 CASE WHEN sx2 = 3 THEN 1 ELSE 0 END AS "sexUnknown", CASE WHEN age_cat = '40-64' THEN 1 WHEN age_cat IS NOT NULL THEN 0 END AS "age_cat40.64",
 CASE WHEN indication_grp = 'Transplantation' THEN 1 ELSE 0 END AS "indication_grpTransplantation", {', '.join(MOL_FLAGS)},
 'first' AS source FROM c WHERE {EXPOSED} AND serious = 0"""


def first_features(spark, sf_dir):
    return CF.portable_features(with_serious(spark, sf_dir), "first", DEMO_MOLECULES, DEMO_OUTCOMES)


def second_features(spark, sf_dir):
    bound = bind_columns(second_source(spark, sf_dir).withColumnRenamed("AGE_NUM", "AGE"), PORTABLE_SOURCE).drop("serious")
    return CF.portable_features(bound, "second", DEMO_MOLECULES, DEMO_OUTCOMES, roles=("PS", "C"))


@query(CARRIER + BOTH_ROWS + PORTABLE)
def portable_features(spark, sf_dir):
    return first_features(spark, sf_dir)


# The second source has no age unit and no seriousness, and other roles.
SECOND_ROWS = BOTH_ROWS.replace("('PS', 'SS')", "('PS', 'C')").replace(
    f"min({AGE_OF}) AS age", "min(try_cast(nullif(age, '') AS DOUBLE)) AS age"
)
SECOND_PORTABLE = PORTABLE.replace("'first' AS source", "'second' AS source").replace(" AND serious = 0", "")


@query(CARRIER + SECOND_ROWS + SECOND_PORTABLE)
def portable_features_second_source(spark, sf_dir):
    return second_features(spark, sf_dir)


# --- design ---------------------------------------------------------------------------------------


def demo_design(spark, sf_dir):
    return DM.design_matrix(features(spark, sf_dir), MOL_FLAGS, FACTORS)


DESIGN_TERMS = {
    **{f: f"CAST({f} AS DOUBLE)" for f in MOL_FLAGS},
    "sexF": "CAST(sex = 'F' AS DOUBLE)", "sexM": "CAST(sex = 'M' AS DOUBLE)",
    "age_cat18.39": "CAST(age_cat = '18-39' AS DOUBLE)", "age_cat40.64": "CAST(age_cat = '40-64' AS DOUBLE)",
    "age_cat65.": "CAST(age_cat = '65+' AS DOUBLE)",
    "indication_grpTransplantation": "CAST(indication_grp = 'Transplantation' AS DOUBLE)",
    "indication_grpAutoimmune.diseases": "CAST(indication_grp = 'Autoimmune diseases' AS DOUBLE)",
}
DESIGN = f""", x AS (SELECT case_id, outcome AS y, {', '.join(f'{v} AS "{k}"' for k, v in DESIGN_TERMS.items())}
 FROM c WHERE sex IS NOT NULL AND age_cat IS NOT NULL)"""


@query(CARRIER + DRUG_ROWS + DESIGN + " SELECT * FROM x")
def design_matrix(spark, sf_dir):
    return DM.design_table(demo_design(spark, sf_dir))


@query(CARRIER + DRUG_ROWS + DESIGN + f""" SELECT {', '.join(f'"{t}"' for t in DESIGN_TERMS)}, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos
 FROM x GROUP BY ALL""")
def collapsed_patterns(spark, sf_dir):
    design = demo_design(spark, sf_dir)
    return DM.collapse(design).select(*[F.get("x", i).alias(t) for i, t in enumerate(design.terms)], "n", "pos")


@query(CARRIER + DRUG_ROWS + f""", o AS (SELECT *, {TTO_BIN.format('tto_days')} AS tto_bin FROM c WHERE sex IS NOT NULL)
 SELECT sex, tto_bin, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS pos FROM o GROUP BY 1, 2""")
def onset_as_predictor(spark, sf_dir):
    cases = features(spark, sf_dir, extra=("tto_days",)).withColumn("tto_bin", tto_bin("tto_days"))
    bins = [D.ONSET_MISSING, *[label for _, label in D.ONSET_BINS], D.ONSET_LAST]
    design = DM.design_matrix(cases, (), {"sex": ("F", "M", "Other"), "tto_bin": bins})
    names = {t: i for i, t in enumerate(design.terms)}

    def level(column, levels):
        out = F.lit(levels[0])
        for value in levels:
            position = names.get(DM.term_name(f"{column}{value}"))
            if position is not None:
                out = F.when(F.get("x", position) == 1, value).otherwise(out)
        return out

    rows = DM.collapse(design).select(
        level("sex", ("F", "M", "Other")).alias("sex"), level("tto_bin", bins).alias("tto_bin"), "n", "pos"
    )
    return rows.groupBy("sex", "tto_bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


# --- penalised path -------------------------------------------------------------------------------


def demo_path(spark, sf_dir):
    return L.lasso_model(demo_design(spark, sf_dir))


# With one 0/1 predictor the penalised fit has a closed form: the two group rates move towards each
# other until the score of the predictor equals the penalty.
ONE_PATH = """, i AS (SELECT outcome AS y, flag_mol_red AS x,
  CAST('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':20251121'), 1, 8) AS BIGINT) % 10 + 1 AS fold FROM c),
 hold AS (SELECT fold, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, sum(x)::DOUBLE AS n1, sum(x * y)::DOUBLE AS y1 FROM i GROUP BY 1),
 whole AS (SELECT 0 AS fold, sum(n) AS n, sum(p) AS p, sum(n1) AS n1, sum(y1) AS y1 FROM hold),
 train AS (SELECT hold.fold, w.n - hold.n AS n, w.p - hold.p AS p, w.n1 - hold.n1 AS n1, w.y1 - hold.y1 AS y1 FROM hold, whole w
  UNION ALL SELECT * FROM whole),
 m1 AS (SELECT *, sqrt(n1 / n * (1 - n1 / n)) AS sd, y1 - p / n * n1 AS g FROM train),
 lam AS (SELECT k, exp(ln(abs(g) / sd / n) + k * ln(1e-4::DOUBLE) / 99) AS pen FROM m1, range(100) r(k) WHERE fold = 0),
 f0 AS (SELECT fold, k, pen, n, p, n1, y1, CASE WHEN abs(g) / (n * sd) <= pen * (1 + 1e-12) THEN n1 * p / n
  ELSE y1 - sign(g) * pen * n * sd END AS e1 FROM m1, lam),
 fit AS (SELECT fold, k, pen, e1 / n1 AS p1, (p - e1) / (n - n1) AS p0 FROM f0)"""


@query(CARRIER + DRUG_ROWS + ONE_PATH + """ SELECT round(pen, 6) + 0.0 AS "lambda",
 round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) + 0.0 AS coef FROM fit WHERE fold = 0""")
def lasso_one_flag_path(spark, sf_dir):
    patterns, _ = one_flag_patterns(spark, sf_dir)
    penalties = L.lambda_sequence(L.moments(patterns, 1))
    rows = [(f.penalty, f.beta[0]) for f in L.fit_path(patterns, 1, penalties)]
    fitted = spark.createDataFrame(rows, "lambda double, coef double")
    return rounded(rounded(fitted, "lambda"), "coef", digits=4)


@query(CARRIER + DRUG_ROWS + ONE_PATH + """, l1 AS (SELECT k, pen, h.n, -2 * (h.y1 * ln(p1) + (h.n1 - h.y1) * ln(1 - p1)
  + (h.p - h.y1) * ln(p0) + (h.n - h.n1 - h.p + h.y1) * ln(1 - p0)) / h.n AS loss FROM fit JOIN hold h USING (fold)),
 l2 AS (SELECT k, pen, n, loss, sum(loss * n) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS cvm FROM l1)
 SELECT round(pen, 6) + 0.0 AS "lambda", round(max(cvm), 4) + 0.0 AS cvm,
 round(sqrt(sum((loss - cvm) ** 2 * n) / sum(n) / 9), 4) + 0.0 AS cvsd FROM l2 GROUP BY k, pen""")
def lasso_one_flag_cv_curve(spark, sf_dir):
    design = DM.design_matrix(features(spark, sf_dir), ("flag_mol_red",), {})
    path, _, _ = L.lasso_model(design)
    return rounded(rounded(path.curve, "lambda"), "cvm", "cvsd", digits=4)


@query(CARRIER + DRUG_ROWS + DESIGN + f""", v AS (UNPIVOT x ON {', '.join(f'"{t}"' for t in DESIGN_TERMS)} INTO NAME feature VALUE val),
 gr AS (SELECT feature, abs(sum(val * y) - avg(y) * sum(val)) / nullif(stddev_pop(val), 0) / count(*) AS g FROM v GROUP BY 1)
 SELECT CAST(k AS INTEGER) AS i, {r6('exp(ln(max(g)) + k * ln(1e-4::DOUBLE) / 99)')} AS "lambda" FROM gr, range(100) r(k) GROUP BY k""")
def lasso_penalty_sequence(spark, sf_dir):
    design = demo_design(spark, sf_dir)
    penalties = L.lambda_sequence(L.moments(DM.collapse(design), len(design.terms)), 100)
    return rounded(spark.createDataFrame(list(enumerate(penalties)), "i int, lambda double"), "lambda")


@query()
def lasso_cv_curve(spark, sf_dir):
    path, _, _ = demo_path(spark, sf_dir)
    return path.curve


@query()
def lasso_coefficient_path(spark, sf_dir):
    path, _, _ = demo_path(spark, sf_dir)
    return path.path


@query()
def lasso_chosen_coefficients(spark, sf_dir):
    path, _, _ = demo_path(spark, sf_dir)
    tables = [path.coefficients(rule).withColumn("rule", F.lit(f"lambda.{rule}")) for rule in ("min", "1se")]
    return tables[0].unionByName(tables[1])


@query()
def lasso_out_of_fold(spark, sf_dir):
    design = L.with_folds(demo_design(spark, sf_dir), 10, 10)
    return L.oof_predict(design, L.training_patterns(design)).predictions


# The closed form for each outer fold and each inner fold of its training set.
NESTED = """, i AS (SELECT case_id, outcome AS y, flag_mol_red AS x,
  CAST('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':20251121'), 1, 8) AS BIGINT) % 10 + 1 AS fold,
  CAST('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':20251122'), 1, 8) AS BIGINT) % 10 + 1 AS inn FROM c),
 cell AS (SELECT fold, inn, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, sum(x)::DOUBLE AS n1, sum(x * y)::DOUBLE AS y1 FROM i GROUP BY 1, 2),
 b AS (SELECT DISTINCT fold AS b FROM cell), j AS (SELECT DISTINCT inn AS j FROM cell),
 hold AS (SELECT b, inn AS j, sum(n) AS n, sum(p) AS p, sum(n1) AS n1, sum(y1) AS y1 FROM b JOIN cell ON fold <> b GROUP BY 1, 2),
 train AS (SELECT b, j.j, sum(n) AS n, sum(p) AS p, sum(n1) AS n1, sum(y1) AS y1 FROM hold JOIN j ON hold.j <> j.j GROUP BY 1, 2
  UNION ALL SELECT b, 0, sum(n), sum(p), sum(n1), sum(y1) FROM hold GROUP BY 1),
 m1 AS (SELECT *, sqrt(n1 / n * (1 - n1 / n)) AS sd, y1 - p / n * n1 AS g FROM train),
 lam AS (SELECT b, k, exp(ln(abs(g) / sd / n) + k * ln(1e-4::DOUBLE) / 99) AS pen FROM m1, range(100) r(k) WHERE j = 0),
 f0 AS (SELECT b, j, k, pen, n, p, n1, CASE WHEN abs(g) / (n * sd) <= pen * (1 + 1e-12) THEN n1 * p / n
  ELSE y1 - sign(g) * pen * n * sd END AS e1 FROM m1 JOIN lam USING (b)),
 fit AS (SELECT b, j, k, pen, e1 / n1 AS p1, (p - e1) / (n - n1) AS p0 FROM f0),
 l1 AS (SELECT b, k, pen, h.n, -2 * (h.y1 * ln(p1) + (h.n1 - h.y1) * ln(1 - p1)
  + (h.p - h.y1) * ln(p0) + (h.n - h.n1 - h.p + h.y1) * ln(1 - p0)) / h.n AS loss FROM fit JOIN hold h USING (b, j)),
 l2 AS (SELECT *, sum(loss * n) OVER w / sum(n) OVER w AS cvm FROM l1 WINDOW w AS (PARTITION BY b, k)),
 cv AS (SELECT b, k, max(pen) AS pen, max(cvm) AS cvm, sqrt(sum((loss - cvm) ** 2 * n) / sum(n) / (count(*) - 1)) AS cvsd FROM l2 GROUP BY 1, 2),
 best AS (SELECT DISTINCT ON (b) b, k AS kmin, cvm + cvsd AS bound FROM cv ORDER BY b, cvm, k),
 se AS (SELECT b, kmin, min(k) AS kse FROM cv JOIN best USING (b) WHERE cvm <= bound GROUP BY 1, 2)"""


@query(CARRIER + DRUG_ROWS + NESTED + """ SELECT case_id AS id, CAST(fold AS INTEGER) AS fold, CAST(y AS INTEGER) AS y, r.rule,
 round(CASE x WHEN 1 THEN p1 ELSE p0 END, 5) + 0.0 AS p_hat
 FROM i JOIN se ON fold = se.b, (VALUES ('min'), ('1se')) r(rule) JOIN fit ON fit.b = i.fold AND fit.j = 0
  AND fit.k = CASE r.rule WHEN 'min' THEN kmin ELSE kse END""")
def lasso_one_flag_out_of_fold(spark, sf_dir):
    design = L.with_folds(DM.design_matrix(features(spark, sf_dir), ("flag_mol_red",), {}), 10, 10)
    patterns = L.training_patterns(design)
    tables = [
        L.oof_predict(design, patterns, rule=rule).predictions.withColumn("rule", F.lit(rule)) for rule in ("min", "1se")
    ]
    return rounded(tables[0].unionByName(tables[1]), "p_hat", digits=5)


@query()
def lasso_selected_refit(spark, sf_dir):
    path, patterns, _ = demo_path(spark, sf_dir)
    # The tables carry no planted signal, so the stricter rule may select nothing.
    return RF.refit_logistic(patterns, path.terms, path.selected("min"))


@query()
def lasso_model_lock(spark, sf_dir):
    path, _, _ = demo_path(spark, sf_dir)
    target = scratch_path(spark, "lock")
    write_manifest(spark, L.lock_manifest(path, DEMO_MOLECULES, D.INDICATION_LEVELS), target)
    return spark.read.json(target).select("family", "alpha", "nlambda", "features", "indication_levels")


@query(CARRIER + DRUG_ROWS + ONE_PATH + """, l1 AS (SELECT k, pen, h.n, -2 * (h.y1 * ln(p1) + (h.n1 - h.y1) * ln(1 - p1)
  + (h.p - h.y1) * ln(p0) + (h.n - h.n1 - h.p + h.y1) * ln(1 - p0)) / h.n AS loss FROM fit JOIN hold h USING (fold)),
 l2 AS (SELECT *, sum(loss * n) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS cvm FROM l1),
 cv AS (SELECT k, max(cvm) AS cvm, sqrt(sum((loss - cvm) ** 2 * n) / sum(n) / 9) AS cvsd FROM l2 GROUP BY k),
 best AS (SELECT k AS kmin, cvm + cvsd AS bound FROM cv ORDER BY cvm, k LIMIT 1),
 se AS (SELECT kmin, min(k) AS kse FROM cv, best WHERE cvm <= bound GROUP BY 1),
 cf AS (SELECT k, round(ln(p0 / (1 - p0)), 4) + 0.0 AS b0, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) + 0.0 AS b1 FROM fit WHERE fold = 0)
 SELECT CAST(fit.k AS INTEGER) AS i, round(fit.pen, 6) + 0.0 AS "lambda", fit.k = kmin AS is_min, fit.k = kse AS is_1se, 'binomial' AS family, 'logit' AS link,
 1 AS alpha, 20251121 AS seed, 10 AS folds, 'flag_mol_red' AS terms, 'red:RED WIDGET,RED GEAR,RED BOLT' AS dictionary,
 'indication_grp:Other,Transplantation,Autoimmune diseases' AS levels, mn.b0 AS intercept_min, mn.b1 AS coef_min, s1.b0 AS intercept_1se, s1.b1 AS coef_1se
 FROM fit, se, cf mn, cf s1 WHERE fold = 0 AND mn.k = kmin AND s1.k = kse""")
def lasso_lock_one_flag(spark, sf_dir):
    # Fitted, locked under its hash, read back with the same dictionary and levels, and shown in full.
    design = DM.design_matrix(features(spark, sf_dir), ("flag_mol_red",), {})
    path, _, _ = L.lasso_model(design)
    dictionary, levels = {"red": DEMO_MOLECULES["red"]}, {"indication_grp": D.INDICATION_LEVELS}
    folder = scratch_path(spark, "locks")
    name = LK.write_lock(spark, L.lock_record(path, dictionary, levels), folder)
    record = LK.read_lock(spark, folder, name, dictionary, levels)
    listed = lambda d: ";".join(f"{k}:{','.join(v)}" for k, v in d.items())
    shown = {
        "family": record["family"], "link": record["link"], "alpha": record["alpha"], "seed": record["seed"], "folds": record["folds"],
        "terms": ",".join(record["terms"]), "dictionary": listed(record["dictionary"]), "levels": listed(record["levels"]),
    }
    for rule in ("min", "1se"):
        spec = LK.locked_spec(record, rule)
        shown |= {f"intercept_{rule}": round(spec.intercept, 4) + 0.0, f"coef_{rule}": round(spec.coefficients["flag_mol_red"], 4) + 0.0}
    table = LK.penalty_rows(record, spark).drop("lock_id").withColumns({k: F.lit(v) for k, v in shown.items()})
    return rounded(table, "lambda")


# --- refit ----------------------------------------------------------------------------------------

ONE_FLAG = """, k AS (SELECT count(*) FILTER (WHERE flag_mol_red = 1 AND outcome = 1)::DOUBLE AS a,
 count(*) FILTER (WHERE flag_mol_red = 1 AND outcome = 0)::DOUBLE AS b, count(*) FILTER (WHERE flag_mol_red = 0 AND outcome = 1)::DOUBLE AS c,
 count(*) FILTER (WHERE flag_mol_red = 0 AND outcome = 0)::DOUBLE AS d FROM c),
 e AS (SELECT '(Intercept)' AS term, ln(c / d) AS beta, sqrt(1 / c + 1 / d) AS se FROM k
 UNION ALL SELECT 'flag_mol_red', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM k)"""
WALD = f""" SELECT term, {r6('beta')} AS beta, {r6('se')} AS se, {r6('exp(beta)')} AS "OR", {r6('exp(beta - 1.96 * se)')} AS "CI_low",
 {r6('exp(beta + 1.96 * se)')} AS "CI_high" FROM e"""
WALD_COLUMNS = ("beta", "se", "OR", "CI_low", "CI_high")


def one_flag_patterns(spark, sf_dir):
    design = DM.design_matrix(features(spark, sf_dir), ("flag_mol_red",), {})
    return cut_lineage(DM.collapse(design)), design.terms


@query(CARRIER + DRUG_ROWS + ONE_FLAG + WALD)
def refit_one_flag(spark, sf_dir):
    patterns, terms = one_flag_patterns(spark, sf_dir)
    fitted = RF.refit_logistic(patterns, terms, terms)
    return rounded(fitted.select("term", *WALD_COLUMNS), *WALD_COLUMNS)


@query(CARRIER + DRUG_ROWS + ONE_FLAG + WALD)
def robust_one_flag(spark, sf_dir):
    # With one binary term the model is saturated, so sandwich and model errors agree.
    patterns, terms = one_flag_patterns(spark, sf_dir)
    robust = RF.robust_errors(patterns, terms, RF.refit_logistic(patterns, terms, terms), keep_intercept=True)
    return rounded(robust.select("term", *WALD_COLUMNS), *WALD_COLUMNS)


# Two disjoint levels against the rest: the fit has a closed form although it has two terms.
TWO_LEVELS = ("indication_grpTransplantation", "indication_grpAutoimmune.diseases")
TWO_FLAGS = """, k AS (SELECT indication_grp AS g, count(*) FILTER (WHERE outcome = 1)::DOUBLE AS a, count(*) FILTER (WHERE outcome = 0)::DOUBLE AS b
 FROM c WHERE flag_mol_red IS NOT NULL GROUP BY 1), o AS (SELECT * FROM k WHERE g = 'Other'),
 e AS (SELECT '(Intercept)' AS term, ln(a / b) AS beta, sqrt(1 / a + 1 / b) AS se FROM o
 UNION ALL SELECT CASE k.g WHEN 'Transplantation' THEN 'indication_grpTransplantation' ELSE 'indication_grpAutoimmune.diseases' END,
  ln(k.a * o.b / (k.b * o.a)), sqrt(1 / k.a + 1 / k.b + 1 / o.a + 1 / o.b) FROM k, o WHERE k.g <> 'Other')"""


def two_level_patterns(spark, sf_dir):
    levels = {"indication_grp": D.INDICATION_LEVELS}
    design = DM.design_matrix(features(spark, sf_dir), (), levels)
    return cut_lineage(DM.collapse(design)), design.terms


@query(CARRIER + DRUG_ROWS + TWO_FLAGS + WALD)
def refit_two_flags(spark, sf_dir):
    patterns, terms = two_level_patterns(spark, sf_dir)
    return rounded(RF.refit_logistic(patterns, terms, TWO_LEVELS).select("term", *WALD_COLUMNS), *WALD_COLUMNS)


@query(CARRIER + DRUG_ROWS + TWO_FLAGS + f""" SELECT term AS variable,
 printf('%.2f [%.2f–%.2f]', exp(beta), exp(beta - 1.96 * se), exp(beta + 1.96 * se)) AS adjusted_or FROM e""")
def odds_ratio_text_two_flags(spark, sf_dir):
    patterns, terms = two_level_patterns(spark, sf_dir)
    return RF.odds_table(RF.refit_logistic(patterns, terms, TWO_LEVELS)).select("variable", "adjusted_or")


# Coefficients that are no fit, so that sandwich and model errors differ; the inverse is that of a 2x2 matrix.
GIVEN = {"(Intercept)": -1.5, "flag_mol_red": 0.75}


@query(CARRIER + DRUG_ROWS + f""", q AS (SELECT flag_mol_red AS x, outcome AS y, 1 / (1 + exp(-({GIVEN['(Intercept)']} + {GIVEN['flag_mol_red']} * flag_mol_red))) AS p
 FROM c), s AS (SELECT sum(p * (1 - p)) AS i00, sum(x * p * (1 - p)) AS i11, sum((y - p) ** 2) AS m00, sum(x * (y - p) ** 2) AS m11 FROM q),
 e AS (SELECT '(Intercept)' AS term, {GIVEN['(Intercept)']}::DOUBLE AS beta,
  sqrt(i11 * i11 * m00 - 2 * i11 * i11 * m11 + i11 * i11 * m11) / (i00 * i11 - i11 * i11) AS se FROM s
 UNION ALL SELECT 'flag_mol_red', {GIVEN['flag_mol_red']}::DOUBLE,
  sqrt(i11 * i11 * m00 - 2 * i00 * i11 * m11 + i00 * i00 * m11) / (i00 * i11 - i11 * i11) FROM s)""" + WALD)
def robust_given_coefficients(spark, sf_dir):
    patterns, terms = one_flag_patterns(spark, sf_dir)
    given = spark.createDataFrame(list(GIVEN.items()), "term string, beta double")
    robust = RF.robust_errors(patterns, terms, given, keep_intercept=True)
    return rounded(robust.select("term", *WALD_COLUMNS), *WALD_COLUMNS)


def full_refit(spark, sf_dir):
    design = demo_design(spark, sf_dir)
    patterns = cut_lineage(DM.collapse(design))
    return RF.refit_logistic(patterns, list(design.terms), list(design.terms)), patterns, list(design.terms)


@query()
def refit_all_terms(spark, sf_dir):
    return full_refit(spark, sf_dir)[0]


@query()
def robust_all_terms(spark, sf_dir):
    fitted, patterns, terms = full_refit(spark, sf_dir)
    return RF.robust_errors(patterns, terms, fitted)


@query()
def odds_ratio_text(spark, sf_dir):
    return RF.odds_table(full_refit(spark, sf_dir)[0])


IMPORTANCE_BETA = {"flag_mol_red": 0.5, "flag_mol_old": -0.25, "sexM": 0.125, "age_cat65.": 1.5}
IMPORTANCE_ROWS = ", ".join(f"('{t}', {b}::DOUBLE)" for t, b in IMPORTANCE_BETA.items())
UNPIVOT = f""", v AS (UNPIVOT x ON {', '.join(f'"{t}"' for t in IMPORTANCE_BETA)} INTO NAME feature VALUE val),
 b AS (SELECT * FROM (VALUES {IMPORTANCE_ROWS}) w(feature, beta))"""


@query(CARRIER + DRUG_ROWS + DESIGN + UNPIVOT + f""" SELECT feature, beta, {r6('exp(beta)')} AS "OR",
 {r6('avg(abs(val * beta))')} AS importance FROM v JOIN b USING (feature) GROUP BY feature, beta""")
def contribution_importance(spark, sf_dir):
    design = demo_design(spark, sf_dir)
    table = RF.contribution_importance(DM.collapse(design), design.terms, IMPORTANCE_BETA)
    return rounded(table, "OR", "importance")


@query(CARRIER + DRUG_ROWS + DESIGN + UNPIVOT + f""" SELECT feature, beta, {r6('nullif(stddev_samp(val), 0)')} AS sd,
 {r6('abs(beta) * nullif(stddev_samp(val), 0)')} AS importance FROM v JOIN b USING (feature) GROUP BY feature, beta""")
def spread_importance(spark, sf_dir):
    design = demo_design(spark, sf_dir)
    return rounded(RF.spread_importance(DM.collapse(design), design.terms, IMPORTANCE_BETA), "sd", "importance")


# --- locked models --------------------------------------------------------------------------------

CRUDE_FLAGS = {**{f: f for f in MOL_FLAGS}, "sexMale": '"sexMale"', "age_cat40.64": 'coalesce("age_cat40.64", 0)',
               "indication_grpTransplantation": '"indication_grpTransplantation"'}


def crude_refit(spark, sf_dir):
    """Refit-like table from the data: overall odds as intercept and one crude odds ratio per term."""
    filled = zero_fill(first_features(spark, sf_dir), CRUDE_FLAGS)
    y = F.col("outcome")
    sums = {}
    for i, term in enumerate(CRUDE_FLAGS):
        x = F.col(f"`{term}`")
        sums |= {f"a{i}": F.sum(x * y), f"b{i}": F.sum(x * (1 - y)), f"c{i}": F.sum((1 - x) * y), f"d{i}": F.sum((1 - x) * (1 - y))}
    wide = filled.agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()])
    entries = [F.struct(F.lit("(Intercept)").alias("term"), (F.col("pos") / (F.col("n") - F.col("pos"))).alias("OR"))]
    entries += [
        F.struct(F.lit(t).alias("term"), (F.col(f"a{i}") / F.col(f"b{i}") / (F.col(f"c{i}") / F.col(f"d{i}"))).alias("OR"))
        for i, t in enumerate(CRUDE_FLAGS)
    ]
    return wide.select(F.inline(F.array(*entries)))


CRUDE = ", pf AS (" + PORTABLE + "), rf AS (SELECT '(Intercept)' AS term, sum(outcome) / (count(*) - sum(outcome)) AS o FROM pf " + " ".join(
    f"""UNION ALL SELECT '{t}', sum({e} * outcome) / sum({e} * (1 - outcome)) / (sum((1 - {e}) * outcome) / sum((1 - {e}) * (1 - outcome))) FROM pf"""
    for t, e in CRUDE_FLAGS.items()) + ")"


@query(CARRIER + BOTH_ROWS + CRUDE + f""" SELECT term, {r6('ln(o)')} AS beta FROM rf""")
def lock_spec(spark, sf_dir):
    spec = S.lock_spec(crude_refit(spark, sf_dir), "crude")
    terms = F.map_concat("coefficients", F.create_map(F.lit("(Intercept)"), F.col("intercept")))
    return rounded(spec.select(F.explode(terms).alias("term", "beta")), "beta")


@query(CARRIER + BOTH_ROWS + CRUDE + f""" SELECT term, {r6('ln(o)')} AS beta FROM rf WHERE term <> '(Intercept)'""")
def spec_file_round_trip(spark, sf_dir):
    path = scratch_path(spark, "spec")
    write_spec(S.lock_spec(crude_refit(spark, sf_dir), "crude", {"source": "first"}), path)
    spec = read_spec(spark, path)
    return rounded(spec.frame(spark).select(F.explode("coefficients").alias("term", "beta")), "beta")


SPEC = ModelSpec(
    -1.25,
    {"sexMale": 0.5, "age_cat40.64": -0.375, "indication_grpTransplantation": 0.625, "flag_mol_red": 0.25,
     "flag_mol_blue": -0.75, "flag_mol_old": 0.125, "flag_mol_gear": 1.0, "flag_mol_absent": 2.0},
)
SPEC_TERMS = {t: e for t, e in CRUDE_FLAGS.items()}
ETA = " + ".join(f"{SPEC.coefficients[t]}::DOUBLE * {e}" for t, e in SPEC_TERMS.items()) + f" + ({SPEC.intercept})"


def scored_sql(source: str, name: str) -> str:
    return f", {name} AS (SELECT caseid AS \"ID\", outcome, 1 / (1 + exp(-({ETA}))) AS prob, {ETA} AS eta FROM ({source}))"


@query(CARRIER + BOTH_ROWS + scored_sql(PORTABLE, "sc") + f""" SELECT "ID", outcome, {r6('prob')} AS prob, {r6('eta')} AS eta FROM sc""")
def score_cases(spark, sf_dir):
    return rounded(V.predictions(first_features(spark, sf_dir), SPEC), "prob", "eta")


def measures_sql(dataset: str, features: str, source: str) -> str:
    """Measures of one source, as a query of its own."""
    return CARRIER + features + scored_sql(source, "sc") + """, s AS (SELECT outcome AS y, greatest(least(prob, 1 - 1e-6), 1e-6) AS p FROM sc)""" + curve_sql() + f"""
 SELECT '{dataset}' AS dataset, 'AUROC' AS metric, {r6('auroc')} AS value FROM ro
 UNION ALL SELECT '{dataset}', 'AUPRC', {r6('auprc')} FROM pr UNION ALL SELECT '{dataset}', 'Brier', {r6('avg((p - y) ** 2)')} FROM s"""


@query(measures_sql("first", BOTH_ROWS, PORTABLE))
def validate_first_source(spark, sf_dir):
    return rounded(V.validate({"first": first_features(spark, sf_dir)}, SPEC), "value")


@query(measures_sql("second", SECOND_ROWS, SECOND_PORTABLE))
def validate_second_source(spark, sf_dir):
    return rounded(V.validate({"second": second_features(spark, sf_dir)}, SPEC), "value")


@query(f"""SELECT * FROM ({measures_sql('first', BOTH_ROWS, PORTABLE)})
 UNION ALL SELECT * FROM ({measures_sql('second', SECOND_ROWS, SECOND_PORTABLE)})""")
def validate_two_sources(spark, sf_dir):
    tables = {"first": first_features(spark, sf_dir), "second": second_features(spark, sf_dir)}
    path = scratch_path(spark, "manifest")
    V.validation_manifest(spark, SPEC, tables, path, {"first": sf_dir, "second": sf_dir})
    return rounded(V.validate(tables, SPEC), "value")


@query(CARRIER + BOTH_ROWS + scored_sql(PORTABLE, "sc") + f""", s AS (SELECT outcome AS y, prob AS p FROM sc),
 q AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM s),
 i AS (SELECT e, unnest(e[2:len(e) - 1]) AS edge FROM q),
 b AS (SELECT y, p, 1 + (SELECT count(*) FROM i WHERE s.p >= i.edge) AS bin FROM s)
 SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {r6('avg(p)')} AS mean_pred, {r6('avg(y)')} AS obs_rate FROM b GROUP BY 1""")
def validation_bins(spark, sf_dir):
    table = V.validation_bins(first_features(spark, sf_dir), SPEC)
    return rounded(table.select("bin", "n", "mean_pred", "obs_rate"), "mean_pred", "obs_rate")


MOLECULE_LEVELS = {"None": None, "Red": "flag_mol_red", "Blue": "flag_mol_blue", "Green": "flag_mol_green"}
GRID = f""", b AS (SELECT term, ln(o) AS beta FROM rf),
 mo AS (SELECT * FROM (VALUES ('None', NULL), ('Red', 'flag_mol_red'), ('Blue', 'flag_mol_blue'), ('Green', 'flag_mol_green')) v(molecule, mt)),
 sx AS (SELECT * FROM (VALUES ('Female', NULL), ('Male', 'sexMale')) v(sex, st)),
 ag AS (SELECT * FROM (VALUES ('<18', NULL), ('18-39', NULL), ('40-64', 'age_cat40.64'), ('65+', NULL)) v(age, gt)),
 ind AS (SELECT * FROM (VALUES ('Other', NULL), ('Transplantation', 'indication_grpTransplantation'), ('Autoimmune diseases', NULL)) v(indication, it)),
 gr AS (SELECT sex, age, indication, molecule, concat_ws(';', mt, st, gt, it) AS terms_used,
  coalesce((SELECT beta FROM b WHERE term = mt), 0) + coalesce((SELECT beta FROM b WHERE term = st), 0)
  + coalesce((SELECT beta FROM b WHERE term = gt), 0) + coalesce((SELECT beta FROM b WHERE term = it), 0) AS lo
  FROM mo, sx, ag, ind),
 po AS (SELECT *, 1 / (1 + exp(-(lo + (SELECT beta FROM b WHERE term = '(Intercept)')))) AS risk FROM gr)"""
PORTRAIT = f""" SELECT sex, age, indication, molecule, terms_used, {r6('lo')} AS "logOR_combo", {r6('exp(lo)')} AS "OR_combo",
 {r6('risk')} AS risk_abs, CASE WHEN risk < 0.02 THEN 'Low' WHEN risk < 0.05 THEN 'Moderate' ELSE 'High' END AS risk_cat FROM po"""
PORTRAIT_NUMBERS = ("logOR_combo", "OR_combo", "risk_abs")


def spec_table(spark, sf_dir):
    return S.lock_spec(crude_refit(spark, sf_dir), "crude")


@query(CARRIER + BOTH_ROWS + CRUDE + GRID + PORTRAIT)
def risk_portraits(spark, sf_dir):
    return rounded(S.portraits(spec_table(spark, sf_dir), MOLECULE_LEVELS), *PORTRAIT_NUMBERS)


@query(CARRIER + BOTH_ROWS + CRUDE + GRID + PORTRAIT + " ORDER BY po.risk DESC, molecule, sex, age, indication LIMIT 20")
def highest_risk_portraits(spark, sf_dir):
    table = S.portraits(spec_table(spark, sf_dir), MOLECULE_LEVELS)
    best = table.orderBy(F.desc("risk_abs"), "molecule", "sex", "age", "indication").limit(20)
    return rounded(best, *PORTRAIT_NUMBERS)


@query(CARRIER + BOTH_ROWS + CRUDE + GRID.replace("po AS (SELECT *, 1 / (1 + exp(-(lo + (SELECT beta FROM b WHERE term = '(Intercept)'))))",
       "po AS (SELECT *, 1 / (1 + exp(-(lo + ln(0.05::DOUBLE / 0.95))))") + PORTRAIT)
def recalibrated_portraits(spark, sf_dir):
    spec = S.recalibrate(spec_table(spark, sf_dir), 0.05)
    return rounded(S.portraits(spec, MOLECULE_LEVELS), *PORTRAIT_NUMBERS)


@query(CARRIER + BOTH_ROWS + CRUDE + f""", w AS (SELECT unnest({list(S.PORTRAIT_TERMS)}) AS term)
 SELECT term FROM w WHERE term NOT IN (SELECT term FROM rf)""")
def absent_model_terms(spark, sf_dir):
    return S.absent_terms(spec_table(spark, sf_dir))
