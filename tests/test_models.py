"""Model fits against a plain Newton fit, optimality conditions and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.operators import scoring as S
from casewatch.plans import design as DM
from casewatch.plans import lasso as L
from casewatch.plans import refit as RF
from casewatch.sources import ModelSpec

LEVELS = ("F", "M")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    out = []
    for i in range(1500):
        a, b, sex = int(rng.random() < 0.4), int(rng.random() < 0.2), rng.choice(LEVELS)
        p = 1 / (1 + math.exp(1.0 - 1.2 * a + 0.3 * b - 0.4 * (sex == "M")))
        out.append((i, a, b, sex, int(rng.random() < p)))
    return out


@pytest.fixture(scope="module")
def design(spark, data):
    cases = spark.createDataFrame(data, "case_id long, a int, b int, sex string, outcome int")
    return DM.design_matrix(cases, ("a", "b"), {"sex": LEVELS})


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x
        beta += np.linalg.solve(h, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    meat = (x * ((y - p) ** 2)[:, None]).T @ x
    return beta, np.sqrt(np.diag(inverse)), np.sqrt(np.diag(inverse @ meat @ inverse))


def arrays(data):
    x = np.array([[1, a, b, sex == "F"] for _, a, b, sex, _ in data], float)
    return x, np.array([r[4] for r in data], float)


def test_first_factor_keeps_all_levels():
    names = [t for t, _, _ in DM.design_terms(("f",), {"sex": LEVELS, "age_cat": ("<18", "18-39", "65+")})]
    assert names == ["f", "sexF", "sexM", "age_cat18.39", "age_cat65."]


def test_incomplete_rows_are_dropped(spark):
    cases = spark.createDataFrame([(1, 1, "F", 1), (2, None, "M", 0), (3, 0, None, 1)], "case_id long, a int, sex string, outcome int")
    assert DM.design_matrix(cases, ("a",), {"sex": LEVELS}).frame.count() == 1


def test_collapse_keeps_totals(design, data):
    totals = DM.collapse(design).agg(F.sum("n"), F.sum("pos"), F.count("*")).first()
    assert tuple(totals) == (len(data), sum(r[4] for r in data), 8)


def test_refit_and_robust_errors(design, data):
    patterns = DM.collapse(design)
    # sexF and sexM sum to the intercept, so the second one is left out.
    fitted = RF.refit_logistic(patterns, design.terms, list(design.terms))
    rows = {r["term"]: r for r in fitted.collect()}
    beta, se, robust = newton(*arrays(data))
    order = ["(Intercept)", "a", "b", "sexF"]
    assert list(rows) == order
    assert [rows[t]["beta"] for t in order] == pytest.approx(list(beta), abs=1e-6)
    assert [rows[t]["se"] for t in order] == pytest.approx(list(se), abs=1e-6)
    hc = {r["term"]: r["se"] for r in RF.robust_errors(patterns, design.terms, fitted, keep_intercept=True).collect()}
    assert [hc[t] for t in order] == pytest.approx(list(robust), abs=1e-6)


def patterns_of(spark, rows):
    return spark.createDataFrame([([float(v) for v in x], n, pos) for x, n, pos in rows], "x array<double>, n long, pos long")


def test_separated_data_raise(spark):
    complete = patterns_of(spark, [((0, 0), 40, 10), ((0, 1), 30, 9), ((1, 0), 20, 20), ((1, 1), 10, 10)])
    with pytest.raises(RF.Separated) as error:
        RF.refit_logistic(complete, ("a", "b"), ("a", "b"))
    assert "a" in error.value.terms and "b" not in error.value.terms
    # No single term predicts the outcome, only their sum does.
    jointly = patterns_of(spark, [((0, 0), 40, 0), ((0, 1), 30, 12), ((1, 0), 20, 9), ((1, 1), 10, 10)])
    with pytest.raises(RF.Separated) as error:
        RF.refit_logistic(jointly, ("a", "b"), ("a", "b"))
    assert {"a", "b"} <= set(error.value.terms)
    with pytest.raises(RF.Separated):
        RF.refit_logistic(patterns_of(spark, [((0,), 5, 0), ((1,), 4, 0)]), ("a",), ("a",))
    with pytest.raises(ValueError):
        RF.refit_logistic(patterns_of(spark, []), ("a",), ("a",))


def test_unsettled_fit_raises(spark, design):
    with pytest.raises(RuntimeError):
        RF.newton(DM.collapse(design), design.terms, ["a", "b"], steps=2)


def test_steps_are_halved_where_a_whole_one_overshoots(spark):
    # Newton's first step from zero overshoots on a rare outcome with a strong numeric term.
    rows = [((x,), 10_000, pos) for x, pos in ((0.0, 1), (1.0, 2), (20.0, 3), (40.0, 9_990))]
    used, beta, sums = RF.newton(patterns_of(spark, rows), ("a",), ("a",))
    x = np.array([[1.0, r[0][0]] for r in rows])
    n, pos = (np.array([r[k] for r in rows], float) for k in (1, 2))
    p = 1 / (1 + np.exp(-x @ beta))
    assert used == ["a"] and np.abs(x.T @ (pos - n * p)).max() < 1e-3
    assert sums.loglik == pytest.approx(float((pos * np.log(p) + (n - pos) * np.log1p(-p)).sum()), rel=1e-9)


def test_rare_outcomes_are_no_separation(spark):
    fitted = RF.refit_logistic(patterns_of(spark, [((0,), 10_000_000, 20), ((1,), 5_000_000, 40)]), ("a",), ("a",)).collect()
    assert fitted[1]["beta"] == pytest.approx(math.log(40 * (10_000_000 - 20) / (20 * (5_000_000 - 40))), abs=1e-6)


def test_sums_do_not_depend_on_partitions(spark, design):
    patterns = DM.collapse(design)
    one, many = (RF.cross_products(patterns.repartition(k), [0, 1], [0.3, -0.2, 0.1]) for k in (1, 7))
    assert one.loglik == pytest.approx(many.loglik) and np.allclose(one.information, many.information) and np.allclose(one.squared, many.squared)


def test_one_binary_feature_is_the_log_odds_ratio(spark):
    cells = {(1, 1): 10, (1, 0): 20, (0, 1): 30, (0, 0): 40}
    rows = [(i, e, y) for i, ((e, y), n) in enumerate(cells.items()) for _ in range(n)]
    design = DM.design_matrix(spark.createDataFrame(rows, "case_id long, e int, outcome int"), ("e",), {})
    rows = {r["term"]: r for r in RF.refit_logistic(DM.collapse(design), design.terms, ["e"]).collect()}
    assert rows["e"]["beta"] == pytest.approx(math.log(10 * 40 / (20 * 30)), abs=1e-7)


@pytest.fixture(scope="module")
def path(design):
    return L.lasso_model(design, folds=3)


def test_path_meets_the_optimality_conditions(path, data):
    fitted, _, _ = path
    x = np.array([[a, b, sex == "F", sex == "M"] for _, a, b, sex, _ in data], float)
    y = np.array([r[4] for r in data], float)
    sd = x.std(axis=0)
    assert all(b == 0 for b in fitted.fits[0].beta)
    for fit in fitted.fits:
        beta = np.array(fit.beta)
        p = 1 / (1 + np.exp(-(fit.intercept + x @ beta)))
        score = (x / sd).T @ (y - p) / len(y)
        assert np.all(np.abs(score) <= fit.penalty + 1e-7)
        assert abs(np.mean(y - p)) < 1e-7
        active = beta != 0
        assert np.allclose(score[active], fit.penalty * np.sign(beta[active]), atol=1e-7)


def test_path_agrees_with_another_solver(spark, path, data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    fitted, _, _ = path
    x = np.array([[a, b, sex == "F", sex == "M"] for _, a, b, sex, _ in data], float)
    sd = x.std(axis=0)
    points = spark.createDataFrame([(float(r[4]), Vectors.dense(v / sd)) for r, v in zip(data, x)], ["label", "features"])
    for fit in fitted.fits[10::40]:
        other = LogisticRegression(regParam=fit.penalty, elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-12).fit(points)
        ours = fit.intercept + x @ np.array(fit.beta)
        theirs = other.intercept + (x / sd) @ other.coefficients.toArray()
        assert np.abs(ours - theirs).max() < 1e-3


def test_held_out_deviance_is_that_of_the_folds(design, data):
    folded = L.with_folds(design, 3, 2)
    patterns = L.training_patterns(folded)
    rows = folded.frame.collect()
    (whole, nested), penalties = L.cross_validated(patterns, design.terms, [(), (("fold", 2),)], "inner", 6), range(6)
    for path, kept in ((whole, rows), (nested, [r for r in rows if r["fold"] != 2])):
        curve = [r["cvm"] for r in path.curve.orderBy(F.desc("lambda")).collect()]
        total = np.zeros(6)
        for held in (1, 2):
            train = [r for r in kept if r["inner"] != held]
            alone = design.frame.sparkSession.createDataFrame([(list(r["x"]), 1, r["y"]) for r in train], "x array<double>, n long, pos long")
            fits = L.fit_path(alone, len(design.terms), [f.penalty for f in path.fits])
            for i in penalties:
                for r in kept:
                    if r["inner"] == held:
                        eta = fits[i].intercept + float(np.dot(r["x"], fits[i].beta))
                        total[i] += 2 * (np.logaddexp(0, eta) - r["y"] * eta)
        assert curve == pytest.approx(list(total / len(kept)), abs=1e-7)


def test_numeric_and_constant_terms(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 3), 1, int(rng.random() < 0.3)) for i in range(400)]
    cases = spark.createDataFrame(rows, "case_id long, v double, one int, outcome int")
    path, _, _ = L.lasso_model(DM.design_matrix(cases, ("v", "one"), {}), n_lambda=12, folds=2)
    assert all(f.beta[1] == 0 for f in path.fits) and path.fits[-1].beta[0] != 0


def test_terms_unrelated_to_the_outcome_are_an_error(spark):
    cases = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "case_id long, a int, outcome int")
    with pytest.raises(ValueError, match="no term varies"):
        L.lasso_path(L.training_patterns(L.with_folds(DM.design_matrix(cases, ("a",), {}), 2, 2)), ("a",))


def test_curve_and_rules(path):
    fitted, _, _ = path
    curve = {r["lambda"]: r for r in fitted.curve.collect()}
    assert fitted.lambda_1se >= fitted.lambda_min
    best = curve[fitted.lambda_min]
    assert best["cvm"] == min(r["cvm"] for r in curve.values())
    assert curve[fitted.lambda_1se]["cvm"] <= best["cvm"] + best["cvsd"]
    assert "a" in fitted.selected("min")
    assert fitted.path.count() == 100 * len(fitted.terms)


def test_nothing_selected_is_an_error(path):
    fitted, _, _ = path
    empty = L.LassoPath(fitted.terms, fitted.fits, fitted.curve, fitted.path, fitted.lambda_min, fitted.fits[0].penalty)
    with pytest.raises(ValueError, match="non-zero"):
        empty.selected("1se")


def test_out_of_fold(design, data):
    folded = L.with_folds(design, 2, 2)
    out = L.oof_predict(folded, L.training_patterns(folded), n_lambda=3)
    assert out.predictions.count() == len(data)
    aucs = out.fold_auc.collect()
    assert len(aucs) == 2 and all(0.5 < r["AUROC"] < 1 for r in aucs)
    assert aucs[0]["mean_AUC"] == pytest.approx(sum(r["AUROC"] for r in aucs) / 2)


def test_one_class_outcome_is_an_error(spark):
    cases = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "case_id long, a int, outcome int")
    with pytest.raises(ValueError, match="two values"):
        L.lasso_model(DM.design_matrix(cases, ("a",), {}), n_lambda=2, folds=2)


def test_importance(design, data):
    patterns, beta = DM.collapse(design), {"a": 2.0, "sexM": -1.0}
    contribution = {r["feature"]: r["importance"] for r in RF.contribution_importance(patterns, design.terms, beta).collect()}
    assert contribution["a"] == pytest.approx(2 * np.mean([r[1] for r in data]))
    spread = {r["feature"]: r["importance"] for r in RF.spread_importance(patterns, design.terms, beta).collect()}
    assert spread["a"] == pytest.approx(2 * np.std([r[1] for r in data], ddof=1))


REFIT = [("(Intercept)", 0.1), ("sexMale", 1.5), ("age_cat40.64", 0.8), ("id_case", 9.9)]


def test_lock_score_and_portrait_agree(spark):
    refit = spark.createDataFrame(REFIT, "term string, OR double")
    spec = S.lock_spec(refit, "m", {"source": "test"})
    from casewatch.sources import spec_from_frame

    locked = spec_from_frame(spec)
    assert set(locked.coefficients) == {"sexMale", "age_cat40.64"}
    assert locked.intercept == pytest.approx(math.log(0.1))
    case = spark.createDataFrame([(1, 0, 1, None)], "case_id long, outcome int, sexMale int, `age_cat40.64` int")
    scored = S.score(case, locked).first()
    portrait = S.portraits(spec).filter("sex = 'Male' AND age = '<18' AND indication = 'Other' AND molecule = 'None'").first()
    assert scored["prob"] == pytest.approx(portrait["risk_abs"])
    assert portrait["terms_used"] == "sexMale"


def test_portrait_grid(spark):
    spec = ModelSpec(-2.0, {"sexUnknown": 0.5, "flag_mol_sirolimus": 1.0}).frame(spark)
    table = S.portraits(spec)
    assert table.count() == 6 * 3 * 4 * 3
    assert S.portraits(spec, include_sex_unknown=False).count() == 6 * 2 * 4 * 3
    absent = table.filter("molecule = 'Tacrolimus' AND sex = 'Female' AND age = '65+' AND indication = 'Other'").first()
    assert absent["terms_used"] == "flag_mol_tacrolimus" and absent["OR_combo"] == 1.0


def test_lock_errors(spark):
    def lock(rows):
        return S.lock_spec(spark.createDataFrame(rows, "term string, OR double")).collect()

    with pytest.raises(Exception, match="Intercept"):
        lock([("sexMale", 1.5)])
    with pytest.raises(Exception, match="covariates"):
        lock([("(Intercept)", 0.1)])


def test_recalibration(spark):
    spec = S.recalibrate(ModelSpec(-2.0, {"sexMale": 0.5}).frame(spark), 0.05)
    base = S.portraits(spec).filter("sex = 'Female' AND age = '<18' AND indication = 'Other' AND molecule = 'None'").first()
    assert base["risk_abs"] == pytest.approx(0.05)


def test_score_ignores_absent_features(spark):
    case = spark.createDataFrame([(1, 1)], "case_id long, outcome int")
    assert S.score(case, ModelSpec(0.0, {"nope": 3.0})).first()["prob"] == 0.5


def test_trained_sex_term_reaches_the_male_portrait(spark):
    from casewatch.operators import scoring as S
    from casewatch.plans import case_features as CF
    from casewatch.plans import design as DM

    rows = [(i, "A", "PS", 1 if i % 3 == 0 else 9, "M" if i % 2 else "F", "40", "YR", "GRAFT") for i in range(60)]
    reports = spark.createDataFrame(rows, "case_id long, drug string, role string, pt_code long, sex string, age string, age_unit string, indication string")
    cases = CF.case_features(reports, {"a": ("A",)}, [1], sex_levels=CF.MODEL_SEXES)
    terms = DM.design_matrix(cases, ("flag_a",), {"age_cat": ("40-64",), "sex": CF.MODEL_SEXES}).terms
    assert "sexMale" in terms
    refit = lambda term: spark.createDataFrame([("(Intercept)", 0.1), (term, 3.0)], "term string, OR double")
    drawn = {r["sex"]: r["OR_combo"] for r in S.portraits(S.lock_spec(refit("sexMale"))).where("molecule = 'None'").collect()}
    assert abs(drawn["Male"] - 3.0) < 1e-12 and drawn["Female"] == 1.0
    with pytest.raises(Exception, match="no portrait level for sexM"):
        S.portraits(S.lock_spec(refit("sexM"))).collect()


def test_representative_does_not_favour_a_level(spark):
    from casewatch.operators.cases import subgroup_universe

    rows = [(i, "A", 1, "F", "US", v, "40", "YR") for i in range(200) for v in (f"HYPERTENSION {i}", f"GRAFT {i}")]
    reports = spark.createDataFrame(rows, "case_id long, drug string, pt_code long, sex string, region string, indication string, age string, age_unit string")
    groups = {r[0]: r[1] for r in subgroup_universe(reports, {"a": ("A",)}, [1], by_value=True).groupBy("indication_grp").count().collect()}
    assert min(groups["Other"], groups["Transplantation"]) > 60
    assert subgroup_universe(reports).count() == 200
