"""Cumulative sums, quantiles and evaluation measures against numpy and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.operators import evaluate as EV
from casewatch.operators.folds import balanced_folds, fold_of
from casewatch.operators.ranking import exact_quantiles, running_totals


@pytest.mark.parametrize("n_cuts", [1, 7, 255])
def test_running_totals(spark, n_cuts):
    rng = random.Random(1)
    # A third of the weight sits on one value.
    values = {g: {rng.randrange(400): rng.randrange(1, 9) for _ in range(150)} | {200: 400} for g in "ab"}
    df = spark.createDataFrame([(g, v, n) for g, d in values.items() for v, n in d.items()], "g string, v int, n long")
    for r in running_totals(df, "v", ["n"], ["g"], n_cuts).collect():
        assert r["n_upto"] == sum(n for v, n in values[r["g"]].items() if v <= r["v"])
        assert r["n_all"] == sum(values[r["g"]].values())


def test_quantiles(spark):
    rng = random.Random(2)
    xs = [rng.choice([1.5, rng.random()]) for _ in range(331)] + [None] * 5
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    (row,) = exact_quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", probs).collect()
    clean = [x for x in xs if x is not None]
    assert row["n"] == len(clean)
    assert row["q"] == pytest.approx(list(np.quantile(clean, probs)))


def test_quantile_of_four(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert exact_quantiles(df, "x", (0.25,)).first()["q"] == [1.75]


def auc(y, p):
    wins = [(a > b) + 0.5 * (a == b) for a, ya in zip(p, y) for b, yb in zip(p, y) if ya == 1 and yb == 0]
    return sum(wins) / len(wins)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    p = [round(rng.random(), rng.choice([1, 2, 6])) for _ in range(400)]
    y = [int(rng.random() < q) for q in p]
    return y, p, spark.createDataFrame(list(zip(y, p)), "y int, p double")


def test_auroc_and_brier(scored):
    y, p, df = scored
    row = EV.discrimination(df).first()
    assert row["AUROC"] == pytest.approx(auc(y, p))
    assert row["Brier"] == pytest.approx(np.mean((np.array(p) - y) ** 2))
    flipped = EV.discrimination(df.withColumn("p", 1 - F.col("p"))).first()
    assert row["AUROC"] + flipped["AUROC"] == pytest.approx(1.0)


def test_auprc_equals_fine_interpolation(scored):
    y, p, df = scored
    levels = sorted(set(p), reverse=True)
    total = sum(y)
    tp = fp = area = 0.0
    for level in levels:
        dt = sum(1 for a, b in zip(y, p) if b == level and a == 1)
        df_ = sum(1 for a, b in zip(y, p) if b == level and a == 0)
        steps = 2000
        for i in range(steps if dt else 0):
            t = tp + dt * (i + 0.5) / steps
            f = fp + df_ * (i + 0.5) / steps
            area += dt / steps * t / (t + f)
        tp, fp = tp + dt, fp + df_
    assert EV.discrimination(df).first()["AUPRC"] == pytest.approx(area / total, abs=1e-5)


def test_degenerate_scores(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.25)], "y int, p double")
    row = EV.discrimination(one).first()
    assert (row["AUROC"], row["AUPRC"]) == (None, None) and row["Brier"] == pytest.approx((0.25 + 0.5625) / 2)
    empty = spark.createDataFrame([(1, None), (0, float("nan"))], "y int, p double")
    assert tuple(EV.discrimination(empty).first()) == (None, None, None)
    assert EV.calibration_table(empty).count() == 0
    constant = EV.calibration_table(spark.createDataFrame([(1, 0.3), (0, 0.3)], "y int, p double")).collect()
    assert [(r["bin"], r["n"], r["obs_rate"], r["sd_pred"]) for r in constant] == [(1, 2, 0.5, 0.0)]


def test_calibration_bins(scored):
    y, p, df = scored
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    which = np.clip(np.searchsorted(edges, p, side="left"), 1, len(edges) - 1)
    got = {r["bin"]: r for r in EV.calibration_table(df).collect()}
    for b in np.unique(which):
        inside = np.array(p)[which == b]
        assert got[b]["n"] == len(inside)
        assert got[b]["mean_pred"] == pytest.approx(inside.mean())
        assert got[b]["sd_pred"] == pytest.approx(inside.std(ddof=1))


def test_hosmer_lemeshow_tail(spark):
    # P(chi-square with 8 degrees > 15.507) is 0.05.
    df = spark.createDataFrame([(15.50731306,)], "x double")
    assert df.select(EV.chi_square_upper_tail(F.col("x"), 8)).first()[0] == pytest.approx(0.05, abs=1e-6)
    with pytest.raises(ValueError):
        EV.chi_square_upper_tail(F.col("x"), 7)


def test_decision_curve(scored):
    y, p, df = scored
    for r in EV.decision_curve(df).collect():
        t = r["threshold"]
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        assert r["net_benefit"] == pytest.approx(tp / len(y) - fp / len(y) * t / (1 - t))


def test_folds(spark):
    ids = spark.range(1003).withColumnRenamed("id", "case_id")
    sizes = [r["count"] for r in balanced_folds(ids, "case_id", 10).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
    a = {r["case_id"]: r["f"] for r in ids.select("case_id", fold_of("case_id", 10).alias("f")).collect()}
    b = {r["case_id"]: r["f"] for r in ids.filter("case_id % 2 = 0").select("case_id", fold_of("case_id", 10).alias("f")).collect()}
    assert all(a[k] == v for k, v in b.items()) and set(a.values()) == set(range(1, 11))


def test_chi_square_tail_for_odd_degrees(spark):
    # Upper 5% and 1% points.
    for df, x, p in ((1, 3.841458820694124, 0.05), (7, 14.067140449340169, 0.05), (9, 21.665994333461924, 0.01)):
        value = spark.range(1).select(EV.chi_square_tail(F.lit(x), df)).first()[0]
        assert value == pytest.approx(p, abs=1e-10)
    tails = spark.createDataFrame([(0.0,), (400.0,), (1e6,)], "x double").select(EV.chi_square_tail(F.col("x"), 3)).collect()
    assert tails[0][0] == 1.0 and tails[1][0] < 1e-12 and tails[2][0] == 0.0


def test_odd_number_of_groups(scored):
    row = EV.hosmer_lemeshow(scored[2], groups=9).first()
    assert row["df"] == 7 and 0 <= row["p_value"] <= 1


def test_all_measures_from_one_table(scored):
    df = scored[2]
    every = EV.evaluate(df)
    assert every.discrimination.collect() == EV.discrimination(df).collect()
    assert sorted(every.calibration.collect()) == sorted(EV.calibration_table(df).collect())
    assert every.hosmer_lemeshow.collect() == EV.hosmer_lemeshow(df).collect()
    assert sorted(every.decision_curve.collect()) == sorted(EV.decision_curve(df).collect())


def test_ranges_meet_without_a_fold_over_cuts(spark):
    import random

    rng = random.Random(9)
    values = [(rng.choice("ab"), rng.randint(-50, 50), rng.randint(1, 5)) for _ in range(400)]
    sums = {}
    for g, v, n in values:
        sums[g, v] = sums.get((g, v), 0) + n
    df = spark.createDataFrame([(g, v, n) for (g, v), n in sums.items()], "g string, v int, n long")
    for ranges in (1, 3, 50, 1000):
        totals = running_totals(df, "v", ["n"], ["g"], ranges)
        plan = totals._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and "lambda" not in plan
        got = {(r["g"], r["v"]): (r["n_upto"], r["n_all"]) for r in totals.collect()}
        assert got == {(g, v): (sum(n for (h, w), n in sums.items() if h == g and w <= v), sum(n for (h, _), n in sums.items() if h == g)) for g, v in sums}


def test_equal_count_bins_keep_ties_together(spark):
    from casewatch.operators.evaluate import equal_count_bins

    def bins(scores, g):
        df = spark.createDataFrame([(float(p), i % 2) for i, p in enumerate(scores)], "p double, y int")
        return [(r["bin"], r["low"], r["high"], r["n"]) for r in equal_count_bins(df, bins=g).orderBy("bin").collect()]

    # By hand: a bin ends at the first score whose running count reaches its share of all rows.
    assert bins([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 5) == [(1, 1, 2, 2), (2, 3, 4, 2), (3, 5, 6, 2), (4, 7, 8, 2), (5, 9, 10, 2)]
    assert bins([1, 2, 3, 4, 5, 6, 7], 3) == [(1, 1, 3, 3), (2, 4, 5, 2), (3, 6, 7, 2)]
    assert bins([0.1] * 6 + [0.2] + [0.3] * 2 + [0.9], 5) == [(1, 0.1, 0.1, 6), (2, 0.2, 0.3, 3), (3, 0.9, 0.9, 1)]
    assert bins([0.5] * 8, 10) == [(1, 0.5, 0.5, 8)]
    assert bins([0.1, 0.2], 10) == [(1, 0.1, 0.1, 1), (2, 0.2, 0.2, 1)] and bins([], 4) == []
