"""L1-penalised logistic path with cross-validation over the collapsed design."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.functions.numbers import logistic
from casewatch.operators.evaluate import fold_auc
from casewatch.operators.filters import require_two_classes
from casewatch.operators.folds import fold_of
from casewatch.operators.scoring import INTERCEPT
from casewatch.plans.design import Design, collapse
from casewatch.plans.path_solver import Exclusions, held_out_deviance, solve_paths
from casewatch.session import cut_lineage

SEED = 20251121


@dataclass(frozen=True)
class Moments:
    """Weighted sums of a pattern table: everything the penalty sequence and the scaling need."""

    n: float
    rate: float
    sd: tuple[float, ...]
    gradient: tuple[float, ...]

    @property
    def lambda_max(self) -> float:
        return max((abs(g) / s for g, s in zip(self.gradient, self.sd) if s > 0), default=0.0) / self.n


Cells = list[tuple[dict[str, int], np.ndarray]]


def cell_sums(patterns: DataFrame, p: int, columns: Sequence[str] = ()) -> Cells:
    """Cases, positives and three sums per term for each combination of the fold columns, in one aggregate."""
    sums = [F.sum("n").alias("n"), F.sum("pos").alias("pos")]
    for j in range(p):
        x = F.get("x", j)
        sums += [F.sum(F.col("n") * x).alias(f"s{j}"), F.sum(F.col("n") * x * x).alias(f"q{j}"),
                 F.sum(F.col("pos") * x).alias(f"g{j}")]
    width = len(columns)
    return [
        (dict(zip(columns, row[:width])), np.array([v or 0 for v in row[width:]], float))
        for row in patterns.groupBy(*columns).agg(*sums).collect()
    ]


def moments_of(cells: Cells, exclusions: Exclusions = ()) -> Moments:
    """Moments of the patterns outside the excluded folds."""
    total = sum(values for cell, values in cells if all(cell[column] != value for column, value in exclusions))
    if not np.any(total):
        raise ValueError("a training set has no cases")
    n, rate = float(total[0]), float(total[1] / total[0])
    s, q, g = total[2::3], total[3::3], total[4::3]
    variance = np.maximum(q / n - (s / n) ** 2, 0.0)
    return Moments(n, rate, tuple(np.sqrt(variance).tolist()), tuple((g - rate * s).tolist()))


def moments(patterns: DataFrame, p: int) -> Moments:
    """One aggregate; the result has a few numbers per term."""
    return moments_of(cell_sums(patterns, p))


def lambda_sequence(m: Moments, n_lambda: int = 100) -> list[float]:
    """Log-spaced penalties from the smallest one that removes every term."""
    smallest = 1e-4 if m.n > len(m.sd) else 1e-2
    if m.lambda_max <= 0:
        raise ValueError("no term varies together with the outcome")
    top = math.log(m.lambda_max)
    step = math.log(smallest) / max(n_lambda - 1, 1)
    return [math.exp(top + i * step) for i in range(n_lambda)]


@dataclass(frozen=True)
class Fit:
    penalty: float
    intercept: float
    beta: tuple[float, ...]


def _solve(
    patterns: DataFrame, sets: Sequence[Exclusions], measured: Sequence[Moments], penalties: Sequence[Sequence[float]]
) -> list[list[Fit]]:
    """A path per training set, all solved together."""
    if any(not 0 < m.rate < 1 for m in measured):
        raise ValueError("a training set needs both values of the outcome")
    solved = solve_paths(
        patterns, sets, np.array(penalties, float), np.array([m.sd for m in measured]).reshape(len(sets), -1),
        np.array([m.rate for m in measured]), np.array([m.n for m in measured]),
    )
    return [
        [Fit(float(penalty), float(row[0]), tuple(float(b) for b in row[1:])) for penalty, row in zip(pens, path)]
        for pens, path in zip(penalties, solved)
    ]


def fit_path(patterns: DataFrame, p: int, penalties: Sequence[float]) -> list[Fit]:
    """One fit per penalty on all patterns; penalties from large to small converge fastest."""
    return _solve(patterns, [()], [moments(patterns, p)], [list(penalties)])[0]


def coefficient_frame(patterns: DataFrame, fits: dict[int, list[Fit]], fold: str) -> DataFrame:
    rows = [(key, i, f.penalty, f.intercept, list(f.beta)) for key, fs in fits.items() for i, f in enumerate(fs)]
    return patterns.sparkSession.createDataFrame(
        rows, f"{fold} int, i int, lambda double, intercept double, beta array<double>"
    )


def linear_part():
    return F.col("intercept") + F.aggregate(
        F.zip_with("x", "beta", lambda x, b: x * b), F.lit(0.0), lambda total, v: total + v
    )


@dataclass(frozen=True)
class LassoPath:
    """Cross-validated path. `curve`: (lambda, cvm, cvsd). `path`: (feature, lambda, log_lambda, coef)."""

    terms: tuple[str, ...]
    fits: list[Fit]
    curve: DataFrame
    path: DataFrame
    lambda_min: float
    lambda_1se: float

    def at(self, rule: str = "1se") -> Fit:
        wanted = self.lambda_1se if rule == "1se" else self.lambda_min
        return next(f for f in self.fits if f.penalty == wanted)

    def coefficients(self, rule: str = "1se") -> DataFrame:
        """(term, coef) without the intercept."""
        return self.path.filter(F.col("lambda") == self.at(rule).penalty).select(
            F.col("feature").alias("term"), "coef"
        )

    def selected(self, rule: str = "1se") -> list[str]:
        chosen = [t for t, b in zip(self.terms, self.at(rule).beta) if b != 0]
        if not chosen:
            raise ValueError(f"no term has a non-zero coefficient at lambda.{rule}")
        return chosen


def cross_validated(
    patterns: DataFrame, terms: Sequence[str], bases: Sequence[Exclusions], fold: str, n_lambda: int = 100
) -> list[LassoPath]:
    """One cross-validated path per base (the patterns without its folds), over the values of `fold`.

    The paths of all bases and of all their folds are solved together; each base sets its own penalties. A
    second pass gives the held-out deviance of all penalties. What reaches the driver is set by folds,
    penalties and terms.
    """
    p = len(terms)
    columns = sorted({fold, *[column for base in bases for column, _ in base]})
    cells = cell_sums(patterns, p, columns)
    values = sorted({cell[fold] for cell, _ in cells})
    sets: list[Exclusions] = []
    measured: list[Moments] = []
    penalties: list[list[float]] = []
    for base in bases:
        whole = moments_of(cells, base)
        sequence = lambda_sequence(whole, n_lambda)
        for exclusions in [base, *[(*base, (fold, v)) for v in values]]:
            sets.append(exclusions)
            measured.append(moments_of(cells, exclusions))
            penalties.append(sequence)
    fits = _solve(patterns, sets, measured, penalties)
    size = len(values) + 1
    held = [i for i in range(len(sets)) if i % size]
    models = np.array([[(f.intercept, *f.beta) for f in fits[i]] for i in held])
    deviance, weights = held_out_deviance(patterns, [sets[i] for i in held], models)
    out = []
    for b in range(len(bases)):
        rows = slice(b * len(values), (b + 1) * len(values))
        out.append(_chosen(patterns, terms, fits[b * size], deviance[rows], weights[rows]))
    return out


def _chosen(
    patterns: DataFrame, terms: Sequence[str], fits: list[Fit], deviance: np.ndarray, weights: np.ndarray
) -> LassoPath:
    """Curve over the penalties and the two rules, from the deviance (folds, penalties) of folds with cases."""
    filled = weights > 0
    n = weights[filled][:, None]
    loss = deviance[filled] / n
    mean = (loss * n).sum(0) / n.sum()
    spread = ((loss - mean) ** 2 * n).sum(0) / n.sum()
    sd = np.sqrt(spread / max(len(n) - 1, 1))
    curve = [(f.penalty, float(m), float(s)) for f, m, s in zip(fits, mean, sd)]
    best = min(curve, key=lambda row: row[1])
    within = max(row[0] for row in curve if row[1] <= best[1] + best[2])
    spark = patterns.sparkSession
    path_rows = [(t, f.penalty, math.log(f.penalty), b) for f in fits for t, b in zip(terms, f.beta)]
    return LassoPath(
        tuple(terms), fits,
        spark.createDataFrame(curve, "lambda double, cvm double, cvsd double"),
        spark.createDataFrame(path_rows, "feature string, lambda double, log_lambda double, coef double"),
        best[0], within,
    )


def lasso_path(patterns: DataFrame, terms: Sequence[str], fold: str = "fold", n_lambda: int = 100) -> LassoPath:
    """Penalty path on all patterns, and deviance per penalty on each held-out fold."""
    return cross_validated(patterns, terms, [()], fold, n_lambda)[0]


def with_folds(design: Design, outer: int, inner: int, key: str = "case_id", seed: int = SEED) -> Design:
    frame = design.frame.withColumns({"fold": fold_of(key, outer, seed), "inner": fold_of(key, inner, seed + 1)})
    return Design(frame, design.terms)


def training_patterns(design: Design) -> DataFrame:
    """Collapsed design with both fold columns, written once because every pass of the fits reads it."""
    return cut_lineage(collapse(design, ["fold", "inner"]))


@dataclass(frozen=True)
class OutOfFold:
    predictions: DataFrame
    fold_auc: DataFrame


def oof_predict(
    design: Design, patterns: DataFrame, n_lambda: int = 100, key: str = "case_id", rule: str = "1se"
) -> OutOfFold:
    """Nested out-of-fold predictions: per outer fold an inner cross-validation picks the penalty by `rule`."""
    fold_ids = sorted(r[0] for r in patterns.select("fold").distinct().collect())
    paths = cross_validated(patterns, design.terms, [(("fold", k),) for k in fold_ids], "inner", n_lambda)
    chosen = {k: [path.at(rule)] for k, path in zip(fold_ids, paths)}
    models = F.broadcast(coefficient_frame(patterns, chosen, "fold"))  # one row per outer fold
    predictions = design.frame.join(models, "fold").select(
        F.col(key).alias("id"), "fold", "y", logistic(linear_part()).alias("p_hat")
    )
    return OutOfFold(predictions, fold_auc(predictions, "fold", "y", "p_hat"))


def check_outcome(design: Design) -> Design:
    require_two_classes(design.frame, "y")
    return design


def lasso_model(
    design: Design, n_lambda: int = 100, folds: int = 10, key: str = "case_id"
) -> tuple[LassoPath, DataFrame, Design]:
    """Path over a design; also returns the written patterns and the design with folds."""
    folded = with_folds(check_outcome(design), folds, folds, key)
    patterns = training_patterns(folded)
    return lasso_path(patterns, design.terms, "fold", n_lambda), patterns, folded


def lock_manifest(path: LassoPath, dictionary, indication_levels: Sequence[str], seed: int = SEED) -> dict:
    """What identifies a fitted path: settings, features, dictionary and level order."""
    return {
        "seed": seed, "family": "binomial", "alpha": 1, "nlambda": len(path.fits),
        "features": list(path.terms), "dictionary": {k: list(v) for k, v in dictionary.items()},
        "indication_levels": list(indication_levels),
        "lambda_min": path.lambda_min, "lambda_1se": path.lambda_1se,
        "coefficients_1se": {INTERCEPT: path.at("1se").intercept, **dict(zip(path.terms, path.at("1se").beta))},
    }


def lock_record(
    path: LassoPath, dictionary: Mapping[str, Sequence[str]], levels: Mapping[str, Sequence[str]], folds: int = 10, seed: int = SEED
) -> dict:
    """All that defines a fitted path, for `sources.locks`: settings, terms, dictionary, level order, penalties and
    the coefficients at both chosen penalties."""
    fitted = {rule: {"intercept": float(path.at(rule).intercept), "beta": [float(b) for b in path.at(rule).beta]} for rule in ("min", "1se")}
    return {
        "family": "binomial", "link": "logit", "alpha": 1, "seed": seed, "folds": folds, "terms": list(path.terms),
        "dictionary": {k: list(v) for k, v in dictionary.items()}, "levels": {k: list(v) for k, v in levels.items()},
        "penalties": [float(f.penalty) for f in path.fits], "lambda_min": float(path.lambda_min), "lambda_1se": float(path.lambda_1se),
        "coefficients": fitted,
    }
