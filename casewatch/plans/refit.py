"""Unpenalised refit, robust errors and importance of the selected terms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.functions.numbers import format_or_ci, format_p
from casewatch.operators.scoring import INTERCEPT

Z95 = 1.96
TABLE = "term string, beta double, se double, z double, p_value double, OR double, CI_low double, CI_high double"


SETTLED = 1e-10  # relative change of the log-likelihood, and size of the scaled gradient, at which a fit has converged
FLAT = 1e-8  # share of the information at zero coefficients below which a direction counts as separated
STEPS = 50


@dataclass(frozen=True)
class Sums:
    """Log-likelihood, gradient, information and squared residuals (w x x') at given coefficients."""

    loglik: float
    gradient: np.ndarray
    information: np.ndarray
    squared: np.ndarray


def cross_products(patterns: DataFrame, places: Sequence[int], beta: Sequence[float]) -> Sums:
    """One pass over (x, n, pos): sums for the intercept and the terms at `places` of x.

    Every task sums its Arrow batches with numpy and gives one number per entry; Spark adds them up by entry, so
    terms x terms numbers reach the driver whatever the size of the data.
    """
    at, b = np.array(places, dtype=np.int64), np.array(beta, dtype=np.float64)
    p = len(b)

    def run(batches):
        total = np.zeros(1 + p + 2 * p * p)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([np.ones(batch.num_rows), rows[:, at]])
            n, pos = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
            eta = x @ b
            fitted = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            loss = np.logaddexp(0.0, eta) * n - pos * eta
            residual = pos - n * fitted
            squared = pos * (1 - fitted) ** 2 + (n - pos) * fitted**2
            weighted = (x * (n * fitted * (1 - fitted))[:, None]).T @ x
            total += np.concatenate([[-loss.sum()], x.T @ residual, weighted.ravel(), ((x * squared[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["entry", "value"])

    narrow = patterns.select("x", F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos"))
    entries = narrow.mapInArrow(run, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + p + 2 * p * p)
    for entry, value in entries.collect():
        total[entry] = value
    square = lambda k: total[1 + p + k * p * p : 1 + p + (k + 1) * p * p].reshape(p, p)
    return Sums(float(total[0]), total[1 : 1 + p], square(0), square(1))


def independent(cross: np.ndarray) -> list[int]:
    """Columns that are no linear combination of the ones before, from their cross-products."""
    kept: list[int] = []
    for j in range(len(cross)):
        left_over = cross[j, j]
        if kept:
            side = cross[np.ix_(kept, [j])]
            left_over -= (side.T @ np.linalg.solve(cross[np.ix_(kept, kept)], side)).item()
        if left_over > 1e-9 * max(cross[j, j], 1.0):
            kept.append(j)
    return kept


def independent_terms(patterns: DataFrame, terms: Sequence[str], selected: Sequence[str]) -> list[str]:
    """Selected terms without those that are linear combinations of the intercept and earlier terms."""
    at_zero = cross_products(patterns, [terms.index(t) for t in selected], [0.0] * (len(selected) + 1))
    return [selected[j - 1] for j in independent(4 * at_zero.information)[1:]]


class Separated(ValueError):
    """No finite maximum-likelihood estimate exists: some terms predict the outcome of all their cases."""

    def __init__(self, terms: Sequence[str]):
        super().__init__(f"no finite estimate: the outcome is separated by {', '.join(terms)}")
        self.terms = tuple(terms)


def _check_separation(names: Sequence[str], start: np.ndarray, now: np.ndarray) -> None:
    """Raise if the information has vanished along some direction, compared with that at zero coefficients."""
    root = np.linalg.inv(np.linalg.cholesky(start))
    values, vectors = np.linalg.eigh(root @ now @ root.T)
    if values[0] < FLAT:
        direction = np.abs(root.T @ vectors[:, 0]) * np.sqrt(np.diag(start))
        raise Separated([t for t, d in zip(names, direction) if d > 0.1 * direction.max()])


def newton(patterns: DataFrame, terms: Sequence[str], selected: Sequence[str], steps: int = STEPS) -> tuple[list[str], np.ndarray, Sums]:
    """(independent terms, coefficients with the intercept first, sums there) of the maximum-likelihood fit.

    A step that does not raise the likelihood is halved. Ends when the likelihood and the gradient have settled;
    raises `Separated` where the likelihood only approaches its maximum at infinity, RuntimeError without convergence.
    `patterns` is read once a step: pass a written table.
    """
    places = [terms.index(t) for t in selected]
    sums = cross_products(patterns, places, [0.0] * (len(places) + 1))
    if not sums.information.any():
        raise ValueError("no cases to fit")
    kept = independent(4 * sums.information)
    used = [selected[j - 1] for j in kept[1:]]
    places = [terms.index(t) for t in used]
    grid = np.ix_(kept, kept)
    sums = Sums(sums.loglik, sums.gradient[kept], sums.information[grid], sums.squared[grid])
    names, start, beta = [INTERCEPT, *used], sums.information, np.zeros(len(kept))
    for _ in range(steps):
        step = np.linalg.solve(sums.information, sums.gradient)
        for _ in range(30):
            new = cross_products(patterns, places, beta + step)
            if new.loglik >= sums.loglik - 1e-12 * abs(sums.loglik):
                break
            step = step / 2
        else:
            raise RuntimeError("the fit has not converged: no step raises the likelihood")
        change, beta, sums = new.loglik - sums.loglik, beta + step, new
        _check_separation(names, start, sums.information)
        scaled = np.abs(sums.gradient) / np.sqrt(np.diag(start))
        if change <= SETTLED * (abs(sums.loglik) + 0.1) and scaled.max() <= SETTLED * math.sqrt(start[0, 0]) + 1e-9:
            return used, beta, sums
    raise RuntimeError(f"the fit has not converged in {steps} steps")


def _row(term: str, beta: float, se: float) -> tuple:
    z = beta / se
    return (term, beta, se, z, math.erfc(abs(z) / math.sqrt(2.0)), math.exp(beta),
            math.exp(beta - Z95 * se), math.exp(beta + Z95 * se))


def refit_logistic(
    patterns: DataFrame, terms: Sequence[str], selected: Sequence[str], keep_intercept: bool = True
) -> DataFrame:
    """Maximum-likelihood fit of the selected terms: odds ratio, Wald interval, p-value per term.

    The collapsed form gives the coefficients and errors of the case-level fit. Redundant terms are left out;
    separated data and fits that do not converge raise.
    """
    used, beta, sums = newton(patterns, terms, selected)
    errors = np.sqrt(np.diag(np.linalg.inv(sums.information)))
    rows = [_row(t, float(b), float(s)) for t, b, s in zip([INTERCEPT, *used], beta, errors)]
    return patterns.sparkSession.createDataFrame(rows if keep_intercept else rows[1:], TABLE)


def robust_errors(
    patterns: DataFrame, terms: Sequence[str], refit: DataFrame, keep_intercept: bool = False
) -> DataFrame:
    """The refit with sandwich (HC0) errors at its coefficients, from one pass."""
    rows = {r["term"]: r["beta"] for r in refit.select("term", "beta").collect()}
    used = [t for t in terms if t in rows]
    betas = [rows[INTERCEPT], *(rows[t] for t in used)]
    sums = cross_products(patterns, [terms.index(t) for t in used], betas)
    inverse = np.linalg.inv(sums.information)
    covariance = inverse @ sums.squared @ inverse
    out = [
        _row(t, b, math.sqrt(covariance[i, i]))
        for i, (t, b) in enumerate(zip([INTERCEPT, *used], betas))
        if keep_intercept or t != INTERCEPT
    ]
    return patterns.sparkSession.createDataFrame(out, TABLE)


def odds_table(refit: DataFrame) -> DataFrame:
    """Variable, adjusted odds ratio with interval, p-value as text."""
    return refit.select(
        F.col("term").alias("variable"),
        format_or_ci("OR", "CI_low", "CI_high").alias("adjusted_or"),
        format_p("p_value").alias("p_text"),
    )


def contribution_importance(patterns: DataFrame, terms: Sequence[str], beta: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution |x beta| per term, with the coefficient and its odds ratio."""
    n = F.col("n")
    entries = [
        F.struct(F.lit(t).alias("feature"), F.lit(float(beta[t])).alias("beta"), F.get("_sums", i).alias("_s"))
        for i, t in enumerate(terms) if t in beta
    ]
    sums = patterns.agg(
        F.array(*[F.sum(n * F.abs(F.get("x", i))) for i in range(len(terms))]).alias("_sums"),
        F.sum("n").alias("_n"),
    )
    return sums.select("_n", F.inline(F.array(*entries))).select(
        "feature", (F.abs("beta") * F.col("_s") / F.col("_n")).alias("importance"), "beta",
        F.exp("beta").alias("OR"),
    )


def spread_importance(patterns: DataFrame, terms: Sequence[str], beta: Mapping[str, float]) -> DataFrame:
    """|beta| times the sample standard deviation of the term; null for a constant term."""
    n = F.col("n")
    sums = patterns.agg(
        F.array(*[F.sum(n * F.get("x", i)) for i in range(len(terms))]).alias("_s"),
        F.array(*[F.sum(n * F.get("x", i) * F.get("x", i)) for i in range(len(terms))]).alias("_q"),
        F.sum("n").alias("_n"),
    )
    entries = [
        F.struct(F.lit(t).alias("feature"), F.lit(float(beta[t])).alias("beta"),
                 F.get("_s", i).alias("s"), F.get("_q", i).alias("q"))
        for i, t in enumerate(terms) if t in beta
    ]
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("_n")) / (F.col("_n") - 1)
    sd = F.nullif(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0))
    return sums.select("_n", F.inline(F.array(*entries))).select(
        "feature", "beta", sd.alias("sd"), (F.abs("beta") * sd).alias("importance")
    )
