"""Dummy-coded design columns and their collapsed form."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.operators.filters import complete_cases


def term_name(text: str) -> str:
    """Syntactic term name: characters other than letters, digits, '.' and '_' become '.'."""
    return re.sub(r"[^A-Za-z0-9._]", ".", text)


@dataclass(frozen=True)
class Design:
    """Case rows with `x` (array of doubles in the order of `terms`), `y` and the kept columns."""

    frame: DataFrame
    terms: tuple[str, ...]


def design_terms(flags: Sequence[str], factors: Mapping[str, Sequence[str]]) -> list[tuple[str, str, str | None]]:
    """(term, column, level) without intercept: the first factor keeps all levels, later ones drop their first."""
    terms: list[tuple[str, str, str | None]] = [(flag, flag, None) for flag in flags]
    for i, (column, levels) in enumerate(factors.items()):
        used = levels if i == 0 else levels[1:]
        terms += [(term_name(f"{column}{level}"), column, level) for level in used]
    return terms


def design_matrix(
    cases: DataFrame,
    flags: Sequence[str],
    factors: Mapping[str, Sequence[str]],
    y: str = "outcome",
    keep: Sequence[str] = ("case_id",),
) -> Design:
    """Design over complete cases."""
    complete = complete_cases(cases, [*flags, *factors])
    terms = design_terms(flags, factors)
    columns = [
        F.col(column).cast("double") if level is None else (F.col(column) == level).cast("double")
        for _, column, level in terms
    ]
    frame = complete.select(*keep, F.col(y).cast("int").alias("y"), F.array(*columns).alias("x"))
    return Design(frame, tuple(name for name, _, _ in terms))


def design_table(design: Design, keep: Sequence[str] = ("case_id", "y")) -> DataFrame:
    """One column per term."""
    return design.frame.select(*keep, *[F.get("x", i).alias(t) for i, t in enumerate(design.terms)])


def collapse(design: Design, folds: Sequence[str] = ()) -> DataFrame:
    """(x, folds, n, pos): cases with the same predictors and folds as one weighted row.

    With 0/1 predictors the number of rows is bounded by the number of level combinations; numeric
    predictors work too, only with less collapsing. Every fit on it equals the fit on the cases.
    """
    return design.frame.groupBy("x", *folds).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos")
    )
