"""Disproportionality measures over 2x2 counts held in columns a, b, c, d.

Two layouts exist and must not be mixed:

* `event_major`:    a exposed+event, b other+event,      c exposed+no event, d other+no event
* `exposure_major`: a exposed+event, b exposed+no event, c other+event,      d other+no event

and two zero corrections: `cell` adds 0.5 to the zero cells only, `table` adds 0.5 to all four
cells when any is zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def zero_correct(a: Column, b: Column, c: Column, d: Column, mode: str) -> tuple[Column, ...]:
    cells = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (a, b, c, d)]
    if mode == "cell":
        return tuple(F.when(x == 0, x + 0.5).otherwise(x) for x in cells)
    if mode == "table":
        any_zero = F.least(*cells) == 0
        return tuple(F.when(any_zero, x + 0.5).otherwise(x) for x in cells)
    raise ValueError(f"correction must be 'cell' or 'table', not {mode!r}")


def reporting_odds_ratio(a: Column, b: Column, c: Column, d: Column, layout: str) -> Column:
    """Equal in both layouts, but each keeps its own order of operations."""
    return (a / c) / (b / d) if layout == "event_major" else (a * d) / (b * c)


def odds_ratio_bounds(ror: Column, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    half = Z95 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.exp(F.ln(ror) - half), F.exp(F.ln(ror) + half)


def proportional_ratio(a: Column, b: Column, c: Column, d: Column, layout: str) -> Column:
    if layout == "event_major":
        return (a / (a + c)) / (b / (b + d))
    return (a / (a + b)) / (c / (c + d))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    cross = a * d - b * c
    return (a + b + c + d) * cross * cross / ((a + b) * (c + d) * (a + c) * (b + d))


def information_component(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    n = a + b + c + d
    ic = F.log2(a * n / ((a + b) * (a + c)))
    ln2_squared = F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))
    variance = (1 / a - 1 / (a + b) - 1 / (a + c) + 1 / n) / ln2_squared
    half = Z95 * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return ic, ic - half, ic + half


def with_metrics(counts: DataFrame, layout: str = "event_major", correction: str | None = None) -> DataFrame:
    """Add the measures of one layout to a table holding a, b, c, d.

    `event_major` adds N, ROR, LCL_ROR, UCL_ROR, PRR, chi2; `exposure_major` adds ROR, ROR_LCL,
    ROR_UCL, PRR, Chi2, IC, IC025, IC975. The counts themselves stay uncorrected.
    """
    if layout not in ("event_major", "exposure_major"):
        raise ValueError(f"layout must be 'event_major' or 'exposure_major', not {layout!r}")
    mode = correction or ("cell" if layout == "event_major" else "table")
    names = ("_a", "_b", "_c", "_d")
    cells = zero_correct(F.col("a"), F.col("b"), F.col("c"), F.col("d"), mode)
    fixed = counts.withColumns(dict(zip(names, cells)))
    a, b, c, d = (F.col(n) for n in names)
    fixed = fixed.withColumn("ROR", reporting_odds_ratio(a, b, c, d, layout))
    low, high = odds_ratio_bounds(F.col("ROR"), a, b, c, d)
    prr, chi2 = proportional_ratio(a, b, c, d, layout), chi_square(a, b, c, d)
    if layout == "event_major":
        added = {"N": a + b + c + d, "LCL_ROR": low, "UCL_ROR": high, "PRR": prr, "chi2": chi2}
        order = ["N", "ROR", "LCL_ROR", "UCL_ROR", "PRR", "chi2"]
    else:
        ic, ic_low, ic_high = information_component(a, b, c, d)
        added = {
            "ROR_LCL": low, "ROR_UCL": high, "PRR": prr, "Chi2": chi2,
            "IC": ic, "IC025": ic_low, "IC975": ic_high,
        }
        order = ["ROR", "ROR_LCL", "ROR_UCL", "PRR", "Chi2", "IC", "IC025", "IC975"]
    return fixed.withColumns(added).select(*counts.columns, *order)
