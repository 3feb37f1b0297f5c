"""Small numeric helpers and text formats of result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from casewatch import defaults as D
from casewatch.functions.text import as_col, safe_double


def pct(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * as_col(num), as_col(den)), digits)


def ratio(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def log_odds(odds_ratio: Column | str) -> Column:
    return F.ln(as_col(odds_ratio))


def odds(beta: Column | str) -> Column:
    return F.exp(as_col(beta))


def logistic(eta: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(eta)))


def clip_probability(p: Column | str, eps: float = 1e-6) -> Column:
    value = as_col(p)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0 - eps)), F.lit(eps)))


def risk_category(
    p: Column | str, cuts: Sequence[float] = D.RISK_CUTS, labels: Sequence[str] = D.RISK_LABELS
) -> Column:
    """Left-closed categories; the last one includes 1. Null outside [0, 1]."""
    value = as_col(p)
    out = F.when((value < 0) | (value > 1), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(value < cut, label)
    return out.when(value.isNotNull(), labels[-1])


def format_or_ci(estimate: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.format_string("%.2f [%.2f–%.2f]", as_col(estimate), as_col(low), as_col(high))


def _strip_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def format_p(p: Column | str) -> Column:
    """A probability at three significant digits, trailing zeros dropped, scientific below 1e-4."""
    value = as_col(p)
    scientific = F.format_string("%.2e", value)
    mantissa = F.regexp_replace(F.substring_index(scientific, "e", 1), r"\.?0+$", "")
    out = F.when(value.isNull(), F.lit(None).cast("string")).when(value == 0, "0")
    for decimals, floor in ((2, 1.0), (3, 0.1), (4, 0.01), (5, 0.001), (6, 9.995e-5)):
        out = out.when(value >= floor, _strip_zeros(F.format_string(f"%.{decimals}f", value)))
    return out.otherwise(F.concat_ws("e", mantissa, F.substring_index(scientific, "e", -1)))


def order_key(label: Column | str, levels: Iterable[str]) -> Column:
    """Position of the label in a fixed display order; labels outside it come last."""
    levels = list(levels)
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(label))
    return F.when(position > 0, position.cast("int")).otherwise(len(levels) + 1)


def zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Listed columns as doubles, null as 0; a missing column becomes 0."""
    present = set(df.columns)

    def filled(name: str) -> Column:
        if name not in present:
            return F.lit(0.0)
        column = F.col(f"`{name}`")
        number = safe_double(column) if isinstance(df.schema[name].dataType, StringType) else column.cast("double")
        return F.coalesce(number, F.lit(0.0))

    return df.withColumns({name: filled(name) for name in columns})
