"""Evaluation of predicted probabilities against a 0/1 outcome.

All measures start from the distinct scores with their counts, so equal scores are handled as ties and
a score shared by most rows is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.operators.filters import finite_pairs
from casewatch.operators.ranking import quantiles_of_counts, running_totals
from casewatch.session import cut_lineage


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, p, n, pos): rows and positives per distinct score; missing and infinite pairs dropped.

    The table is written once, because every measure reads it several times and it is far smaller than
    the plan that makes it.
    """
    pairs = finite_pairs(df, y, p).select(*by, F.col(y).cast("bigint").alias("y"), F.col(p).cast("double").alias("p"))
    return cut_lineage(pairs.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))


def discrimination(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties count half), AUPRC (interpolated integral) and Brier score, one row per group.

    AUROC and AUPRC are null with one outcome class; all are null without any valid pair.
    """
    return discrimination_of(score_counts(df, y, p, by), by)


def discrimination_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`discrimination` from a written `score_counts` table."""
    ranked = running_totals(counts, "p", ["n", "pos"], by)
    neg = (F.col("n") - F.col("pos")).cast("double")
    pos = F.col("pos").cast("double")
    neg_below = (F.col("n_upto") - F.col("pos_upto")).cast("double") - neg
    all_pos = F.col("pos_all").cast("double")
    all_neg = (F.col("n_all") - F.col("pos_all")).cast("double")
    # Going down the scores: true and false positives before this score, then including it.
    tp0 = all_pos - F.col("pos_upto")
    fp0 = all_neg - (F.col("n_upto") - F.col("pos_upto"))
    slope = neg / pos
    start = fp0 - slope * tp0
    log_part = F.when(start == 0, F.lit(0.0)).otherwise(
        start / ((1 + slope) * (1 + slope)) * (F.ln(tp0 + fp0 + pos + neg) - F.ln(tp0 + fp0))
    )
    area = F.when(pos > 0, pos / (1 + slope) - log_part).otherwise(F.lit(0.0))
    error = pos * (1 - F.col("p")) * (1 - F.col("p")) + neg * F.col("p") * F.col("p")
    sums = ranked.groupBy(*by).agg(
        F.sum(pos * (neg_below + neg / 2)).alias("_wins"),
        F.sum(area).alias("_area"),
        F.sum(error).alias("_error"),
        F.max(all_pos).alias("_pos"),
        F.max(all_neg).alias("_neg"),
    )
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("_wins") / (F.col("_pos") * F.col("_neg"))).alias("AUROC"),
        F.when(both, F.col("_area") / F.col("_pos")).alias("AUPRC"),
        F.try_divide(F.col("_error"), F.col("_pos") + F.col("_neg")).alias("Brier"),
    )


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    gap = F.col(p) - F.col(y)
    return finite_pairs(df, y, p).agg(F.avg(gap * gap).alias("Brier"))


def metric_summary(df: DataFrame, dataset: str, y: str = "y", p: str = "p") -> DataFrame:
    """Long form (dataset, metric, value)."""
    wide = discrimination(df, y, p).withColumn("dataset", F.lit(dataset))
    return wide.unpivot("dataset", ["AUROC", "AUPRC", "Brier"], "metric", "value")


def fold_auc(df: DataFrame, fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """AUROC per fold and their mean over folds with both classes."""
    per_fold = discrimination(df, y, p, [fold]).select(fold, "AUROC")
    return per_fold.withColumn("mean_AUC", per_fold.agg(F.avg("AUROC")).scalar())


def _binned(counts: DataFrame, bins: int, closed: str) -> DataFrame:
    """Bin number and bounds per score; edges are quantiles of all scores, repeated ones merged."""
    found = quantiles_of_counts(counts, "p", [i / bins for i in range(bins + 1)])
    edges = found.agg(F.array_sort(F.array_distinct(F.first("q")))).scalar()
    score = F.col("p")

    def passed(edge: Column) -> Column:
        return score > edge if closed == "right" else score >= edge

    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    return (
        counts.withColumn("_edges", edges)
        .withColumn("bin", F.size(F.filter(inner, passed)) + 1)
        .withColumn("low", F.get("_edges", F.col("bin") - 1))
        .withColumn("high", F.coalesce(F.get("_edges", F.col("bin")), F.col("low")))
        .drop("_edges")
    )


def calibration_table(
    df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, closed: str = "right"
) -> DataFrame:
    """Per quantile bin: size, mean prediction, observed rate, spread of the predictions.

    `closed="right"` puts a score on an edge into the lower bin, `"left"` into the upper one. A constant
    score gives one bin.
    """
    return calibration_of(score_counts(df, y, p), bins, closed)


def calibration_of(counts: DataFrame, bins: int = 10, closed: str = "right") -> DataFrame:
    """`calibration_table` from a written `score_counts` table."""
    binned = _binned(counts, bins, closed)
    n, gap = F.col("n"), F.col("p") - F.col("low")
    grouped = binned.groupBy("bin", "low", "high").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("p")).alias("_p"), F.sum("pos").alias("_pos"),
        F.sum(n * gap).alias("_g"), F.sum(n * gap * gap).alias("_g2"),
    )
    variance = (F.col("_g2") - F.col("_g") * F.col("_g") / F.col("n")) / (F.col("n") - 1)
    return grouped.select(
        "bin", "low", "high", "n",
        (F.col("_p") / F.col("n")).alias("mean_pred"),
        (F.col("_pos") / F.col("n")).alias("obs_rate"),
        F.when(F.col("n") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sd_pred"),
    )


def equal_count_bins(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Calibration in bins of about equal counts that keep equal scores together: (bin, low, high, n, mean_pred, obs_rate).

    A bin ends at the first score that brings the running count to its share of all rows; a score with many rows may
    cover several shares, and bins that would be empty are left out, so there can be fewer than `bins`. Bounds are
    scores. Unlike quantile edges, which may lie between scores, the cut depends on the running counts alone.
    """
    ranked = running_totals(score_counts(df, y, p), "p", ["n"])
    share = F.expr(f"(n_upto - n) * {int(bins)} div n_all")
    found = ranked.groupBy(share.alias("_share")).agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("p")).alias("_p"), F.sum("pos").alias("_pos"),
    )
    number = F.row_number().over(Window.orderBy("_share"))  # at most `bins` rows
    return found.select(
        number.alias("bin"), "low", "high", F.col("n").cast("bigint").alias("n"),
        (F.col("_p") / F.col("n")).alias("mean_pred"), (F.col("_pos") / F.col("n")).alias("obs_rate"),
    )


def chi_square_upper_tail(x: Column, df: int) -> Column:
    """P(chi-square > x) for even degrees of freedom (closed form)."""
    if df < 2 or df % 2:
        raise ValueError("the closed form needs an even, positive number of degrees of freedom")
    half = x / 2
    terms = F.lit(1.0)
    for i in range(1, df // 2):
        terms = terms + F.pow(half, F.lit(float(i))) / float(factorial(i))
    return F.exp(-half) * terms


def chi_square_tail(x: Column, df: int) -> Column:
    """P(chi-square > x): closed form for even degrees of freedom, the series of the incomplete gamma for odd ones.

    The series is exact to about 1e-13; tails beyond x = 600 are far smaller than that and given as 0.
    """
    if df < 1:
        raise ValueError("the number of degrees of freedom must be positive")
    if df % 2 == 0:
        return chi_square_upper_tail(x, df)
    half, shape = x / 2, df / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def grow(state: Column, i: Column) -> Column:
        term = state["term"] * half / (i + F.lit(shape))
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(700)), start, grow, lambda state: state["total"])
    below = F.exp(F.lit(shape) * F.ln(half) - half - F.lit(lgamma(shape + 1))) * series
    return F.when(x <= 0, F.lit(1.0)).when(x > 600, F.lit(0.0)).otherwise(F.greatest(1 - below, F.lit(0.0)))


def hosmer_lemeshow(df: DataFrame, y: str = "y", p: str = "p", groups: int = 10) -> DataFrame:
    """Goodness-of-fit statistic over quantile bins with groups - 2 degrees of freedom."""
    return hosmer_lemeshow_of(score_counts(df, y, p), groups)


def hosmer_lemeshow_of(counts: DataFrame, groups: int = 10) -> DataFrame:
    """`hosmer_lemeshow` from a written `score_counts` table."""
    binned = _binned(counts, groups, "right").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("pos").cast("double").alias("o1"), F.sum(F.col("n") * F.col("p")).alias("e1")
    )
    o0, e0 = F.col("n") - F.col("o1"), F.col("n") - F.col("e1")
    gap1, gap0 = F.col("o1") - F.col("e1"), o0 - e0
    statistic = binned.agg(
        F.sum(F.try_divide(gap1 * gap1, F.col("e1")) + F.try_divide(gap0 * gap0, e0)).alias("statistic")
    )
    return statistic.select(
        "statistic", F.lit(groups - 2).alias("df"),
        chi_square_tail(F.col("statistic"), groups - 2).alias("p_value"),
    )


def decision_curve(
    df: DataFrame, y: str = "y", p: str = "p", thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Net benefit per threshold, a score at the threshold counting as positive.

    Each score is counted once, at the number of thresholds it reaches; the threshold rows then sum
    those counts, so rows are never multiplied by thresholds.
    """
    return decision_curve_of(score_counts(df, y, p), thresholds)


def decision_curve_of(counts: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """`decision_curve` from a written `score_counts` table."""
    cuts = sorted(thresholds or [i / 100 for i in range(1, 100)])
    cut_array = F.array(*[F.lit(float(c)) for c in cuts])
    reached = counts.groupBy(
        F.size(F.filter(cut_array, lambda cut: cut <= F.col("p"))).alias("reached")
    ).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    totals = reached.agg(F.sum("n").alias("n_all"))
    grid = totals.select("n_all", F.posexplode(cut_array).alias("i", "threshold"))
    hits = (
        reached.filter("reached > 0")
        .select(F.explode(F.sequence(F.lit(0), F.col("reached") - 1)).alias("i"), "n", "pos")
        .groupBy("i").agg(F.sum("n").alias("n"), F.sum("pos").alias("tp"))
    )
    t, total = F.col("threshold"), F.col("n_all")
    tp = F.coalesce("tp", F.lit(0))
    fp = F.coalesce(F.col("n") - F.col("tp"), F.lit(0))
    return grid.join(hits, "i", "left").select(
        "threshold", (tp / total - fp / total * (t / (1 - t))).alias("net_benefit")
    )


@dataclass(frozen=True)
class Evaluation:
    """All measures of one prediction table."""

    discrimination: DataFrame
    calibration: DataFrame
    hosmer_lemeshow: DataFrame
    decision_curve: DataFrame


def evaluate(
    df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, groups: int = 10,
    thresholds: Sequence[float] | None = None,
) -> Evaluation:
    """Every measure from one written table of distinct scores, so the scores are derived once."""
    counts = score_counts(df, y, p)
    return Evaluation(
        discrimination_of(counts), calibration_of(counts, bins), hosmer_lemeshow_of(counts, groups),
        decision_curve_of(counts, thresholds),
    )
