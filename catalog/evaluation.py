"""Evaluation of a case-level score that takes many values, with ties."""

from pyspark.sql import functions as F

from casewatch.functions import clip_probability, logistic
from casewatch.operators import evaluate as EV
from casewatch.operators.folds import fold_of
from casewatch.operators.ranking import exact_quantiles, running_totals
from casewatch.plans.carrier import DEMO_OUTCOMES, report_table
from casewatch.session import cut_lineage
from catalog.carrier_sql import CARRIER, r6
from catalog.registry import query, rounded

SCORES = """, s0 AS (SELECT case_id, max(CASE WHEN pt_code IN (1, 2, 3, 4) THEN 1 ELSE 0 END) AS y,
  CAST(sum(pt_code * (1 + length(drug))) AS BIGINT) % 997 AS k FROM m GROUP BY 1),
 s AS (SELECT case_id, y, 1 / (1 + exp(-(k / 500.0 - 2))) AS p FROM s0)"""
FOLD = "CAST(CAST('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':20251121'), 1, 8) AS BIGINT) % 5 + 1 AS INTEGER)"


def scores(spark, sf_dir):
    m = report_table(spark, sf_dir)
    cases = m.groupBy("case_id").agg(
        F.max(F.col("pt_code").isin(*DEMO_OUTCOMES).cast("int")).alias("y"),
        (F.sum(F.col("pt_code") * (1 + F.length("drug"))) % 997).alias("k"),
    )
    return cases.select("case_id", "y", logistic(F.col("k") / 500.0 - 2).alias("p"))


def curve_sql(group: str = "", source: str = "s") -> str:
    """Distinct scores with the positives and negatives above them, and both areas."""
    key, part = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    by = f"GROUP BY {group}" if group else ""
    return f""", lv AS (SELECT {key}p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM {source} GROUP BY {key}p),
 cu AS (SELECT *, n - pos AS neg, sum(pos) OVER (w) - pos AS tp0, sum(n - pos) OVER (w) - (n - pos) AS fp0,
  sum(pos) OVER ({part}) AS tp, sum(n - pos) OVER ({part}) AS tn FROM lv WINDOW w AS ({part} ORDER BY p DESC)),
 hp AS (SELECT *, neg / pos AS h, fp0 - neg / pos * tp0 AS b FROM cu WHERE pos > 0),
 pr AS (SELECT {key}sum(pos / (1 + h) - CASE WHEN b = 0 THEN 0 ELSE b / (1 + h) ** 2 *
  (ln(tp0 + fp0 + pos + neg) - ln(tp0 + fp0)) END) / max(tp) AS auprc FROM hp {by}),
 ro AS (SELECT {key}sum(pos * (tn - fp0 - neg + neg / 2)) / (max(tp) * max(tn)) AS auroc FROM cu {by})"""


RANK_AUC = """, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s)"""


@query(CARRIER + SCORES + RANK_AUC + f""" SELECT {r6('''(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) *
 (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (1.0 * count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))''')} AS "AUROC"
FROM r""")
def auroc(spark, sf_dir):
    return rounded(EV.discrimination(scores(spark, sf_dir)).select("AUROC"), "AUROC")


@query(CARRIER + SCORES + curve_sql() + f""" SELECT {r6('auprc')} AS "AUPRC" FROM pr""")
def auprc(spark, sf_dir):
    return rounded(EV.discrimination(scores(spark, sf_dir)).select("AUPRC"), "AUPRC")


@query(CARRIER + SCORES + f""" SELECT {r6('avg((p - y) ** 2)')} AS "Brier" FROM s""")
def brier(spark, sf_dir):
    return rounded(EV.brier(scores(spark, sf_dir)), "Brier")


@query(CARRIER + SCORES + curve_sql() + f""" SELECT 'derived' AS dataset, 'AUROC' AS metric, {r6('auroc')} AS value FROM ro
 UNION ALL SELECT 'derived', 'AUPRC', {r6('auprc')} FROM pr UNION ALL SELECT 'derived', 'Brier', {r6('avg((p - y) ** 2)')} FROM s""")
def metric_summary(spark, sf_dir):
    return rounded(EV.metric_summary(scores(spark, sf_dir), "derived"), "value")


@query(CARRIER + SCORES + f", f AS (SELECT *, {FOLD} AS fold FROM s)" + curve_sql("fold", "f") + f"""
 SELECT fold, {r6('auroc')} AS "AUROC", round((SELECT avg(auroc) FROM ro), 6) + 0.0 AS "mean_AUC" FROM ro""")
def fold_auc(spark, sf_dir):
    folded = scores(spark, sf_dir).withColumn("fold", fold_of("case_id", 5))
    return rounded(EV.fold_auc(folded), "AUROC", "mean_AUC")


EDGES = """, q AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM s),
 i AS (SELECT e, unnest(e[2:len(e) - 1]) AS edge FROM q),
 b AS (SELECT y, p, 1 + (SELECT count(*) FROM i WHERE s.p {0} i.edge) AS bin FROM s)"""


@query(CARRIER + SCORES + EDGES.format(">") + f""" SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {r6('avg(p)')} AS mean_pred,
 {r6('avg(y)')} AS obs_rate, {r6('stddev_samp(p)')} AS sd_pred FROM b GROUP BY 1""")
def calibration_quantile_bins(spark, sf_dir):
    table = EV.calibration_table(scores(spark, sf_dir)).drop("low", "high")
    return rounded(table, "mean_pred", "obs_rate", "sd_pred")


@query(CARRIER + SCORES + EDGES.format(">=") + f""" SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {r6('avg(p)')} AS mean_pred,
 {r6('avg(y)')} AS obs_rate, {r6('stddev_samp(p)')} AS sd_pred FROM b GROUP BY 1""")
def calibration_equal_frequency_bins(spark, sf_dir):
    table = EV.calibration_table(scores(spark, sf_dir), closed="left").drop("low", "high")
    return rounded(table, "mean_pred", "obs_rate", "sd_pred")


@query(CARRIER + SCORES + f""", t AS (SELECT round(p, 1) AS p, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1),
 k AS (SELECT *, (sum(n) OVER (ORDER BY p) - n) * 10 // sum(n) OVER () AS share FROM t)
 SELECT CAST(row_number() OVER (ORDER BY share) AS INTEGER) AS bin, min(p) + 0.0 AS low, max(p) + 0.0 AS high, CAST(sum(n) AS BIGINT) AS n,
 {r6('sum(n * p) / sum(n)')} AS mean_pred, {r6('sum(pos) / sum(n)')} AS obs_rate FROM k GROUP BY share""")
def calibration_tied_scores(spark, sf_dir):
    # Scores of one digit: a few values hold most rows.
    tied = scores(spark, sf_dir).withColumn("p", F.round("p", 1))
    return rounded(EV.equal_count_bins(tied), "low", "high", "mean_pred", "obs_rate")


@query(CARRIER + SCORES + EDGES.format(">") + f""", g AS (SELECT bin, count(*) AS n, sum(y) AS o1, sum(p) AS e1 FROM b GROUP BY 1),
 h AS (SELECT sum((o1 - e1) ** 2 / e1 + (o1 - e1) ** 2 / (n - e1)) AS x FROM g)
 SELECT round(x, 5) + 0.0 AS statistic, 8 AS df, {r6('exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6)')} AS p_value FROM h""")
def hosmer_lemeshow(spark, sf_dir):
    return rounded(rounded(EV.hosmer_lemeshow(scores(spark, sf_dir)), "statistic", digits=5), "p_value")


@query(CARRIER + SCORES + f""", t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i))
 SELECT threshold, {r6('''sum(CASE WHEN p >= threshold THEN y ELSE 0 END) / count(*)
 - sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END) / count(*) * (threshold / (1 - threshold))''')} AS net_benefit
 FROM s, t GROUP BY 1""")
def decision_curve(spark, sf_dir):
    return rounded(EV.decision_curve(scores(spark, sf_dir)), "net_benefit")


@query(CARRIER + SCORES + """, e AS (SELECT case_id, y, CASE WHEN case_id % 5 = 0 THEN NULL ELSE p END AS p FROM s WHERE y = 1)
 SELECT CAST(NULL AS DOUBLE) AS "AUROC", CAST(NULL AS DOUBLE) AS "AUPRC", round(avg((p - y) ** 2), 6) + 0.0 AS "Brier" FROM e""")
def one_class_metrics(spark, sf_dir):
    one = scores(spark, sf_dir).filter("y = 1").withColumn("p", F.expr("CASE WHEN case_id % 5 = 0 THEN NULL ELSE p END"))
    return rounded(EV.discrimination(one), "AUROC", "AUPRC", "Brier")


@query(CARRIER + SCORES + f""" SELECT y, count(*) AS n, {r6('quantile_cont(p, 0.05)')} AS q05, {r6('quantile_cont(p, 0.5)')} AS q50,
 {r6('quantile_cont(p, 0.95)')} AS q95 FROM s GROUP BY 1""")
def exact_score_quantiles(spark, sf_dir):
    found = exact_quantiles(scores(spark, sf_dir), "p", (0.05, 0.5, 0.95), ["y"])
    named = found.select("y", "n", *[F.get("q", i).alias(q) for i, q in enumerate(("q05", "q50", "q95"))])
    return rounded(named, "q05", "q50", "q95")


@query(CARRIER + """, k AS (SELECT role, CAST(quantity * 100 + tto_days AS BIGINT) AS v, count(*) AS n FROM m GROUP BY 1, 2)
 SELECT role, v, n, CAST(sum(n) OVER (PARTITION BY role ORDER BY v) AS BIGINT) AS n_upto,
 CAST(sum(n) OVER (PARTITION BY role) AS BIGINT) AS n_all FROM k""")
def running_counts(spark, sf_dir):
    value = (F.col("quantity") * 100 + F.col("tto_days")).cast("bigint").alias("v")
    collapsed = report_table(spark, sf_dir).groupBy("role", value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(cut_lineage(collapsed), "v", ["n"], ["role"])
