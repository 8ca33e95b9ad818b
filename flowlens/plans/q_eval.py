"""Registered queries: thresholding, scoring decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.labels import severity
from flowlens.functions.metrics import CONFUSION_SQL, METRIC_SQL, confusion_sql
from flowlens.operators import evaluate as E
from flowlens.plans import bindings as B
from flowlens.plans.views_sql import SCORES, with_views

THETA_P = 99.0
CANDIDATE_THETAS = [50.0, 100.0, 150.0, 200.0, 250.0]  # fixed values: D12 candidates


def _split(spark, sf):
    return B.scores(spark, sf, "val"), B.scores(spark, sf, "test")


def _scored_test(spark, sf):
    val, test = _split(spark, sf)
    theta = E.percentile_threshold(val, THETA_P)
    return E.classify(test, theta), theta


# SQL fragments shared by the oracle queries
_TH = "th AS (SELECT quantile_cont(score, 0.99) AS theta FROM scores WHERE split = 'val')"
_PRED = _TH + """, pred AS (
  SELECT s.*, th.theta, CAST(s.score > th.theta AS INTEGER) AS prediction
  FROM scores s CROSS JOIN th WHERE s.split = 'test')"""


def q_run_summary(spark, sf):
    """Flagship: p99 validation threshold -> classify -> severity -> run summary per user."""
    p, theta = _scored_test(spark, sf)
    sev = severity("score", theta)
    g = p.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("prediction").cast("long").alias("anomaly_count"),
        *[F.sum(F.when(sev == s, 1).otherwise(0)).cast("long").alias(f"n_{s}") for s in ("critical", "high", "medium", "low")],
    )
    return g.select(
        "user_id",
        "total_flows",
        "anomaly_count",
        (F.col("total_flows") - F.col("anomaly_count")).alias("normal_count"),
        F.round(F.when(F.col("total_flows") > 0, F.col("anomaly_count") / F.col("total_flows")).otherwise(0.0), 6).alias("anomaly_rate"),
        F.round(F.lit(theta), 6).alias("threshold"),
        "n_critical", "n_high", "n_medium", "n_low",
    )


SQL_RUN_SUMMARY = with_views("""
SELECT user_id, CAST(count(*) AS BIGINT) AS total_flows, CAST(sum(prediction) AS BIGINT) AS anomaly_count,
       CAST(count(*) - sum(prediction) AS BIGINT) AS normal_count,
       round(CASE WHEN count(*) > 0 THEN sum(prediction) * 1.0 / count(*) ELSE 0.0 END, 6) AS anomaly_rate,
       round(any_value(theta), 6) AS threshold,
       CAST(sum(CASE WHEN score > 2.0 * theta THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
       CAST(sum(CASE WHEN score <= 2.0 * theta AND score > 1.5 * theta THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
       CAST(sum(CASE WHEN score <= 1.5 * theta AND score > theta THEN 1 ELSE 0 END) AS BIGINT) AS n_medium,
       CAST(sum(CASE WHEN score <= theta THEN 1 ELSE 0 END) AS BIGINT) AS n_low
FROM pred GROUP BY user_id""", SCORES, _PRED)


def q_percentile_threshold(spark, sf):
    val, _ = _split(spark, sf)
    rows = [(p, E.percentile_threshold(val, p)) for p in (95.0, 99.0)]
    return spark.createDataFrame(rows, "percentile double, threshold double").select(
        "percentile", F.round("threshold", 6).alias("threshold")
    )


SQL_PERCENTILE_THRESHOLD = with_views("""
SELECT 95.0::DOUBLE AS percentile, round(quantile_cont(score, 0.95), 6) AS threshold FROM scores WHERE split = 'val'
UNION ALL
SELECT 99.0::DOUBLE, round(quantile_cont(score, 0.99), 6) FROM scores WHERE split = 'val'""", SCORES)


def q_score_stats(spark, sf):
    val, _ = _split(spark, sf)
    return E.score_stats(val)


SQL_SCORE_STATS = with_views("""
SELECT round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean,
       round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90,
       round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.975), 6) AS p97_5,
       round(quantile_cont(score, 0.99), 6) AS p99, round(stddev_pop(score), 6) AS std
FROM scores WHERE split = 'val'""", SCORES)


def q_classify(spark, sf):
    p, _ = _scored_test(spark, sf)
    return p.select("event_id", "score", "prediction")


SQL_CLASSIFY = with_views("SELECT event_id, score, prediction FROM pred", SCORES, _PRED)


def q_severity_counts(spark, sf):
    p, theta = _scored_test(spark, sf)
    return p.groupBy(severity("score", theta).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


SQL_SEVERITY_COUNTS = with_views("""
SELECT CASE WHEN score > 2.0 * theta THEN 'critical' WHEN score > 1.5 * theta THEN 'high'
            WHEN score > theta THEN 'medium' ELSE 'low' END AS severity, CAST(count(*) AS BIGINT) AS n
FROM pred GROUP BY 1""", SCORES, _PRED)


def q_confusion(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.confusion(p)


SQL_CONFUSION = with_views("SELECT " + confusion_sql("truth", "prediction") + " FROM pred", SCORES, _PRED)


def q_metrics(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.metrics(p)


SQL_METRICS = with_views(
    "SELECT tn, fp, fn, tp, " + METRIC_SQL + " FROM (SELECT " + confusion_sql("truth", "prediction") + " FROM pred) c",
    SCORES, _PRED,
)


_CURVE = """g AS (SELECT score, CAST(sum(truth) AS BIGINT) AS pos, CAST(sum(1 - truth) AS BIGINT) AS neg
      FROM scores WHERE split = 'test' GROUP BY score),
c AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
      FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N,
             sum(neg * (cum_pos - pos / 2.0)) AS auc_num, sum(pos * cum_pos / (cum_pos + cum_neg)) AS ap_num FROM c),
curves AS (SELECT round(CASE WHEN P * N <> 0 THEN auc_num / (P * N) END, 6) AS roc_auc,
                  round(CASE WHEN N > 0 AND P <> 0 THEN ap_num / P END, 6) AS pr_auc FROM t)"""


def q_auc_ap(spark, sf):
    _, test = _split(spark, sf)
    return E.auc_ap(test)


SQL_AUC_AP = with_views("SELECT roc_auc, pr_auc FROM curves", SCORES, _CURVE)


def q_roc_curve(spark, sf):
    _, test = _split(spark, sf)
    return E.roc_curve(test)


SQL_ROC_CURVE = with_views("""
SELECT score AS threshold, round(CASE WHEN t.N <> 0 THEN cum_neg * 1.0 / t.N END, 6) AS fpr,
       round(CASE WHEN t.P <> 0 THEN cum_pos * 1.0 / t.P END, 6) AS tpr
FROM c CROSS JOIN t""", SCORES, _CURVE)


_SWEEP = """ths AS (
  SELECT unnest([90.0, 92.0, 93.0, 94.0, 95.0, 96.0, 97.0, 97.5, 98.0, 99.0]::DOUBLE[]) AS percentile,
         unnest(quantile_cont(score, [0.90, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.975, 0.98, 0.99])) AS threshold
  FROM scores WHERE split = 'val'),
cnt AS (
  SELECT percentile, threshold,""" + CONFUSION_SQL.format(t="s.truth", p="CAST(s.score > threshold AS INTEGER)") + """
  FROM ths CROSS JOIN scores s WHERE s.split = 'test' GROUP BY percentile, threshold),
sweep AS (
  SELECT percentile, round(threshold, 6) AS threshold, precision, recall, f1_score, f2_score, roc_auc, pr_auc,
         fpr, fnr, accuracy, tp, tn, fp, fn
  FROM (SELECT *, """ + METRIC_SQL + """ FROM cnt) m CROSS JOIN curves)"""


def q_threshold_sweep(spark, sf):
    val, test = _split(spark, sf)
    return E.threshold_sweep(val, test)


SQL_THRESHOLD_SWEEP = with_views("SELECT * FROM sweep", SCORES, _CURVE, _SWEEP)


def q_select_threshold(spark, sf):
    val, test = _split(spark, sf)
    sweep = E.threshold_sweep(val, test)
    return E.select_threshold(sweep, "max_f2_under_fpr", 0.07).unionByName(
        E.select_threshold(sweep, "max_recall_under_fpr", 0.07)
    ).unionByName(E.select_threshold(sweep, "fixed_percentile", val=val, percentile=THETA_P))


SQL_SELECT_THRESHOLD = with_views("""
SELECT * FROM (
  SELECT threshold, percentile, 'max_f2_under_fpr' AS strategy FROM pool
  ORDER BY f2_score DESC, recall DESC, fpr ASC LIMIT 1)
UNION ALL
SELECT * FROM (
  SELECT threshold, percentile, 'max_recall_under_fpr' AS strategy FROM pool
  ORDER BY recall DESC, f2_score DESC, fpr ASC LIMIT 1)
UNION ALL
SELECT round(quantile_cont(score, 0.99), 6), CAST(99.0 AS DOUBLE), 'fixed_percentile' FROM scores WHERE split = 'val'""",
    SCORES, _CURVE, _SWEEP,
    """pool AS (
  SELECT * FROM sweep WHERE fpr <= 0.07
  UNION ALL
  SELECT * FROM (SELECT * FROM sweep ORDER BY fpr ASC, percentile DESC LIMIT 1)
  WHERE NOT EXISTS (SELECT 1 FROM sweep WHERE fpr <= 0.07))""")


def q_false_negatives(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.false_negatives(p, "event_id")


SQL_FALSE_NEGATIVES = with_views("SELECT event_id, score FROM pred WHERE truth = 1 AND prediction = 0", SCORES, _PRED)


def q_per_label_metrics(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.per_label_metrics(p)


_PER_LABEL = """per_label AS (
  SELECT label, n, n_attack, n - n_attack AS n_benign, tp, fn, fp, tn,
         round(CASE WHEN tp + fn <> 0 THEN tp * 1.0 / (tp + fn) END, 6) AS recall,
         round(CASE WHEN fp + tn <> 0 THEN fp * 1.0 / (fp + tn) END, 6) AS fpr,
         round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score
  FROM (SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(truth) AS BIGINT) AS n_attack,
               """ + confusion_sql("truth", "prediction") + """,
               avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score
        FROM pred GROUP BY label) g)"""

SQL_PER_LABEL_METRICS = with_views("SELECT * FROM per_label", SCORES, _PRED, _PER_LABEL)


def q_detection_tiers(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.detection_tiers(E.per_label_metrics(p))


SQL_DETECTION_TIERS = with_views("""
SELECT label, tp, fn, tp + fn AS support, round(coalesce(r, 0.0) * 100, 2) AS recall_pct,
       CASE WHEN tp = 0 OR coalesce(r, 0.0) = 0 THEN 'undetected' WHEN r < 0.20 THEN 'weak'
            WHEN r >= 0.80 AND tp + fn >= 100 THEN 'good' ELSE 'moderate' END AS tier
FROM (SELECT *, coalesce(recall, CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) END) AS r FROM per_label) x
WHERE lower(label) <> 'benign'""", SCORES, _PRED, _PER_LABEL)


def q_baselines(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.baselines(p)


SQL_BASELINES = with_views("""
SELECT predictor,
  round(CASE WHEN tn+fp+fn+tp = 0 THEN 0.0 ELSE (tp+tn)*1.0/(tn+fp+fn+tp) END, 6) AS accuracy,
  round(CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp*1.0/(tp+fp) END, 6) AS precision,
  round(CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp*1.0/(tp+fn) END, 6) AS recall,
  round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END, 6) AS f1_score
FROM (SELECT predictor, """ + confusion_sql("t", "p") + """ FROM (
  SELECT 'model' AS predictor, truth AS t, prediction AS p FROM pred
  UNION ALL SELECT 'always_normal', truth, 0 FROM pred
  UNION ALL SELECT 'always_anomaly', truth, 1 FROM pred) u GROUP BY predictor) c""", SCORES, _PRED)


def q_error_by_cell(spark, sf):
    p, _ = _scored_test(spark, sf)
    return E.error_by_cell(p)


SQL_ERROR_BY_CELL = with_views("""
SELECT CASE WHEN truth = 0 AND prediction = 0 THEN 'TN' WHEN truth = 0 AND prediction = 1 THEN 'FP'
            WHEN truth = 1 AND prediction = 1 THEN 'TP' WHEN truth = 1 AND prediction = 0 THEN 'FN' END AS cell,
       CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score,
       round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM pred WHERE truth IS NOT NULL GROUP BY 1""", SCORES, _PRED)


def q_threshold_candidates(spark, sf):
    """Anomaly / normal counts per candidate theta on the whole scored table."""
    s = B.scores(spark, sf)
    th = spark.createDataFrame([(t,) for t in CANDIDATE_THETAS], "theta double")
    exceed = sum((F.col("score") > F.lit(t)).cast("int") for t in CANDIDATE_THETAS)
    b = s.groupBy(exceed.alias("b")).agg(F.count(F.lit(1)).alias("k"))
    need = sum((F.col("theta") >= F.lit(t)).cast("int") for t in CANDIDATE_THETAS)
    return th.crossJoin(F.broadcast(b)).groupBy("theta").agg(
        F.sum(F.when(F.col("b") >= need, F.col("k")).otherwise(0)).cast("long").alias("anomaly_count"),
        F.sum(F.when(F.col("b") < need, F.col("k")).otherwise(0)).cast("long").alias("normal_count"),
    )


SQL_THRESHOLD_CANDIDATES = with_views("""
SELECT theta, CAST(sum(CASE WHEN score > theta THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count,
       CAST(sum(CASE WHEN score > theta THEN 0 ELSE 1 END) AS BIGINT) AS normal_count
FROM scores CROSS JOIN (SELECT unnest([50.0, 100.0, 150.0, 200.0, 250.0]::DOUBLE[]) AS theta) t
GROUP BY theta""", SCORES)


QUERIES = {
    "d6_run_summary": (q_run_summary, SQL_RUN_SUMMARY),
    "f1_percentile_threshold": (q_percentile_threshold, SQL_PERCENTILE_THRESHOLD),
    "f2_score_stats": (q_score_stats, SQL_SCORE_STATS),
    "d4_classify": (q_classify, SQL_CLASSIFY),
    "d5_severity_counts": (q_severity_counts, SQL_SEVERITY_COUNTS),
    "f3_confusion": (q_confusion, SQL_CONFUSION),
    "f4_metrics": (q_metrics, SQL_METRICS),
    "f5_f6_auc_ap": (q_auc_ap, SQL_AUC_AP),
    "f7_roc_curve": (q_roc_curve, SQL_ROC_CURVE),
    "f8_threshold_sweep": (q_threshold_sweep, SQL_THRESHOLD_SWEEP),
    "f9_select_threshold": (q_select_threshold, SQL_SELECT_THRESHOLD),
    "f10_false_negatives": (q_false_negatives, SQL_FALSE_NEGATIVES),
    "f11_per_label_metrics": (q_per_label_metrics, SQL_PER_LABEL_METRICS),
    "f12_detection_tiers": (q_detection_tiers, SQL_DETECTION_TIERS),
    "f13_baselines": (q_baselines, SQL_BASELINES),
    "f14_error_by_cell": (q_error_by_cell, SQL_ERROR_BY_CELL),
    "d12_threshold_candidates": (q_threshold_candidates, SQL_THRESHOLD_CANDIDATES),
}


# -- F15 - F17 -------------------------------------------------------------------------

def q_density_histogram(spark, sf):
    val, _ = _split(spark, sf)
    return E.density_histogram(val, "score", 0.995, 80)


_CAP = """cap AS (SELECT quantile_cont(score, 0.995) AS cap FROM scores WHERE split = 'val'),
kept AS (SELECT score FROM scores, cap WHERE split = 'val' AND score <= cap)"""

SQL_DENSITY_HISTOGRAM = with_views("""
SELECT CAST(b AS INTEGER) AS bin, round(mn + (b - 1) * ((mx - mn) / 80), 6) AS lo,
       round(CASE WHEN (mx - mn) / 80 > 0 THEN k / (n * ((mx - mn) / 80)) END, 6) AS density
FROM (SELECT CASE WHEN (mx - mn) / 80 > 0 THEN least(80, CAST(floor((score - mn) / ((mx - mn) / 80)) AS INTEGER) + 1) ELSE 1 END AS b,
             count(*) AS k
      FROM kept, (SELECT min(score) AS mn, max(score) AS mx FROM kept) s0 GROUP BY 1) c,
     (SELECT min(score) AS mn, max(score) AS mx, count(*) AS n FROM kept) st""", SCORES, _CAP)


def q_density_wide(spark, sf):
    """F15, the view of false positives: the same histogram up to p99.8."""
    val, _ = _split(spark, sf)
    return E.density_histogram(val, "score", 0.998, 80)


SQL_DENSITY_WIDE = SQL_DENSITY_HISTOGRAM.replace("quantile_cont(score, 0.995)", "quantile_cont(score, 0.998)")


def q_kde(spark, sf):
    val, _ = _split(spark, sf)
    return E.kde_grid(val, "score", 0.995, 500, 0.3)


SQL_KDE = with_views("""
SELECT CAST(g AS INTEGER) AS g, round(x, 6) AS x,
       round(sum(exp(-0.5 * ((x - score) / h) * ((x - score) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM (SELECT range AS g, range * (cap / 499) AS x FROM range(500), cap) grid,
     (SELECT k.score, st.n, st.h
      FROM kept k, (SELECT count(*) AS n, stddev_samp(score) * 0.3 AS h FROM kept) st) points
GROUP BY g, x""", SCORES, _CAP)


def q_best_by_metric(spark, sf):
    val, test = _split(spark, sf)
    return E.best_by_metric(E.threshold_sweep(val, test))


SQL_BEST_BY_METRIC = with_views(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, arg_min(percentile, ({'' if lower else '-'}{m}, percentile)) AS percentile, "
    f"arg_min({m}, ({'' if lower else '-'}{m}, percentile)) AS value FROM sweep WHERE {m} IS NOT NULL"
    for m, lower in [("f1_score", False), ("f2_score", False), ("recall", False), ("precision", False), ("accuracy", False), ("fpr", True)]
), SCORES, _CURVE, _SWEEP)


def q_tradeoff(spark, sf):
    """F16: recall and FPR change from P99 to P90, in percentage points."""
    val, test = _split(spark, sf)
    sw = E.threshold_sweep(val, test)
    a = sw.filter(F.col("percentile") == 90.0).select(F.col("recall").alias("r90"), F.col("fpr").alias("f90"))
    b = sw.filter(F.col("percentile") == 99.0).select(F.col("recall").alias("r99"), F.col("fpr").alias("f99"))
    return a.crossJoin(b).select(
        F.round((F.col("r90") - F.col("r99")) * 100, 4).alias("recall_gain_pts"),
        F.round((F.col("f90") - F.col("f99")) * 100, 4).alias("fpr_cost_pts"),
    )


SQL_TRADEOFF = with_views("""
SELECT round((a.recall - b.recall) * 100, 4) AS recall_gain_pts, round((a.fpr - b.fpr) * 100, 4) AS fpr_cost_pts
FROM (SELECT * FROM sweep WHERE percentile = 90.0) a, (SELECT * FROM sweep WHERE percentile = 99.0) b""", SCORES, _CURVE, _SWEEP)


def q_composite_rank(spark, sf):
    val, test = _split(spark, sf)
    sw = E.threshold_sweep(val, test).withColumn("experiment", F.lit("percentile_sweep"))
    return E.composite_rank(sw, "percentile")


SQL_COMPOSITE_RANK = with_views("""
SELECT experiment, percentile, rank_f1_score, rank_recall, rank_roc_auc, rank_fpr,
       (rank_f1_score + rank_recall + rank_roc_auc + rank_fpr) / 4.0 AS composite
FROM (SELECT 'percentile_sweep' AS experiment, percentile,
             CAST(rank() OVER (ORDER BY f1_score DESC) AS INTEGER) AS rank_f1_score,
             CAST(rank() OVER (ORDER BY recall DESC) AS INTEGER) AS rank_recall,
             CAST(rank() OVER (ORDER BY roc_auc DESC) AS INTEGER) AS rank_roc_auc,
             CAST(rank() OVER (ORDER BY fpr ASC) AS INTEGER) AS rank_fpr FROM sweep) r""", SCORES, _CURVE, _SWEEP)


QUERIES.update({
    "f15_density_histogram": (q_density_histogram, SQL_DENSITY_HISTOGRAM),
    "f15_density_p998": (q_density_wide, SQL_DENSITY_WIDE),
    "f15_kde": (q_kde, SQL_KDE),
    "f16_best_by_metric": (q_best_by_metric, SQL_BEST_BY_METRIC),
    "f16_tradeoff": (q_tradeoff, SQL_TRADEOFF),
    "f17_composite_rank": (q_composite_rank, SQL_COMPOSITE_RANK),
})
