"""Column expressions for confusion counts and the metrics derived from them.

Three zero-denominator conventions exist and are kept apart:
``ratio`` gives 0.0 (evaluation metrics), ``ratio_or_null`` gives NULL
(per-label reports), and the export summary prints "N/A" (see results).
Every division is guarded by an explicit CASE so the query never divides
by zero, whatever the ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def r6(c: Column | str, digits: int = DIGITS) -> Column:
    """Round a double for stable comparison across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den == 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, NULL when den == 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def confusion_sums(truth: Column | str, pred: Column | str) -> list[Column]:
    """tn, fp, fn, tp as conditional sums (one pass, partial aggregation)."""
    t = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred

    def cnt(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")

    return [
        cnt((t == 0) & (p == 0)).alias("tn"),
        cnt((t == 0) & (p == 1)).alias("fp"),
        cnt((t == 1) & (p == 0)).alias("fn"),
        cnt((t == 1) & (p == 1)).alias("tp"),
    ]


def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp", digits: int = DIGITS, names=None) -> list[Column]:
    """accuracy .. anomaly_rate from the four counts; empty denominators give 0.0."""
    tn, fp, fn, tp = (F.col(x) for x in (tn, fp, fn, tp))
    n = tn + fp + fn + tp
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    cols = {
        "accuracy": ratio(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        "f2_score": ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "tpr": recall,
        "anomaly_rate": ratio(tp + fp, n),
    }
    return [F.round(v, digits).alias(k) for k, v in cols.items() if names is None or k in names]


METRIC_SQL = """
  round(CASE WHEN tn+fp+fn+tp = 0 THEN 0.0 ELSE (tp+tn)*1.0/(tn+fp+fn+tp) END, 6) AS accuracy,
  round(CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp*1.0/(tp+fp) END, 6) AS precision,
  round(CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp*1.0/(tp+fn) END, 6) AS recall,
  round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END, 6) AS f1_score,
  round(CASE WHEN 5*tp+4*fn+fp = 0 THEN 0.0 ELSE 5.0*tp/(5*tp+4*fn+fp) END, 6) AS f2_score,
  round(CASE WHEN fp+tn = 0 THEN 0.0 ELSE fp*1.0/(fp+tn) END, 6) AS fpr,
  round(CASE WHEN fn+tp = 0 THEN 0.0 ELSE fn*1.0/(fn+tp) END, 6) AS fnr,
  round(CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp*1.0/(tp+fn) END, 6) AS tpr,
  round(CASE WHEN tn+fp+fn+tp = 0 THEN 0.0 ELSE (tp+fp)*1.0/(tn+fp+fn+tp) END, 6) AS anomaly_rate"""

CONFUSION_SQL = """
  CAST(coalesce(sum(CASE WHEN {t} = 0 AND {p} = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn,
  CAST(coalesce(sum(CASE WHEN {t} = 0 AND {p} = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(CASE WHEN {t} = 1 AND {p} = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(CASE WHEN {t} = 1 AND {p} = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp"""


def confusion_sql(truth: str, pred: str) -> str:
    return CONFUSION_SQL.format(t=truth, p=pred)
