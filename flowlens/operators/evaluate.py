"""Thresholding and evaluation (percentile thresholds, confusion, metrics,
ROC AUC / average precision / ROC curve, sweeps, per-label reports).

All curve statistics use one aggregation to distinct scores followed by the
distributed prefix scan of ``operators.ordering`` -- never a single-partition
window, never a per-threshold pass over the rows.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.metrics import confusion_sums, metric_columns, r6, ratio_or_null
from flowlens.operators.ordering import ordered_scan
from flowlens.operators.quantiles import exact_percentiles, group_percentile_table

# fixed values: sweep percentiles of the validation scores
SWEEP_PERCENTILES = [90.0, 92.0, 93.0, 94.0, 95.0, 96.0, 97.0, 97.5, 98.0, 99.0]
STATS_PERCENTILES = {"p90": 90.0, "p95": 95.0, "p97_5": 97.5, "p99": 99.0}


# -- F1 / F2 ----------------------------------------------------------------

def percentile_threshold(val: DataFrame, percentile: float, score: str = "score") -> float:
    """numpy-style linear percentile of the validation scores (exact, distributed)."""
    theta = exact_percentiles(val, score, [percentile / 100.0])[0]
    if theta is None:
        raise ValueError("no validation scores")
    return theta


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    """min, max, mean, median, population std, p90, p95, p97.5, p99 (one row)."""
    pcts = exact_percentiles(df, score, [0.5] + [p / 100.0 for p in STATS_PERCENTILES.values()])
    base = df.agg(
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
    )
    names = ["median", *STATS_PERCENTILES]
    return base.select(
        r6("min").alias("min"),
        r6("max").alias("max"),
        r6("mean").alias("mean"),
        *[F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in zip(names, pcts)],
        r6("std").alias("std"),
    )


# -- D4 / F3 / F4 ---------------------------------------------------------------

def classify(df: DataFrame, theta: float | Column, score: str = "score", out: str = "prediction") -> DataFrame:
    """prediction = score > theta (strict).

    A NaN or infinite score, or a threshold that is not finite and above 0, is
    an error; a null score has a null prediction.
    """
    s, inf = F.col(score).cast("double"), F.lit(math.inf)
    if isinstance(theta, Column):
        t = theta.cast("double")
        bad_theta = t.isNull() | F.isnan(t) | (t <= 0) | (t == inf)
        t = F.when(bad_theta, F.raise_error(F.lit("threshold must be finite and above 0"))).otherwise(t)
    elif not (math.isfinite(theta) and theta > 0):
        raise ValueError(f"threshold must be finite and above 0: {theta}")
    else:
        t = F.lit(float(theta))
    bad = F.isnan(s) | (F.abs(s) == inf)
    verdict = F.when(bad, F.raise_error(F.lit("score is not finite"))).otherwise((s > t).cast("int"))
    return df.withColumn(out, verdict)


def confusion(df: DataFrame, truth: str = "truth", pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_sums(truth, pred))


def metrics(df: DataFrame, truth: str = "truth", pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts plus accuracy .. anomaly rate; empty denominators give 0.0."""
    c = confusion(df, truth, pred, by)
    return c.select(*by, "tn", "fp", "fn", "tp", *metric_columns())


# -- F5 / F6 / F7: curves over distinct scores -----------------------------------

def score_groups(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row per distinct score with positive / negative counts (partial aggregation)."""
    return df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(truth).cast("long")).alias("pos"),
        F.sum((1 - F.col(truth)).cast("long")).alias("neg"),
    )


def cumulative_groups(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Distinct scores in descending order with inclusive running pos/neg counts."""
    g = score_groups(df, score, truth)
    return ordered_scan(g, order_cols=[F.col("score").desc()], sums=["pos", "neg"])


def auc_ap(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Tie-aware ROC AUC and non-interpolated average precision (one row).

    AUC = sum_g neg_g * (cumPos_g - pos_g / 2) / (P * N)
    AP  = sum_g pos_g * cumPos_g / cumAll_g / P
    NULL when a class is missing.
    """
    c = cumulative_groups(df, score, truth)
    agg = c.agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("auc_num"),
        F.sum(F.col("pos").cast("double") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("ap_num"),
    )
    return agg.select(
        F.round(ratio_or_null(F.col("auc_num"), F.col("P").cast("double") * F.col("N").cast("double")), 6).alias("roc_auc"),
        F.round(F.when(F.col("N") > 0, ratio_or_null(F.col("ap_num"), F.col("P"))), 6).alias("pr_auc"),
    )


def roc_curve(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first."""
    c = cumulative_groups(df, score, truth)
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return c.crossJoin(F.broadcast(tot)).select(
        F.col("score").alias("threshold"),
        F.round(ratio_or_null(F.col("cum_neg"), F.col("N")), 6).alias("fpr"),
        F.round(ratio_or_null(F.col("cum_pos"), F.col("P")), 6).alias("tpr"),
    )


# -- F8 / F9 ---------------------------------------------------------------------

class NoScoresError(ValueError):
    """A threshold was asked of a table without scores."""


def threshold_sweep(
    val: DataFrame, test: DataFrame, percentiles: Sequence[float] = SWEEP_PERCENTILES,
    score: str = "score", truth: str = "truth",
) -> DataFrame:
    """Metrics on ``test`` for each percentile threshold of ``val``.

    The thresholds come from one batched exact-percentile job.  Each test row
    is bucketed by how many thresholds it exceeds (one expression, no row
    expansion); the k+1 buckets are then folded into per-threshold counts.
    AUC / AP are computed once.  Without validation scores there is no
    threshold: ``NoScoresError``.
    """
    spark = val.sparkSession
    thetas = exact_percentiles(val, score, [p / 100.0 for p in percentiles])
    if None in thetas:
        raise NoScoresError("no validation scores")
    exceed = sum((F.col(score) > F.lit(t)).cast("int") for t in sorted(thetas))
    # a row is predicted anomalous for threshold i iff it exceeds at least need_i = #{j: t_j <= t_i} thresholds
    need = {t: r + 1 for r, t in enumerate(sorted(thetas))}
    th = spark.createDataFrame(
        [(i, float(p), float(t), need[t]) for i, (p, t) in enumerate(zip(percentiles, thetas))],
        "i int, percentile double, threshold double, need int",
    )
    buckets = test.filter(F.col(truth).isNotNull()).groupBy(exceed.alias("b")).agg(
        F.sum(F.col(truth).cast("long")).alias("pos"), F.sum((1 - F.col(truth)).cast("long")).alias("neg")
    )
    per = (
        th.crossJoin(F.broadcast(buckets))
        .groupBy("i", "percentile", "threshold")
        .agg(
            F.sum(F.when(F.col("b") >= F.col("need"), F.col("pos")).otherwise(0)).cast("long").alias("tp"),
            F.sum(F.when(F.col("b") >= F.col("need"), F.col("neg")).otherwise(0)).cast("long").alias("fp"),
            F.sum(F.when(F.col("b") < F.col("need"), F.col("pos")).otherwise(0)).cast("long").alias("fn"),
            F.sum(F.when(F.col("b") < F.col("need"), F.col("neg")).otherwise(0)).cast("long").alias("tn"),
        )
    )
    curves = auc_ap(test, score, truth)
    m = per.select("percentile", "threshold", "tp", "tn", "fp", "fn", *metric_columns())
    return m.crossJoin(F.broadcast(curves)).select(
        "percentile",
        F.round("threshold", 6).alias("threshold"),
        "precision", "recall", "f1_score", "f2_score", "roc_auc", "pr_auc", "fpr", "fnr", "accuracy",
        "tp", "tn", "fp", "fn",
    )


def select_threshold(sweep: DataFrame, strategy: str, max_fpr: float = 0.07, val: DataFrame | None = None,
                     percentile: float = 99.0, score: str = "score") -> DataFrame:
    """Pick one sweep row: max F2 (or recall) among fpr <= max_fpr; fallback lowest fpr.

    ``fixed_percentile`` takes that percentile of the scores of ``val`` instead.
    """
    if strategy == "fixed_percentile":
        if val is None:
            raise ValueError("fixed_percentile needs the validation scores")
        row = (percentile_threshold(val, percentile, score), float(percentile), strategy)
        chosen = val.sparkSession.createDataFrame([row], "threshold double, percentile double, strategy string")
        return chosen.withColumn("threshold", F.round("threshold", 6))
    if strategy == "max_f2_under_fpr":
        order = [F.col("f2_score").desc(), F.col("recall").desc(), F.col("fpr").asc()]
    elif strategy == "max_recall_under_fpr":
        order = [F.col("recall").desc(), F.col("f2_score").desc(), F.col("fpr").asc()]
    else:
        raise ValueError(f"unsupported strategy {strategy}")
    eligible = sweep.filter(F.col("fpr") <= max_fpr)
    fallback = sweep.orderBy(F.col("fpr").asc(), F.col("percentile").desc()).limit(1)
    has = eligible.agg(F.count(F.lit(1)).alias("k"))
    pool = eligible.unionByName(fallback.crossJoin(has).filter("k = 0").drop("k"))
    return pool.orderBy(*order).limit(1).select("threshold", "percentile", F.lit(strategy).alias("strategy"))


# -- F10 / F11 / F12 / F13 / F14 ----------------------------------------------------

def false_negatives(df: DataFrame, key: str, score: str = "score", truth: str = "truth", pred: str = "prediction",
                    parts: Sequence[str] = ()) -> DataFrame:
    """Missed attacks: key, score and the ``parts`` of the score (reconstruction, KL)."""
    return df.filter((F.col(truth) == 1) & (F.col(pred) == 0)).select(key, score, *parts)


def per_label_metrics(df: DataFrame, label: str = "label", score: str = "score",
                      truth: str = "truth", pred: str = "prediction") -> DataFrame:
    """Per label: support, tp/fn/fp/tn, recall / fpr (NULL on empty denominators), mean and median score."""
    null_key = "\u0000"
    keyed = df.withColumn("_lk", F.coalesce(F.col(label).cast("string"), F.lit(null_key)))
    med_df = group_percentile_table(keyed, score, "_lk", [0.5]).select("_lk", F.col("pct")[0].alias("median_score"))
    g = keyed.groupBy(label, "_lk").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(truth).cast("long")).alias("n_attack"),
        *confusion_sums(truth, pred),
        F.avg(score).alias("mean_score"),
    ).join(med_df, "_lk", "left")
    return g.select(
        label,
        "n",
        "n_attack",
        (F.col("n") - F.col("n_attack")).alias("n_benign"),
        "tp", "fn", "fp", "tn",
        F.round(ratio_or_null(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(ratio_or_null(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"),
        r6("mean_score").alias("mean_score"),
        r6("median_score").alias("median_score"),
    )


def detection_tiers(per_label: DataFrame, label: str = "label") -> DataFrame:
    """Attack labels only (benign removed, case-insensitive) with a tier."""
    recall = F.coalesce(F.col("recall"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))))
    attacks = per_label.filter(F.lower(F.col(label)) != "benign").withColumn("r", recall)
    tier = (
        F.when((F.col("tp") == 0) | (F.coalesce(F.col("r"), F.lit(0.0)) == 0), F.lit("undetected"))
        .when(F.col("r") < 0.20, F.lit("weak"))
        .when((F.col("r") >= 0.80) & (F.col("tp") + F.col("fn") >= 100), F.lit("good"))
        .otherwise(F.lit("moderate"))
    )
    return attacks.select(
        label, "tp", "fn", (F.col("tp") + F.col("fn")).alias("support"),
        F.round(F.coalesce(F.col("r"), F.lit(0.0)) * 100, 2).alias("recall_pct"), tier.alias("tier"),
    )


def baselines(df: DataFrame, truth: str = "truth", pred: str = "prediction") -> DataFrame:
    """Model metrics beside always-normal and always-anomaly predictors (3 rows)."""
    model = df.select(F.lit("model").alias("predictor"), F.col(truth).alias("t"), F.col(pred).alias("p"))
    normal = df.select(F.lit("always_normal").alias("predictor"), F.col(truth).alias("t"), F.lit(0).alias("p"))
    anomaly = df.select(F.lit("always_anomaly").alias("predictor"), F.col(truth).alias("t"), F.lit(1).alias("p"))
    c = model.unionByName(normal).unionByName(anomaly).groupBy("predictor").agg(*confusion_sums("t", "p"))
    return c.select("predictor", *metric_columns(names=("accuracy", "precision", "recall", "f1_score")))


def error_by_cell(df: DataFrame, score: str = "score", truth: str = "truth", pred: str = "prediction") -> DataFrame:
    cell = (
        F.when((F.col(truth) == 0) & (F.col(pred) == 0), "TN")
        .when((F.col(truth) == 0) & (F.col(pred) == 1), "FP")
        .when((F.col(truth) == 1) & (F.col(pred) == 1), "TP")
        .when((F.col(truth) == 1) & (F.col(pred) == 0), "FN")
    )
    return df.filter(F.col(truth).isNotNull()).groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.round(F.min(score), 6).alias("min_score"),
        F.round(F.max(score), 6).alias("max_score"),
    )


# -- F15 / F16 / F17 ----------------------------------------------------------------

def density_histogram(df: DataFrame, score: str, cap_p: float = 0.995, bins: int = 80) -> DataFrame:
    """Scores <= their p99.5 in ``bins`` equal-width bins over [min, max]; density = count / (n * width)."""
    cap = exact_percentiles(df, score, [cap_p])[0]
    kept = df.filter(F.col(score) <= F.lit(cap).cast("double"))  # no scores: no bins
    st = kept.agg(F.min(score).alias("mn"), F.max(score).alias("mx"), F.count(F.lit(1)).alias("n"))
    w = (F.col("mx") - F.col("mn")) / bins
    b = F.when(w > 0, F.least(F.lit(bins), F.floor((F.col(score) - F.col("mn")) / w).cast("int") + 1)).otherwise(1)
    c = kept.crossJoin(F.broadcast(st)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(st)).select(
        "bin",
        F.round(F.col("mn") + (F.col("bin") - 1) * w, 6).alias("lo"),
        F.round(F.when(w > 0, F.col("k") / (F.col("n") * w)), 6).alias("density"),
    )


def kde_grid(df: DataFrame, score: str, cap_p: float = 0.995, points: int = 500, factor: float = 0.3) -> DataFrame:
    """Gaussian KDE (bandwidth = factor x sample std) of scores <= p99.5 on ``points`` grid points in [0, cap].

    Every score adds its kernel to the grid: a task keeps one sum per grid point
    and emits ``points`` rows, so the shuffle does not grow with the rows.  Scores
    without spread give NULL densities, no scores no rows.
    """
    cap = exact_percentiles(df, score, [cap_p])[0]
    if cap is None:
        return df.sparkSession.createDataFrame([], "g int, x double, density double")
    kept = df.filter(F.col(score) <= F.lit(cap)).select(F.col(score).cast("double").alias("v"))
    st = kept.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd")).first()
    n, h, step = st["n"], (st["sd"] or 0.0) * factor, cap / (points - 1)
    grid = np.arange(points) * step

    def add_kernels(batches):
        total = np.zeros(points)
        for rb in batches:
            v = rb.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 1024):  # bounds the (points, rows) block
                total += np.exp(-0.5 * ((grid[:, None] - v[None, at:at + 1024]) / h) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], ["g", "s"])

    if h > 0:
        sums = kept.mapInArrow(add_kernels, "g int, s double").groupBy("g").agg(F.sum("s").alias("s"))
        density = F.col("s") / F.lit(n * h * math.sqrt(2 * math.pi))
    else:
        sums = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g"))
        density = F.lit(None).cast("double")
    return sums.select("g", F.round(F.col("g") * F.lit(step), 6).alias("x"), F.round(density, 6).alias("density"))


def best_by_metric(sweep: DataFrame, key: str = "percentile") -> DataFrame:
    """Per metric the sweep row that is best (max; min for fpr / fnr), ties -> smallest key."""
    rows = []
    for m, lower in [("f1_score", False), ("f2_score", False), ("recall", False), ("precision", False),
                     ("accuracy", False), ("fpr", True)]:
        order = F.struct((F.col(m) if lower else -F.col(m)).alias("v"), F.col(key).alias("k"))
        rows.append(sweep.filter(F.col(m).isNotNull()).agg(
            F.lit(m).alias("metric"), F.min_by(key, order).alias(key), F.min_by(m, order).alias("value")
        ))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def composite_rank(results: DataFrame, config: str, experiment: str = "experiment") -> DataFrame:
    """Rank configs per experiment on f1 / recall / roc_auc (high is good) and fpr (low is good); ties share
    the lowest rank; composite = mean rank (lower is better)."""
    from pyspark.sql import Window

    ranks = []
    for m, desc in [("f1_score", True), ("recall", True), ("roc_auc", True), ("fpr", False)]:
        w = Window.partitionBy(experiment).orderBy(F.col(m).desc() if desc else F.col(m).asc())
        ranks.append(F.rank().over(w).alias(f"rank_{m}"))
    r = results.select(experiment, config, *ranks)
    return r.select(experiment, config, "rank_f1_score", "rank_recall", "rank_roc_auc", "rank_fpr",
                    ((F.col("rank_f1_score") + F.col("rank_recall") + F.col("rank_roc_auc") + F.col("rank_fpr")) / 4.0).alias("composite"))
