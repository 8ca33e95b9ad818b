"""Result-store queries (latest runs, pages, top anomalies, histograms, overview,
upload lists, global flows, exports with ground truth, timelines).

Per-upload / per-run top-k and pages use ``row_number() <= k`` windows, which
Spark plans as WindowGroupLimit: every map task keeps at most k rows per group
before the shuffle, so a hot upload cannot overload one task.  Latest-run
selection is a partial aggregation of ``max(struct(created_at, run_id))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import compare_cell, normalise_truth, severity, truth_is_text, truth_value
from flowlens.operators.ordering import ordered_scan

HISTOGRAM_BINS = 30
# fixed values: prediction label texts (English, Vietnamese)
LABEL_EN = {1: "anomaly", 0: "normal"}
LABEL_VI = {1: "Bất thường", 0: "Bình thường"}


def latest_runs(runs: DataFrame) -> DataFrame:
    """One run per upload: newest created_at, ties by larger run_id."""
    best = runs.groupBy("upload_id").agg(F.max(F.struct("created_at", "run_id")).alias("_k"))
    return runs.join(
        best.select("upload_id", F.col("_k.run_id").alias("run_id")), ["upload_id", "run_id"], "left_semi"
    )


def find_run(uploads: DataFrame, runs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(upload_id, run_id, status) of the requested or else the latest run.

    ``wanted``: (upload_id, run_id) requests, a null run_id meaning the latest;
    None asks for the latest run of every upload.  A run counts only under its
    own upload.  Status ``ok``, ``no_run`` or ``no_upload``.
    """
    if wanted is None:
        wanted = uploads.select("upload_id", F.lit(None).cast("long").alias("run_id"))
    latest = latest_runs(runs).select("upload_id", F.col("run_id").alias("_latest"))
    own = runs.select("upload_id", "run_id", F.lit(True).alias("_own"))
    known = uploads.select("upload_id", F.lit(True).alias("_known"))
    asked = (
        wanted.select("upload_id", "run_id").join(known, "upload_id", "left")
        .join(latest, "upload_id", "left").join(own, ["upload_id", "run_id"], "left")
    )
    found = F.when(F.col("run_id").isNull(), F.col("_latest")).when(F.col("_own"), F.col("run_id"))
    return asked.select(
        "upload_id", found.alias("run_id"),
        F.when(F.col("_known").isNull(), "no_upload").when(found.isNull(), "no_run").otherwise("ok").alias("status"),
    )


def page_by_group(df: DataFrame, group: str, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows (page-1)*size+1 .. page*size of each group, with page metadata."""
    w = Window.partitionBy(group).orderBy(*order)
    lo, hi = (page - 1) * size, page * size
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= hi).filter(F.col("_rn") > lo)
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, group).select(
        "*",
        F.ceil(F.col("total") / F.lit(size)).cast("long").alias("total_pages"),
        F.lit(page > 1).alias("has_previous"),
        (F.lit(page) < F.ceil(F.col("total") / F.lit(size))).alias("has_next"),
    ).drop("_rn")


def results_page(predictions: DataFrame, rows: DataFrame, runs: DataFrame, page: int, size: int) -> DataFrame:
    """Page of every latest run, ordered by row_index: predictions are paged first and only
    the rows of the page meet their payload (every prediction has its row: A14 checks it)."""
    if not 1 <= size <= 100 or page < 1:
        raise ValueError("page >= 1 and 1 <= size <= 100")
    lr = latest_runs(runs).select("run_id", "threshold")
    p = predictions.join(lr, "run_id", "left_semi")
    paged = page_by_group(p, "run_id", [F.col("row_index")], page, size)
    return paged.join(rows.hint("merge"), ["upload_id", "row_index"], "inner")  # see export_results


def top_anomalies(predictions: DataFrame, runs: DataFrame, k: int = 100) -> DataFrame:
    """Per latest run: anomalies by error desc, row_index asc, first k."""
    lr = latest_runs(runs).select("run_id")
    a = predictions.filter(F.col("prediction") == 1).join(lr, "run_id", "left_semi")
    w = Window.partitionBy("run_id").orderBy(F.col("reconstruction_error").desc(), F.col("row_index").asc())
    return a.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def histogram(pred: DataFrame, group: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of reconstruction_error per group, zero-filled, labelled by lower edge."""
    stats = pred.groupBy(*group).agg(F.min("reconstruction_error").alias("mn"), F.max("reconstruction_error").alias("mx"))
    x = F.col("reconstruction_error")
    span = F.col("mx") - F.col("mn")
    bucket = F.when(span > 0, F.least(F.lit(bins), F.floor((x - F.col("mn")) / span * bins).cast("int") + 1)).otherwise(1)
    joined = pred.join(stats, group, "inner") if group else pred.crossJoin(stats)
    counted = joined.groupBy(*group, bucket.alias("bucket")).agg(
        F.sum(F.when(F.col("prediction") == 1, 1).otherwise(0)).cast("long").alias("anomaly"),
        F.sum(F.when(F.col("prediction") == 1, 0).otherwise(1)).cast("long").alias("normal"),
    )
    grid = stats.crossJoin(pred.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bucket")))
    step = F.when(span > 0, span / bins).otherwise(F.lit(1.0))
    return grid.join(counted, [*group, "bucket"], "left").select(
        *group,
        "bucket",
        F.format_string("%.4f", F.col("mn") + (F.col("bucket") - 1) * step).alias("bin"),
        F.coalesce("normal", F.lit(0)).cast("long").alias("normal"),
        F.coalesce("anomaly", F.lit(0)).cast("long").alias("anomaly"),
    )


def overview(uploads: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals over uploads and over the latest run of each upload (one row)."""
    u = uploads.agg(
        F.count(F.lit(1)).alias("total_uploads"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("total_uploaded_flows")
    )
    lr = latest_runs(runs).agg(
        F.count("run_id").alias("analyzed_uploads"),
        F.coalesce(F.sum("total_flows"), F.lit(0)).cast("long").alias("total_analyzed_flows"),
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).cast("long").alias("anomaly_count"),
        F.coalesce(F.sum("normal_count"), F.lit(0)).cast("long").alias("normal_count"),
    )
    return u.crossJoin(lr).withColumn(
        "anomaly_rate",
        F.when(F.col("total_analyzed_flows") > 0, F.col("anomaly_count") / F.col("total_analyzed_flows")).otherwise(0.0),
    )


def latest_activity(uploads: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest latest-run with its upload; else newest upload with NULL run (one row)."""
    lr = latest_runs(runs).join(uploads.select("upload_id", "filename", F.col("created_at").alias("uploaded_at")), "upload_id")
    with_run = lr.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(1).select(
        "upload_id", "run_id", "filename", "uploaded_at", F.col("created_at").alias("predicted_at"), F.lit(0).alias("pri")
    )
    no_run = uploads.orderBy(F.col("created_at").desc(), F.col("upload_id").desc()).limit(1).select(
        "upload_id", F.lit(None).cast("long").alias("run_id"), "filename", F.col("created_at").alias("uploaded_at"),
        F.lit(None).cast("timestamp_ntz").alias("predicted_at"), F.lit(1).alias("pri"),
    )
    return with_run.unionByName(no_run).orderBy("pri").limit(1).drop("pri")


def list_uploads(uploads: DataFrame, runs: DataFrame, status: str, page: int, size: int) -> DataFrame:
    """uploads left join latest runs; filter analyzed / pending / all; ordered page."""
    lr = latest_runs(runs).select("upload_id", "run_id", "total_flows", "anomaly_count", "normal_count")
    j = uploads.join(lr, "upload_id", "left")
    if status == "analyzed":
        j = j.filter(F.col("run_id").isNotNull())
    elif status == "pending":
        j = j.filter(F.col("run_id").isNull())
    elif status != "all":
        raise ValueError(status)
    out = j.select(
        "upload_id", "filename", "row_count", "col_count", "created_at", "run_id",
        F.coalesce("anomaly_count", F.lit(0)).cast("long").alias("anomaly_count"),
        F.coalesce("normal_count", F.lit(0)).cast("long").alias("normal_count"),
        F.when(F.col("run_id").isNull(), "pending").otherwise("completed").alias("status"),
    )
    return out.orderBy(F.col("row_count").desc(), F.col("created_at").desc(), F.col("upload_id").desc()).offset(
        (page - 1) * size
    ).limit(size)


def global_flows(predictions: DataFrame, runs: DataFrame, uploads: DataFrame, prediction: int | None,
                 page: int, size: int) -> DataFrame:
    """Predictions of latest runs with upload info; newest run first, then row order."""
    lr = latest_runs(runs).select("run_id", "upload_id", F.col("created_at").alias("run_created_at"))
    p = predictions if prediction is None else predictions.filter(F.col("prediction") == prediction)
    j = p.join(lr, ["run_id", "upload_id"]).join(uploads.select("upload_id", "filename"), "upload_id")
    return j.select(
        "upload_id", "filename", "run_id", "row_index", "reconstruction_error", "prediction", "run_created_at"
    ).orderBy(F.col("run_created_at").desc(), F.col("run_id").desc(), F.col("row_index").asc()).offset(
        (page - 1) * size
    ).limit(size)


def resolve_truth(rows: DataFrame, *extra: Column) -> DataFrame:
    """Per stored row: actual_label (raw text under the first truth key) and actual_binary."""
    v = truth_value("payload")
    return rows.select(
        "upload_id", "row_index", v.alias("actual_label"), normalise_truth(v, truth_is_text("payload")).alias("actual_binary"),
        *extra,
    )


def has_source_file(rows: DataFrame) -> bool:
    """Whether any stored payload names its source file (stops at the first one)."""
    return bool(rows.filter(F.get_json_object("payload", "$._source_file").isNotNull()).take(1))


def export_results(predictions: DataFrame, rows: DataFrame, runs: DataFrame, prediction: str = "all",
                   sort: str | None = None, source_file: bool = False) -> DataFrame:
    """Export rows for every latest run, with labels, severity, truth and compare cell.

    ``sort``: ``idx``, ``err_desc`` or ``err_asc`` inside a run (ties by row_index), a
    range-partitioned sort; None leaves the order open.  ``source_file`` adds
    ``original_source_file`` (empty where a payload has none).
    """
    error = F.col("reconstruction_error")
    orders = {"idx": [], "err_desc": [error.desc()], "err_asc": [error.asc()]}
    if sort is not None and sort not in orders:
        raise ValueError(f"unsupported sort {sort}")
    lr = latest_runs(runs).select("run_id", "threshold")
    p = predictions.join(lr, "run_id")
    if prediction == "anomaly":
        p = p.filter(F.col("prediction") == 1)
    elif prediction == "normal":
        p = p.filter(F.col("prediction") == 0)
    named = F.get_json_object("payload", "$._source_file").alias("_source_file")
    truth = resolve_truth(rows, *([named] if source_file else []))
    # sort-merge: stored rows may be a hundredth of their size as Parquet, which the planner takes for small and would broadcast
    j = p.join(truth.hint("merge"), ["upload_id", "row_index"], "left")
    out = j.select(
        (F.col("row_index") + 1).alias("flow_no"),
        "run_id",
        "row_index",
        "reconstruction_error",
        "threshold",
        "prediction",
        F.when(F.col("prediction") == 1, LABEL_EN[1]).otherwise(LABEL_EN[0]).alias("predicted_label_en"),
        F.when(F.col("prediction") == 1, LABEL_VI[1]).otherwise(LABEL_VI[0]).alias("predicted_label_vi"),
        severity("reconstruction_error", F.col("threshold")).alias("severity"),
        F.coalesce("actual_label", F.lit("N/A")).alias("actual_label"),
        F.coalesce(F.col("actual_binary").cast("string"), F.lit("N/A")).alias("actual_binary"),
        compare_cell("prediction", "actual_binary").alias("compare_result"),
        *([F.coalesce("_source_file", F.lit("")).alias("original_source_file")] if source_file else []),
    )
    return out if sort is None else out.orderBy("run_id", *orders[sort], "row_index")


def _fmt_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit("N/A")).otherwise(F.format_string("%.6f", num / den))


def export_summary(export: DataFrame) -> DataFrame:
    """Per run: count, has_ground_truth, TP/FP/TN/FN and ratio texts; zero denominators -> N/A."""
    c = export.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_exported"),
        *[F.sum(F.when(F.col("compare_result") == k, 1).otherwise(0)).cast("long").alias(k) for k in ("TP", "FP", "TN", "FN")],
    )
    has = (F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")) > 0
    tp, fp, tn, fn = (F.col(k) for k in ("TP", "FP", "TN", "FN"))
    prec = tp / (tp + fp)
    rec = tp / (tp + fn)
    f1 = F.when(
        ((tp + fp) == 0) | ((tp + fn) == 0) | (tp == 0), F.lit("N/A")
    ).otherwise(F.format_string("%.6f", 2 * prec * rec / (prec + rec)))
    return c.select(
        "run_id",
        "total_exported",
        F.when(has, "true").otherwise("false").alias("has_ground_truth"),
        *[F.when(has, F.col(k).cast("string")).otherwise("N/A").alias(k.lower()) for k in ("TP", "FP", "TN", "FN")],
        _fmt_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _fmt_ratio(tp, tp + fp).alias("precision"),
        _fmt_ratio(tp, tp + fn).alias("recall"),
        f1.alias("f1_score"),
    )


def severity_counts(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per latest run: critical/high/medium/low counts over alert rows, zeros kept."""
    lr = latest_runs(runs).select("run_id", "threshold")
    a = predictions.filter(F.col("prediction") == 1).join(lr, "run_id")
    c = a.groupBy("run_id", severity("reconstruction_error", F.col("threshold")).alias("severity")).count()
    levels = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")])
    grid = lr.select("run_id", F.explode(levels).alias("severity"))
    return grid.join(c, ["run_id", "severity"], "left").select(
        "run_id", "severity", F.coalesce("count", F.lit(0)).cast("long").alias("n")
    )


def row_timeline(predictions: DataFrame, runs: DataFrame, buckets: int = 12) -> DataFrame:
    """Per latest run: min(b, n) contiguous buckets of ceil(n / b) rows in row order."""
    lr = latest_runs(runs).select("run_id", F.col("total_flows").alias("n"))
    p = predictions.join(lr, "run_id")
    idx = ordered_scan(p, order_cols=["row_index"], group_cols=["run_id"], index_col="pos")
    size = F.ceil(F.col("n") / F.least(F.lit(buckets), F.col("n")))
    b = F.floor(F.col("pos") / size).cast("int")
    c = idx.groupBy("run_id", b.alias("bucket")).agg(
        F.sum(F.when(F.col("prediction") == 1, 1).otherwise(0)).cast("long").alias("anomaly"),
        F.sum(F.when(F.col("prediction") == 1, 0).otherwise(1)).cast("long").alias("normal"),
    )
    grid = lr.select("run_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(buckets), F.col("n")) - 1)).alias("bucket"))
    return grid.join(c, ["run_id", "bucket"], "left").select(
        "run_id", "bucket", F.coalesce("normal", F.lit(0)).alias("normal"), F.coalesce("anomaly", F.lit(0)).alias("anomaly")
    )
