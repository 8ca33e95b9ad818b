"""Registered queries over the result store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators import results as R
from flowlens.plans import bindings as B
from flowlens.plans.views_sql import STORE, with_views
from flowlens.session import scratch_dir
from flowlens.sources import result_store as S
from flowlens.sources.commits import CommitConflict, CommitLog

PAGE, PAGE_SIZE = 2, 2

_LATEST = """latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs)
  WHERE rn = 1)"""


def _st(spark, sf):
    return B.store(spark, sf)


def q_latest_runs(spark, sf):
    st = _st(spark, sf)
    return R.latest_runs(st["runs"]).select("upload_id", "run_id", "created_at", "total_flows", "anomaly_count")


SQL_LATEST_RUNS = with_views(
    "SELECT upload_id, run_id, created_at, total_flows, anomaly_count FROM latest", STORE, _LATEST
)


def q_find_run(spark, sf):
    st = _st(spark, sf)
    return R.find_run(st["uploads"], st["runs"])


def q_find_given_run(spark, sf):
    """G2 with requests: every run under its own upload and under the next one, the latest, and an unknown upload."""
    st = _st(spark, sf)
    own = st["runs"].select("upload_id", "run_id")
    wanted = (
        own.unionByName(own.select((F.col("upload_id") + 1).alias("upload_id"), "run_id"))
        .unionByName(st["uploads"].select("upload_id", F.lit(None).cast("long").alias("run_id")))
    )
    return R.find_run(st["uploads"], st["runs"], wanted)


SQL_FIND_GIVEN_RUN = with_views("""
, wanted AS (
  SELECT upload_id, run_id FROM runs UNION ALL SELECT upload_id + 1, run_id FROM runs
  UNION ALL SELECT upload_id, NULL FROM uploads
), found AS (
  SELECT w.upload_id, CASE WHEN w.run_id IS NULL THEN l.run_id ELSE r.run_id END AS run_id,
         u.upload_id IS NOT NULL AS known
  FROM wanted w LEFT JOIN latest l ON l.upload_id = w.upload_id
  LEFT JOIN runs r ON r.upload_id = w.upload_id AND r.run_id = w.run_id
  LEFT JOIN uploads u ON u.upload_id = w.upload_id
)
SELECT upload_id, run_id, CASE WHEN NOT known THEN 'no_upload' WHEN run_id IS NULL THEN 'no_run' ELSE 'ok' END AS status
FROM found""", STORE, _LATEST)


SQL_FIND_RUN = with_views("""
SELECT u.upload_id, l.run_id, CASE WHEN l.run_id IS NULL THEN 'no_run' ELSE 'ok' END AS status
FROM uploads u LEFT JOIN latest l ON u.upload_id = l.upload_id""", STORE, _LATEST)


def q_results_page(spark, sf):
    st = _st(spark, sf)
    page = R.results_page(st["predictions"], st["rows"], st["runs"], PAGE, PAGE_SIZE)
    return page.select("run_id", "row_index", "reconstruction_error", "prediction", "payload", "total",
                       "total_pages", "has_previous", "has_next")


SQL_RESULTS_PAGE = with_views("""
SELECT run_id, row_index, reconstruction_error, prediction, payload, total,
       CAST(ceil(total / 2.0) AS BIGINT) AS total_pages, true AS has_previous, 2 < ceil(total / 2.0) AS has_next
FROM (
  SELECT p.run_id, p.row_index, p.reconstruction_error, p.prediction, r.payload,
         row_number() OVER (PARTITION BY p.run_id ORDER BY p.row_index) AS rn,
         count(*) OVER (PARTITION BY p.run_id) AS total
  FROM predictions p JOIN rows_t r ON p.upload_id = r.upload_id AND p.row_index = r.row_index
  WHERE p.run_id IN (SELECT run_id FROM latest)) x
WHERE rn > 2 AND rn <= 4""", STORE, _LATEST)


def q_top_anomalies(spark, sf):
    st = _st(spark, sf)
    return R.top_anomalies(st["predictions"], st["runs"], 100).select("run_id", "row_index", "reconstruction_error", "rank")


SQL_TOP_ANOMALIES = with_views("""
SELECT run_id, row_index, reconstruction_error, rank FROM (
  SELECT run_id, row_index, reconstruction_error,
         CAST(row_number() OVER (PARTITION BY run_id ORDER BY reconstruction_error DESC, row_index ASC) AS INTEGER) AS rank
  FROM predictions WHERE prediction = 1 AND run_id IN (SELECT run_id FROM latest)) x
WHERE rank <= 100""", STORE, _LATEST)


_HIST_SQL = """
, hs AS (SELECT {g}, min(reconstruction_error) AS mn, max(reconstruction_error) AS mx FROM hp GROUP BY {g}),
hc AS (
  SELECT {gp}, CASE WHEN mx > mn THEN least(30, CAST(floor((reconstruction_error - mn) / (mx - mn) * 30) AS INTEGER) + 1)
                    ELSE 1 END AS bucket,
         CAST(sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS anomaly,
         CAST(sum(CASE WHEN prediction = 1 THEN 0 ELSE 1 END) AS BIGINT) AS normal
  FROM hp JOIN hs USING ({g}) GROUP BY ALL)
SELECT {gs}, CAST(b.bucket AS INTEGER) AS bucket,
       printf('%.4f', hs.mn + (b.bucket - 1) * CASE WHEN hs.mx > hs.mn THEN (hs.mx - hs.mn) / 30 ELSE 1.0 END) AS bin,
       CAST(coalesce(hc.normal, 0) AS BIGINT) AS normal, CAST(coalesce(hc.anomaly, 0) AS BIGINT) AS anomaly
FROM hs CROSS JOIN (SELECT unnest(range(1, 31)) AS bucket) b
LEFT JOIN hc ON hc.{g} = hs.{g} AND hc.bucket = b.bucket"""


def q_histogram30(spark, sf):
    st = _st(spark, sf)
    lr = R.latest_runs(st["runs"]).select("run_id")
    p = st["predictions"].join(lr, "run_id", "left_semi")
    return R.histogram(p, ["run_id"])


SQL_HISTOGRAM30 = with_views(
    "SELECT * FROM (WITH hp AS (SELECT * FROM predictions WHERE run_id IN (SELECT run_id FROM latest))"
    + _HIST_SQL.format(g="run_id", gp="hp.run_id", gs="hs.run_id") + ")",
    STORE, _LATEST,
)


def q_overview(spark, sf):
    st = _st(spark, sf)
    o = R.overview(st["uploads"], st["runs"])
    return o.withColumn("anomaly_rate", F.round("anomaly_rate", 6))


SQL_OVERVIEW = with_views("""
SELECT u.total_uploads, u.total_uploaded_flows, l.analyzed_uploads, l.total_analyzed_flows, l.anomaly_count,
       l.normal_count,
       round(CASE WHEN l.total_analyzed_flows > 0 THEN l.anomaly_count * 1.0 / l.total_analyzed_flows ELSE 0.0 END, 6)
         AS anomaly_rate
FROM (SELECT CAST(count(*) AS BIGINT) AS total_uploads, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_uploaded_flows
      FROM uploads) u
CROSS JOIN (SELECT CAST(count(run_id) AS BIGINT) AS analyzed_uploads,
                   CAST(coalesce(sum(total_flows), 0) AS BIGINT) AS total_analyzed_flows,
                   CAST(coalesce(sum(anomaly_count), 0) AS BIGINT) AS anomaly_count,
                   CAST(coalesce(sum(normal_count), 0) AS BIGINT) AS normal_count FROM latest) l""", STORE, _LATEST)


def q_overview_histogram(spark, sf):
    st = _st(spark, sf)
    lr = R.latest_runs(st["runs"]).select("run_id")
    p = st["predictions"].join(lr, "run_id", "left_semi").withColumn("_all", F.lit(1))
    return R.histogram(p, ["_all"]).drop("_all")


SQL_OVERVIEW_HISTOGRAM = with_views(
    "SELECT bucket, bin, normal, anomaly FROM (WITH hp AS (SELECT *, 1 AS _all FROM predictions "
    "WHERE run_id IN (SELECT run_id FROM latest))"
    + _HIST_SQL.format(g="_all", gp="hp._all", gs="hs._all") + ")",
    STORE, _LATEST,
)


def q_latest_activity(spark, sf):
    st = _st(spark, sf)
    return R.latest_activity(st["uploads"], st["runs"])


SQL_LATEST_ACTIVITY = with_views("""
SELECT upload_id, run_id, filename, uploaded_at, predicted_at FROM (
  SELECT * FROM (SELECT l.upload_id, l.run_id, u.filename, u.created_at AS uploaded_at, l.created_at AS predicted_at, 0 AS pri
                 FROM latest l JOIN uploads u ON l.upload_id = u.upload_id
                 ORDER BY l.created_at DESC, l.run_id DESC LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT upload_id, CAST(NULL AS BIGINT), filename, created_at, CAST(NULL AS TIMESTAMP), 1
                 FROM uploads ORDER BY created_at DESC, upload_id DESC LIMIT 1)
) x ORDER BY pri LIMIT 1""", STORE, _LATEST)


def _list_sql(where: str) -> str:
    return with_views(f"""
SELECT u.upload_id, u.filename, u.row_count, u.col_count, u.created_at, l.run_id,
       CAST(coalesce(l.anomaly_count, 0) AS BIGINT) AS anomaly_count,
       CAST(coalesce(l.normal_count, 0) AS BIGINT) AS normal_count,
       CASE WHEN l.run_id IS NULL THEN 'pending' ELSE 'completed' END AS status
FROM uploads u LEFT JOIN latest l ON u.upload_id = l.upload_id
{where}
ORDER BY u.row_count DESC, u.created_at DESC, u.upload_id DESC LIMIT 20 OFFSET 0""", STORE, _LATEST)


def q_list_uploads_all(spark, sf):
    st = _st(spark, sf)
    return R.list_uploads(st["uploads"], st["runs"], "all", 1, 20)


def q_list_uploads_pending(spark, sf):
    st = _st(spark, sf)
    return R.list_uploads(st["uploads"], st["runs"], "pending", 1, 20)


def q_global_flows(spark, sf):
    st = _st(spark, sf)
    return R.global_flows(st["predictions"], st["runs"], st["uploads"], 1, 1, 50)


SQL_GLOBAL_FLOWS = with_views("""
SELECT p.upload_id, u.filename, p.run_id, p.row_index, p.reconstruction_error, p.prediction, l.created_at AS run_created_at
FROM predictions p JOIN latest l ON p.run_id = l.run_id AND p.upload_id = l.upload_id
JOIN uploads u ON p.upload_id = u.upload_id
WHERE p.prediction = 1
ORDER BY l.created_at DESC, p.run_id DESC, p.row_index ASC LIMIT 50""", STORE, _LATEST)


_TRUTH_SQL = """truth AS (
  SELECT upload_id, row_index, actual_label,
         CASE WHEN actual_label IS NULL OR trim(actual_label) = '' THEN NULL
              WHEN lower(strip_accents(trim(actual_label))) = 'false' THEN 0
              WHEN lower(strip_accents(trim(actual_label))) = 'true' THEN 1
              WHEN jt <> 'VARCHAR' AND TRY_CAST(actual_label AS DOUBLE) = 0 THEN 0
              WHEN jt <> 'VARCHAR' AND TRY_CAST(actual_label AS DOUBLE) = 1 THEN 1
              WHEN lower(strip_accents(trim(actual_label))) IN ('0', 'benign', 'normal', 'binh thuong') THEN 0
              ELSE 1 END AS actual_binary
  FROM (SELECT upload_id, row_index,
               CASE WHEN tk IS NOT NULL THEN json_extract_string(payload, '$."' || tk || '"') END AS actual_label,
               CASE WHEN tk IS NOT NULL THEN json_type(payload, '$."' || tk || '"') END AS jt
        FROM (SELECT upload_id, row_index, payload,
                     list_filter(json_keys(payload), lambda k: lower(trim(k)) IN ('label', 'actual_label', 'true_label', 'binary_label'))[1] AS tk
              FROM rows_t) a) b)"""


def q_ground_truth(spark, sf):
    """G13 + G14: truth key resolution and normalisation for every stored row."""
    st = _st(spark, sf)
    return R.resolve_truth(st["rows"])


SQL_GROUND_TRUTH = with_views("SELECT upload_id, row_index, actual_label, actual_binary FROM truth", STORE, _TRUTH_SQL)


_EXPORT_SQL = """export AS (
  SELECT p.run_id, p.row_index + 1 AS flow_no, p.row_index, p.reconstruction_error, l.threshold, p.prediction,
         CASE WHEN p.prediction = 1 THEN 'anomaly' ELSE 'normal' END AS predicted_label_en,
         CASE WHEN p.prediction = 1 THEN 'Bất thường' ELSE 'Bình thường' END AS predicted_label_vi,
         CASE WHEN p.reconstruction_error > l.threshold * 2.0 THEN 'critical'
              WHEN p.reconstruction_error > l.threshold * 1.5 THEN 'high'
              WHEN p.reconstruction_error > l.threshold THEN 'medium' ELSE 'low' END AS severity,
         coalesce(t.actual_label, 'N/A') AS actual_label,
         coalesce(CAST(t.actual_binary AS VARCHAR), 'N/A') AS actual_binary,
         CASE WHEN t.actual_binary IS NULL THEN 'N/A'
              WHEN p.prediction = 1 AND t.actual_binary = 1 THEN 'TP'
              WHEN p.prediction = 1 AND t.actual_binary = 0 THEN 'FP'
              WHEN p.prediction = 0 AND t.actual_binary = 0 THEN 'TN'
              WHEN p.prediction = 0 AND t.actual_binary = 1 THEN 'FN' ELSE 'N/A' END AS compare_result
  FROM predictions p JOIN latest l ON p.run_id = l.run_id
  LEFT JOIN truth t ON p.upload_id = t.upload_id AND p.row_index = t.row_index)"""


def q_export_results(spark, sf):
    st = _st(spark, sf)
    return R.export_results(st["predictions"], st["rows"], st["runs"])


SQL_EXPORT_RESULTS = with_views("SELECT * FROM export", STORE, _LATEST, _TRUTH_SQL, _EXPORT_SQL)


def q_export_summary(spark, sf):
    st = _st(spark, sf)
    return R.export_summary(R.export_results(st["predictions"], st["rows"], st["runs"]))


SQL_EXPORT_SUMMARY = with_views("""
SELECT run_id, total_exported, CASE WHEN TP + FP + TN + FN > 0 THEN 'true' ELSE 'false' END AS has_ground_truth,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(TP AS VARCHAR) ELSE 'N/A' END AS tp,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(FP AS VARCHAR) ELSE 'N/A' END AS fp,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(TN AS VARCHAR) ELSE 'N/A' END AS tn,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(FN AS VARCHAR) ELSE 'N/A' END AS fn,
       CASE WHEN TP + TN + FP + FN = 0 THEN 'N/A' ELSE printf('%.6f', (TP + TN) * 1.0 / (TP + TN + FP + FN)) END AS accuracy,
       CASE WHEN TP + FP = 0 THEN 'N/A' ELSE printf('%.6f', TP * 1.0 / (TP + FP)) END AS precision,
       CASE WHEN TP + FN = 0 THEN 'N/A' ELSE printf('%.6f', TP * 1.0 / (TP + FN)) END AS recall,
       CASE WHEN TP + FP = 0 OR TP + FN = 0 OR TP = 0 THEN 'N/A'
            ELSE printf('%.6f', 2.0 * (TP * 1.0 / (TP + FP)) * (TP * 1.0 / (TP + FN))
                                / ((TP * 1.0 / (TP + FP)) + (TP * 1.0 / (TP + FN)))) END AS f1_score
FROM (SELECT run_id, CAST(count(*) AS BIGINT) AS total_exported,
             sum(CASE WHEN compare_result = 'TP' THEN 1 ELSE 0 END) AS TP,
             sum(CASE WHEN compare_result = 'FP' THEN 1 ELSE 0 END) AS FP,
             sum(CASE WHEN compare_result = 'TN' THEN 1 ELSE 0 END) AS TN,
             sum(CASE WHEN compare_result = 'FN' THEN 1 ELSE 0 END) AS FN
      FROM export GROUP BY run_id) c""", STORE, _LATEST, _TRUTH_SQL, _EXPORT_SQL)


def q_page_view_filter(spark, sf):
    """Inside page 1 (size 100) of each latest run: normal rows whose row index contains '1', error desc."""
    st = _st(spark, sf)
    page = R.results_page(st["predictions"], st["rows"], st["runs"], 1, 100)
    f = page.filter((F.col("prediction") == 0) & F.col("row_index").cast("string").contains("1"))
    w = Window.partitionBy("run_id").orderBy(F.col("reconstruction_error").desc(), F.col("row_index"))
    return f.select("run_id", "row_index", "reconstruction_error", F.row_number().over(w).alias("pos"))


SQL_PAGE_VIEW_FILTER = with_views("""
SELECT run_id, row_index, reconstruction_error,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY reconstruction_error DESC, row_index) AS INTEGER) AS pos
FROM (SELECT p.*, row_number() OVER (PARTITION BY p.run_id ORDER BY p.row_index) AS rn
      FROM predictions p JOIN rows_t r ON p.upload_id = r.upload_id AND p.row_index = r.row_index
      WHERE p.run_id IN (SELECT run_id FROM latest)) x
WHERE rn <= 100 AND prediction = 0 AND contains(CAST(row_index AS VARCHAR), '1')""", STORE, _LATEST)


def q_severity_counts_store(spark, sf):
    st = _st(spark, sf)
    return R.severity_counts(st["predictions"], st["runs"])


SQL_SEVERITY_COUNTS_STORE = with_views("""
SELECT l.run_id, s.severity, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM latest l CROSS JOIN (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) s
LEFT JOIN (
  SELECT p.run_id, CASE WHEN p.reconstruction_error > l.threshold * 2.0 THEN 'critical'
                        WHEN p.reconstruction_error > l.threshold * 1.5 THEN 'high'
                        WHEN p.reconstruction_error > l.threshold THEN 'medium' ELSE 'low' END AS severity,
         count(*) AS n
  FROM predictions p JOIN latest l ON p.run_id = l.run_id WHERE p.prediction = 1 GROUP BY ALL) c
ON c.run_id = l.run_id AND c.severity = s.severity""", STORE, _LATEST)


def q_row_timeline(spark, sf):
    st = _st(spark, sf)
    return R.row_timeline(st["predictions"], st["runs"], 12)


SQL_ROW_TIMELINE = with_views("""
SELECT g.run_id, g.bucket, coalesce(c.normal, 0) AS normal, coalesce(c.anomaly, 0) AS anomaly
FROM (SELECT run_id, CAST(unnest(range(0, least(12, total_flows))) AS INTEGER) AS bucket FROM latest) g
LEFT JOIN (
  SELECT run_id, CAST(floor(pos / ceil(n / least(12, n))) AS INTEGER) AS bucket,
         CAST(sum(CASE WHEN prediction = 1 THEN 0 ELSE 1 END) AS BIGINT) AS normal,
         CAST(sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS anomaly
  FROM (SELECT p.run_id, p.prediction, l.total_flows AS n,
               row_number() OVER (PARTITION BY p.run_id ORDER BY p.row_index) - 1 AS pos
        FROM predictions p JOIN latest l ON p.run_id = l.run_id) x
  GROUP BY ALL) c ON g.run_id = c.run_id AND g.bucket = c.bucket""", STORE, _LATEST)


def q_load_upload(spark, sf):
    """Every upload's rows in row order as a typed frame, checked against metadata."""
    st = _st(spark, sf)
    return S.load_upload(st["rows"], st["uploads"], "k bigint, event_type string, Label string")


SQL_LOAD_UPLOAD = with_views("""
SELECT upload_id, row_index, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k,
       json_extract_string(payload, '$.event_type') AS event_type, json_extract_string(payload, '$.Label') AS Label
FROM rows_t""", STORE)


def q_delete_upload(spark, sf):
    """Remove the largest upload (and its rows, runs, predictions); remaining counts per table."""
    st = _st(spark, sf)
    victim = st["uploads"].orderBy(F.col("row_count").desc(), F.col("upload_id").desc()).limit(1).select("upload_id")
    kept = S.delete_upload(st, victim)
    return S.table_counts(kept)


def q_delete_committed(spark, sf):
    """A12 on a committed store: the largest upload and all uploads without rows are deleted by one
    manifest; per table what is left and the ends of the ids, read back from the store."""
    log = CommitLog(spark, scratch_dir(spark, "committed", unique=True))
    log.commit("load", adopt=B.store_paths(spark, sf))
    uploads = log.read()["uploads"]
    largest = uploads.orderBy(F.col("row_count").desc(), F.col("upload_id").desc()).first()["upload_id"]
    # the uploads that come from the nation table: as many as it has rows
    empty = [r["upload_id"] for r in uploads.filter("row_count = 0").select("upload_id").collect()]
    S.delete_committed(spark, log.root, [largest, *empty], txn="delete")
    S.delete_committed(spark, log.root, [largest, *empty], txn="delete")  # a retry changes nothing
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.min("upload_id").alias("first_id"),
                    F.max("upload_id").alias("last_id")) for name, df in S.read_committed(spark, log.root).items()]
    return reduce(DataFrame.unionByName, parts)


SQL_DELETE_COMMITTED = with_views("""
SELECT table_name, CAST(count(*) AS BIGINT) AS n, min(upload_id) AS first_id, max(upload_id) AS last_id FROM (
  SELECT 'uploads' AS table_name, upload_id FROM uploads UNION ALL SELECT 'rows', upload_id FROM rows_t
  UNION ALL SELECT 'runs', upload_id FROM runs UNION ALL SELECT 'predictions', upload_id FROM predictions) t
WHERE upload_id NOT IN (SELECT upload_id FROM victim) GROUP BY table_name""", STORE,
    """victim AS ((SELECT upload_id FROM uploads ORDER BY row_count DESC, upload_id DESC LIMIT 1)
  UNION ALL SELECT upload_id FROM uploads WHERE row_count = 0)""")


SQL_DELETE_UPLOAD = with_views("""
SELECT * FROM (
  SELECT 'uploads' AS table_name, CAST(count(*) AS BIGINT) AS n FROM uploads WHERE upload_id NOT IN (SELECT upload_id FROM victim)
  UNION ALL SELECT 'rows', CAST(count(*) AS BIGINT) FROM rows_t WHERE upload_id NOT IN (SELECT upload_id FROM victim)
  UNION ALL SELECT 'runs', CAST(count(*) AS BIGINT) FROM runs WHERE upload_id NOT IN (SELECT upload_id FROM victim)
  UNION ALL SELECT 'predictions', CAST(count(*) AS BIGINT) FROM predictions WHERE upload_id NOT IN (SELECT upload_id FROM victim))""",
    STORE, "victim AS (SELECT upload_id FROM uploads ORDER BY row_count DESC, upload_id DESC LIMIT 1)")


def q_save_run_check(spark, sf):
    """Validate every stored run against its rows (count and unknown row indexes)."""
    st = _st(spark, sf)
    return S.validate_runs(st["predictions"], st["runs"], st["rows"])


SQL_SAVE_RUN_CHECK = with_views("""
SELECT r.run_id, r.total_flows, CAST(coalesce(c.n_results, 0) AS BIGINT) AS n_results,
       CAST(coalesce(c.n_unknown, 0) AS BIGINT) AS n_unknown,
       r.total_flows = coalesce(c.n_results, 0) AND coalesce(c.n_unknown, 0) = 0 AS valid
FROM runs r LEFT JOIN (
  SELECT p.run_id, count(*) AS n_results, sum(CASE WHEN w.row_index IS NULL THEN 1 ELSE 0 END) AS n_unknown
  FROM predictions p LEFT JOIN rows_t w ON p.upload_id = w.upload_id AND p.row_index = w.row_index
  GROUP BY p.run_id) c ON r.run_id = c.run_id""", STORE)


def q_save_run(spark, sf):
    """The latest run of the upload with most runs is saved into a committed store that holds all other
    runs.  The first attempt fails after its predictions are written, the second saves it, a third
    changes nothing and a writer that started from the former version loses.  What readers see
    of the upload's runs, and the outcome of every attempt."""
    st = _st(spark, sf)
    upload = st["runs"].groupBy("upload_id").count().orderBy(F.col("count").desc(), "upload_id").first()["upload_id"]
    run_id = st["runs"].filter(F.col("upload_id") == upload).agg(F.max("run_id")).first()[0]
    mine = F.col("run_id") == run_id
    log = CommitLog(spark, scratch_dir(spark, "committed", unique=True))
    log.commit("load", replace={"runs": st["runs"].filter(~mine), "predictions": st["predictions"].filter(~mine)})
    base = log.snapshot()
    preds, run = st["predictions"].filter(mine), st["runs"].filter(mine)
    rows = st["rows"].filter(F.col("upload_id") == upload)
    broken = run.withColumn("threshold", F.raise_error(F.lit("writer lost")).cast("double"))
    outcomes = []
    for run_row, txn, start in ((broken, None, base), (run, None, base), (run, None, None), (run, "late writer", base)):
        try:
            seq = S.save_run(preds, run_row, rows, log.root, txn, start).seq
            outcomes.append(f"version {seq}")
        except CommitConflict:
            outcomes.append("conflict")
        except Exception as e:
            if "writer lost" not in str(e):
                raise
            outcomes.append("failed")
    got = S.read_committed(spark, log.root)
    counts = got["predictions"].filter(F.col("upload_id") == upload).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.sum("prediction").cast("long").alias("n_anomaly"),
        F.max("row_index").alias("last_row"))
    return got["runs"].filter(F.col("upload_id") == upload).join(counts, "run_id", "left").select(
        "run_id", "upload_id", "total_flows", "anomaly_count", "n_results", "n_anomaly", "last_row",
        F.when(mine, F.lit(", ".join(outcomes))).alias("outcomes"))


SQL_SAVE_RUN = with_views("""
SELECT r.run_id, r.upload_id, r.total_flows, r.anomaly_count, CAST(c.n AS BIGINT) AS n_results, CAST(c.a AS BIGINT) AS n_anomaly, c.m AS last_row,
       CASE WHEN r.run_id = max(r.run_id) OVER () THEN 'failed, version 2, version 2, conflict' END AS outcomes
FROM runs r JOIN (SELECT run_id, count(*) AS n, sum(prediction) AS a, max(row_index) AS m FROM predictions GROUP BY run_id) c
  ON r.run_id = c.run_id
WHERE r.upload_id = (SELECT upload_id FROM runs GROUP BY upload_id ORDER BY count(*) DESC, upload_id LIMIT 1)""", STORE)


def q_table_constraints(spark, sf):
    """Violation counts of the store constraints (all zero on a healthy store)."""
    st = _st(spark, sf)
    return S.constraint_violations(st)


SQL_TABLE_CONSTRAINTS = with_views("""
SELECT * FROM (
  SELECT 'prediction_domain' AS check_name, CAST(count(*) AS BIGINT) AS violations FROM predictions WHERE prediction NOT IN (0, 1)
  UNION ALL SELECT 'rows_unique', CAST(count(*) AS BIGINT) FROM (SELECT upload_id, row_index FROM rows_t GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'predictions_unique', CAST(count(*) AS BIGINT) FROM (SELECT run_id, row_index FROM predictions GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'rows_fk_upload', CAST(count(*) AS BIGINT) FROM rows_t r WHERE NOT EXISTS (SELECT 1 FROM uploads u WHERE u.upload_id = r.upload_id)
  UNION ALL SELECT 'runs_fk_upload', CAST(count(*) AS BIGINT) FROM runs r WHERE NOT EXISTS (SELECT 1 FROM uploads u WHERE u.upload_id = r.upload_id)
  UNION ALL SELECT 'predictions_fk_run', CAST(count(*) AS BIGINT) FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = p.run_id)
  UNION ALL SELECT 'predictions_fk_row', CAST(count(*) AS BIGINT) FROM predictions p WHERE NOT EXISTS (
      SELECT 1 FROM rows_t r WHERE r.upload_id = p.upload_id AND r.row_index = p.row_index))""", STORE)


QUERIES = {
    "g1_latest_runs": (q_latest_runs, SQL_LATEST_RUNS),
    "g2_find_run": (q_find_run, SQL_FIND_RUN),
    "g2_find_given_run": (q_find_given_run, SQL_FIND_GIVEN_RUN),
    "g3_results_page": (q_results_page, SQL_RESULTS_PAGE),
    "g4_top_anomalies": (q_top_anomalies, SQL_TOP_ANOMALIES),
    "g5_histogram30": (q_histogram30, SQL_HISTOGRAM30),
    "g6_overview": (q_overview, SQL_OVERVIEW),
    "g7_overview_histogram": (q_overview_histogram, SQL_OVERVIEW_HISTOGRAM),
    "g8_latest_activity": (q_latest_activity, SQL_LATEST_ACTIVITY),
    "g9_list_uploads_all": (q_list_uploads_all, _list_sql("")),
    "g9_list_uploads_pending": (q_list_uploads_pending, _list_sql("WHERE l.run_id IS NULL")),
    "g10_global_flows": (q_global_flows, SQL_GLOBAL_FLOWS),
    "g11_export_results": (q_export_results, SQL_EXPORT_RESULTS),
    "g12_export_summary": (q_export_summary, SQL_EXPORT_SUMMARY),
    "g13_g14_ground_truth": (q_ground_truth, SQL_GROUND_TRUTH),
    "g16_page_view_filter": (q_page_view_filter, SQL_PAGE_VIEW_FILTER),
    "g17_severity_counts": (q_severity_counts_store, SQL_SEVERITY_COUNTS_STORE),
    "g18_row_timeline": (q_row_timeline, SQL_ROW_TIMELINE),
    "a9_load_upload": (q_load_upload, SQL_LOAD_UPLOAD),
    "a12_delete_upload": (q_delete_upload, SQL_DELETE_UPLOAD),
    "a12_delete_committed": (q_delete_committed, SQL_DELETE_COMMITTED),
    "a14_save_run": (q_save_run, SQL_SAVE_RUN),
    "a14_save_run_check": (q_save_run_check, SQL_SAVE_RUN_CHECK),
    "a15_table_constraints": (q_table_constraints, SQL_TABLE_CONSTRAINTS),
}


def q_compare_sparse_truth(spark, sf):
    """G12 + G15 on sparse ground truth: documents scored by length (theta = p90), truth = toxic where
    labelled; compare cells (N/A without truth) and the summary texts."""
    from flowlens.functions.labels import compare_cell
    from flowlens.operators.quantiles import exact_percentiles

    t = B.truth_sparse(spark, sf)
    theta = exact_percentiles(t, "score", [0.9])[0]
    cells = t.withColumn("prediction", (F.col("score") > F.lit(theta)).cast("int")).withColumn(
        "compare_result", compare_cell("prediction", "truth")
    ).withColumn("run_id", F.lit(1))
    return R.export_summary(cells).drop("run_id").crossJoin(
        cells.groupBy().agg(F.sum((F.col("compare_result") == "N/A").cast("long")).alias("n_na"))
    )


SQL_COMPARE_SPARSE_TRUTH = """
WITH t AS (SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS truth FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
th AS (SELECT quantile_cont(score, 0.9) AS theta FROM t),
c AS (SELECT CASE WHEN truth IS NULL THEN 'N/A'
                  WHEN score > theta AND truth = 1 THEN 'TP' WHEN score > theta AND truth = 0 THEN 'FP'
                  WHEN score <= theta AND truth = 0 THEN 'TN' WHEN score <= theta AND truth = 1 THEN 'FN' ELSE 'N/A' END AS cr
      FROM t, th),
s AS (SELECT CAST(count(*) AS BIGINT) AS total_exported, sum(CASE WHEN cr = 'TP' THEN 1 ELSE 0 END) AS TP,
             sum(CASE WHEN cr = 'FP' THEN 1 ELSE 0 END) AS FP, sum(CASE WHEN cr = 'TN' THEN 1 ELSE 0 END) AS TN,
             sum(CASE WHEN cr = 'FN' THEN 1 ELSE 0 END) AS FN, CAST(sum(CASE WHEN cr = 'N/A' THEN 1 ELSE 0 END) AS BIGINT) AS n_na FROM c)
SELECT total_exported, CASE WHEN TP + FP + TN + FN > 0 THEN 'true' ELSE 'false' END AS has_ground_truth,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(TP AS VARCHAR) ELSE 'N/A' END AS tp,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(FP AS VARCHAR) ELSE 'N/A' END AS fp,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(TN AS VARCHAR) ELSE 'N/A' END AS tn,
       CASE WHEN TP + FP + TN + FN > 0 THEN CAST(FN AS VARCHAR) ELSE 'N/A' END AS fn,
       CASE WHEN TP + TN + FP + FN = 0 THEN 'N/A' ELSE printf('%.6f', (TP + TN) * 1.0 / (TP + TN + FP + FN)) END AS accuracy,
       CASE WHEN TP + FP = 0 THEN 'N/A' ELSE printf('%.6f', TP * 1.0 / (TP + FP)) END AS precision,
       CASE WHEN TP + FN = 0 THEN 'N/A' ELSE printf('%.6f', TP * 1.0 / (TP + FN)) END AS recall,
       CASE WHEN TP + FP = 0 OR TP + FN = 0 OR TP = 0 THEN 'N/A'
            ELSE printf('%.6f', 2.0 * (TP * 1.0 / (TP + FP)) * (TP * 1.0 / (TP + FN))
                                / ((TP * 1.0 / (TP + FP)) + (TP * 1.0 / (TP + FN)))) END AS f1_score,
       n_na
FROM s"""

QUERIES["g15_compare_sparse_truth"] = (q_compare_sparse_truth, SQL_COMPARE_SPARSE_TRUTH)
