"""Registered query: incremental scoring of arriving files."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import prep as P
from flowlens.operators import score as S
from flowlens.operators.quantiles import exact_percentiles
from flowlens.plans import bindings as B
from flowlens.plans.q_prep import _IMPUTED_SQL, _MED_SQL, _SCALER_SQL, FEATS, KEY, PREP_VIEWS, _medians
from flowlens.plans.q_score import FLOW_NET, net_sql_views
from flowlens.session import scratch_dir
from flowlens.sources.commits import CommitLog
from flowlens.streaming.stream_score import stream_score

COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def q_stream_score(spark, sf):
    """Stream the day files through frozen scoring (score = value, theta 150); runs summed per day."""
    landing = B.arrivals(spark, sf)
    out = scratch_dir(spark, "stream_out", unique=True)
    ckpt = scratch_dir(spark, "stream_ckpt", unique=True)
    q = stream_score(
        spark, landing, COLUMNS, lambda df: df.withColumn("score", F.col("value").cast("double")),
        B.STORE_THETA, out, ckpt, files_per_trigger=8, available_now=True,
    )
    q.awaitTermination()
    runs = CommitLog(spark, out).read()["runs"]
    return runs.groupBy(F.regexp_extract("_file", r"day=([0-9-]+)", 1).alias("day")).agg(
        F.sum("total_flows").cast("long").alias("total_flows"), F.sum("anomaly_count").cast("long").alias("anomaly_count")
    )


SQL_STREAM_SCORE = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS total_flows,
       CAST(sum(CASE WHEN value > 150.0 THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count
FROM events GROUP BY 1"""



def q_stream_flows(spark, sf):
    """A18 as served: flow files land as raw text and are scored by serving prep (C14: lenient schema, coercion,
    stored medians), the stored scaler (C7) and the network (D1) against the stored p99 threshold; the stream is
    started a second time and finds nothing to do.  Runs summed per source."""
    s, med = _medians(spark, sf)
    imp = P.impute(s, med, FEATS, KEY + ["split"])
    scaler = P.fit_scaler(imp.filter(F.col("split") == "train"), FEATS)
    stored = scratch_dir(spark, "stream_artifacts", unique=True)
    med.write.parquet(f"{stored}/medians")
    scaler.write.parquet(f"{stored}/scaler")
    med, scaler = spark.read.parquet(f"{stored}/medians"), spark.read.parquet(f"{stored}/scaler")

    def score(df, keep=("_file", "row_index")):
        x = P.serving_prep(df, FEATS, med, list(keep))
        x = P.scale(x, scaler, FEATS, list(keep)).withColumn("_x", F.array(*FEATS))
        return S.vae_score(x, FLOW_NET, "_x", list(keep)).withColumnRenamed("reconstruction_error", "score")

    val = s.filter(F.col("split") == "val")
    theta = exact_percentiles(score(val, ("split",)), "score", [0.99])[0]
    landing = scratch_dir(spark, "stream_flows", unique=True)
    raw = [F.col("qty_text" if c == "qty_num" else c).cast("string").alias(c) for c in FEATS]
    (s.select(F.col("source_file").alias("source"), *raw).repartitionByRange(B._files_for(s), "source", F.rand(7))
     .write.option("header", True).partitionBy("source").csv(landing))
    out, ckpt = (scratch_dir(spark, name, unique=True) for name in ("stream_out", "stream_ckpt"))
    for _ in range(2):
        stream_score(spark, landing, FEATS, score, theta, out, ckpt, files_per_trigger=16).awaitTermination()
    return CommitLog(spark, out).read()["runs"].groupBy(F.regexp_extract("_file", r"source=([^/]+)/", 1).alias("source")).agg(
        F.sum("total_flows").cast("long").alias("total_flows"), F.sum("anomaly_count").cast("long").alias("anomaly_count"),
        F.round(F.max("threshold"), 6).alias("threshold"))


_SCALED = "scaled AS (SELECT i.split, 'src_' || year(i.l_shipdate) AS source, " + ", ".join(
    f"(i.{c} - m_{c}) / s_{c} AS {c}" for c in FEATS) + " FROM imputed i CROSS JOIN scaler)"
SQL_STREAM_FLOWS = "WITH " + ",\n".join([
    *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL, _SCALED,
    *net_sql_views(FLOW_NET, "scaled", list(FEATS), ["split", "source"], "fn")]) + """,
th AS (SELECT quantile_cont(recon_error, 0.99) AS theta FROM fn_out WHERE split = 'val')
SELECT source, CAST(count(*) AS BIGINT) AS total_flows, CAST(sum(CASE WHEN recon_error > theta THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count,
       round(any_value(theta), 6) AS threshold
FROM fn_out, th GROUP BY source"""

QUERIES = {
    "a18_stream_score": (q_stream_score, SQL_STREAM_SCORE),
    "a18_stream_flows": (q_stream_flows, SQL_STREAM_FLOWS),
}
