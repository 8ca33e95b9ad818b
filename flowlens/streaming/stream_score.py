"""Incremental scoring of newly arriving CSV files with Structured Streaming.

``readStream`` over a landing folder -> ``foreachBatch``: the rows of a micro-batch get
their index inside their file by block counts (no row moves, a large file stays spread
over its splits), are scored by a stateless function with frozen artifacts (contract
columns, medians, scaler, model, threshold), and predictions and one run per file are
published by one commit whose transaction id names the stream and the batch.  A batch that
is delivered again, after a failure anywhere before the checkpoint was written, finds
its transaction in the log and changes nothing.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import scratch_dir
from flowlens.sources.commits import CommitLog
from flowlens.sources.flow_files import with_row_index


def stream_score(
    spark: SparkSession,
    landing: str,
    columns: list[str],
    score: Callable[[DataFrame], DataFrame],
    theta: float,
    out: str,
    checkpoint: str,
    files_per_trigger: int = 8,
    available_now: bool = True,
):
    """Start (and, with ``available_now``, finish) the streaming query; returns the StreamingQuery.

    ``score`` maps a frame with the all-string contract columns, ``_file`` and ``row_index`` to one
    that keeps the last two and has a ``score``.  Read the tables ``predictions`` and ``runs`` with
    ``CommitLog(spark, out).read()``.  ``checkpoint`` names the stream in the log.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    src = (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger)
        .csv(landing)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, batch_id, score, theta, out, checkpoint)

    writer = src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def publish_batch(batch: DataFrame, batch_id: int, score: Callable[[DataFrame], DataFrame], theta: float, out: str,
                  stream: str) -> None:
    """Score one micro-batch and publish it once."""
    spark = batch.sparkSession
    log, txn = CommitLog(spark, out, key="run_id"), f"{stream}#{batch_id}"
    if log.committed(txn):
        return
    # inside a micro-batch the frame is static: the reader position is available again
    indexed = with_row_index(batch.withColumn("_pos", F.monotonically_increasing_id()), group=["_file"])
    staged = scratch_dir(spark, "stream", unique=True)  # scored once, read by both tables
    score(indexed).select(
        F.xxhash64("_file").alias("run_id"), "_file", "row_index", "score",
        (F.col("score") > F.lit(theta)).cast("int").alias("prediction")).write.parquet(staged)
    predictions = spark.read.parquet(staged)
    runs = predictions.groupBy("run_id", "_file").agg(
        F.count(F.lit(1)).alias("total_flows"), F.sum("prediction").cast("long").alias("anomaly_count"),
    ).select("*", F.lit(theta).alias("threshold"), F.lit(batch_id).cast("long").alias("batch_id"))
    log.commit(txn, append={"runs": runs}, adopt={"predictions": staged})
