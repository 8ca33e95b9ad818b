"""The result store as Parquet tables: uploads, rows, runs, predictions.

Store layout (one folder per table, on the shared filesystem):

* ``rows``        upload_id, row_index, payload (JSON text), sorted by (upload_id, row_index)
* ``uploads``     upload_id, filename, row_count, col_count, file_sha256, created_at
* ``runs``        run_id, upload_id, created_at, total_flows, anomaly_count,
                  normal_count, anomaly_rate, threshold
* ``predictions`` run_id, upload_id, row_index, reconstruction_error, prediction,
                  prediction_label, predicted_at

Row tables are written range-partitioned and sorted on (upload_id, row_index),
so Parquet min/max statistics prune by upload without a directory per upload.
Uploads, runs and deletions are published by one manifest each (``sources.commits``).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.ordering import ordered_scan
from flowlens.sources.commits import CommitLog, Snapshot


class StoreError(RuntimeError):
    """A store write or read violated an invariant; nothing partial was published."""


def _write(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def build_store_from_rows(
    spark: SparkSession, src: DataFrame, nation: DataFrame, theta: float, root: str
) -> dict[str, str]:
    """Build the four store tables from scored source rows.

    ``src`` has upload_id, ts, event_id, reconstruction_error, payload, day.
    One run per (upload, day); run-less uploads come from ``nation``.
    """
    indexed = ordered_scan(src, order_cols=["ts", "event_id"], group_cols=["upload_id"], index_col="row_index")
    staged = _write(
        indexed.select("upload_id", "row_index", "ts", "payload", "reconstruction_error", "day")
        .sortWithinPartitions("upload_id", "row_index"),
        f"{root}/_staged",
    )
    base = spark.read.parquet(staged)

    rows = base.select("upload_id", "row_index", "payload")
    run_id = (F.col("upload_id") * 1000 + F.dayofyear("day")).cast("long")
    created = F.col("day").cast("timestamp_ntz")
    pred = (F.col("reconstruction_error") > F.lit(theta)).cast("int")
    predictions = base.select(
        run_id.alias("run_id"),
        "upload_id",
        "row_index",
        "reconstruction_error",
        pred.alias("prediction"),
        F.when(pred == 1, F.lit("anomaly")).otherwise(F.lit("normal")).alias("prediction_label"),
        created.alias("predicted_at"),
    )
    runs = predictions.groupBy("run_id", "upload_id", "predicted_at").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("prediction").cast("long").alias("anomaly_count"),
    ).select(
        "run_id",
        "upload_id",
        F.col("predicted_at").alias("created_at"),
        "total_flows",
        "anomaly_count",
        (F.col("total_flows") - F.col("anomaly_count")).alias("normal_count"),
        F.round(F.col("anomaly_count") / F.col("total_flows"), 6).alias("anomaly_rate"),
        F.lit(theta).alias("threshold"),
    )
    event_uploads = base.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("created_at")
    ).select(
        "upload_id",
        F.concat(F.lit("user_"), F.col("upload_id").cast("string"), F.lit(".csv")).alias("filename"),
        "row_count",
        F.lit(3).alias("col_count"),
        F.lit(None).cast("string").alias("file_sha256"),
        "created_at",
    )
    nation_uploads = nation.select(
        (F.lit(1_000_000) + F.col("n_nationkey")).cast("long").alias("upload_id"),
        F.concat(F.lower("n_name"), F.lit(".csv")).alias("filename"),
        F.lit(0).cast("long").alias("row_count"),
        F.lit(3).alias("col_count"),
        F.lit(None).cast("string").alias("file_sha256"),
        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    paths = {
        "rows": _write(rows, f"{root}/rows"),
        "predictions": _write(predictions.sortWithinPartitions("run_id", "row_index"), f"{root}/predictions"),
    }
    paths["runs"] = _write(runs, f"{root}/runs")
    paths["uploads"] = _write(event_uploads.unionByName(nation_uploads), f"{root}/uploads")
    return paths


# ---------------------------------------------------------------------------
# Register an uploaded CSV file
# ---------------------------------------------------------------------------

MAX_UPLOAD_BYTES = 100 * 1024 * 1024  # fixed value: upload size cap


def register_uploads(spark: SparkSession, uploads: dict[str, int], root: str) -> DataFrame:
    """Store CSV files (path -> upload id) as uploads, in a fixed number of jobs; returns their metadata.

    Every file is checked before anything is stored: .csv name, at most 100 MB
    (by its length, without reading it), at least one row.  Rows and metadata are
    published in one commit, in which the ids' former rows and metadata go, so no failure
    leaves new rows under old metadata.  ``read_committed`` gives the stored tables.
    """
    from flowlens.functions.cleaning import json_safe_payload
    from flowlens.sources.flow_files import csv_groups, qualified, read_headers, row_blocks, with_row_index

    ids = {qualified(spark, p): i for p, i in uploads.items()}
    paths = list(ids)
    if not all(p.lower().endswith(".csv") for p in paths):
        raise StoreError("only .csv files are accepted")
    if spark.read.format("binaryFile").load(paths).select("length").filter(F.col("length") > MAX_UPLOAD_BYTES).count():
        raise StoreError("file larger than 100 MB")
    heads = read_headers(spark, paths)
    parts = [df.select("_file", "_block", "_pos", json_safe_payload(names).alias("payload"))
             for names, df in csv_groups(spark, paths, heads)]
    if not parts:
        raise StoreError("empty CSV (header only)")
    rows = reduce(DataFrame.unionByName, parts)
    blocks = row_blocks(rows)
    counts = blocks.groupBy("_file").agg(F.sum("_n").alias("row_count"))  # one line per split; no further pass over the files
    if counts.count() < len(paths):
        raise StoreError("empty CSV (header only)")
    indexed = with_row_index(rows, group=["_file"], blocks=blocks)
    named = spark.createDataFrame(list(ids.items()), "_file string, upload_id long")

    digests = spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("_file"), F.sha2("content", 256).alias("file_sha256"))
    columns = heads.select("_file", F.col("names").alias("columns"))
    meta = named.join(counts, "_file").join(columns, "_file").join(digests, "_file").select(
        "upload_id", F.element_at(F.split("_file", "/"), -1).alias("filename"), F.col("_file").alias("path"), "row_count",
        F.size("columns").alias("col_count"), "columns", "file_sha256",
        F.localtimestamp().cast("timestamp_ntz").alias("created_at"))
    stored = indexed.join(named, "_file").select("upload_id", "row_index", "payload")
    keys = list(ids.values())
    CommitLog(spark, root).commit(
        f"register-{uuid.uuid4().hex}", append={"rows": stored, "uploads": meta}, drop_keys={"rows": keys, "uploads": keys})
    return read_committed(spark, root)["uploads"].filter(F.col("upload_id").isin(keys))


def register_upload(spark: SparkSession, path: str, upload_id: int, root: str) -> int:
    """Store one CSV file as an upload; returns its number of rows."""
    return register_uploads(spark, {path: upload_id}, root).first()["row_count"]


# ---------------------------------------------------------------------------
# A9 / A12 / A14 / A15
# ---------------------------------------------------------------------------

def load_upload(rows: DataFrame, uploads: DataFrame, schema: str) -> DataFrame:
    """Rows as a typed frame (``from_json`` with ``schema``); raises when an
    upload's stored row count differs from its metadata."""
    counts = rows.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))
    bad = (
        uploads.join(counts, "upload_id", "left")
        .filter(F.coalesce(F.col("n"), F.lit(0)) != F.col("row_count"))
        .count()
    )
    if bad:
        raise StoreError(f"{bad} upload(s) have a row count that differs from their metadata")
    parsed = F.from_json("payload", schema)
    names = [f.split()[0] for f in schema.split(",")]
    return rows.select("upload_id", "row_index", *[parsed[n].alias(n) for n in names])


def delete_upload(store: dict[str, DataFrame], victims: DataFrame) -> dict[str, DataFrame]:
    """Remove uploads and, by cascade, their rows, runs and predictions (left-anti joins).

    Raises when none of the victims exists.  For a committed store see ``delete_committed``.
    """
    found = store["uploads"].join(victims, "upload_id", "left_semi").count()
    if found == 0:
        raise StoreError("upload not found")
    v = victims.select("upload_id").distinct()
    return {name: df.join(v, "upload_id", "left_anti") for name, df in store.items()}


def delete_committed(spark: SparkSession, root: str, upload_ids: list[int], txn: str | None = None) -> Snapshot:
    """Delete uploads of a committed store and, by cascade, their rows, runs and predictions.

    One manifest takes the ids out of all tables at once; no data file is read or
    written, and readers of the former version are not disturbed.  An id that is not stored raises.
    """
    log = CommitLog(spark, root)
    base, txn = log.snapshot(), txn or f"delete-{uuid.uuid4().hex}"
    if log.committed(txn):
        return base
    stored = log.read(base)["uploads"].filter(F.col("upload_id").isin(*upload_ids)).select("upload_id").distinct().count()
    if stored < len(set(upload_ids)):
        raise StoreError("upload not found")
    return log.commit(txn, drop_keys={t: list(upload_ids) for t in base.tables}, base=base)


def table_counts(store: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("table_name")).groupBy("table_name").count() for name, df in store.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", F.col("count").cast("long").alias("n"))


def validate_runs(predictions: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Per run: declared total vs results, and results whose row index matches no stored row."""
    matched = predictions.join(
        rows.select("upload_id", "row_index", F.lit(1).alias("_hit")).hint("merge"),  # never a broadcast of all rows
        ["upload_id", "row_index"], "left",
    )
    c = matched.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("n_unknown"),
    )
    return runs.join(c, "run_id", "left").select(
        "run_id",
        "total_flows",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        ((F.col("total_flows") == F.coalesce("n_results", F.lit(0))) & (F.coalesce("n_unknown", F.lit(0)) == 0)).alias("valid"),
    )


def save_run(predictions_new: DataFrame, run_new: DataFrame, rows: DataFrame, root: str, txn: str | None = None,
             base: Snapshot | None = None) -> Snapshot:
    """Save one run: validate first, then predictions and run row in one commit.

    ``txn`` (by default the run's id) names the attempt: a retry after a success writes
    nothing, one after a failure writes everything, for nothing of the failed attempt is
    visible.  A run id that another transaction saved is refused, and a writer that
    lost the race for a version gets ``CommitConflict``.
    """
    spark = predictions_new.sparkSession
    ids = [r["run_id"] for r in run_new.select("run_id").limit(2).collect()]
    if len(ids) != 1:
        raise StoreError("save_run takes exactly one run")
    txn, log = txn or f"run-{ids[0]}", CommitLog(spark, root)
    base = base if base is not None else log.snapshot()
    if log.committed(txn):
        return log.snapshot()
    if validate_runs(predictions_new, run_new, rows).filter(~F.col("valid")).count():
        raise StoreError("run does not match its upload's rows; nothing written")
    if predictions_new.filter(~F.col("run_id").eqNullSafe(F.lit(ids[0]))).limit(1).count():
        raise StoreError("predictions of another run; nothing written")
    saved = log.read(base).get("runs")
    if saved is not None and saved.filter(F.col("run_id") == ids[0]).limit(1).count():
        raise StoreError(f"run {ids[0]} is saved already")
    return log.commit(txn, append={"predictions": predictions_new, "runs": run_new}, base=base)


def constraint_violations(store: dict[str, DataFrame]) -> DataFrame:
    """Violation counts: prediction domain, uniqueness and foreign keys."""
    u, r, runs, p = store["uploads"], store["rows"], store["runs"], store["predictions"]

    def n(name, df):
        return df.agg(F.count(F.lit(1)).cast("long").alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    checks = [
        n("prediction_domain", p.filter(~F.col("prediction").isin(0, 1))),
        n("rows_unique", r.groupBy("upload_id", "row_index").count().filter("count > 1")),
        n("predictions_unique", p.groupBy("run_id", "row_index").count().filter("count > 1")),
        n("rows_fk_upload", r.join(u, "upload_id", "left_anti")),
        n("runs_fk_upload", runs.join(u, "upload_id", "left_anti")),
        n("predictions_fk_run", p.join(runs, "run_id", "left_anti")),
        n("predictions_fk_row", p.join(r.hint("merge"), ["upload_id", "row_index"], "left_anti")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def commit_tables(tables: dict[str, DataFrame], root: str, txn: str | None = None, base: Snapshot | None = None) -> Snapshot:
    """Replace the given tables in one commit; the others stay.  Readers see the former
    version, whose files are never touched, until its manifest is published.  With ``base``
    (the version the tables were derived from) a change by another writer raises ``CommitConflict``."""
    spark = next(iter(tables.values())).sparkSession
    return CommitLog(spark, root).commit(txn or f"tables-{uuid.uuid4().hex}", replace=tables, base=base)


def read_committed(spark, root: str) -> dict[str, DataFrame]:
    """The tables of the newest committed version."""
    tables = CommitLog(spark, root).read()
    if not tables:
        raise StoreError(f"nothing committed under {root}")
    return tables
