"""Prepared-data artifacts: split tables, prep metadata and table fingerprints."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, features: Sequence[str], label: str, source: str, out: str,
                 medians: DataFrame | None = None, scaler: DataFrame | None = None) -> dict[str, str]:
    """Features + binary label partitioned by split; test metadata; the ordered feature contract; and what was
    fitted on the training split: one row of medians, and (feature, pos, mean, scale) rows of the scaler."""
    paths = {
        "features": f"{out}/features",
        "test_metadata": f"{out}/test_metadata",
        "feature_schema": f"{out}/feature_schema",
    }
    df.select("split", *features, "binary_label").write.mode("overwrite").partitionBy("split").parquet(paths["features"])
    df.filter(F.col("split") == "test").select(label, F.col(source).alias("source_file"), "binary_label").write.mode(
        "overwrite"
    ).parquet(paths["test_metadata"])
    spark = df.sparkSession
    spark.createDataFrame([(list(features),)], "feature_columns array<string>").coalesce(1).write.mode("overwrite").json(
        paths["feature_schema"]
    )
    for name, fitted in (("medians", medians), ("scaler", scaler)):
        if fitted is not None:
            paths[name] = f"{out}/{name}"
            fitted.write.mode("overwrite").parquet(paths[name])
    return paths


def prep_metadata(df: DataFrame, dropped: Sequence[str], impute: str = "median",
                  scale: str = "standard_population") -> DataFrame:
    """One row: rows per split, validation and test-attack ratios, dropped columns, policies."""
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    a = df.agg(
        cnt(F.col("split") == "train").alias("n_train"),
        cnt(F.col("split") == "val").alias("n_val"),
        cnt(F.col("split") == "test").alias("n_test"),
        cnt((F.col("split") == "test") & (F.col("binary_label") == 1)).alias("_test_attack"),
    )
    return a.select(
        "n_train", "n_val", "n_test",
        F.round(F.when(F.col("n_train") + F.col("n_val") > 0, F.col("n_val") / (F.col("n_train") + F.col("n_val"))), 6).alias("val_ratio"),
        F.round(F.when(F.col("n_test") > 0, F.col("_test_attack") / F.col("n_test")), 6).alias("test_attack_ratio"),
        F.lit(",".join(dropped)).alias("dropped_columns"),
        F.lit(impute).alias("impute_policy"),
        F.lit(scale).alias("scale_policy"),
    )


def table_fingerprint(df: DataFrame, extra: dict | None = None) -> DataFrame:
    """Order-independent fingerprint: the count and the exact sum of 60 bits of each row's md5 (as decimal).

    A row's text is its columns cast to string, NULL as ``\\N``, joined by ``|``.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("fingerprint"))
    for k, v in (extra or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out
