"""Cleaning, splitting and feature preparation without leakage.

Fitted artifacts (medians, scaler, min/max) are one-row DataFrames computed
on the training split only and joined back with a broadcast (their size is
one row, independent of the data).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.cleaning import coerce_numeric, finite_or_null
from flowlens.functions.labels import binary_label
from flowlens.operators.quantiles import percentile_columns, radix_select
from flowlens.session import scratch_dir

# fixed values: zero-variance and near-constant columns dropped before training
CONSTANT_COLS = [
    "Bwd PSH Flags", "Bwd URG Flags", "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate", "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
]
NEAR_CONSTANT_COLS = ["Fwd URG Flags", "RST Flag Count", "CWE Flag Count", "ECE Flag Count"]


class PrepError(ValueError):
    pass


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# -- A5 / A6 ------------------------------------------------------------------

def align_schema(df: DataFrame, contract: Sequence[str], mode: str = "lenient", keep: Sequence[str] = ()) -> DataFrame:
    """Select the contract columns in order.  lenient: missing -> NULL, extra dropped;
    strict: a missing contract column is an error."""
    present = set(df.columns)
    missing = [c for c in contract if c not in present]
    if mode == "strict" and missing:
        raise PrepError(f"missing contract columns: {missing}")
    if mode not in ("strict", "lenient"):
        raise ValueError(mode)
    cols = [q(c) if c in present else F.lit(None).cast("string").alias(c) for c in contract]
    return df.select(*keep, *cols)


def coerce_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every contract column -> finite double or NULL."""
    return df.select(*keep, *[coerce_numeric(q(c)).alias(c) for c in cols])


# -- C1 - C5 --------------------------------------------------------------------

def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def dedupe_keep_first(df: DataFrame, cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order_cols``) of every group of equal ``cols``.

    A partial ``min(struct(order))`` aggregation: map-side combine collapses a
    hot group of copies before the shuffle; no sort, no window.  Grouping treats
    NULLs as equal (missing equals missing).
    """
    order_cols = list(order_cols)
    if len(order_cols) == 1 and dict(df.dtypes)[order_cols[0]] in ("bigint", "int", "double", "timestamp", "timestamp_ntz"):
        # a single fixed-width order key (e.g. the file-order row index): hash aggregation
        return df.groupBy(*[q(c) for c in cols]).agg(F.min(q(order_cols[0])).alias(order_cols[0]))
    first = df.groupBy(*[q(c) for c in cols]).agg(F.min(F.struct(*[q(c) for c in order_cols])).alias("_first"))
    return first.select(*[q(c) for c in cols], *[F.col(f"_first.`{c}`").alias(c) for c in order_cols])


def source_split(df: DataFrame, source: str, benign_source: str, label: str = "label", benign: str = "BENIGN",
                 with_count: bool = False):
    """Benign source -> train_val, everything else -> test; raises if the benign source holds attacks.

    The check and the train_val row count are one aggregation; ``with_count``
    returns (frame, train_val rows)."""
    in_bs = q(source) == benign_source
    chk = df.agg(
        F.sum((in_bs & ~q(label).eqNullSafe(F.lit(benign))).cast("long")).alias("bad"),
        F.sum(in_bs.cast("long")).alias("n"),
    ).first()
    if chk["bad"]:
        raise PrepError("benign source contains non-benign labels")
    out = df.withColumn("split", F.when(in_bs, "train_val").otherwise("test"))
    return (out, int(chk["n"] or 0)) if with_count else out


def hash_key(cols: Sequence[str | Column], seed: int) -> Column:
    """Reproducible pseudo-random order: first 60 bits of md5(key | seed) as a long."""
    parts = [c if isinstance(c, Column) else q(c).cast("string") for c in cols]
    h = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def train_val_split(df: DataFrame, key_cols: Sequence[str | Column], seed: int = 42, val_fraction: float = 0.2,
                    split_col: str = "split", n: int | None = None) -> DataFrame:
    """val = exactly ceil(val_fraction * n) rows, those with the smallest key hash; train = the rest.

    The cut is the exact k-th smallest hash (radix selection on its digits), so no
    global sort or window is needed.  If more rows tie at the cut than fit (equal keys, even
    all of them), the first of them by their place in the scan are taken: the rows are
    written once with that place, and the cut among the places is selected likewise.
    ``n`` (the row count) may be passed when the caller already has it.
    """
    h = df.withColumn("_h", hash_key(key_cols, seed))
    n = h.count() if n is None else n
    k = math.ceil(val_fraction * n)
    if k == 0:
        return h.withColumn(split_col, F.lit("train")).drop("_h")
    cut, below, ties = radix_select(h, "_h", k - 1)
    val = F.col("_h") <= F.lit(cut)
    if below + ties > k:
        path = scratch_dir(df.sparkSession, "split", unique=True)
        h.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
        h = df.sparkSession.read.schema(h.withColumn("_place", F.lit(0).cast("long")).schema).parquet(path)
        last, _, _ = radix_select(h.filter(F.col("_h") == F.lit(cut)), "_place", k - below - 1)
        val = (F.col("_h") < F.lit(cut)) | ((F.col("_h") == F.lit(cut)) & (F.col("_place") <= F.lit(last)))
    return h.withColumn(split_col, F.when(val, "val").otherwise("train")).drop("_h", "_place")


# -- C6 / C7 / C8 / C10 -----------------------------------------------------------

def fit_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: linear-interpolated median of every column on the training rows (exact, bracketed)."""
    med = percentile_columns(train, cols, [0.5])
    schema = ", ".join(f"`{c}` double" for c in cols)
    return train.sparkSession.createDataFrame([tuple(med[(c, 0.5)] for c in cols)], schema)


def impute(df: DataFrame, medians: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """NULL -> stored median; a column without a median -> 0.0."""
    have = set(medians.columns)
    m = medians.select(*[q(c).alias(f"_m_{c}") for c in cols if c in have])
    j = df.crossJoin(F.broadcast(m))
    return j.select(
        *keep,
        *[F.coalesce(q(c), F.col(f"`_m_{c}`") if c in have else F.lit(None), F.lit(0.0)).alias(c) for c in cols],
    )


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (feature, pos, mean, scale): population std, 0 -> 1."""
    agg = train.agg(*[x for c in cols for x in (F.avg(q(c)).alias(f"mean__{c}"), F.stddev_pop(q(c)).alias(f"std__{c}"))])
    s = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), F.col(f"`mean__{c}`").alias("mean"),
                  F.when(F.col(f"`std__{c}`") > 0, F.col(f"`std__{c}`")).otherwise(F.lit(1.0)).alias("scale"))
         for i, c in enumerate(cols)]
    return agg.select(F.explode(F.array(*s)).alias("s")).select("s.*")


def scale(df: DataFrame, scaler: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / scale with the broadcast one-row scaler."""
    wide = scaler.groupBy().agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_s_{i}") for i, c in enumerate(cols)]
    )
    j = df.crossJoin(F.broadcast(wide))
    return j.select(*keep, *[((q(c) - F.col(f"_s_{i}.mean")) / F.col(f"_s_{i}.scale")).alias(c) for i, c in enumerate(cols)])


def assert_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: count of NULL / NaN / Inf cells (all zero on a clean matrix)."""
    agg = df.agg(*[F.sum(finite_or_null(q(c)).isNull().cast("long")).alias(c) for c in cols])
    s = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n_bad")) for c in cols]
    return agg.select(F.explode(F.array(*s)).alias("s")).select("s.*")


def matrix_checks(df: DataFrame, cols: Sequence[str], expected: int, split: str = "split", label: str = "label",
                  benign: str = "BENIGN") -> DataFrame:
    """(check, n_bad): non-finite cells, missing or surplus features, attacks in train / val (one pass)."""
    cells = [finite_or_null(q(c)).isNull().cast("long") for c in cols]
    attack = F.coalesce(F.col(label) != benign, F.lit(True)) & F.col(split).isin("train", "val")
    agg = df.agg(
        F.coalesce(F.sum(sum(cells, F.lit(0).cast("long"))), F.lit(0)).alias("non_finite_cells"),
        F.lit(abs(len(cols) - expected)).cast("long").alias("feature_count"),
        F.coalesce(F.sum(attack.cast("long")), F.lit(0)).alias("attacks_in_train_val"),
    )
    s = [F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad")) for c in agg.columns]
    return agg.select(F.explode(F.array(*s)).alias("s")).select("s.*")


def require_clean(checks: DataFrame) -> None:
    """Raise if a row of ``matrix_checks`` (three rows) counts a violation."""
    bad = {r["check"]: r["n_bad"] for r in checks.filter("n_bad > 0").collect()}
    if bad:
        raise ValueError(f"feature matrix is not clean: {bad}")


def min_max_scale(df: DataFrame, ref: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) with min/max from ``ref``; a range <= 1e-8 divides by 1."""
    mm = ref.agg(*[x for c in cols for x in (F.min(q(c)).alias(f"_mn_{c}"), F.max(q(c)).alias(f"_mx_{c}"))])
    j = df.crossJoin(F.broadcast(mm))
    out = []
    for c in cols:
        rng = F.col(f"`_mx_{c}`") - F.col(f"`_mn_{c}`")
        out.append(((q(c) - F.col(f"`_mn_{c}`")) / F.when(rng <= 1e-8, F.lit(1.0)).otherwise(rng)).alias(c))
    return j.select(*keep, *out)


# -- C9 / C12 / C13 ----------------------------------------------------------------

def fixed_batch(df: DataFrame, order_cols: Sequence[str], n: int = 128) -> DataFrame:
    """The first n rows in order (TakeOrderedAndProject: bounded top-k)."""
    return df.orderBy(*order_cols).limit(n)


def sample_per_label(df: DataFrame, label: str, n: int, seed: int, key_cols: Sequence[str | Column]) -> DataFrame:
    """Up to n pseudo-random rows per label (row_number over a hash order -> WindowGroupLimit)."""
    w = Window.partitionBy(label).orderBy(hash_key(key_cols, seed), *[c for c in key_cols if isinstance(c, str)])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sample_report(sample: DataFrame, targets: DataFrame, label: str, n: int) -> DataFrame:
    """requested / found / status per target label; targets with no rows are listed with 0."""
    found = sample.groupBy(label).agg(F.count(F.lit(1)).alias("found"))
    return targets.join(found, label, "left").select(
        label,
        F.lit(n).cast("long").alias("requested"),
        F.coalesce("found", F.lit(0)).cast("long").alias("found"),
        F.when(F.coalesce("found", F.lit(0)) == 0, "missing")
        .when(F.col("found") < n, "partial").otherwise("ok").alias("status"),
    )


def mixed_batch(df: DataFrame, quotas: DataFrame, label: str, seed: int, key_cols: Sequence[str | Column]) -> DataFrame:
    """Per-label quotas (label, quota) applied with one windowed pass; broadcast quota table."""
    w = Window.partitionBy(label).orderBy(hash_key(key_cols, seed), *[c for c in key_cols if isinstance(c, str)])
    # a literal bound first (plans as WindowGroupLimit: at most max-quota rows per label leave each task),
    # then the per-label quota from the broadcast table
    top = quotas.agg(F.max("quota")).first()[0] or 0
    ranked = df.join(F.broadcast(quotas), label).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    return ranked.filter(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


# -- C14 -------------------------------------------------------------------------

def serving_prep(df: DataFrame, contract: Sequence[str], medians: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Lenient align + coerce + impute with stored medians (never refit); one projection, no shuffle."""
    aligned = align_schema(df, contract, "lenient", keep)
    coerced = coerce_columns(aligned, contract, keep)
    return impute(coerced, medians, contract, keep)


def with_binary_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("binary_label", binary_label(label))
