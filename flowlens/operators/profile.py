"""Exploratory profiling of a wide numeric flow table.

Every profile is one (or two) aggregation passes over the table with one
expression per column, followed by an ``unpivot`` of the single result row --
never one job per column.  Percentiles of many columns are computed together
by the bracketed exact routine of ``operators.quantiles`` (unpivot to
(column, value), one set of passes for all columns).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.cleaning import finite_or_null
from flowlens.operators.quantiles import group_percentile_table, percentile_columns

INF = float("inf")


def _wide_to_long(row_df: DataFrame, cols: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """1-row frame with columns ``<prefix>__<col>`` -> one row per col with a column per prefix."""
    structs = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"`{p}__{c}`").alias(p) for p in prefixes]) for c in cols
    ]
    return row_df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def label_distribution(df: DataFrame, label: str = "label", benign: str = "BENIGN") -> DataFrame:
    """Per label: count, percent of all rows (3 dp), is_benign."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(total).select(
        label, "n", F.round(F.col("n") * 100.0 / F.col("total"), 3).alias("pct"),
        (F.col(label) == benign).alias("is_benign"),
    )


def label_totals(df: DataFrame, label: str = "label", benign: str = "BENIGN") -> DataFrame:
    """Totals: benign rows, attack rows (NULL label counts as attack), distinct labels."""
    return df.agg(
        F.sum(F.col(label).eqNullSafe(F.lit(benign)).cast("long")).alias("n_benign"),
        F.sum((~F.col(label).eqNullSafe(F.lit(benign))).cast("long")).alias("n_attack"),
        F.countDistinct(label).alias("n_labels"),
    )


def label_by_source(df: DataFrame, source: str = "source_file", label: str = "label") -> DataFrame:
    return df.groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with missing values: count and percent (4 dp)."""
    agg = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"nulls__{c}") for c in cols],
    )
    long = _wide_to_long(agg, cols, ["nulls"])
    return long.crossJoin(agg.select("_total")).filter(F.col("nulls") > 0).select(
        "feature", F.col("nulls").alias("n_missing"),
        F.round(F.col("nulls") * 100.0 / F.col("_total"), 4).alias("pct"),
    )


def inf_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with +/-Inf cells (before cleaning): count and percent (4 dp)."""
    agg = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.sum((F.abs(F.col(f"`{c}`")) == F.lit(INF)).cast("long")).alias(f"infs__{c}") for c in cols],
    )
    long = _wide_to_long(agg, cols, ["infs"])
    return long.crossJoin(agg.select("_total")).filter(F.col("infs") > 0).select(
        "feature", F.col("infs").alias("n_inf"), F.round(F.col("infs") * 100.0 / F.col("_total"), 4).alias("pct")
    )


def duplicate_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first occurrence of their value combination (one row)."""
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("k"))
    return groups.agg(
        F.sum("k").cast("long").alias("n_rows"),
        F.sum(F.col("k") - 1).cast("long").alias("n_duplicates"),
        F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("long").alias("n_duplicated_groups"),
    ).select(
        "n_rows", "n_duplicates", "n_duplicated_groups",
        F.round(F.when(F.col("n_rows") > 0, F.col("n_duplicates") * 100.0 / F.col("n_rows")).otherwise(0.0), 3).alias("pct"),
    )


def duplicate_members_sample(df: DataFrame, cols: Sequence[str], groups: int, seed: int = 42) -> DataFrame:
    """All member rows of ``groups`` duplicated value combinations, picked by a seeded hash order
    (a sampling operator: the limit is on groups, every member of a picked group is returned)."""
    from flowlens.operators.prep import hash_key

    dup = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    picked = dup.withColumn("_h", hash_key(list(cols), seed)).orderBy("_h", *cols).limit(groups).select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(cols)]
    )
    cond = None
    for i, c in enumerate(cols):  # missing equals missing, as in the duplicate count
        e = F.col(c).eqNullSafe(F.col(f"_p{i}"))
        cond = e if cond is None else cond & e
    return df.join(F.broadcast(picked), cond, "left_semi")


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: distinct non-null count <= 1 (min == max, or no value at all)."""
    agg = df.agg(
        *[x for c in cols for x in (
            F.min(F.col(f"`{c}`")).cast("string").alias(f"mn__{c}"),
            F.max(F.col(f"`{c}`")).cast("string").alias(f"mx__{c}"),
            F.count(F.col(f"`{c}`")).alias(f"cnt__{c}"),
        )]
    )
    long = _wide_to_long(agg, cols, ["mn", "mx", "cnt"])
    return long.select("feature", ((F.col("cnt") == 0) | (F.col("mn") == F.col("mx"))).alias("is_constant"))


def near_constant_columns(df: DataFrame, cols: Sequence[str], share: float = 0.99) -> DataFrame:
    """Columns whose most frequent non-null value holds >= ``share`` of the non-null cells.

    A value with share >= 50 % is the median, so the candidate is the
    (approximate) median -- a mergeable sketch -- and a second pass counts it
    exactly.  No (column, value) shuffle of high-cardinality columns.
    Constant columns are excluded.
    """
    cand = df.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5, 100000).alias(f"cand__{c}") for c in cols]
    ).first()
    agg = df.agg(
        *[x for c in cols for x in (
            F.sum((F.col(f"`{c}`").cast("double") == F.lit(cand[f"cand__{c}"])).cast("long")).alias(f"top__{c}"),
            F.count(F.col(f"`{c}`")).alias(f"cnt__{c}"),
            F.min(F.col(f"`{c}`").cast("double")).alias(f"mn__{c}"),
            F.max(F.col(f"`{c}`").cast("double")).alias(f"mx__{c}"),
        )]
    )
    long = _wide_to_long(agg, cols, ["top", "cnt", "mn", "mx"])
    values = {c: cand[f"cand__{c}"] for c in cols}
    value_col = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(values[c]).cast("double"))])
    return long.filter(
        (F.col("cnt") > 0) & (F.col("mn") != F.col("mx")) & (F.col("top") >= F.lit(share) * F.col("cnt"))
    ).select(
        "feature",
        value_col[F.col("feature")].alias("top_value"),
        F.round(F.col("top") * 100.0 / F.col("cnt"), 2).alias("share_pct"),
    )


DESCRIBE_PCTS = [("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)]


def describe_extended(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, p5..p95 (linear), max, skewness and excess
    kurtosis (bias-corrected like pandas), n_inf; Inf counts as missing."""
    exprs = []
    for c in cols:
        x = finite_or_null(F.col(f"`{c}`"))
        exprs += [
            F.count(x).alias(f"count__{c}"),
            F.avg(x).alias(f"mean__{c}"),
            F.stddev_samp(x).alias(f"std__{c}"),
            F.min(x).alias(f"min__{c}"),
            F.max(x).alias(f"max__{c}"),
            F.skewness(x).alias(f"g1__{c}"),
            F.kurtosis(x).alias(f"g2__{c}"),
            F.sum((F.abs(F.col(f"`{c}`").cast("double")) == F.lit(INF)).cast("long")).alias(f"ninf__{c}"),
        ]
    fr = [p for _, p in DESCRIBE_PCTS]
    long = _wide_to_long(df.agg(*exprs), cols, ["count", "mean", "std", "min", "max", "g1", "g2", "ninf"])
    finite = df.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) for c in cols])
    pv = percentile_columns(finite, cols, fr)
    pct = df.sparkSession.createDataFrame(
        [(c, [pv[(c, p)] for p in fr]) for c in cols], "feature string, pct array<double>"
    )
    long = long.join(F.broadcast(pct), "feature")  # one row per column
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    nan_safe = lambda e: F.when(~F.isnan(e), e)
    return long.select(
        "feature",
        F.col("count").cast("long").alias("count"),
        F.round("mean", 9).alias("mean"),
        F.round("std", 5).alias("std"),
        F.round("min", 6).alias("min"),
        *[F.round(F.col("pct")[i], 6).alias(name) for i, (name, _) in enumerate(DESCRIBE_PCTS)],
        F.round("max", 6).alias("max"),
        F.round(nan_safe(skew), 5).alias("skewness"),
        F.round(nan_safe(kurt), 5).alias("kurtosis"),
        F.col("ninf").cast("long").alias("n_inf"),
    )


def clipped_histogram(df: DataFrame, cols: Sequence[str], bins: int = 20,
                      lo_p: float = 0.01, hi_p: float = 0.99) -> DataFrame:
    """Per column: clip at p1/p99, then equal-width bins; counts per bin (zero bins omitted)."""
    q = percentile_columns(df, cols, [lo_p, hi_p])
    # every column's bucket, counted in the scan stage as one small map of (feature, bucket)
    cells = []
    for c in cols:
        lo, hi = q[(c, lo_p)], q[(c, hi_p)]
        if lo is None:
            continue
        v = F.col(f"`{c}`").cast("double")
        inside = F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
        at = F.least(F.lit(bins), F.floor((inside - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int") + 1) if hi > lo else F.lit(1)
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("feature"), at.alias("bucket"))))
    bounds = df.sparkSession.createDataFrame([(c, q[(c, lo_p)], q[(c, hi_p)]) for c in cols], "feature string, lo double, hi double")
    if not cells:
        return bounds.filter("lo IS NOT NULL").select("feature", F.lit(1).alias("bucket"), F.lit(0).cast("long").alias("n"), "lo", "hi")
    counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).groupBy("s.feature", "s.bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(bounds), "feature").select(  # one row per column
        "feature", "bucket", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _bin(df: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    clipped = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
    span = F.col("hi") - F.col("lo")
    b = F.when(span > 0, F.least(F.lit(bins), F.floor((clipped - F.col("lo")) / span * bins).cast("int") + 1)).otherwise(1)
    return df.groupBy(*keys, b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.first("lo"), 6).alias("lo"),
        F.round(F.first("hi"), 6).alias("hi"),
    )


def clipped_by_label(df: DataFrame, col: str, label: str = "label", bins: int = 20) -> DataFrame:
    """One feature per label: clip at the label's own p1/p99, equal-width bins."""
    bounds = group_percentile_table(df, col, label, [0.01, 0.99]).select(
        label, F.col("pct")[0].alias("lo"), F.col("pct")[1].alias("hi"))
    vals = df.select(F.col(label).cast("string").alias(label), F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    return _bin(vals.join(bounds, label), [label], bins)


_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy", "bad"]


def _pair_moments(shift: np.ndarray, scale: np.ndarray):
    """Arrow batches -> one row of pairwise-complete moments per column pair and partition.

    Values are shifted and scaled by the global mean and deviation, so the sums
    don't cancel; ``bad`` counts non-finite cells.
    """
    k = len(shift)
    left, right = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad, s1, s2, s12 = (np.zeros((k, k)) for _ in range(5))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            have = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            wild = have & ~np.isfinite(x)
            x = np.where(have & ~wild, (x - shift) / scale, 0.0)
            m = have.astype(np.float64)
            n, bad = n + m.T @ m, bad + wild.T.astype(np.float64) @ m
            s1, s2, s12 = s1 + x.T @ m, s2 + (x * x).T @ m, s12 + x.T @ x
            for i in range(k):  # spread of column i over the rows that column j has
                both = have & have[:, i : i + 1]
                low[i] = np.minimum(low[i], np.where(both, x[:, i : i + 1], np.inf).min(axis=0))
                high[i] = np.maximum(high[i], np.where(both, x[:, i : i + 1], -np.inf).max(axis=0))
        at, ta = (left, right), (right, left)
        values = [n[at], s1[at], s1[ta], s2[at], s2[ta], s12[at], bad[at] + bad[ta], low[at], high[at], low[ta], high[ta]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *[pa.array(v, pa.float64()) for v in values]],
            ["i", "j", *_SUMS, "lox", "hix", "loy", "hiy"])

    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str], top: int = 40) -> DataFrame:
    """Pearson correlation with pairwise-complete rows, over the ``top`` highest-variance columns.

    Pass 1: mean and sample variance per column (selection); pass 2: one row of
    moments per pair and partition, merged by ``groupBy``.  The plan grows with the
    columns, not with the pairs.  A side that is constant over the pair's rows,
    or a non-finite cell, gives NULL.
    """
    first = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}|{c}")
                     for c in cols for k, f in (("v", F.var_samp), ("m", F.avg))]).first()
    variance = {c: first[f"v|{c}"] for c in cols if first[f"v|{c}"] is not None}
    ranked = sorted(variance, key=lambda c: -variance[c] if np.isfinite(variance[c]) else np.inf)[:top]
    keep = [c for c in cols if c in ranked]  # stable column order
    if len(keep) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    spread = np.array([variance[c] for c in keep])
    usable = np.isfinite(spread) & (spread > 0)
    shift = np.where(usable, np.array([first[f"m|{c}"] for c in keep], dtype=np.float64), 0.0)
    scale = np.sqrt(np.where(usable, spread, 1.0))
    fields = ", ".join(f"{c} double" for c in [*_SUMS, "lox", "hix", "loy", "hiy"])
    moments = (
        df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(keep)])
        .mapInArrow(_pair_moments(shift, scale), f"i int, j int, {fields}")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in ("lox", "loy")],
             *[F.max(c).alias(c) for c in ("hix", "hiy")])
    )
    vx, vy = (F.col("n") * F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}") for a in "xy")
    varies = (F.col("bad") == 0) & (F.col("lox") < F.col("hix")) & (F.col("loy") < F.col("hiy")) & (vx > 0) & (vy > 0)
    corr = F.when(varies, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*map(F.lit, keep))
    return moments.select(F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"),
                          F.round(corr, 6).alias("corr"))


def quality_gates(df: DataFrame, cols: Sequence[str], source: str, label: str, benign_source: str,
                  expected_files: int, benign: str = "BENIGN", file_columns: DataFrame | None = None) -> DataFrame:
    """One row per gate: (gate, value, pass).  ``file_columns`` (one row per file with ``n_cols``) adds the
    gate that every file has the same number of columns."""
    is_benign = F.col(label) == benign
    in_bs = F.col(source) == benign_source
    a = df.agg(
        F.countDistinct(source).alias("n_files"),
        F.sum(F.col(label).isNull().cast("long")).alias("null_labels"),
        F.sum((in_bs & ~is_benign).cast("long")).alias("bs_non_benign"),
        F.countDistinct(F.when(is_benign, F.col(source))).alias("benign_files"),
        F.sum(F.when(in_bs, sum(F.col(f"`{c}`").isNull().cast("long") for c in cols)).otherwise(0)).alias("bs_nulls"),
        F.sum(F.when(in_bs, sum((F.abs(F.col(f"`{c}`").cast("double")) == F.lit(INF)).cast("long") for c in cols)).otherwise(0)).alias("bs_infs"),
        *[F.count(F.col(f"`{c}`")).alias(f"nn__{c}") for c in cols],
    )
    all_null = sum((F.col(f"`nn__{c}`") == 0).cast("long") for c in cols)
    gates = [
        ("file_count", F.col("n_files").cast("double"), F.col("n_files") == expected_files),
        ("label_present", F.col("null_labels").cast("double"), F.col("null_labels") == 0),
        ("benign_source_all_benign", F.col("bs_non_benign").cast("double"), F.col("bs_non_benign") == 0),
        ("benign_in_many_files", F.col("benign_files").cast("double"), F.col("benign_files") > 1),
        ("no_all_null_column", all_null.cast("double"), all_null == 0),
        ("benign_source_nulls", F.col("bs_nulls").cast("double"), F.lit(True)),
        ("benign_source_infs", F.col("bs_infs").cast("double"), F.lit(True)),
    ]
    if file_columns is not None:
        a = a.crossJoin(file_columns.agg(F.countDistinct("n_cols").alias("n_widths")))
        gates.append(("same_column_count", F.col("n_widths").cast("double"), F.col("n_widths") <= 1))
    s = [F.struct(F.lit(g).alias("gate"), v.alias("value"), p.alias("passed")) for g, v, p in gates]
    return a.select(F.explode(F.array(*s)).alias("s")).select("s.*")


def candidate_features(constants: DataFrame, near: DataFrame, infs: DataFrame) -> DataFrame:
    """Each column's category: constant > near_constant > inf_affected > candidate."""
    return (
        constants.join(near.select("feature", F.lit(True).alias("near")), "feature", "left")
        .join(infs.select("feature", F.lit(True).alias("has_inf")), "feature", "left")
        .select(
            "feature",
            F.when(F.col("is_constant"), "constant")
            .when(F.col("near").isNotNull(), "near_constant")
            .when(F.col("has_inf").isNotNull(), "inf_affected")
            .otherwise("candidate")
            .alias("category"),
        )
    )


def non_numeric_samples(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """Per non-numeric column: distinct count and the k smallest distinct values (sample values).

    Unpivot -> distinct (feature, value) -> ``row_number() <= k`` per feature, planned as
    WindowGroupLimit, so no column's values are gathered in one buffer."""
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols
    ])).alias("s")).select("s.*").filter(F.col("value").isNotNull()).distinct()
    w = Window.partitionBy("feature").orderBy("value")
    top = long.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    samples = top.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "value"))), lambda x: x["value"]).alias("sample_values")
    )
    counts = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.join(samples, "feature")


def class_balance(df: DataFrame, split: str = "split", truth: str = "binary_label") -> DataFrame:
    """Per split: normal / attack counts and percent (2 dp)."""
    g = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(truth) == 0, 1).otherwise(0)).cast("long").alias("n_normal"),
        F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).cast("long").alias("n_attack"),
    )
    return g.select(
        split, "n", "n_normal", "n_attack",
        F.round(F.col("n_normal") * 100.0 / F.col("n"), 2).alias("pct_normal"),
        F.round(F.col("n_attack") * 100.0 / F.col("n"), 2).alias("pct_attack"),
    )

