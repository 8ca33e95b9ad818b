"""Distributed prefix scan / row index against a brute-force pandas computation."""

import numpy as np
import pandas as pd

from flowlens.operators.ordering import ordered_scan


def test_global_index_and_prefix_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.permutation(500), "v": rng.integers(0, 5, 500)})
    df = spark.createDataFrame(pdf)
    out = ordered_scan(df, order_cols=["k"], sums=["v"], index_col="idx", num_partitions=7).toPandas()
    exp = pdf.sort_values("k").reset_index(drop=True)
    exp["idx"] = np.arange(len(exp))
    exp["cum_v"] = exp["v"].cumsum()
    got = out.sort_values("k").reset_index(drop=True)
    assert (got["idx"].values == exp["idx"].values).all()
    assert (got["cum_v"].values == exp["cum_v"].values).all()


def test_grouped_index_with_hot_group_and_null_key(spark):
    # one group holds a third of the rows; a NULL group key is its own group
    groups = ["hot"] * 300 + ["a"] * 200 + ["b"] * 300 + [None] * 100
    pdf = pd.DataFrame({"g": groups, "t": np.arange(900)[::-1]})
    df = spark.createDataFrame(pdf, "g string, t long")
    out = ordered_scan(df, order_cols=["t"], group_cols=["g"], index_col="idx", num_partitions=5).toPandas()
    for g, part in out.groupby(out["g"].fillna("<null>")):
        part = part.sort_values("t")
        assert list(part["idx"]) == list(range(len(part))), g


def single_partition_inputs(plan: str) -> list[str]:
    """The operator feeding every ``Exchange SinglePartition`` in a plan string."""
    lines = [ln.strip(" +-:") for ln in plan.splitlines()]
    return [lines[i + 1] for i, ln in enumerate(lines) if "Exchange SinglePartition" in ln and i + 1 < len(lines)]


def test_rows_never_meet_in_one_partition(spark):
    """Only the per-partition totals (one row per range partition) may be gathered in one task."""
    from pyspark.sql import functions as F

    df = spark.range(1000).withColumn("v", F.lit(1))
    out = ordered_scan(df, order_cols=["id"], sums=["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_pid" in plan
    for feeder in single_partition_inputs(plan):
        assert feeder.startswith("HashAggregate(keys=[_pid"), feeder


def test_ranges_follow_the_counted_rows(spark, monkeypatch):
    from flowlens.operators import ordering

    assert ordering.range_count(0, 8) == 8 and ordering.range_count(10**12, 8) == 250_000
    seen = []
    monkeypatch.setattr(ordering, "range_count", lambda rows, setting: seen.append((rows, max(1, -(-rows // 10)))) or seen[-1][1])
    rows = ordered_scan(spark.range(95).withColumnRenamed("id", "k"), order_cols=["k"], index_col="i").collect()
    assert seen == [(95, 10)] and all(r.k == r.i for r in rows) and len(rows) == 95
    assert ordered_scan(spark.range(0), order_cols=["id"], index_col="i").count() == 0
