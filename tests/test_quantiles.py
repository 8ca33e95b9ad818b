"""Exact percentiles (numpy linear semantics) with forced bracketing."""

import numpy as np
import pytest

from flowlens.operators.quantiles import exact_percentiles, order_statistics


def test_matches_numpy_with_ties(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.gamma(2.0, 3.0, 5000), 1)  # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    ps = [0.0, 0.01, 0.5, 0.9, 0.975, 0.99, 1.0]
    got = exact_percentiles(df, "x", ps, max_inside=300, accuracy=200)
    exp = np.percentile(vals, [p * 100 for p in ps])
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


def test_order_statistics_and_nulls(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,), (2.0,), (None,)], "x double")
    assert order_statistics(df, "x", [0, 2]) == {0: 1.0, 2: 3.0}
    assert exact_percentiles(df, "x", [0.5]) == [2.0]


def test_empty_input(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_percentiles(df, "x", [0.5]) == [None]


def test_grouped_and_column_percentiles(spark):
    from flowlens.operators.quantiles import grouped_percentiles, percentile_columns

    rng = np.random.default_rng(11)
    a = np.round(rng.normal(size=3000), 2)
    b = np.round(rng.exponential(size=3000), 2)
    df = spark.createDataFrame([(float(x), float(y), "g1" if i % 3 else "g2") for i, (x, y) in enumerate(zip(a, b))],
                               "a double, b double, g string")
    got = percentile_columns(df, ["a", "b"], [0.05, 0.5, 0.95], max_inside=200, accuracy=500)
    for c, arr in (("a", a), ("b", b)):
        for p in (0.05, 0.5, 0.95):
            assert abs(got[(c, p)] - np.percentile(arr, p * 100)) < 1e-9
    per = grouped_percentiles(df, "a", "g", [0.5], max_inside=150, accuracy=300)
    idx = np.arange(3000)
    assert abs(per[("g2", 0.5)] - np.percentile(a[idx % 3 == 0], 50)) < 1e-9
    assert abs(per[("g1", 0.5)] - np.percentile(a[idx % 3 != 0], 50)) < 1e-9


def test_ties_never_reach_one_task(spark):
    from pyspark.sql import functions as F

    from flowlens.operators import quantiles as Q

    # 90 % zeros: the final window sees distinct values only
    df = spark.range(20000).select(F.when(F.col("id") % 10 != 0, 0.0).otherwise(F.col("id") * 1.0).alias("x"))
    seen, ranked = [], Q._ranked

    def spy(tagged):
        out = ranked(tagged)
        seen.append(max([r["n"] for r in out.groupBy("_t").count().withColumnRenamed("count", "n").collect()], default=0))
        return out

    Q._ranked = spy
    try:
        got = exact_percentiles(df, "x", [0.0, 0.25, 0.5, 0.9, 0.95, 1.0], max_inside=500, accuracy=1000)
    finally:
        Q._ranked = ranked
    vals = np.array([0.0 if i % 10 else float(i) for i in range(20000)])
    assert np.allclose(got, np.percentile(vals, [0, 25, 50, 90, 95, 100]))
    assert all(n <= 500 for n in seen)


def test_two_values_narrow(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.when(F.col("id") < 2500, -1.0).otherwise(float("inf")).alias("x"))
    assert order_statistics(df, "x", [0, 2499, 2500, 4999], max_inside=10) == {
        0: -1.0, 2499: -1.0, 2500: float("inf"), 4999: float("inf")}


def test_radix_select_is_exact_for_close_integers(spark):
    import random

    from flowlens.operators.quantiles import radix_select

    rng = random.Random(4)
    values = [2**59 + i for i in range(100)] + [-(2**63), 2**63 - 1, 0, -1] + [5] * 50 + [rng.randrange(-2**62, 2**62) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    order = sorted(values)
    for k in (0, 1, 20, 120, 200, 301, len(values) - 1):
        for few in (1000, 3):
            assert radix_select(df, "v", k, few) == (order[k], sum(v < order[k] for v in values), values.count(order[k]))
    with pytest.raises(ValueError):
        radix_select(df, "v", len(values))


@pytest.mark.parametrize("accuracy", [100_000, 250])
def test_group_percentiles_as_a_table(spark, accuracy):
    """A hot group, tied values, single rows, many small groups; a coarse sketch may miss ranks."""
    from flowlens.operators.quantiles import group_percentile_table

    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("tied", 1.5)] * 500 + [("one", 7.0)]
    rows += [(f"g{i % 300}", float(x)) for i, x in enumerate(rng.exponential(size=1500))]
    rows += [("hot", None), ("hot", float("nan")), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = [0.0, 0.01, 0.5, 0.999, 1.0]
    got = {r["g"]: (r["n"], r["pct"]) for r in group_percentile_table(df, "x", "g", ps, accuracy).collect()}
    want = {}
    for g, x in rows:
        if g is not None and x is not None and x == x:
            want.setdefault(g, []).append(x)
    assert got.keys() == want.keys()
    for g, xs in want.items():
        assert got[g][0] == len(xs)
        np.testing.assert_allclose(got[g][1], np.percentile(xs, [100 * p for p in ps]), rtol=1e-12, atol=1e-12)
