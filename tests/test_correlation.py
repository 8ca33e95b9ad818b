"""Pairwise-complete correlation against pandas, on many columns."""

import numpy as np
import pandas as pd

from flowlens.operators.profile import correlation_matrix


def test_wide_matrix_agrees_with_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 66)) * rng.uniform(0.1, 9, 66) + 1e6
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.05] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c {i}" for i in range(66)])
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(5)
    got = {(r.col_a, r.col_b): r["corr"] for r in correlation_matrix(df, list(pdf.columns), 40).collect()}
    top = list(pdf.var().nlargest(40).index)
    want = pdf[top].corr()
    assert len(got) == 780
    assert all(abs(want.loc[a, b] - v) < 2e-6 for (a, b), v in got.items())


def test_constant_null_and_non_finite_sides(spark):
    rows = [(1.0, 5.0, None, float("inf"), 1.0), (2.0, 5.0, 1.0, 1.0, 2.0), (3.0, 6.0, None, 2.0, 4.0), (None, 7.0, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, n double, i double, z double")
    got = {(r.col_a, r.col_b): r["corr"] for r in correlation_matrix(df, ["a", "b", "n", "i", "z"]).collect()}
    assert got["a", "n"] is None and got["a", "i"] is None  # one common row; a non-finite cell
    assert abs(got["a", "z"] - np.corrcoef([1, 2, 3], [1, 2, 4])[0, 1]) < 1e-6
    assert correlation_matrix(df.limit(0), ["a", "b"]).count() == 0
