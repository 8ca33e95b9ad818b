"""Property-based checks of the two scale primitives against brute force (hypothesis)."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowlens.operators.ordering import ordered_scan
from flowlens.operators.quantiles import exact_percentiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    values=st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300),
    fractions=st.lists(st.floats(min_value=0.0, max_value=1.0), min_size=1, max_size=4),
    max_inside=st.sampled_from([5, 40, 10_000]),
)
def test_exact_percentiles_match_numpy(spark, values, fractions, max_inside):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_percentiles(df, "x", fractions, max_inside=max_inside, accuracy=100)
    exp = [float(np.percentile(np.array(values, dtype=float), f * 100)) for f in fractions]
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


@SETTINGS
@given(
    rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 10_000)), min_size=1, max_size=200,
                  unique_by=lambda r: r[1]),
    parts=st.integers(min_value=1, max_value=9),
)
def test_ordered_scan_matches_pandas(spark, rows, parts):
    pdf = pd.DataFrame(rows, columns=["g", "t"])
    pdf["v"] = pdf["t"] % 7
    df = spark.createDataFrame(pdf, "g string, t long, v long")
    out = ordered_scan(df, order_cols=["t"], group_cols=["g"], sums=["v"], index_col="idx", num_partitions=parts).toPandas()
    exp = pdf.sort_values("t").copy()
    key = exp["g"].fillna("<null>")
    exp["idx"] = exp.groupby(key).cumcount()
    exp["cum_v"] = exp.groupby(key)["v"].cumsum()
    m = out.merge(exp, on="t", suffixes=("", "_e"))
    assert len(m) == len(pdf)
    assert (m["idx"] == m["idx_e"]).all() and (m["cum_v"] == m["cum_v_e"]).all()
