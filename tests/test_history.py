"""Stored histories of several shapes, and merged moments."""

import json

import numpy as np

from flowlens.operators import evaluate as E
from flowlens.operators import fit as FT


def _rows(spark, history):
    text = history if isinstance(history, str) else json.dumps(history)
    df = spark.createDataFrame([("r", text)], "run_id string, history_json string")
    return [tuple(r)[1:] for r in FT.normalise_history(df).orderBy("epoch").collect()]


def test_lists_of_unequal_length_and_other_names(spark):
    got = _rows(spark, {"loss": [3, "2.5", None], "val_recon": [1], "kl_loss": "no list", "extra": [1, 2, 3, 4]})
    assert got == [(1, 3.0, None, None, None, 1.0, None), (2, 2.5, None, None, None, None, None), (3, None, None, None, None, None, None)]


def test_the_first_name_counts_even_if_null(spark):
    assert _rows(spark, {"train_loss": None, "loss": [1], "val_loss": [2]}) == [(1, None, None, None, 2.0, None, None)]


def test_records(spark):
    got = _rows(spark, [{"epoch": 7, "loss": 1, "valid_loss": float("nan")}, "no record", {"total_loss": 2, "val_kld_loss": "x"}])
    assert got == [(3, 2.0, None, None, None, None, None), (7, 1.0, None, None, None, None, None)]


def test_other_shapes_have_no_rows(spark):
    for text in ("3", "null", "{}", "[]", '{"other": [1]}', "not json", ""):
        assert _rows(spark, text) == []
    assert FT.normalise_history(spark.createDataFrame([("r", None)], "run_id string, history_json string")).count() == 0


def test_moments_of_shifted_values_over_partitions(spark):
    x = 1e6 + np.random.default_rng(1).normal(size=(500, 3))
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "x array<double>").repartition(7)
    by_dim = {r["dim"]: r for r in FT.moment_vectors(df, ["x"]).collect()}
    for i in range(3):
        r = by_dim[i]
        assert r["n"] == 500 and r["lo"] == x[:, i].min() and r["hi"] == x[:, i].max()
        np.testing.assert_allclose([r["mean"], r["m2"] / 499], [x[:, i].mean(), x[:, i].var(ddof=1)], rtol=1e-9)
    whole = FT.merged_moments(FT.moment_vectors(df, ["x"]), "col").first()
    np.testing.assert_allclose([whole["n"], whole["m2"] / 1499], [1500, x.var(ddof=1)], rtol=1e-9)


def test_densities_of_an_empty_table(spark):
    none = spark.createDataFrame([], "score double")
    assert E.kde_grid(none, "score").count() == 0
    assert E.density_histogram(none, "score").count() == 0
