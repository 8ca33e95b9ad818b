"""Guards and options of classification, threshold choice, feature checks and export."""

import pytest

from flowlens.operators import evaluate as E
from flowlens.operators import fit as FT
from flowlens.operators import prep as P
from flowlens.operators import results as R
from pyspark.sql import functions as F


def _scores(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "score double")


@pytest.mark.parametrize("theta", [0.0, -1.0, float("nan"), float("inf")])
def test_classify_rejects_a_bad_threshold(spark, theta):
    with pytest.raises(ValueError, match="threshold"):
        E.classify(_scores(spark, 1.0), theta)
    with pytest.raises(Exception, match="threshold must be finite"):
        E.classify(_scores(spark, 1.0), F.lit(theta)).collect()


def test_classify_is_strict_and_rejects_non_finite_scores(spark):
    got = [r.prediction for r in E.classify(_scores(spark, 1.0, 1.5, None), 1.0).collect()]
    assert got == [0, 1, None]
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="score is not finite"):
            E.classify(_scores(spark, 1.0, bad), 1.0).collect()


def test_fixed_percentile_threshold(spark):
    val = _scores(spark, *[float(i) for i in range(101)])
    row = E.select_threshold(val, "fixed_percentile", val=val, percentile=97.5).first()
    assert (row.threshold, row.percentile, row.strategy) == (97.5, 97.5, "fixed_percentile")
    with pytest.raises(ValueError):
        E.select_threshold(val, "fixed_percentile")


def test_matrix_checks_raise(spark):
    rows = [(1.0, 2.0, "train", "BENIGN"), (float("nan"), None, "test", "ATK_A"), (1.0, 1.0, "val", "ATK_A"),
            (1.0, 1.0, "train", None)]
    df = spark.createDataFrame(rows, "a double, b double, split string, label string")
    checks = P.matrix_checks(df, ["a", "b"], 3)
    assert {r["check"]: r["n_bad"] for r in checks.collect()} == {
        "non_finite_cells": 2, "feature_count": 1, "attacks_in_train_val": 2}
    with pytest.raises(ValueError, match="not clean"):
        P.require_clean(checks)
    P.require_clean(P.matrix_checks(df.limit(0), ["a", "b"], 2))


def test_best_vs_final(spark):
    h = spark.createDataFrame([(1, 1, 3.0, 4.0), (1, 2, 2.0, 2.5), (1, 3, 1.0, 3.0)],
                              "run_id int, epoch int, train_loss double, val_loss double")
    best = spark.createDataFrame([(1, 2, 3)], "run_id int, best_epoch int, final_epoch int")
    r = FT.best_vs_final(h, best).first()
    assert (r.delta_train_loss, r.delta_val_loss, r.best_gap, r.final_gap) == (-1.0, 0.5, 0.5, 2.0)


def test_export_sorts_and_names_the_source_file(spark):
    preds = spark.createDataFrame([(1, 5, 0, 2.0, 1), (1, 5, 1, 7.0, 1), (1, 5, 2, 2.0, 0)],
                                  "run_id long, upload_id long, row_index long, reconstruction_error double, prediction int")
    rows = spark.createDataFrame([(5, 0, '{"_source_file": "a.csv", "label": "BENIGN"}'), (5, 1, '{"x": 1}'), (5, 2, '{"x": 2}')],
                                 "upload_id long, row_index long, payload string")
    runs = spark.sql("SELECT 1L AS run_id, 5L AS upload_id, 1.0D AS threshold, timestamp'2024-01-01' AS created_at")
    order = {s: [r.row_index for r in R.export_results(preds, rows, runs, sort=s).collect()] for s in ("idx", "err_desc", "err_asc")}
    assert order == {"idx": [0, 1, 2], "err_desc": [1, 0, 2], "err_asc": [0, 2, 1]}
    assert R.has_source_file(rows) and not R.has_source_file(rows.filter("row_index > 0"))
    named = R.export_results(preds, rows, runs, sort="idx", source_file=True).collect()
    assert [r.original_source_file for r in named] == ["a.csv", "", ""]
    with pytest.raises(ValueError):
        R.export_results(preds, rows, runs, sort="name")


def test_stored_rows_are_never_broadcast(spark):
    """As Parquet they are far smaller than in memory; the planner would take them for a small table."""
    from flowlens.sources import result_store as S

    preds = spark.createDataFrame([(1, 5, i, 2.0, 1) for i in range(3)],
                                  "run_id long, upload_id long, row_index long, reconstruction_error double, prediction int")
    rows = spark.createDataFrame([(5, i, "{}") for i in range(3)], "upload_id long, row_index long, payload string")
    runs = spark.sql("SELECT 1L AS run_id, 5L AS upload_id, 1.0D AS threshold, 3L AS total_flows, timestamp'2024-01-01' AS created_at")
    for df, n in ((R.export_results(preds, rows, runs), 3), (R.results_page(preds, rows, runs, 1, 2), 2), (S.validate_runs(preds, runs, rows), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [ln for ln in plan.splitlines() if "Join [" in ln and "row_index" in ln]
        assert joins and all("SortMergeJoin" in ln for ln in joins), plan
        assert df.count() == n
