"""Cleaning, splitting and fitted transforms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import prep as P


def test_dedupe_keeps_first_in_order_with_hot_group(spark):
    rows = [(1.0, "a", "f2", i) for i in range(300)] + [(1.0, "a", "f1", 5), (2.0, None, "f1", 1), (2.0, None, "f1", 0)]
    df = spark.createDataFrame(rows, "x double, y string, src string, pos int")
    out = {(r["x"], r["y"]): (r["src"], r["pos"]) for r in P.dedupe_keep_first(df, ["x", "y"], ["src", "pos"]).collect()}
    assert out == {(1.0, "a"): ("f1", 5), (2.0, None): ("f1", 0)}


def test_train_val_split_size(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = P.train_val_split(df, ["k"], 42, 0.2)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["val"] == math.ceil(0.2 * 1003) and counts["train"] == 1003 - counts["val"]
    again = P.train_val_split(df, ["k"], 42, 0.2).filter("split = 'val'").select("k")
    assert s.filter("split = 'val'").select("k").exceptAll(again).count() == 0  # reproducible


@pytest.mark.parametrize("keys", [[7] * 1000, [k // 100 for k in range(1000)], [None] * 300 + list(range(33))])
def test_split_sizes_hold_for_repeated_keys(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(3)
    s = P.train_val_split(df, ["k"], 42, 0.2)
    rows = {r["i"]: r["split"] for r in s.select("i", "split").collect()}
    assert len(rows) == len(keys) and sum(v == "val" for v in rows.values()) == math.ceil(0.2 * len(keys))
    assert s.columns == ["k", "i", "split"]


def test_impute_scale_zero_variance_and_missing_median(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    med = P.fit_medians(train, ["a", "b"])
    imp = P.impute(train, med.select("a"), ["a", "b"])
    vals = sorted((r["a"], r["b"]) for r in imp.collect())
    assert vals == [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)]
    sc = P.fit_scaler(imp, ["a", "b"])
    scales = {r["feature"]: r["scale"] for r in sc.collect()}
    assert scales["b"] == 1.0 and abs(scales["a"] - np.std([1.0, 2.0, 3.0])) < 1e-12
    out = P.scale(imp, sc, ["a", "b"]).collect()
    assert all(r["b"] == 0.0 for r in out)


def test_align_strict_missing_is_error(spark):
    df = spark.createDataFrame([(1, 2)], "a int, extra int")
    with pytest.raises(P.PrepError):
        P.align_schema(df, ["a", "b"], "strict")
    lenient = P.align_schema(df, ["b", "a"], "lenient")
    assert lenient.columns == ["b", "a"] and lenient.first()["b"] is None


def test_min_max_constant_range_divides_by_one(spark):
    ref = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    df = spark.createDataFrame([(5.0,)], "a double")
    assert P.min_max_scale(df, ref, ["a"]).first()["a"] == 3.0


def test_sample_per_label_caps_and_reports(spark):
    df = spark.createDataFrame([("A", i) for i in range(10)] + [("B", 1)], "label string, k int")
    s = P.sample_per_label(df, "label", 3, 42, ["k"])
    targets = spark.createDataFrame([("A",), ("B",), ("C",)], "label string")
    rep = {r["label"]: (r["found"], r["status"]) for r in P.sample_report(s, targets, "label", 3).collect()}
    assert rep == {"A": (3, "ok"), "B": (1, "partial"), "C": (0, "missing")}
    assert P.fixed_batch(df, ["k", "label"], 2).count() == 2
    assert df.select(F.lit(1)).count() == 11
