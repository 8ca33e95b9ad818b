"""Evaluation operators against brute-force numpy computations and zero-denominator rules."""

import numpy as np
import pandas as pd

from flowlens.operators import evaluate as E
from flowlens.operators import results as R


def _brute_auc_ap(scores, truth):
    pos = scores[truth == 1]
    neg = scores[truth == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    order = np.argsort(-scores, kind="mergesort")
    s, t = scores[order], truth[order]
    ap, tp, fp, prev_r = 0.0, 0, 0, 0.0
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            tp += t[j]
            fp += 1 - t[j]
            j += 1
        r = tp / truth.sum()
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
        i = j
    return auc, ap


def test_auc_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    scores = np.round(rng.normal(size=400), 1)
    truth = (rng.random(400) < 0.3 + 0.2 * (scores > 0)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": scores, "truth": truth}))
    got = E.auc_ap(df).first()
    auc, ap = _brute_auc_ap(scores, truth)
    assert abs(got["roc_auc"] - auc) < 1e-6
    assert abs(got["pr_auc"] - ap) < 1e-6


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, truth int")
    r = E.auc_ap(df).first()
    assert r["roc_auc"] is None and r["pr_auc"] is None


def test_metrics_empty_denominators_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "truth int, prediction int")
    r = E.metrics(df).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0 and r["accuracy"] == 1.0


def test_per_label_null_ratios(spark):
    df = spark.createDataFrame([("BENIGN", 1.0, 0, 0), ("DDoS", 2.0, 1, 1), (None, 3.0, 1, 0)],
                               "label string, score double, truth int, prediction int")
    rows = {r["label"]: r for r in E.per_label_metrics(df).collect()}
    assert rows["BENIGN"]["recall"] is None and rows["BENIGN"]["fpr"] == 0.0
    assert rows["DDoS"]["fpr"] is None and rows["DDoS"]["recall"] == 1.0
    assert rows[None]["fn"] == 1


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    val = np.round(rng.normal(size=300), 2)
    test = np.round(rng.normal(size=500) + 0.5, 2)
    truth = (rng.random(500) < 0.4).astype(int)
    vdf = spark.createDataFrame([(float(v), 0) for v in val], "score double, truth int")
    tdf = spark.createDataFrame([(float(s), int(t)) for s, t in zip(test, truth)], "score double, truth int")
    sw = {r["percentile"]: r for r in E.threshold_sweep(vdf, tdf).collect()}
    for p in E.SWEEP_PERCENTILES:
        th = np.percentile(val, p)
        pred = test > th
        assert sw[p]["tp"] == int((pred & (truth == 1)).sum())
        assert sw[p]["fp"] == int((pred & (truth == 0)).sum())


def test_histogram_min_equals_max(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, 2.0, 0)], "run_id int, reconstruction_error double, prediction int")
    rows = R.histogram(df, ["run_id"]).orderBy("bucket").collect()
    assert len(rows) == 30
    assert rows[0]["normal"] == 1 and rows[0]["anomaly"] == 1
    assert rows[1]["bin"] == "3.0000"  # step 1.0 when all values are equal


def test_histogram_value_at_max_goes_to_last_bin(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (1, 3.0, 1)], "run_id int, reconstruction_error double, prediction int")
    rows = {r["bucket"]: r for r in R.histogram(df, ["run_id"]).collect()}
    assert rows[30]["anomaly"] == 1 and rows[1]["normal"] == 1


def test_auc_of_billions(spark, monkeypatch):
    from flowlens.operators import evaluate as EV

    groups = spark.createDataFrame([(0.9, 4_000_000_000, 0), (0.1, 0, 4_000_000_000)], "score double, pos long, neg long")
    monkeypatch.setattr(EV, "score_groups", lambda *a: groups)
    r = EV.auc_ap(groups).first()
    assert (r["roc_auc"], r["pr_auc"]) == (1.0, 1.0)


def test_kde_uses_every_score(spark):
    v = np.random.default_rng(5).gamma(2.0, 3.0, 500)
    got = E.kde_grid(spark.createDataFrame([(float(x),) for x in v], "score double").repartition(4), "score", points=50).orderBy("g").collect()
    cap = np.percentile(v, 99.5)
    k = v[v <= cap]
    h = 0.3 * k.std(ddof=1)
    grid = np.arange(50) * cap / 49
    want = np.exp(-0.5 * ((grid[:, None] - k) / h) ** 2).sum(1) / (len(k) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r["density"] for r in got], want, atol=2e-6)
    same = E.kde_grid(spark.createDataFrame([(1.0,), (1.0,)], "score double"), "score", points=5).collect()
    assert len(same) == 5 and all(r["density"] is None for r in same)


def test_activation_stats_by_matrix_product(spark):
    from flowlens.operators import score as S

    rng = np.random.default_rng(5)
    w, b = rng.normal(size=(40, 6)), rng.normal(size=40)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(50, None)], "id long, x array<double>").repartition(3)
    got = {r["id"]: r for r in S.activation_stats(df, "x", w, b).collect()}
    for i, row in enumerate(x):
        a = np.maximum(w @ row + b, 0)
        top = sorted(range(40), key=lambda u: (-a[u], u))
        r = got[i]
        assert (r["n_active"], r["n_zero"], r["top_unit"], r["top5_units"]) == ((a > 0).sum(), (a <= 0).sum(), top[0], top[:5])
        assert abs(r["top_activation"] - a.max()) < 1e-5
    assert got[50]["n_active"] is None and got[50]["top5_units"] is None
    none = S.activation_stats(df.filter("id < 0"), "x", w, b)
    assert none.count() == 0
