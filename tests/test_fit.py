"""VAE gradients (finite differences), training against a sequential run and the early-stopping replay."""

import numpy as np
import pytest

from flowlens.operators import fit as FT


def _table(spark, n=130, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 5))
    return spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>")


def _sequential(tr, va, hidden, latent, seed, sync, k, **over):
    """The same fit in plain numpy over one shard: a list of epoch records and the best weights."""
    cfg = dict(FT.DEFAULTS, **over)
    x, y = (np.array([r["_x"] for r in d.collect()]) for d in (tr, va))
    like = FT.init_vae(x.shape[1], hidden, latent, seed)
    p = FT.flatten(like)
    m, v, t, out = np.zeros_like(p), np.zeros_like(p), 0, []
    for epoch in range(1, cfg["epochs"] + 1):
        beta = FT.beta_for_epoch(epoch, warmup=cfg["warmup"])
        mixed = x[np.random.default_rng([seed * 1000 + epoch, 0]).permutation(len(x))]
        sums, batches = np.zeros(3), [mixed[at:at + cfg["batch_size"]] for at in range(0, len(x), cfg["batch_size"])]
        for first in range(0, len(batches), k):
            grad = np.zeros_like(p)
            part = batches[first:first + k]
            for i, xb in enumerate(part, start=first):
                *loss, g = FT.loss_and_grad(FT.unflatten(p, like), xb, FT.noise(seed, epoch, 0, i, (len(xb), latent)), beta)
                sums += loss
                grad += FT.flatten(g) * len(xb)
                if sync == "parameters":
                    t += 1
                    p, m, v = FT.adam_step(p, m, v, t, FT.flatten(g), cfg)
            if sync == "gradients":
                t += 1
                p, m, v = FT.adam_step(p, m, v, t, grad / sum(map(len, part)), cfg)
        val = []
        for at in range(0, len(y), cfg["batch_size"]):
            f = FT.forward(FT.unflatten(p, like), y[at:at + cfg["batch_size"]])
            recon = ((f["xhat"] - y[at:at + cfg["batch_size"]]) ** 2).mean()
            val.append(recon + beta * (-0.5 * (1 + f["logvar"] - f["mu"] ** 2 - np.exp(f["logvar"]))).sum(axis=1).mean())
        out.append((*(sums / len(batches)), np.mean(val), p.copy()))
    return out


@pytest.mark.parametrize("sync,k", [("parameters", 1), ("parameters", 2), ("gradients", 1), ("gradients", 2), ("gradients", 99)])
def test_one_shard_equals_a_sequential_run(spark, sync, k):
    """k = 99: one step an epoch with the full-batch gradient."""
    tr, va = FT.training_rows(_table(spark), "x"), FT.training_rows(_table(spark, 40, 2), "x")
    over = {"epochs": 3, "warmup": 30, "batch_size": 50}
    model, hist = FT.fit_prepared(tr, va, [4], 2, seed=3, sync=sync, sync_batches=k, **over)
    rows, want = hist.orderBy("epoch").collect(), _sequential(tr, va, [4], 2, 3, sync, k, **over)
    for r, w in zip(rows, want, strict=True):
        np.testing.assert_allclose([r["train_loss"], r["train_recon"], r["train_kl"], r["val_loss"]], w[:4], rtol=1e-9)
    best = [r["epoch"] for r in rows if r["is_best"]]
    assert best == [1 + int(np.argmin([r["val_recon"] for r in rows]))]
    np.testing.assert_allclose(FT.flatten(model), want[best[0] - 1][4], rtol=1e-9)


def test_gradients_of_shards_sum_to_the_full_batch(spark):
    """One full-batch step over four shards is the step over one, but for the noise; without it, exactly."""
    x = _table(spark, 400)
    grads = []
    for shard_rows in (100, 1000):
        tr = FT.training_rows(x, "x", shard_rows)
        like = FT.init_vae(5, [4], 2, 3)
        state = FT._Run(like, 3).state(0.0)
        state["like"] = dict(like, logvar=(like["logvar"][0] * 0, like["logvar"][1] * 0 - 400))  # std 0: no noise
        state["vec"] = FT.flatten(state["like"])
        cfg = dict(FT.DEFAULTS, sync="gradients", batch_size=64)
        out = tr.mapInArrow(FT._train_fn({0: state}, 1, cfg, 3, 0, "_x"), FT.TRAIN_SCHEMA).toPandas()
        out = out[out["pos"] >= 0].groupby("pos")[["wp", "n"]].sum()
        grads.append((out["wp"] / out["n"]).to_numpy())
    np.testing.assert_allclose(grads[0], grads[1], rtol=1e-9, atol=1e-12)


def test_configurations_fitted_together_equal_separate_fits(spark):
    tr, va = FT.training_rows(_table(spark, 300), "x", 100), FT.training_rows(_table(spark, 60, 2), "x")
    configs = {"a": ([6, 4], 2), "b": ([3], 1), "c": ([8], 3)}
    over = {"epochs": 6, "warmup": 2, "patience": 1, "batch_size": 32}
    models, hist = FT.fit_many(tr, va, configs, 5, **over)
    for name, (hidden, latent) in configs.items():
        model, own = FT.fit_prepared(tr, va, hidden, latent, 5, **over)
        np.testing.assert_allclose(FT.flatten(models[name]), FT.flatten(model), rtol=1e-9)
        a, b = (sorted(d.drop("seconds").collect()) for d in (hist.filter(hist.config == name).drop("config"), own))
        assert [(r["epoch"], r["is_best"]) for r in a] == [(r["epoch"], r["is_best"]) for r in b]
        np.testing.assert_allclose([r["val_loss"] for r in a], [r["val_loss"] for r in b], rtol=1e-9)


def test_copies_of_one_vector_spread_over_shards(spark):
    hot = spark.createDataFrame([([1.0, 2.0],)] * 400 + [([float(i), 0.0],) for i in range(600)] + [(None,)], "x array<double>")
    a, b = (FT.training_rows(d, "x", 100).rdd.glom().map(lambda p: sorted(tuple(r["_x"]) for r in p)).collect()
            for d in (hot.repartition(1), hot.repartition(7)))
    assert len(a) == 10 and sum(map(len, a)) == 1000 and sorted(a) == sorted(b)
    assert max(sum(r == (1.0, 2.0) for r in p) for p in a) < 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "x array<double>")
    with pytest.raises(FT.FitError):
        FT.vae_fit(none, none, "x", [3], 1)
    model, hist = FT.vae_fit(_table(spark), none, "x", [3], 1, epochs=2, warmup=1)
    rows = hist.orderBy("epoch").collect()
    assert [r["val_loss"] for r in rows] == [None, None] and [r["n_val"] for r in rows] == [0, 0]
    assert [r["is_best"] for r in rows] == [False, True]  # after warm-up the total of the training rows counts


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    model = FT.init_vae(5, [4, 3], 2, seed=1)
    x = rng.normal(size=(7, 5))
    eps = rng.normal(size=(7, 2))
    for fb in (None, 0.05):
        _, _, _, g = FT.loss_and_grad(model, x, eps, beta=0.7, free_bits=fb)
        vec, gv = FT.flatten(model), FT.flatten(g)
        for i in rng.choice(len(vec), 25, replace=False):
            h = 1e-6
            up, dn = vec.copy(), vec.copy()
            up[i] += h
            dn[i] -= h
            lu = FT.loss_and_grad(FT.unflatten(up, model), x, eps, 0.7, fb)[0]
            ld = FT.loss_and_grad(FT.unflatten(dn, model), x, eps, 0.7, fb)[0]
            assert abs((lu - ld) / (2 * h) - gv[i]) < 1e-5


def test_beta_schedule():
    assert FT.beta_for_epoch(15, 0.0, 1.0, 30, "linear") == 0.5
    assert FT.beta_for_epoch(15, 0.0, 1.0, 30, "quadratic") == 0.25
    assert FT.beta_for_epoch(45, 0.0, 1.0, 30, "linear") == 1.0
    assert FT.beta_for_epoch(3, 0.0, 1.0, 30, "constant") == 1.0


def test_local_sgd_reduces_loss(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(600, 2))
    x = np.hstack([z, z @ rng.normal(size=(2, 4))])
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(3)
    # beta 0: a plain autoencoder must learn the 2-d structure (with beta 1 this data collapses)
    model, hist = FT.vae_fit(df, df, "x", [8], 2, seed=3, epochs=8, warmup=2, batch_size=64, lr=1e-2, beta_end=0.0)
    h = hist.orderBy("epoch").collect()
    assert h[-1]["val_recon"] < 0.6 * h[0]["val_recon"]
    assert sum(r["is_best"] for r in h) == 1


def test_fit_does_not_depend_on_the_input_partitions(spark):
    rows = [(np.random.default_rng(i).normal(size=3).tolist(),) for i in range(300)]
    fits = [FT.vae_fit(d, d, "x", [4], 2, seed=3, shard_rows=100, epochs=2, batch_size=32, buffer_rows=64)
            for d in (spark.createDataFrame(rows, "x array<double>").repartition(n) for n in (1, 5))]
    a, b = (h.orderBy("epoch").collect() for _, h in fits)
    assert [r["n_train"] for r in a] == [300, 300] == [r["n_train"] for r in b]
    np.testing.assert_allclose([r["val_loss"] for r in a], [r["val_loss"] for r in b], rtol=1e-9)


def test_replay_rule(spark):
    # warm-up 3, patience 2: best by val_recon in warm-up, reset at epoch 4, stop after 2 non-improving epochs
    rows = [("r", e, vl, vr, 0.0) for e, vl, vr in [
        (1, 9.0, 5.0), (2, 9.0, 4.0), (3, 9.0, 4.5), (4, 3.0, 9.0), (5, 2.0, 9.0), (6, 2.5, 9.0), (7, 2.1, 9.0), (8, 1.0, 9.0)]]
    h = spark.createDataFrame(rows, "run_id string, epoch int, val_loss double, val_recon double, train_loss double")
    r = FT.replay_early_stop(h, 3, 2).first()
    assert (r["best_epoch"], r["final_epoch"], r["stopped_early"], r["best_loss"]) == (5, 7, True, 2.0)
    short = h.filter("epoch <= 3")
    r2 = FT.replay_early_stop(short, 3, 2).first()
    assert (r2["best_epoch"], r2["final_epoch"], r2["stopped_early"]) == (2, 3, False)
