"""VAE fitting as a Spark job and training-history analytics.

E1 is data-parallel: the training rows are dealt to shards of a given size by a hash
of the row (copies of one row are dealt out one by one) and checkpointed once, so
the fitted model does not depend on the cluster's cores.  An epoch is one or more
rounds; in a round every shard works on its next ``sync_batches`` minibatches from the
shared parameters.  With ``sync="parameters"`` it takes Adam steps of its own and the
parameter vectors are averaged, weighted by rows (local SGD); with ``sync="gradients"``
the gradients are summed over all batches of the round and one step is taken, so a
round that covers the epoch is a step with the full-batch gradient.  Either way a task
emits its vector as rows (configuration, position, value) and ``groupBy(configuration,
position)`` sums them, so the driver receives one row per parameter -- the size of the
model, independent of the data and of the number of partitions.  Validation is a second
``mapInArrow`` job that returns per-partition sums.

E4 fits several configurations at once: every round trains all of them on the rows that
the task reads anyway, so the table is scanned once an epoch whatever their number.

E2 (early-stopping replay), F18 (best epoch and neighbours) and F20 (history
audit) are window programs over an epoch-history table partitioned by run.
"""

from __future__ import annotations

import time
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.quantiles import exact_percentiles
from flowlens.operators.score import forward

# ---------------------------------------------------------------------------
# parameters as one flat vector
# ---------------------------------------------------------------------------


def init_vae(in_dim: int, hidden: Sequence[int], latent: int, seed: int = 42) -> dict:
    """Uniform(+-1/sqrt(fan_in)) initialisation."""
    rng = np.random.default_rng(seed)

    def layer(o, i):
        s = 1.0 / np.sqrt(i)
        return rng.uniform(-s, s, (o, i)), rng.uniform(-s, s, o)

    dims = [in_dim, *hidden]
    enc = [layer(dims[i + 1], dims[i]) for i in range(len(hidden))]
    mu = layer(latent, dims[-1])
    logvar = layer(latent, dims[-1])
    ddims = [latent, *reversed(hidden)]
    dec = [layer(ddims[i + 1], ddims[i]) for i in range(len(hidden))]
    out = layer(in_dim, ddims[-1])
    return {"enc": enc, "mu": mu, "logvar": logvar, "dec": dec, "out": out}


def _slots(model: dict) -> list[tuple]:
    s = []
    for part in ("enc", "dec"):
        for i in range(len(model[part])):
            s.append((part, i))
    s += [("mu", None), ("logvar", None), ("out", None)]
    return s


def flatten(model: dict) -> np.ndarray:
    parts = []
    for part, i in _slots(model):
        w, b = model[part][i] if i is not None else model[part]
        parts += [w.ravel(), b.ravel()]
    return np.concatenate(parts)


def unflatten(vec: np.ndarray, like: dict) -> dict:
    out = {"enc": [], "dec": []}
    pos = 0
    for part, i in _slots(like):
        w0, b0 = like[part][i] if i is not None else like[part]
        w = vec[pos:pos + w0.size].reshape(w0.shape)
        pos += w0.size
        b = vec[pos:pos + b0.size].reshape(b0.shape)
        pos += b0.size
        if i is None:
            out[part] = (w, b)
        else:
            out[part].append((w, b))
    return out


def n_params(model: dict) -> int:
    return int(flatten(model).size)


# ---------------------------------------------------------------------------
# loss and gradients (numpy, one minibatch)
# ---------------------------------------------------------------------------


def loss_and_grad(model: dict, x: np.ndarray, eps: np.ndarray, beta: float,
                  free_bits: float | None = None) -> tuple[float, float, float, dict]:
    """Training-mode VAE loss (MSE mean + beta * mean KL) and its gradient."""
    bsz, d = x.shape
    pre, acts = [], [x]
    h = x
    for w, b in model["enc"]:
        z = h @ w.T + b
        pre.append(z)
        h = np.maximum(z, 0.0)
        acts.append(h)
    wm, bm = model["mu"]
    wl, bl = model["logvar"]
    mu = h @ wm.T + bm
    lv = h @ wl.T + bl
    std = np.exp(0.5 * lv)
    zlat = mu + eps * std
    dpre, dacts = [], [zlat]
    g = zlat
    for w, b in model["dec"]:
        u = g @ w.T + b
        dpre.append(u)
        g = np.maximum(u, 0.0)
        dacts.append(g)
    wo, bo = model["out"]
    xhat = g @ wo.T + bo
    recon = float(((xhat - x) ** 2).mean())
    kl_dim = -0.5 * (1.0 + lv - mu**2 - np.exp(lv))
    if free_bits is not None:
        mask = (kl_dim > free_bits).astype(np.float64)
        kl = float(np.maximum(kl_dim, free_bits).sum(axis=1).mean())
    else:
        mask = np.ones_like(kl_dim)
        kl = float(kl_dim.sum(axis=1).mean())
    loss = recon + beta * kl

    grads = {"enc": [None] * len(model["enc"]), "dec": [None] * len(model["dec"])}
    dx = 2.0 * (xhat - x) / (bsz * d)
    grads["out"] = (dx.T @ dacts[-1], dx.sum(axis=0))
    dg = dx @ wo
    for i in reversed(range(len(model["dec"]))):
        du = dg * (dpre[i] > 0)
        grads["dec"][i] = (du.T @ dacts[i], du.sum(axis=0))
        dg = du @ model["dec"][i][0]
    dz = dg
    dmu = dz + beta * mask * mu / bsz
    dlv = dz * eps * 0.5 * std + beta * mask * 0.5 * (np.exp(lv) - 1.0) / bsz
    grads["mu"] = (dmu.T @ h, dmu.sum(axis=0))
    grads["logvar"] = (dlv.T @ h, dlv.sum(axis=0))
    dh = dmu @ wm + dlv @ wl
    for i in reversed(range(len(model["enc"]))):
        dzl = dh * (pre[i] > 0)
        grads["enc"][i] = (dzl.T @ acts[i], dzl.sum(axis=0))
        dh = dzl @ model["enc"][i][0]
    return loss, recon, kl, grads


def beta_for_epoch(epoch: int, start: float = 0.0, end: float = 1.0, warmup: int = 30, kind: str = "linear") -> float:
    """KL annealing: progress = min(epoch / warmup, 1); linear, quadratic or constant."""
    if warmup <= 0 or kind == "constant":
        return end
    p = min(float(epoch) / float(warmup), 1.0)
    if kind == "quadratic":
        p = p * p
    elif kind != "linear":
        raise ValueError(kind)
    return float(start + (end - start) * p)


# ---------------------------------------------------------------------------
# Distributed local SGD
# ---------------------------------------------------------------------------

class FitError(ValueError):
    """The training table cannot be fitted."""


# per configuration (cfg) and partition one row per parameter (pos >= 0; sync="parameters":
# values times the partition's rows, sync="gradients": gradient sums) and one statistics row (pos = -1)
TRAIN_SCHEMA = ("cfg int, pos int, wp double, wm double, wv double, n long, n_batches long, "
                "sum_loss double, sum_recon double, sum_kl double")
EVAL_SCHEMA = "cfg int, n long, n_batches long, sum_loss double, sum_recon double, sum_kl double"


def _batches_of(rb_iter, feature: str):
    for rb in rb_iter:
        if rb.num_rows == 0:
            continue
        col = rb.column(rb.schema.get_field_index(feature))
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield flat.reshape(rb.num_rows, -1)


def _buffers(batches, feature: str, rows: int, rng):
    """The rows in blocks of about ``rows``, shuffled inside a block."""
    held, n = [], 0
    for x in _batches_of(batches, feature):
        held.append(x)
        n += len(x)
        if n >= rows:
            block = np.concatenate(held)
            yield block[rng.permutation(n)]
            held, n = [], 0
    if held:
        block = np.concatenate(held)
        yield block[rng.permutation(n)]


def _minibatches(batches, feature: str, cfg: dict, rng, at: int, count: int | None):
    """Minibatches ``at`` to ``at + count`` of a shard (to its end for None)."""
    k = 0
    for block in _buffers(batches, feature, cfg["buffer_rows"], rng):
        for start in range(0, len(block), cfg["batch_size"]):
            if k >= at and (count is None or k < at + count):
                yield k, block[start:start + cfg["batch_size"]]
            k += 1


def adam_step(p, m, v, t: int, grad, cfg: dict):
    """One Adam step with clipping and weight decay; returns (p, m, v)."""
    b1, b2 = 0.9, 0.999
    norm = np.sqrt((grad**2).sum())
    if norm > cfg["clip"]:
        grad = grad * (cfg["clip"] / (norm + 1e-6))
    grad = grad + cfg["weight_decay"] * p
    m = b1 * m + (1 - b1) * grad
    v = b2 * v + (1 - b2) * grad * grad
    return p - cfg["lr"] * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + 1e-8), m, v


def noise(seed: int, epoch: int, shard: int, batch: int, shape: tuple[int, int]) -> np.ndarray:
    """The latent noise of a minibatch: the same whatever else is fitted beside it."""
    return np.random.default_rng([seed, epoch, shard, batch]).standard_normal(shape)


def _train_fn(states: dict[int, dict], epoch: int, cfg: dict, order_seed: int, at: int, feature: str):
    """``states``: configuration number -> like, vec, m, v, step, beta, seed."""

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        rng = np.random.default_rng([order_seed * 1000 + epoch, shard])
        local = {c: {**st, "sums": np.zeros(3), "grad": np.zeros_like(st["vec"])} for c, st in states.items()}
        nb = rows = 0
        for k, xb in _minibatches(batches, feature, cfg, rng, at, cfg["sync_batches"]):
            rows, nb = rows + len(xb), nb + 1
            for st in local.values():
                model = unflatten(st["vec"], st["like"])
                eps = noise(st["seed"], epoch, shard, k, (len(xb), model["mu"][0].shape[0]))
                *parts, g = loss_and_grad(model, xb, eps, st["beta"], cfg.get("free_bits"))
                st["sums"] = st["sums"] + parts
                if cfg["sync"] == "gradients":
                    st["grad"] += flatten(g) * len(xb)
                else:
                    st["step"] += 1
                    st["vec"], st["m"], st["v"] = adam_step(st["vec"], st["m"], st["v"], st["step"], flatten(g), cfg)
        if not rows:
            return
        for c, st in local.items():
            k = len(st["vec"])
            vectors = (st["grad"], np.zeros(k), np.zeros(k)) if cfg["sync"] == "gradients" else [
                st[name] * float(rows) for name in ("vec", "m", "v")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k + 1, c, dtype=np.int32)),
                    pa.array(np.arange(-1, k, dtype=np.int32)),
                    *[pa.array(np.concatenate([[np.nan], x])) for x in vectors],
                    pa.array(np.full(k + 1, rows, dtype=np.int64)),
                    pa.array(np.concatenate([[nb], np.zeros(k)]).astype(np.int64)),
                    *[pa.array(np.concatenate([[x], np.zeros(k)])) for x in st["sums"]],
                ],
                names=["cfg", "pos", "wp", "wm", "wv", "n", "n_batches", "sum_loss", "sum_recon", "sum_kl"],
            )

    return run


def _eval_fn(models: dict[int, tuple[dict, float]], batch_size: int, feature: str, free_bits: float | None):
    """``models``: configuration number -> (model, beta)."""

    def run(batches):
        sums = {c: np.zeros(3) for c in models}
        nb = n = 0
        for x in _batches_of(batches, feature):
            for s in range(0, len(x), batch_size):
                xb = x[s:s + batch_size]
                nb, n = nb + 1, n + len(xb)
                for c, (model, beta) in models.items():
                    out = forward(model, xb)
                    recon = float(((out["xhat"] - xb) ** 2).mean())
                    kl_dim = -0.5 * (1.0 + out["logvar"] - out["mu"] ** 2 - np.exp(out["logvar"]))
                    if free_bits is not None:
                        kl_dim = np.maximum(kl_dim, free_bits)
                    kl = float(kl_dim.sum(axis=1).mean())
                    sums[c] += (recon + beta * kl, recon, kl)
        yield pa.RecordBatch.from_pylist(
            [{"cfg": c, "n": n, "n_batches": nb, "sum_loss": s[0], "sum_recon": s[1], "sum_kl": s[2]} for c, s in sums.items()],
            schema=pa.schema([("cfg", pa.int32()), ("n", pa.int64()), ("n_batches", pa.int64()), ("sum_loss", pa.float64()),
                              ("sum_recon", pa.float64()), ("sum_kl", pa.float64())]))

    return run


DEFAULTS = {
    "lr": 1e-3, "weight_decay": 1e-5, "clip": 5.0, "batch_size": 1024, "epochs": 100,
    "beta_start": 0.0, "beta_end": 1.0, "warmup": 30, "schedule": "linear", "patience": 10, "free_bits": None,
    "buffer_rows": 65536,  # rows that a training task holds and shuffles at a time
    "sync": "parameters",  # or "gradients"
    "sync_batches": None,  # minibatches of a shard between two synchronisations; None: the epoch
}
SHARD_ROWS = 8192  # rows of a local-SGD shard


def training_rows(df: DataFrame, feature: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``feature`` as ``_x``, dealt to one partition per ``shard_rows`` rows, in hash order, checkpointed.

    Rows go by their hash.  A vector with more than ``shard_rows`` copies would fill a shard alone:
    such vectors are counted (combined where they are read), and their copies are dealt
    out by number.  Rows without a feature are left out.
    """
    x = df.select(F.col(feature).cast("array<double>").alias("_x")).filter("_x IS NOT NULL")
    x = x.select("_x", F.xxhash64("_x").alias("_h"))
    counts = x.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.agg(F.sum("_n"), F.sum(F.when(F.col("_n") > shard_rows, 1))).first()
    shards = max(1, -(-(facts[0] or 0) // shard_rows))
    if facts[1]:
        hot = F.broadcast(counts.filter(F.col("_n") > shard_rows).select("_h"))  # fewer than there are shards
        copies = x.join(hot, "_h", "left_semi").groupBy("_h", "_x").agg(F.count(F.lit(1)).alias("_n"))
        dealt = copies.select("_x", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"), "_h")
        x = x.join(hot, "_h", "left_anti").unionByName(dealt.select("_x", F.xxhash64("_h", "_k").alias("_h")))
    return x.repartition(shards, "_h").sortWithinPartitions("_h").select("_x").checkpoint(eager=True)


def vae_fit(train: DataFrame, val: DataFrame, feature: str, hidden: Sequence[int], latent: int,
            seed: int = 42, shard_rows: int = SHARD_ROWS, **cfg_over) -> tuple[dict, DataFrame]:
    """Fit a VAE on ``train[feature]`` (array<double>); returns (best model, epoch history DataFrame).

    ``shard_rows`` sets how many shards there are: by the rows, whatever the cores.
    """
    return fit_prepared(training_rows(train, feature, shard_rows), training_rows(val, feature, shard_rows), hidden, latent,
                        seed, **cfg_over)


def fit_prepared(tr: DataFrame, va: DataFrame, hidden: Sequence[int], latent: int, seed: int = 42,
                 **cfg_over) -> tuple[dict, DataFrame]:
    """``vae_fit`` on frames that ``training_rows`` made, so that several fits share them."""
    models, hist = fit_many(tr, va, {"fit": (hidden, latent)}, seed, **cfg_over)
    return models["fit"], hist.drop("config")


class _Run:
    """One configuration under training and the early-stopping rule of E2: during warm-up the best
    checkpoint tracks validation reconstruction; at warm-up + 1 it resets to the validation total;
    afterwards patience counts on the validation total."""

    def __init__(self, like: dict, seed: int):
        self.like, self.seed, self.vec = like, seed, flatten(like)
        self.m, self.v, self.step = np.zeros_like(self.vec), np.zeros_like(self.vec), 0
        self.best, self.best_epoch, self.best_vec, self.no_improve = float("inf"), 0, self.vec.copy(), 0
        self.rows, self.stopped = [], False

    def state(self, beta: float) -> dict:
        return {"like": self.like, "vec": self.vec, "m": self.m, "v": self.v, "step": self.step, "beta": beta, "seed": self.seed}

    def advance(self, parts: list, cfg: dict) -> None:
        stats = next(r for r in parts if r["pos"] == -1)
        rows = sorted((r for r in parts if r["pos"] >= 0), key=lambda r: r["pos"])
        if cfg["sync"] == "gradients":
            self.step += 1
            grad = np.array([r["p"] for r in rows])
            self.vec, self.m, self.v = adam_step(self.vec, self.m, self.v, self.step, grad, cfg)
        else:
            self.vec, self.m, self.v = (np.array([r[k] for r in rows]) for k in ("p", "m", "v"))
            self.step += int(stats["max_nb"])

    def judge(self, rec: dict, cfg: dict) -> None:
        """Without validation rows the training losses stand in."""
        kind = "val" if rec["n_val"] else "train"
        epoch, total, recon = rec["epoch"], rec[f"{kind}_loss"], rec[f"{kind}_recon"]
        value = recon if epoch <= cfg["warmup"] else total
        if epoch == cfg["warmup"] + 1 or value < self.best:
            self.best, self.best_epoch, self.best_vec, self.no_improve = value, epoch, self.vec.copy(), 0
        elif epoch > cfg["warmup"]:
            self.no_improve += 1
            self.stopped = self.no_improve >= cfg["patience"]
        self.rows.append(rec)


HISTORY = ("config string, epoch int, beta double, n_train long, n_val long, train_loss double, train_recon double, train_kl double, "
           "val_loss double, val_recon double, val_kl double, seconds double, is_best boolean")


def fit_many(tr: DataFrame, va: DataFrame, configs: dict[str, tuple[Sequence[int], int]], seed: int = 42,
             **cfg_over) -> tuple[dict[str, dict], DataFrame]:
    """Fit all ``configs`` (name -> (hidden widths, latent size)) together on frames that ``training_rows``
    made: (name -> best model, history with a ``config`` column).

    A configuration that stops early leaves the later rounds; ``seconds`` of an epoch is the
    time of all that were fitted in it.  Each result is that of a fit of its own.  A
    training table without rows raises ``FitError``.
    """
    cfg = dict(DEFAULTS, **cfg_over)
    if cfg["sync"] not in ("parameters", "gradients"):
        raise FitError(f"sync: {cfg['sync']}")
    first = tr.first()
    if first is None:
        raise FitError("no training rows")
    names = list(configs)
    runs = {c: _Run(init_vae(len(first["_x"]), *configs[name], seed), seed) for c, name in enumerate(names)}
    for epoch in range(1, cfg["epochs"] + 1):
        going = {c: r for c, r in runs.items() if not r.stopped}
        if not going:
            break
        t0 = time.time()
        beta = beta_for_epoch(epoch, cfg["beta_start"], cfg["beta_end"], cfg["warmup"], cfg["schedule"])
        sums = {c: {"n": 0, "nb": 0, "sl": 0.0, "sr": 0.0, "sk": 0.0} for c in going}
        at = 0
        while True:
            states = {c: r.state(beta) for c, r in going.items()}
            out = tr.mapInArrow(_train_fn(states, epoch, cfg, seed, at, "_x"), TRAIN_SCHEMA)
            agg = out.groupBy("cfg", "pos").agg(
                (F.sum("wp") / F.sum("n")).alias("p"), (F.sum("wm") / F.sum("n")).alias("m"), (F.sum("wv") / F.sum("n")).alias("v"),
                F.sum("n").alias("n"), F.sum("n_batches").alias("nb"), F.max("n_batches").alias("max_nb"), F.sum("sum_loss").alias("sl"),
                F.sum("sum_recon").alias("sr"), F.sum("sum_kl").alias("sk"),
            ).collect()
            if not agg:  # all shards are at their ends
                break
            for c, run in going.items():
                parts = [r for r in agg if r["cfg"] == c]
                run.advance(parts, cfg)
                stats = next(r for r in parts if r["pos"] == -1)
                sums[c] = {k: total + stats[k] for k, total in sums[c].items()}
            if cfg["sync_batches"] is None:
                break
            at += cfg["sync_batches"]
        models = {c: (unflatten(r.vec, r.like), beta) for c, r in going.items()}
        evals = {r["cfg"]: r for r in va.mapInArrow(_eval_fn(models, cfg["batch_size"], "_x", cfg.get("free_bits")), EVAL_SCHEMA)
                 .groupBy("cfg").agg(F.sum("n").alias("n"), F.sum("n_batches").alias("nb"), F.sum("sum_loss").alias("l"),
                                     F.sum("sum_recon").alias("r"), F.sum("sum_kl").alias("k")).collect()}
        for c, run in going.items():
            st, ev = sums[c], evals.get(c)
            vnb = ev["nb"] if ev else 0
            run.judge({
                "epoch": epoch, "beta": beta, "n_train": int(st["n"]), "n_val": int(ev["n"]) if vnb else 0,
                "train_loss": st["sl"] / st["nb"], "train_recon": st["sr"] / st["nb"], "train_kl": st["sk"] / st["nb"],
                **{f"val_{name}": ev[k] / vnb if vnb else None for name, k in (("loss", "l"), ("recon", "r"), ("kl", "k"))},
                "seconds": time.time() - t0,
            }, cfg)
    rows = [{"config": names[c], **rec, "is_best": rec["epoch"] == run.best_epoch} for c, run in runs.items() for rec in run.rows]
    hist = tr.sparkSession.createDataFrame(rows, HISTORY)
    return {names[c]: unflatten(r.best_vec, r.like) for c, r in runs.items()}, hist


# ---------------------------------------------------------------------------
# E2 / E3 / F18 / F20 over history tables
# ---------------------------------------------------------------------------


def replay_early_stop(history: DataFrame, warmup: int, patience: int, run: str = "run_id") -> DataFrame:
    """Per run: best epoch, final epoch, stopped flag, best loss under the warm-up early-stopping rule."""
    w = Window.partitionBy(run).orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    post = history.filter(F.col("epoch") > warmup)
    # post-warm-up: improvement iff val_loss below every earlier post-warm-up value (first post epoch always)
    p = post.withColumn("_prev_min", F.min("val_loss").over(before)).withColumn(
        "_improve", F.col("_prev_min").isNull() | (F.col("val_loss") < F.col("_prev_min"))
    ).withColumn("_last_imp", F.max(F.when(F.col("_improve"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stops = p.filter(F.col("epoch") - F.col("_last_imp") >= patience).groupBy(run).agg(F.min("epoch").alias("stop_epoch"))
    last = history.groupBy(run).agg(F.max("epoch").alias("last_epoch"))
    fin = last.join(stops, run, "left").select(
        run, F.coalesce("stop_epoch", "last_epoch").alias("final_epoch"), F.col("stop_epoch").isNotNull().alias("stopped_early")
    )
    post_best = p.join(fin, run).filter(F.col("epoch") <= F.col("final_epoch")).filter("_improve").groupBy(run).agg(
        F.max_by("epoch", "epoch").alias("pb_epoch"), F.max_by("val_loss", "epoch").alias("pb_loss")
    )
    warm = history.filter(F.col("epoch") <= warmup).groupBy(run).agg(
        F.min_by("epoch", F.struct("val_recon", "epoch")).alias("wb_epoch"), F.min("val_recon").alias("wb_loss")
    )
    return fin.join(post_best, run, "left").join(warm, run, "left").select(
        run,
        F.coalesce("pb_epoch", "wb_epoch").alias("best_epoch"),
        "final_epoch",
        "stopped_early",
        F.coalesce("pb_loss", "wb_loss").alias("best_loss"),
    )


def epoch_history(batches: DataFrame, run: str = "run_id") -> DataFrame:
    """Epoch value = mean of the batch means (a short last batch weighs the same)."""
    per_batch = batches.groupBy(run, "epoch", "batch").agg(F.avg("loss").alias("bm"), F.first("beta").alias("beta"))
    return per_batch.groupBy(run, "epoch").agg(
        F.avg("bm").alias("train_loss"), F.count(F.lit(1)).alias("n_batches"), F.max("beta").alias("beta")
    )


def best_epoch_neighbours(history: DataFrame, best: DataFrame, k: int = 5, run: str = "run_id") -> DataFrame:
    """Epochs best-k .. best+k clipped to [1, final], is_best flag, val - train gap."""
    j = history.join(best.select(run, "best_epoch", "final_epoch"), run)
    return j.filter(
        (F.col("epoch") >= F.greatest(F.lit(1), F.col("best_epoch") - k))
        & (F.col("epoch") <= F.least(F.col("final_epoch"), F.col("best_epoch") + k))
    ).select(
        run, "epoch", "train_loss", "val_loss", (F.col("epoch") == F.col("best_epoch")).alias("is_best"),
        (F.col("val_loss") - F.col("train_loss")).alias("gap"),
    )


def best_vs_final(history: DataFrame, best: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: losses at the best and the final epoch, final - best, and val - train gap at both."""
    at = {"best": F.col("epoch") == F.col("best_epoch"), "final": F.col("epoch") == F.col("final_epoch")}
    g = history.join(best.select(run, "best_epoch", "final_epoch"), run).groupBy(run, "best_epoch", "final_epoch").agg(
        *[F.max(F.when(cond, F.col(f"{part}_loss"))).alias(f"{k}_{part}_loss")
          for k, cond in at.items() for part in ("train", "val")]
    )
    return g.select(
        "*",
        *[(F.col(f"final_{part}_loss") - F.col(f"best_{part}_loss")).alias(f"delta_{part}_loss") for part in ("train", "val")],
        *[(F.col(f"{k}_val_loss") - F.col(f"{k}_train_loss")).alias(f"{k}_gap") for k in at],
    )


def history_audit(history: DataFrame, best: DataFrame, warmup: int, patience: int, run: str = "run_id") -> DataFrame:
    """Stored best vs argmin(val_loss) (first on ties), epoch count and a status."""
    g = history.groupBy(run).agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("argmin_epoch"),
        F.max("epoch").alias("n_epochs"),
    )
    j = g.join(best.select(run, "best_epoch", "final_epoch"), run)
    status = (
        F.when(F.col("best_epoch") != F.col("argmin_epoch"), "mismatch")
        .when((F.col("best_epoch") == 1) & (F.col("n_epochs") <= warmup), "early_stop_in_warmup")
        .when(F.col("n_epochs") <= warmup, "ended_in_warmup")
        .when(F.col("best_epoch") > patience, "ok")
        .otherwise("warning")
    )
    return j.select(run, "n_epochs", "best_epoch", "argmin_epoch", "final_epoch", status.alias("status"))


# fixed values: the names under which a history may hold each metric, in order of preference
HISTORY_KEYS = {
    "train_loss": ["train_loss", "loss", "total_loss"],
    "train_recon_loss": ["train_recon_loss", "train_recon", "recon_loss", "reconstruction_loss", "train_reconstruction_loss"],
    "train_kl_loss": ["train_kl_loss", "train_kl", "kl_loss", "kld_loss", "train_kld_loss"],
    "val_loss": ["val_loss", "validation_loss", "valid_loss"],
    "val_recon_loss": ["val_recon_loss", "val_recon", "validation_recon_loss", "valid_recon_loss", "val_reconstruction_loss"],
    "val_kl_loss": ["val_kl_loss", "val_kl", "validation_kl_loss", "valid_kl_loss", "val_kld_loss"],
}


def _number(text):
    """A number, or NULL for text that is none, NaN and NULL."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def normalise_history(histories: DataFrame, json: str = "history_json", run: str = "run_id") -> DataFrame:
    """training histories stored as JSON -> one row per run and epoch with the six losses.

    A history is an object of lists (epoch = place from 1; shorter lists are padded with NULL) or a
    list of records (epoch = its ``epoch``, or its place from 1; elements that are no
    records are skipped).  The first name of ``HISTORY_KEYS`` that is present counts, even
    if its value is null; what is no number, or in an object no list, is NULL.  A history
    of another shape, or without any of the lists, has no rows.
    """
    text = F.ltrim(F.col(json))

    def held(m, names):
        """The value under the first of ``names`` that the map has."""
        return m[F.get(F.filter(F.array(*map(F.lit, names)), lambda k: F.map_contains_key(m, k)), F.lit(0))]

    def of_lists(m):
        lists = F.struct(*[F.from_json(held(m, names), "array<string>").alias(key) for key, names in HISTORY_KEYS.items()])

        def rows(at):
            n = F.greatest(*[F.coalesce(F.size(at[key]), F.lit(0)) for key in HISTORY_KEYS])
            epochs = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
            return F.transform(epochs, lambda i: F.struct(
                i.alias("epoch"), *[_number(F.get(at[key], i - 1)).alias(key) for key in HISTORY_KEYS]))

        return F.element_at(F.transform(F.array(lists), rows), 1)

    def of_records(records):
        rows = F.transform(records, lambda m, i: F.when(m.isNotNull(), F.struct(
            F.coalesce(m["epoch"].try_cast("int"), i + 1).alias("epoch"),
            *[_number(held(m, names)).alias(key) for key, names in HISTORY_KEYS.items()])))
        return F.filter(rows, lambda r: r.isNotNull())

    parsed = histories.select(
        run, F.when(text.startswith("{"), F.from_json(text, "map<string,string>")).alias("_m"),
        F.when(text.startswith("["), F.from_json(text, "array<string>")).alias("_r"))
    # an element that is no record parses to NULL
    parsed = parsed.withColumn("_r", F.transform("_r", lambda r: F.when(
        F.ltrim(r).startswith("{"), F.from_json(r, "map<string,string>"))))
    rows = F.when(F.col("_m").isNotNull(), of_lists(F.col("_m"))).otherwise(of_records(F.col("_r")))
    return parsed.select(run, F.explode(rows).alias("r")).select(run, "r.*")


MOMENTS = "col string, dim int, n long, mean double, m2 double, lo double, hi double, sum_abs double"


def moment_vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, dim, n, mean, m2, lo, hi, sum_abs) of the array columns: every task keeps one moment vector
    for each column and merges its batches into it; the tasks' vectors are merged by dimension.  Null arrays are left out."""

    def run(batches):
        held: dict[str, list] = {}
        for rb in batches:
            for c in cols:
                col = rb.column(rb.schema.get_field_index(c)).drop_null()
                if not len(col):
                    continue
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
                mean = x.mean(axis=0)
                new = [len(x), mean, ((x - mean) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0), np.abs(x).sum(axis=0)]
                old = held.get(c)
                if old:
                    n, gap = old[0] + new[0], new[1] - old[1]
                    new = [n, old[1] + gap * (new[0] / n), old[2] + new[2] + gap**2 * (old[0] * new[0] / n),
                           np.minimum(old[3], new[3]), np.maximum(old[4], new[4]), old[5] + new[5]]
                held[c] = new
        for c, (n, *vectors) in held.items():
            k = len(vectors[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * k), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, n, np.int64)),
                 *[pa.array(np.asarray(v, np.float64)) for v in vectors]],
                ["col", "dim", "n", "mean", "m2", "lo", "hi", "sum_abs"])

    parts = df.select(*[F.col(c).cast("array<double>").alias(c) for c in cols]).mapInArrow(run, MOMENTS)
    return merged_moments(parts, "col", "dim")


def merged_moments(parts: DataFrame, *keys: str) -> DataFrame:
    """Moments of the union of the parts of each key; a list holds one part per task (or dimension)."""

    def merge(a, b):
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * (b["n"] / n)).alias("mean"),
                        (a["m2"] + b["m2"] + gap * gap * (a["n"] * b["n"].cast("double") / n)).alias("m2"))

    g = parts.groupBy(*keys).agg(F.collect_list(F.struct("n", "mean", "m2")).alias("p"), F.min("lo").alias("lo"),
                                 F.max("hi").alias("hi"), F.sum("sum_abs").alias("sum_abs"))
    whole = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.element_at("p", 1), merge)
    return g.withColumn("w", whole).select(*keys, "w.n", "w.mean", "w.m2", "lo", "hi", "sum_abs")


def collapse_stats(scored: DataFrame, latent: int, x: str = "x") -> DataFrame:
    """mu spread (sample std overall / per dim), max |mu|, mean and spread of logvar, mean |x_hat| and spread
    of x_hat, error percentiles, model MSE vs the zero predictor and the improvement in percent (one row).
    ``scored`` holds mu, logvar, x_hat and the inputs ``x``."""
    pct = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    by_dim = moment_vectors(scored, ["mu", "logvar", "x_hat"])
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    dims = {r["dim"]: r for r in by_dim.filter("col = 'mu'").select("dim", std.alias("std"), "lo", "hi").collect()}
    all_ = {r["col"]: r for r in merged_moments(by_dim, "col").select(
        "col", std.alias("std"), "mean", (F.col("sum_abs") / F.col("n")).alias("mean_abs"), "lo", "hi").collect()}

    def fact(name, key):
        return F.lit(all_[name][key] if name in all_ else None).cast("double")

    base = scored.agg(
        F.avg("reconstruction_error").alias("mse_model"),
        F.avg(F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b) / F.size(x)).alias("mse_zero"),
    )
    ep = exact_percentiles(scored, "reconstruction_error", pct)
    return base.select(
        F.round(fact("mu", "std"), 6).alias("mu_std"),
        *[F.round(F.lit(dims[i]["std"] if i in dims else None).cast("double"), 6).alias(f"mu_std_{i}") for i in range(latent)],
        F.round(F.greatest(F.abs(fact("mu", "lo")), F.abs(fact("mu", "hi"))), 6).alias("mu_max_abs"),
        F.round(fact("logvar", "mean"), 6).alias("logvar_mean"),
        F.round(fact("logvar", "std"), 6).alias("logvar_std"),
        F.round(fact("x_hat", "mean_abs"), 6).alias("xhat_mean_abs"),
        F.round(fact("x_hat", "std"), 6).alias("xhat_std"),
        F.round("mse_model", 6).alias("mse_model"),
        F.round("mse_zero", 6).alias("mse_zero"),
        F.round(F.when(F.col("mse_zero") > 0, (F.col("mse_zero") - F.col("mse_model")) / F.col("mse_zero") * 100), 4).alias("improvement_pct"),
        *[F.round(F.lit(v).cast("double"), 6).alias(f"err_p{int(p * 100)}") for v, p in zip(ep, pct)],
    )


def collapse_verdict(mu_std: float, decoder_diff: float) -> str:
    if mu_std < 1e-3 and decoder_diff < 1e-3:
        return "COLLAPSED"
    if mu_std > 1e-2 and decoder_diff > 1e-2:
        return "OK"
    return "WARNING"
