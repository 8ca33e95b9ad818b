"""VAE scoring and representation operators.

The model is a small parameter table (well under a megabyte for the
reference architecture); it travels to the executors inside the task
closure once per stage.  Rows never leave the executors: ``mapInArrow``
hands each task Arrow record batches (4,096 rows, the reference batch size)
and a numpy forward pass turns them into errors / latents.  Everything after
the forward pass (thresholds, residual rankings, distances) is built-in
column expressions.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.metrics import r6

# ---------------------------------------------------------------------------
# model representation
# ---------------------------------------------------------------------------


def rule_layer(out_dim: int, in_dim: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic weights from a rule (used for oracle-checked fixed nets)."""
    idx = np.arange(out_dim * in_dim, dtype=np.float64).reshape(out_dim, in_dim)
    w = np.round(np.sin(idx * 0.7 + layer * 1.3 + 0.1) * 0.5, 4)
    b = np.round(np.cos(np.arange(out_dim) * 0.9 + layer) * 0.1, 4)
    return w, b


def rule_vae(in_dim: int, hidden: Sequence[int], latent: int) -> dict:
    """A VAE with rule weights: encoder ``hidden``, decoder ``reversed(hidden)``."""
    dims = [in_dim, *hidden]
    enc = [rule_layer(dims[i + 1], dims[i], i) for i in range(len(hidden))]
    k = len(hidden)
    mu = rule_layer(latent, dims[-1], k)
    logvar = rule_layer(latent, dims[-1], k + 1)
    ddims = [latent, *reversed(hidden)]
    dec = [rule_layer(ddims[i + 1], ddims[i], k + 2 + i) for i in range(len(hidden))]
    out = rule_layer(in_dim, ddims[-1], 2 * k + 2)
    return {"enc": enc, "mu": mu, "logvar": logvar, "dec": dec, "out": out}


def forward(model: dict, x: np.ndarray) -> dict:
    """Eval-mode forward pass: z = mu, ReLU hidden layers, linear output."""
    h = x
    acts = []
    for w, b in model["enc"]:
        h = np.maximum(h @ w.T + b, 0.0)
        acts.append(h)
    mu = h @ model["mu"][0].T + model["mu"][1]
    logvar = h @ model["logvar"][0].T + model["logvar"][1]
    g = mu
    for w, b in model["dec"]:
        g = np.maximum(g @ w.T + b, 0.0)
    xhat = g @ model["out"][0].T + model["out"][1]
    err = ((x - xhat) ** 2).mean(axis=1)
    kl = -0.5 * (1.0 + logvar - mu**2 - np.exp(logvar)).sum(axis=1)
    return {"xhat": xhat, "err": err, "mu": mu, "logvar": logvar, "kl": kl, "acts": acts}


def forward_decoder(model: dict, z: np.ndarray) -> np.ndarray:
    """Decoder only: latent codes -> reconstructions."""
    g = z
    for w, b in model["dec"]:
        g = np.maximum(g @ w.T + b, 0.0)
    return g @ model["out"][0].T + model["out"][1]


def model_table(spark, model: dict) -> DataFrame:
    """Parameter table (part, idx, kind, rows, cols, values) -- the stored form of a model."""
    recs = []
    for part in ("enc", "dec"):
        for i, (w, b) in enumerate(model[part]):
            recs.append((part, i, "w", *w.shape, w.ravel().tolist()))
            recs.append((part, i, "b", b.shape[0], 1, b.ravel().tolist()))
    for part in ("mu", "logvar", "out"):
        w, b = model[part]
        recs.append((part, 0, "w", *w.shape, w.ravel().tolist()))
        recs.append((part, 0, "b", b.shape[0], 1, b.ravel().tolist()))
    return spark.createDataFrame(recs, "part string, idx int, kind string, rows int, cols int, values array<double>")


def load_model(table: DataFrame) -> dict:
    """Parameter table -> model dict (a few hundred rows at most)."""
    parts: dict = {}
    for r in table.collect():
        arr = np.asarray(r["values"], dtype=np.float64).reshape(r["rows"], r["cols"])
        parts.setdefault((r["part"], r["idx"]), {})[r["kind"]] = arr
    model = {"enc": [], "dec": []}
    for part in ("enc", "dec"):
        i = 0
        while (part, i) in parts:
            p = parts[(part, i)]
            model[part].append((p["w"], p["b"].ravel()))
            i += 1
    for part in ("mu", "logvar", "out"):
        p = parts[(part, 0)]
        model[part] = (p["w"], p["b"].ravel())
    return model


# ---------------------------------------------------------------------------
# Scoring with mapInArrow
# ---------------------------------------------------------------------------


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def vae_score(df: DataFrame, model: dict, features: str, keep: Sequence[str], latent: bool = False,
              xhat: bool = False) -> DataFrame:
    """Per row: reconstruction_error (mean squared error over features); optionally
    mu, logvar, kl (D2) and x_hat.  ``features`` is an array<double> column."""
    keep = list(keep)
    in_schema = df.select(*keep).schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in in_schema.fields]
    fields.append("reconstruction_error double")
    if latent:
        fields += ["mu array<double>", "logvar array<double>", "kl double"]
    if xhat:
        fields += ["x_hat array<double>"]
    schema = ", ".join(fields)

    def run(batches):
        for rb in batches:
            n = rb.num_rows
            x = _matrix(rb.column(rb.schema.get_field_index("_x")), n)
            cols = {k: rb.column(rb.schema.get_field_index(k)) for k in keep}
            if n == 0:
                out = forward(model, np.zeros((0, len(model["out"][1]))))
            else:
                out = forward(model, x)
            arrays = [cols[k] for k in keep] + [pa.array(out["err"], pa.float64())]
            names = list(keep) + ["reconstruction_error"]
            if latent:
                arrays += [pa.array(list(out["mu"]), pa.list_(pa.float64())),
                           pa.array(list(out["logvar"]), pa.list_(pa.float64())),
                           pa.array(out["kl"], pa.float64())]
                names += ["mu", "logvar", "kl"]
            if xhat:
                arrays += [pa.array(list(out["xhat"]), pa.list_(pa.float64()))]
                names += ["x_hat"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    src = df.select(*keep, F.col(features).cast("array<double>").alias("_x"))
    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# D3: score modes
# ---------------------------------------------------------------------------


def build_scores(val: DataFrame, test: DataFrame, mode: str, alpha: float = 0.05) -> DataFrame:
    """recon / kl / recon_kl = z(recon) + alpha * z(kl); z from validation mean and population std (0 -> 1)."""
    if mode == "recon":
        return test.withColumn("score", F.col("reconstruction_error"))
    if mode == "kl":
        return test.withColumn("score", F.col("kl"))
    if mode != "recon_kl":
        raise ValueError(mode)
    st = val.agg(
        F.avg("reconstruction_error").alias("_mr"), F.stddev_pop("reconstruction_error").alias("_sr"),
        F.avg("kl").alias("_mk"), F.stddev_pop("kl").alias("_sk"),
    ).select("_mr", F.when(F.col("_sr") > 0, F.col("_sr")).otherwise(1.0).alias("_sr"),
             "_mk", F.when(F.col("_sk") > 0, F.col("_sk")).otherwise(1.0).alias("_sk"))
    z = (F.col("reconstruction_error") - F.col("_mr")) / F.col("_sr") + F.lit(alpha) * (F.col("kl") - F.col("_mk")) / F.col("_sk")
    return test.crossJoin(F.broadcast(st)).withColumn("score", z).drop("_mr", "_sr", "_mk", "_sk")


# ---------------------------------------------------------------------------
# Array expressions (no shuffle)
# ---------------------------------------------------------------------------


def residual_topk(scored: DataFrame, x: str, xhat: str, theta: float, k: int = 2) -> DataFrame:
    """Residual |x - x_hat| per feature, the k largest (feature index, residual), margin = error - theta."""
    res = F.zip_with(F.col(x), F.col(xhat), lambda a, b: F.abs(a - b))
    tagged = F.transform(res, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    ordered = F.array_sort(tagged, lambda a, b: F.when(a["r"] > b["r"], -1).when(a["r"] < b["r"], 1)
                           .otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))
    return scored.withColumn("_top", F.slice(ordered, 1, k)).withColumn(
        "margin", F.col("reconstruction_error") - F.lit(theta)
    )


def unit_contributions(df: DataFrame, x: str, weights: Sequence[float], k: int = 10) -> DataFrame:
    """W[0, j] * x[j] for one hidden unit; share = |c| / (sum |c| + 1e-12); top k by |c|, with rank."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    contrib = F.zip_with(F.col(x), w, lambda a, b: a * b)
    total = F.aggregate(contrib, F.lit(0.0), lambda acc, c: acc + F.abs(c))
    tagged = F.transform(contrib, lambda c, j: F.struct(F.abs(c).alias("a"), j.alias("j"), c.alias("c")))
    ordered = F.array_sort(tagged, lambda p, q_: F.when(p["a"] > q_["a"], -1).when(p["a"] < q_["a"], 1)
                           .otherwise(F.when(p["j"] < q_["j"], -1).when(p["j"] > q_["j"], 1).otherwise(0)))
    top = F.slice(ordered, 1, k)
    return df.select("*", total.alias("_tot"), F.posexplode(top).alias("_rank", "_t")).select(
        *[c for c in df.columns if c != x],
        (F.col("_rank") + 1).alias("rank"),
        F.col("_t.j").alias("unit_input"),
        r6(F.col("_t.c")).alias("contribution"),
        r6(F.col("_t.a") / (F.col("_tot") + F.lit(1e-12))).alias("share"),
    )


def activation_stats(df: DataFrame, x: str, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """First-layer ReLU activations: active (> 0) and zero unit counts, strongest unit, top-5 units (ties: the
    smaller unit).  One matrix product per Arrow batch, as in ``vae_score``; a NULL vector gives NULLs."""
    keep = [c for c in df.columns if c != x]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]

    def run(batches):
        for rb in batches:
            col = rb.column(rb.schema.get_field_index("_x"))
            there = col.is_valid().to_numpy(zero_copy_only=False)
            values = _matrix(col.drop_null(), int(there.sum()))
            acts = np.maximum(values @ w.T + b, 0.0) if len(values) else np.zeros((0, len(b)))
            order = np.argsort(-acts, axis=1, kind="stable")
            active = (acts > 0).sum(axis=1)

            def spread(found, kind):
                full = np.zeros(rb.num_rows, dtype=found.dtype)
                full[there] = found
                return pa.array(full, kind, mask=~there)

            top5 = iter(order[:, :5].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(rb.schema.get_field_index(c)) for c in keep],
                 spread(active, pa.int32()), spread(len(b) - active, pa.int32()), spread(order[:, 0], pa.int32()),
                 spread(np.take_along_axis(acts, order[:, :1], axis=1)[:, 0], pa.float64()),
                 pa.array([next(top5) if t else None for t in there], pa.list_(pa.int32()))],
                names=[*keep, "n_active", "n_zero", "top_unit", "top_activation", "top5_units"])

    schema = ", ".join([*kinds, "n_active int, n_zero int, top_unit int, top_activation double, top5_units array<int>"])
    out = df.select(*keep, F.col(x).cast("array<double>").alias("_x")).mapInArrow(run, schema)
    return out.withColumn("top_activation", r6("top_activation"))


def mean_vector(df: DataFrame, x: str) -> DataFrame:
    """Element-wise mean of an array column (one row): posexplode + groupBy(pos) -- partial aggregation."""
    per = df.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    return per.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_s")).select(
        F.transform("_s", lambda s: s["m"]).alias("rep")
    )


def vector_distance(df: DataFrame, x: str, rep: DataFrame) -> DataFrame:
    """Euclidean, cosine distance (1.0 when a norm < 1e-12), L1 and count of |diff| > 0.01 to ``rep``."""
    j = df.crossJoin(F.broadcast(rep))
    diff = F.zip_with(F.col(x), F.col("rep"), lambda a, b: a - b)
    sq = F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d)
    l1 = F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + F.abs(d))
    dot = F.aggregate(F.zip_with(F.col(x), F.col("rep"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(F.col(x), F.lit(0.0), lambda acc, v: acc + v * v))
    nb = F.sqrt(F.aggregate(F.col("rep"), F.lit(0.0), lambda acc, v: acc + v * v))
    cos = F.when((na < 1e-12) | (nb < 1e-12), F.lit(1.0)).otherwise(1.0 - dot / (na * nb))
    return j.select(
        *[c for c in df.columns if c != x],
        r6(F.sqrt(sq)).alias("euclidean"),
        r6(cos).alias("cosine_distance"),
        r6(l1).alias("l1"),
        F.size(F.filter(diff, lambda d: F.abs(d) > 0.01)).alias("n_diff"),
    )
