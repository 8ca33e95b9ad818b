"""Registered queries: fitting and training-history analytics.

``history`` is an epoch-history table derived from ``events``: run = event
type, epoch = day of month, losses from the day's value extremes (exact
IEEE operations, identical in both engines).  Replay parameters for this
30-epoch history: warm-up 10, patience 5.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import fit as FT
from flowlens.operators import prep as P
from flowlens.operators import score as S
from flowlens.plans import bindings as B
from flowlens.plans.q_prep import FEATS, KEY, PREP_VIEWS, _medians
from flowlens.plans.q_score import TINY, WIDTH, _lin, tiny_sql_views
from flowlens.plans.views_sql import with_views
from flowlens.sources.tables import table

WARMUP, PATIENCE = 10, 5
SELECTED = [(1, "first"), (10, "epoch 10"), (20, "epoch 20"), (30, "epoch 30")]  # fixed values: F19 rows


def history(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(
        ((F.max("value") + F.min("value")) / 200.0).alias("train_loss"),
        (F.min("value") / 20.0).alias("train_recon"),
        ((F.max("value") - F.min("value")) / 1000.0).alias("train_kl"),
        (F.max("value") / 100.0).alias("val_loss"),
        (F.min("value") / 10.0).alias("val_recon"),
        (F.count(F.lit(1)) / 1000.0).alias("val_kl"),
    ).withColumn("beta", F.least(F.lit(1.0), F.col("epoch") / 10.0))


HISTORY_SQL = """history AS (
  SELECT event_type AS run_id, CAST(dayofmonth(ts) AS INTEGER) AS epoch,
         (max(value) + min(value)) / 200.0 AS train_loss, min(value) / 20.0 AS train_recon,
         (max(value) - min(value)) / 1000.0 AS train_kl, max(value) / 100.0 AS val_loss, min(value) / 10.0 AS val_recon,
         count(*) / 1000.0 AS val_kl, least(1.0, CAST(dayofmonth(ts) AS INTEGER) / 10.0) AS beta
  FROM events GROUP BY ALL)"""

REPLAY_SQL = HISTORY_SQL + f""",
p AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min
      FROM history WHERE epoch > {WARMUP}),
p2 AS (SELECT *, prev_min IS NULL OR val_loss < prev_min AS improve FROM p),
p3 AS (SELECT *, max(CASE WHEN improve THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM p2),
fin AS (SELECT l.run_id, coalesce(s.stop_epoch, l.last_epoch) AS final_epoch, s.stop_epoch IS NOT NULL AS stopped_early
        FROM (SELECT run_id, max(epoch) AS last_epoch FROM history GROUP BY run_id) l
        LEFT JOIN (SELECT run_id, min(epoch) AS stop_epoch FROM p3 WHERE epoch - last_imp >= {PATIENCE} GROUP BY run_id) s
        ON l.run_id = s.run_id),
pb AS (SELECT p3.run_id, max(epoch) AS pb_epoch, arg_max(val_loss, epoch) AS pb_loss FROM p3 JOIN fin ON p3.run_id = fin.run_id
       WHERE epoch <= final_epoch AND improve GROUP BY p3.run_id),
wb AS (SELECT run_id, arg_min(epoch, (val_recon, epoch)) AS wb_epoch, min(val_recon) AS wb_loss
       FROM history WHERE epoch <= {WARMUP} GROUP BY run_id),
replay AS (SELECT fin.run_id, CAST(coalesce(pb_epoch, wb_epoch) AS INTEGER) AS best_epoch, CAST(final_epoch AS INTEGER) AS final_epoch,
                  stopped_early, coalesce(pb_loss, wb_loss) AS best_loss
           FROM fin LEFT JOIN pb ON fin.run_id = pb.run_id LEFT JOIN wb ON fin.run_id = wb.run_id)"""


def q_replay(spark, sf):
    r = FT.replay_early_stop(history(spark, sf), WARMUP, PATIENCE)
    return r.select("run_id", "best_epoch", "final_epoch", "stopped_early", F.round("best_loss", 6).alias("best_loss"))


SQL_REPLAY = "WITH " + REPLAY_SQL + "\nSELECT run_id, best_epoch, final_epoch, stopped_early, round(best_loss, 6) AS best_loss FROM replay"


def q_epoch_history(spark, sf):
    ev = table(spark, sf, "events")
    batches = ev.select(
        F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch"), F.hour("ts").alias("batch"),
        (F.col("value") / 100.0).alias("loss"), F.least(F.lit(1.0), F.dayofmonth("ts") / 10.0).alias("beta"),
    )
    h = FT.epoch_history(batches)
    return h.select("run_id", "epoch", F.round("train_loss", 9).alias("train_loss"), "n_batches", F.round("beta", 6).alias("beta"))


SQL_EPOCH_HISTORY = """
SELECT run_id, epoch, round(avg(bm), 9) AS train_loss, CAST(count(*) AS BIGINT) AS n_batches, round(max(beta), 6) AS beta
FROM (SELECT event_type AS run_id, CAST(dayofmonth(ts) AS INTEGER) AS epoch, CAST(hour(ts) AS INTEGER) AS batch,
             avg(value / 100.0) AS bm, any_value(least(1.0, dayofmonth(ts) / 10.0)) AS beta
      FROM events GROUP BY ALL) b
GROUP BY run_id, epoch"""


def q_best_epoch(spark, sf):
    h = history(spark, sf)
    best = FT.replay_early_stop(h, WARMUP, PATIENCE)
    n = FT.best_epoch_neighbours(h, best, 5)
    return n.select("run_id", "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"),
                    "is_best", F.round("gap", 6).alias("gap"))


SQL_BEST_EPOCH = "WITH " + REPLAY_SQL + """
SELECT h.run_id, h.epoch, round(h.train_loss, 6) AS train_loss, round(h.val_loss, 6) AS val_loss, h.epoch = r.best_epoch AS is_best,
       round(h.val_loss - h.train_loss, 6) AS gap
FROM history h JOIN replay r ON h.run_id = r.run_id
WHERE h.epoch >= greatest(1, r.best_epoch - 5) AND h.epoch <= least(r.final_epoch, r.best_epoch + 5)"""


_BEST_FINAL = ["best_train_loss", "best_val_loss", "final_train_loss", "final_val_loss", "delta_train_loss",
               "delta_val_loss", "best_gap", "final_gap"]


def q_best_vs_final(spark, sf):
    h = history(spark, sf)
    out = FT.best_vs_final(h, FT.replay_early_stop(h, WARMUP, PATIENCE))
    return out.select("run_id", "best_epoch", "final_epoch", *[F.round(c, 6).alias(c) for c in _BEST_FINAL])


SQL_BEST_VS_FINAL = "WITH " + REPLAY_SQL + """
SELECT r.run_id, r.best_epoch, r.final_epoch,
       round(b.train_loss, 6) AS best_train_loss, round(b.val_loss, 6) AS best_val_loss,
       round(f.train_loss, 6) AS final_train_loss, round(f.val_loss, 6) AS final_val_loss,
       round(f.train_loss - b.train_loss, 6) AS delta_train_loss, round(f.val_loss - b.val_loss, 6) AS delta_val_loss,
       round(b.val_loss - b.train_loss, 6) AS best_gap, round(f.val_loss - f.train_loss, 6) AS final_gap
FROM replay r JOIN history b ON b.run_id = r.run_id AND b.epoch = r.best_epoch
JOIN history f ON f.run_id = r.run_id AND f.epoch = r.final_epoch"""


def q_history_audit(spark, sf):
    h = history(spark, sf)
    return FT.history_audit(h, FT.replay_early_stop(h, WARMUP, PATIENCE), WARMUP, PATIENCE)


SQL_HISTORY_AUDIT = "WITH " + REPLAY_SQL + f"""
SELECT g.run_id, g.n_epochs, r.best_epoch, g.argmin_epoch, r.final_epoch,
       CASE WHEN r.best_epoch <> g.argmin_epoch THEN 'mismatch'
            WHEN r.best_epoch = 1 AND g.n_epochs <= {WARMUP} THEN 'early_stop_in_warmup'
            WHEN g.n_epochs <= {WARMUP} THEN 'ended_in_warmup'
            WHEN r.best_epoch > {PATIENCE} THEN 'ok' ELSE 'warning' END AS status
FROM (SELECT run_id, CAST(arg_min(epoch, (val_loss, epoch)) AS INTEGER) AS argmin_epoch, CAST(max(epoch) AS INTEGER) AS n_epochs
      FROM history GROUP BY run_id) g JOIN replay r ON g.run_id = r.run_id"""


METRICS = ["train_loss", "train_recon", "train_kl", "val_loss", "val_recon", "val_kl", "beta"]


def _field(name):
    return lambda s: s[name]


def q_selected_epochs(spark, sf):
    """history stored as dict-of-lists JSON per run -> normalised long table -> selected epochs with notes."""
    h = history(spark, sf)
    as_json = h.groupBy("run_id").agg(
        F.to_json(F.struct(*[
            F.transform(F.array_sort(F.collect_list(F.struct("epoch", m))), _field(m)).alias(m) for m in METRICS
        ])).alias("history_json")
    )
    parsed = as_json.select("run_id", F.from_json("history_json", ", ".join(f"{m} array<double>" for m in METRICS)).alias("h"))
    long = parsed.select("run_id", F.posexplode(F.arrays_zip(*[F.col(f"h.{m}").alias(m) for m in METRICS])).alias("pos", "r")).select(
        "run_id", (F.col("pos") + 1).alias("epoch"), *[F.col(f"r.{m}").alias(m) for m in METRICS]
    )
    best = FT.replay_early_stop(h, WARMUP, PATIENCE)
    picks = (
        best.select("run_id", F.explode(F.array(
            *[F.struct(F.lit(e).alias("epoch"), F.lit(i).alias("o"), F.lit(n).alias("note")) for i, (e, n) in enumerate(SELECTED)],
            F.struct(F.col("best_epoch").alias("epoch"), F.lit(4).alias("o"), F.lit("best").alias("note")),
            F.struct(F.col("final_epoch").alias("epoch"), F.lit(5).alias("o"), F.lit("final").alias("note")),
        )).alias("s")).select("run_id", "s.*")
    )
    notes = picks.groupBy("run_id", "epoch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "note"))), lambda s: s["note"]), ", ").alias("notes")
    )
    return long.join(notes, ["run_id", "epoch"]).select(
        "run_id", "epoch", "notes", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss")
    )


SQL_SELECTED_EPOCHS = "WITH " + REPLAY_SQL + """,
picks AS (
  SELECT run_id, 1 AS epoch, 0 AS o, 'first' AS note FROM replay
  UNION ALL SELECT run_id, 10, 1, 'epoch 10' FROM replay
  UNION ALL SELECT run_id, 20, 2, 'epoch 20' FROM replay
  UNION ALL SELECT run_id, 30, 3, 'epoch 30' FROM replay
  UNION ALL SELECT run_id, best_epoch, 4, 'best' FROM replay
  UNION ALL SELECT run_id, final_epoch, 5, 'final' FROM replay),
notes AS (SELECT run_id, epoch, string_agg(note, ', ' ORDER BY o) AS notes FROM picks GROUP BY run_id, epoch)
SELECT h.run_id, h.epoch, n.notes, round(h.train_loss, 6) AS train_loss, round(h.val_loss, 6) AS val_loss
FROM history h JOIN notes n ON h.run_id = n.run_id AND h.epoch = n.epoch"""


STORED = {"train_loss": "train_loss", "train_recon": "train_recon_loss", "train_kl": "train_kl_loss",
          "val_loss": "val_loss", "val_recon": "val_recon_loss", "val_kl": "val_kl_loss"}
# fixed values: other names of the metrics
ALIASES = {"train_loss": "loss", "train_recon": "reconstruction_loss", "train_kl": "kld_loss",
           "val_loss": "validation_loss", "val_recon": "valid_recon_loss", "val_kl": "val_kld_loss"}


def q_normalise_history(spark, sf):
    """every run's history in three stored shapes (lists; records under other names; lists under other names
    of which the validation ones lack the last three epochs), read back as one table."""
    h = history(spark, sf)
    by_epoch = h.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("epoch", *STORED))).alias("e"))

    def listed(names, short=0):
        return F.to_json(F.struct(*[
            F.slice(F.transform("e", _field(m)), F.lit(1), F.size("e") - (short if m.startswith("val") else 0)).alias(names[m])
            for m in STORED]))

    records = F.to_json(F.transform("e", lambda r: F.struct(r["epoch"].alias("epoch"), *[r[m].alias(ALIASES[m]) for m in STORED])))
    shapes = {"lists": listed(STORED), "records": records, "short": listed(ALIASES, 3)}
    stored = by_epoch.select(F.explode(F.array(*[
        F.struct(F.concat_ws("-", "run_id", F.lit(k)).alias("run_id"), v.alias("history_json")) for k, v in shapes.items()])).alias("s"))
    out = FT.normalise_history(stored.select("s.*"))
    return out.select("run_id", "epoch", *[F.round(c, 9).alias(c) for c in STORED.values()])


SQL_NORMALISE_HISTORY = "WITH " + HISTORY_SQL + """,
e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM history)
SELECT run_id || '-' || shape AS run_id, CAST(CASE WHEN shape = 'records' THEN epoch ELSE pos END AS INTEGER) AS epoch, """ + ", ".join(
    f"round({m}, 9) AS {c}" if m.startswith("train") else
    f"CASE WHEN shape <> 'short' OR pos <= n - 3 THEN round({m}, 9) END AS {c}" for m, c in STORED.items()) + """
FROM e, (VALUES ('lists'), ('records'), ('short')) t(shape)"""


# -- E1 / E4 / E5 -----------------------------------------------------------------


def _vector_splits(spark, sf):
    v = B.vectors(spark, sf)
    benign = v.filter(F.col("label") == 0)
    split = P.train_val_split(benign, ["vec_id"], 42, 0.2)
    return split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")


FIT_CFG = {"epochs": 4, "warmup": 2, "patience": 10, "batch_size": 256}


def _epoch_facts(model, hist):
    """What does not depend on the random draws of a fit: rows, annealing weight, size, and that every loss is finite."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in METRICS[:6]]
    return hist.select("epoch", F.round("beta", 6).alias("beta"), "n_train", "n_val",
                       F.lit(FT.n_params(model)).cast("long").alias("n_params"), reduce(and_, finite).alias("losses_finite"))


LOSSES = ["train_loss", "train_recon", "train_kl", "val_loss", "val_recon", "val_kl"]


def q_vae_fit_losses(spark, sf):
    """E1 + E3: the losses of every epoch of the same fit and the epoch whose weights were kept; beside it a
    fit by synchronous gradient steps, one for each minibatch of the shards."""
    tr, va = (FT.training_rows(x, "x") for x in _vector_splits(spark, sf))
    kinds = {"averaged": {}, "gradients": {"sync": "gradients", "sync_batches": 1}}
    parts = [FT.fit_prepared(tr, va, [16, 8], 4, seed=7, **FIT_CFG, **over)[1].withColumn("sync", F.lit(kind))
             for kind, over in kinds.items()]
    return reduce(DataFrame.unionByName, parts).select("sync", "epoch", "beta", *LOSSES, "is_best")


def q_sweep_results(spark, sf):
    """All configurations fitted in one scan an epoch; size, epochs, best epoch and the losses there."""
    tr, va = (FT.training_rows(x, "x") for x in _vector_splits(spark, sf))
    models, hist = FT.fit_many(tr, va, {f"{h}-{z}": (h, z) for h, z in SWEEP}, seed=7, **dict(FIT_CFG, epochs=6))
    sizes = spark.createDataFrame([(f"{h}-{z}", str(h), z, FT.n_params(models[f"{h}-{z}"])) for h, z in SWEEP],
                                  "config string, hidden string, latent int, n_params long")
    best = hist.groupBy("config").agg(
        F.max("epoch").alias("final_epoch"), F.max_by("epoch", "is_best").alias("best_epoch"),
        *[F.max(F.when(F.col("is_best"), F.col(c))).alias(f"best_{c}") for c in LOSSES], F.sum("seconds").alias("fit_seconds"))
    return sizes.join(F.broadcast(best), "config").drop("config")


def _size_sql(inputs: int, hidden: list[int], latent: int) -> int:
    """Parameters of a network: encoder, two latent heads, mirrored decoder."""
    down, up = [inputs, *hidden], [latent, *hidden[::-1], inputs]
    dense = [*zip(down, down[1:]), (hidden[-1], latent), (hidden[-1], latent), *zip(up, up[1:])]
    return sum((i + 1) * o for i, o in dense)


_VECTOR_COUNTS = """vector_counts AS (
  SELECT count(*) - CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_train,
         CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_val, max(len(embedding)) AS width
  FROM embeddings WHERE label = 0)"""


def q_vae_fit(spark, sf):
    """E1 + E3: fit on benign vectors (full width) by local SGD; the facts of every epoch."""
    tr, va = _vector_splits(spark, sf)
    return _epoch_facts(*FT.vae_fit(tr, va, "x", [16, 8], 4, seed=7, **FIT_CFG))


SQL_VAE_FIT = f"""WITH {_VECTOR_COUNTS}
SELECT CAST(e AS INTEGER) AS epoch, round(least(1.0, e / 2.0), 6) AS beta, n_train, n_val,
       CAST({_size_sql(WIDTH, [16, 8], 4)} AS BIGINT) AS n_params, true AS losses_finite
FROM vector_counts, range(1, 5) t(e)"""


FLOW_FIT = {"epochs": 3, "warmup": 30, "patience": 10, "batch_size": 1024}  # the reference batch size


def fit_flows(spark, sf):
    """E1 on the prepared flow features (train split, imputed and scaled on train only), the reference
    architecture [128, 64] -> 16; the model and its history with seconds per epoch."""
    s, med = _medians(spark, sf)
    imp = P.impute(s, med, FEATS, KEY + ["split"])
    scaler = P.fit_scaler(imp.filter(F.col("split") == "train"), FEATS)
    x = P.scale(imp, scaler, FEATS, ["split"]).withColumn("x", F.array(*FEATS))
    tr, va = x.filter(F.col("split") == "train"), x.filter(F.col("split") == "val")
    return FT.vae_fit(tr, va, "x", [128, 64], 16, seed=7, **FLOW_FIT)


def q_vae_fit_flows(spark, sf):
    """E1 on the flow features; the facts of every epoch."""
    return _epoch_facts(*fit_flows(spark, sf))


SQL_VAE_FIT_FLOWS = with_views(f"""
SELECT CAST(e AS INTEGER) AS epoch, round(e / 30.0, 6) AS beta, n_train, n_val,
       CAST({_size_sql(len(FEATS), [128, 64], 16)} AS BIGINT) AS n_params, true AS losses_finite
FROM (SELECT CAST(count(*) FILTER (split = 'train') AS BIGINT) AS n_train,
             CAST(count(*) FILTER (split = 'val') AS BIGINT) AS n_val FROM split_flows) c, range(1, 4) t(e)""", *PREP_VIEWS)

SWEEP = [([16, 8], 4), ([8], 2), ([32, 16], 8)]


def q_config_sweep(spark, sf):
    """Several widths / latent sizes fitted together on the same checkpointed rows; size, rows and epochs per config."""
    tr, va = (FT.training_rows(x, "x") for x in _vector_splits(spark, sf))
    models, hist = FT.fit_many(tr, va, {f"{h}-{z}": (h, z) for h, z in SWEEP}, seed=7, **dict(FIT_CFG, epochs=2))
    parts = []
    for hidden, latent in SWEEP:
        name = f"{hidden}-{latent}"
        facts = _epoch_facts(models[name], hist.filter(F.col("config") == name))
        parts.append(facts.groupBy(F.lit(str(hidden)).alias("hidden"), F.lit(latent).alias("latent"), "n_params", "n_train", "n_val").agg(
            F.max("epoch").alias("epochs"), F.min("losses_finite").alias("losses_finite")))
    return reduce(DataFrame.unionByName, parts)


SQL_CONFIG_SWEEP = f"WITH {_VECTOR_COUNTS}\n" + " UNION ALL ".join(
    f"SELECT '{hidden}' AS hidden, {latent} AS latent, CAST({_size_sql(WIDTH, hidden, latent)} AS BIGINT) AS n_params, "
    "n_train, n_val, 2 AS epochs, true AS losses_finite FROM vector_counts" for hidden, latent in SWEEP)


def q_collapse_stats(spark, sf):
    s = S.vae_score(B.vectors(spark, sf), TINY, "x", ["vec_id", "x"], latent=True, xhat=True)
    return FT.collapse_stats(s, 2, "x")


SQL_COLLAPSE_STATS = "WITH " + tiny_sql_views() + (""",
zeroed AS (SELECT *, (""" + " + ".join(f"x{i} * x{i}" for i in range(WIDTH)) + f") / {float(WIDTH)!r}" + """ AS zero_error FROM tiny)
SELECT round((SELECT stddev_samp(m) FROM (SELECT mu0 AS m FROM tiny UNION ALL SELECT mu1 FROM tiny)), 6) AS mu_std,
       round(stddev_samp(mu0), 6) AS mu_std_0, round(stddev_samp(mu1), 6) AS mu_std_1,
       round(greatest(max(abs(mu0)), max(abs(mu1))), 6) AS mu_max_abs,
       round(avg((lv0 + lv1) / 2), 6) AS logvar_mean,
       round((SELECT stddev_samp(v) FROM (SELECT lv0 AS v FROM tiny UNION ALL SELECT lv1 FROM tiny)), 6) AS logvar_std,
       round((SELECT avg(abs(v)) FROM (SELECT unnest([""" + ", ".join(f"y{i}" for i in range(WIDTH)) + """]) AS v FROM tiny)), 6) AS xhat_mean_abs,
       round((SELECT stddev_samp(v) FROM (SELECT unnest([""" + ", ".join(f"y{i}" for i in range(WIDTH)) + """]) AS v FROM tiny)), 6) AS xhat_std,
       round(avg(recon_error), 6) AS mse_model, round(avg(zero_error), 6) AS mse_zero,
       round(CASE WHEN avg(zero_error) > 0 THEN
             (avg(zero_error) - avg(recon_error)) / avg(zero_error) * 100 END, 4)
         AS improvement_pct,
       round(quantile_cont(recon_error, 0.0), 6) AS err_p0, round(quantile_cont(recon_error, 0.1), 6) AS err_p10,
       round(quantile_cont(recon_error, 0.25), 6) AS err_p25, round(quantile_cont(recon_error, 0.5), 6) AS err_p50,
       round(quantile_cont(recon_error, 0.75), 6) AS err_p75, round(quantile_cont(recon_error, 0.9), 6) AS err_p90,
       round(quantile_cont(recon_error, 0.95), 6) AS err_p95, round(quantile_cont(recon_error, 0.99), 6) AS err_p99,
       round(quantile_cont(recon_error, 1.0), 6) AS err_p100
FROM zeroed""")


PAIRS = 1000  # fixed value: pairs of latent codes


def _uniform(name: str, k: int) -> float:
    """A number in (0, 1) from 60 bits of an md5, so that SQL can draw the same one."""
    return (int(hashlib.md5(f"42|{name}|{k}".encode()).hexdigest()[:15], 16) + 0.5) / 2.0**60


def _normal_codes(n: int) -> np.ndarray:
    """``n`` codes of two independent standard normal numbers (Box-Muller)."""
    u, v = (np.array([_uniform(name, k) for k in range(n)]) for name in "ab")
    r = np.sqrt(-2.0 * np.log(u))
    return np.stack([r * np.cos(2.0 * np.pi * v), r * np.sin(2.0 * np.pi * v)], axis=1)


def q_collapse_verdict(spark, sf):
    """E5 verdict: mu spread and decoder sensitivity on 1,000 pairs of codes drawn from N(0, I)."""
    s = S.vae_score(B.vectors(spark, sf), TINY, "x", ["vec_id"], latent=True)
    mu_std = s.select(F.explode("mu").alias("m")).agg(F.stddev_samp("m")).first()[0] or 0.0
    codes = _normal_codes(2 * PAIRS)
    diff = float(np.abs(S.forward_decoder(TINY, codes[::2]) - S.forward_decoder(TINY, codes[1::2])).mean())
    verdict = FT.collapse_verdict(mu_std, diff)
    return spark.createDataFrame([(round(float(mu_std), 6), round(diff, 6), verdict)],
                                 "mu_std double, decoder_diff double, verdict string")


def _verdict_sql() -> str:
    (wd, bd), (wo, bo) = TINY["dec"][0], TINY["out"]
    gs = [f"g{i}" for i in range(wd.shape[0])]
    u, v = (f"(CAST(CAST('0x' || substr(md5('42|{name}|' || k), 1, 15) AS BIGINT) AS DOUBLE) + 0.5) / 1152921504606846976.0"
            for name in "ab")
    return "WITH " + tiny_sql_views() + f""",
codes AS (SELECT k, sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * ({v})) AS z0, sqrt(-2.0 * ln({u})) * sin(2.0 * pi() * ({v})) AS z1
          FROM range({2 * PAIRS}) t(k)),
hid AS (SELECT k, {", ".join(f"greatest({_lin(wd, bd, ['z0', 'z1'], i)}, 0.0) AS {g}" for i, g in enumerate(gs))} FROM codes),
dec AS (SELECT k, {", ".join(f"{_lin(wo, bo, gs, i)} AS d{i}" for i in range(WIDTH))} FROM hid),
v AS (SELECT (SELECT stddev_samp(m) FROM (SELECT mu0 AS m FROM tiny UNION ALL SELECT mu1 FROM tiny)) AS mu_std,
             (SELECT avg(({" + ".join(f"abs(a.d{i} - b.d{i})" for i in range(WIDTH))}) / {float(WIDTH)!r})
              FROM dec a JOIN dec b ON b.k = a.k + 1 WHERE a.k % 2 = 0) AS diff)
SELECT round(mu_std, 6) AS mu_std, round(diff, 6) AS decoder_diff,
       CASE WHEN mu_std < 1e-3 AND diff < 1e-3 THEN 'COLLAPSED' WHEN mu_std > 1e-2 AND diff > 1e-2 THEN 'OK' ELSE 'WARNING' END AS verdict
FROM v"""


QUERIES = {
    "e1_vae_fit": (q_vae_fit, SQL_VAE_FIT),
    "e1_vae_fit_losses": (q_vae_fit_losses, None),
    "e1_vae_fit_flows": (q_vae_fit_flows, SQL_VAE_FIT_FLOWS),
    "e2_replay_early_stop": (q_replay, SQL_REPLAY),
    "e3_epoch_history": (q_epoch_history, SQL_EPOCH_HISTORY),
    "e4_config_sweep": (q_config_sweep, SQL_CONFIG_SWEEP),
    "e4_sweep_results": (q_sweep_results, None),
    "e5_collapse_stats": (q_collapse_stats, SQL_COLLAPSE_STATS),
    "e5_collapse_verdict": (q_collapse_verdict, _verdict_sql()),
    "f18_best_epoch": (q_best_epoch, SQL_BEST_EPOCH),
    "f19_normalise_history": (q_normalise_history, SQL_NORMALISE_HISTORY),
    "f19_selected_epochs": (q_selected_epochs, SQL_SELECTED_EPOCHS),
    "f18_best_vs_final": (q_best_vs_final, SQL_BEST_VS_FINAL),
    "f20_history_audit": (q_history_audit, SQL_HISTORY_AUDIT),
}
