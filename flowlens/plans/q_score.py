"""Registered queries: VAE scoring and representation.

The oracle-checked net is the 4-3-2-3-4 rule-weight VAE on the first four
embedding components; its DuckDB twin is the same network written out as
scalar SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import evaluate as E
from flowlens.operators import prep as P
from flowlens.operators import score as S
from flowlens.plans import bindings as B
from flowlens.plans.q_prep import FEATS, KEY, _medians
from flowlens.operators.quantiles import exact_percentiles

WIDTH = 64  # components of an embedding, all scored
TINY = S.rule_vae(WIDTH, [3], 2)
WIDE_W, WIDE_B = S.rule_layer(8, 64, 0)
ALPHA = 0.05


def _lit(v: float) -> str:
    return f"({float(v)!r})::DOUBLE"


def _lin(w, b, inputs, i):
    return " + ".join(f"{_lit(w[i][j])} * {inputs[j]}" for j in range(len(inputs))) + f" + {_lit(b[i])}"


def tiny_sql_views() -> str:
    """CTE ``tiny`` over embeddings: vec_id, label, x0.., mu0..1, lv0..1, y0.. (the network in SQL)."""
    m = TINY
    xs = [f"x{i}" for i in range(WIDTH)]
    w, b = m["enc"][0]
    hs = [f"h{i}" for i in range(w.shape[0])]
    wm, bm = m["mu"]
    wl, bl = m["logvar"]
    wd, bd = m["dec"][0]
    gs = [f"g{i}" for i in range(wd.shape[0])]
    wo, bo = m["out"]
    mus = [f"mu{i}" for i in range(wm.shape[0])]
    return ",\n".join([
        "tv AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(WIDTH)) + " FROM embeddings)",
        "t1 AS (SELECT *, " + ", ".join(f"greatest({_lin(w, b, xs, i)}, 0.0) AS {hs[i]}" for i in range(len(hs))) + " FROM tv)",
        "t2 AS (SELECT *, " + ", ".join(f"{_lin(wm, bm, hs, i)} AS mu{i}" for i in range(len(mus)))
        + ", " + ", ".join(f"{_lin(wl, bl, hs, i)} AS lv{i}" for i in range(len(mus))) + " FROM t1)",
        "t3 AS (SELECT *, " + ", ".join(f"greatest({_lin(wd, bd, mus, i)}, 0.0) AS {gs[i]}" for i in range(len(gs))) + " FROM t2)",
        "t4 AS (SELECT *, " + ", ".join(f"{_lin(wo, bo, gs, i)} AS y{i}" for i in range(WIDTH)) + " FROM t3)",
        "tiny AS (SELECT *, (" + " + ".join(f"(x{i} - y{i}) * (x{i} - y{i})" for i in range(WIDTH)) + ") / " + f"{float(WIDTH)!r}" + " AS recon_error, "
        "-0.5 * (" + " + ".join(f"(1.0 + lv{i} - mu{i} * mu{i} - exp(lv{i}))" for i in range(len(mus))) + ") AS kl FROM t4)",
    ])


def net_sql_views(model: dict, src: str, inputs: list[str], keep: list[str], prefix: str) -> list[str]:
    """CTEs computing a (one-hidden-layer) rule-weight VAE over ``inputs`` of view ``src``;
    the last CTE ``<prefix>_out`` has ``keep`` columns plus recon_error."""
    (w, b), = model["enc"]
    wm, bm = model["mu"]
    (wd, bd), = model["dec"]
    wo, bo = model["out"]
    hs = [f"{prefix}_h{i}" for i in range(w.shape[0])]
    mus = [f"{prefix}_m{i}" for i in range(wm.shape[0])]
    gs = [f"{prefix}_g{i}" for i in range(wd.shape[0])]
    ys = [f"{prefix}_y{i}" for i in range(len(inputs))]
    cols = ", ".join(keep + inputs)
    return [
        f"{prefix}_1 AS (SELECT {cols}, " + ", ".join(f"greatest({_lin(w, b, inputs, i)}, 0.0) AS {hs[i]}" for i in range(len(hs))) + f" FROM {src})",
        f"{prefix}_2 AS (SELECT *, " + ", ".join(f"{_lin(wm, bm, hs, i)} AS {mus[i]}" for i in range(len(mus))) + f" FROM {prefix}_1)",
        f"{prefix}_3 AS (SELECT *, " + ", ".join(f"greatest({_lin(wd, bd, mus, i)}, 0.0) AS {gs[i]}" for i in range(len(gs))) + f" FROM {prefix}_2)",
        f"{prefix}_4 AS (SELECT *, " + ", ".join(f"{_lin(wo, bo, gs, i)} AS {ys[i]}" for i in range(len(ys))) + f" FROM {prefix}_3)",
        f"{prefix}_out AS (SELECT {', '.join(keep)}, (" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(inputs, ys))
        + f") / {float(len(inputs))!r} AS recon_error FROM {prefix}_4)",
    ]


def _tiny_scored(spark, sf, latent=False, xhat=False):
    return S.vae_score(B.vectors(spark, sf), TINY, "x", ["vec_id", "label", "x"], latent=latent, xhat=xhat)


def q_vae_score(spark, sf):
    s = _tiny_scored(spark, sf)
    return s.select("vec_id", F.round("reconstruction_error", 6).alias("reconstruction_error"))


SQL_VAE_SCORE = "WITH " + tiny_sql_views() + "\nSELECT vec_id, round(recon_error, 6) AS reconstruction_error FROM tiny"


def q_latent(spark, sf):
    s = _tiny_scored(spark, sf, latent=True)
    return s.select(
        "vec_id",
        *[F.round(F.col("mu")[i], 6).alias(f"mu{i}") for i in range(2)],
        *[F.round(F.col("logvar")[i], 6).alias(f"logvar{i}") for i in range(2)],
        F.round("kl", 6).alias("kl"),
    )


SQL_LATENT = "WITH " + tiny_sql_views() + """
SELECT vec_id, round(mu0, 6) AS mu0, round(mu1, 6) AS mu1, round(lv0, 6) AS logvar0, round(lv1, 6) AS logvar1,
       round(kl, 6) AS kl FROM tiny"""


def q_build_scores(spark, sf):
    s = _tiny_scored(spark, sf, latent=True)
    val = s.filter(F.col("label") == 0)
    out = S.build_scores(val, s, "recon_kl", ALPHA)
    return out.select("vec_id", F.round("score", 6).alias("score"))


SQL_BUILD_SCORES = "WITH " + tiny_sql_views() + """,
st AS (SELECT avg(recon_error) AS mr, CASE WHEN stddev_pop(recon_error) > 0 THEN stddev_pop(recon_error) ELSE 1.0 END AS sr,
              avg(kl) AS mk, CASE WHEN stddev_pop(kl) > 0 THEN stddev_pop(kl) ELSE 1.0 END AS sk
       FROM tiny WHERE label = 0)
SELECT vec_id, round((recon_error - mr) / sr + 0.05 * (kl - mk) / sk, 6) AS score FROM tiny CROSS JOIN st"""


def q_false_negative_parts(spark, sf):
    s = _tiny_scored(spark, sf, latent=True)
    val = s.filter(F.col("label") == 0)
    scored = S.build_scores(val, s, "recon_kl", ALPHA).withColumn("truth", (F.col("label") != 0).cast("int"))
    # a standardised score is centred on 0, so its threshold may be negative: no error-scale guard here
    theta = E.percentile_threshold(scored.filter("truth = 0"), 90.0)
    missed = E.false_negatives(scored.withColumn("prediction", (F.col("score") > theta).cast("int")), "vec_id",
                               parts=["reconstruction_error", "kl"])
    return missed.select("vec_id", *[F.round(c, 6).alias(c) for c in ("score", "reconstruction_error", "kl")])


SQL_FALSE_NEGATIVE_PARTS = "WITH " + tiny_sql_views() + """,
st AS (SELECT avg(recon_error) AS mr, CASE WHEN stddev_pop(recon_error) > 0 THEN stddev_pop(recon_error) ELSE 1.0 END AS sr,
              avg(kl) AS mk, CASE WHEN stddev_pop(kl) > 0 THEN stddev_pop(kl) ELSE 1.0 END AS sk
       FROM tiny WHERE label = 0),
sc AS (SELECT vec_id, label, recon_error, kl, (recon_error - mr) / sr + 0.05 * (kl - mk) / sk AS score FROM tiny CROSS JOIN st),
th AS (SELECT quantile_cont(score, 0.9) AS theta FROM sc WHERE label = 0)
SELECT vec_id, round(score, 6) AS score, round(recon_error, 6) AS reconstruction_error, round(kl, 6) AS kl
FROM sc CROSS JOIN th WHERE label <> 0 AND score <= theta"""


def q_residual_topk(spark, sf):
    s = _tiny_scored(spark, sf, xhat=True)
    theta = exact_percentiles(s.filter(F.col("label") == 0), "reconstruction_error", [0.99])[0]
    r = S.residual_topk(s, "x", "x_hat", theta, 2)
    return r.select(
        "vec_id", F.round("margin", 6).alias("margin"),
        F.col("_top")[0]["i"].alias("top1_feature"), F.round(F.col("_top")[0]["r"], 6).alias("top1_residual"),
        F.col("_top")[1]["i"].alias("top2_feature"), F.round(F.col("_top")[1]["r"], 6).alias("top2_residual"),
    )


SQL_RESIDUAL_TOPK = "WITH " + tiny_sql_views() + """,
th AS (SELECT quantile_cont(recon_error, 0.99) AS theta FROM tiny WHERE label = 0),
rs AS (SELECT vec_id, recon_error - theta AS margin,
              list_sort([""" + ", ".join(f"{{'r': abs(x{i} - y{i}), 'k': {-i}}}" for i in range(WIDTH)) + """], 'DESC') AS srt
       FROM tiny CROSS JOIN th)
SELECT vec_id, round(margin, 6) AS margin, CAST(-srt[1].k AS INTEGER) AS top1_feature, round(srt[1].r, 6) AS top1_residual,
       CAST(-srt[2].k AS INTEGER) AS top2_feature, round(srt[2].r, 6) AS top2_residual FROM rs"""


def q_unit_contributions(spark, sf):
    v = B.vectors(spark, sf).select("vec_id", "x")
    return S.unit_contributions(v, "x", WIDE_W[0], 10)


SQL_UNIT_CONTRIBUTIONS = """
WITH w AS (SELECT [""" + ", ".join(_lit(x) for x in WIDE_W[0]) + """] AS w),
c AS (SELECT vec_id, list_transform(range(1, 65), lambda j: CAST(embedding[j] AS DOUBLE) * w[j]) AS c FROM embeddings, w),
t AS (SELECT vec_id, list_sum(list_transform(c, lambda v: abs(v))) AS tot,
             list_sort(list_transform(range(1, 65), lambda j: {'a': abs(c[j]), 'k': -(j - 1), 'c': c[j]}), 'DESC')[1:10] AS top
      FROM c)
SELECT vec_id, CAST(r AS INTEGER) AS rank, CAST(-top[r].k AS INTEGER) AS unit_input, round(top[r].c, 6) AS contribution,
       round(top[r].a / (tot + 1e-12), 6) AS share
FROM t, (SELECT unnest(range(1, 11)) AS r) rr"""


def q_activation_stats(spark, sf):
    v = B.vectors(spark, sf).select("vec_id", "x")
    return S.activation_stats(v, "x", WIDE_W, WIDE_B)


def _act_sql() -> str:
    units = []
    for u in range(WIDE_W.shape[0]):
        wl = "[" + ", ".join(_lit(x) for x in WIDE_W[u]) + "]"
        units.append(f"greatest(list_sum(list_transform(range(1, 65), lambda j: CAST(embedding[j] AS DOUBLE) * {wl}[j])) + {_lit(WIDE_B[u])}, 0.0)")
    return """
WITH a AS (SELECT vec_id, [""" + ", ".join(units) + """] AS acts FROM embeddings),
b AS (SELECT vec_id, acts, list_sort(list_transform(range(1, 9), lambda i: {'a': acts[i], 'k': -(i - 1)}), 'DESC') AS srt FROM a)
SELECT vec_id, CAST(len(list_filter(acts, lambda v: v > 0)) AS INTEGER) AS n_active,
       CAST(len(list_filter(acts, lambda v: v <= 0)) AS INTEGER) AS n_zero,
       CAST(-srt[1].k AS INTEGER) AS top_unit, round(srt[1].a, 6) AS top_activation,
       list_transform(srt[1:5], lambda s: CAST(-s.k AS INTEGER)) AS top5_units FROM b"""


def q_vector_distance(spark, sf):
    v = B.vectors(spark, sf)
    rep = S.mean_vector(v.filter(F.col("label") == 0), "x")
    return S.vector_distance(v.select("vec_id", "label", "x"), "x", rep)


SQL_VECTOR_DISTANCE = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT pos, avg(x[pos]) AS m FROM v, (SELECT unnest(range(1, 65)) AS pos) r WHERE label = 0 GROUP BY pos),
rep AS (SELECT list(m ORDER BY pos) AS rep FROM p),
d AS (SELECT vec_id, label, x, rep, list_transform(range(1, 65), lambda i: x[i] - rep[i]) AS diff FROM v, rep),
n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS na, sqrt(list_sum(list_transform(rep, lambda a: a * a))) AS nb,
             list_sum(list_transform(range(1, 65), lambda i: x[i] * rep[i])) AS dot FROM d)
SELECT vec_id, label, round(sqrt(list_sum(list_transform(diff, lambda a: a * a))), 6) AS euclidean,
       round(CASE WHEN na < 1e-12 OR nb < 1e-12 THEN 1.0 ELSE 1.0 - dot / (na * nb) END, 6) AS cosine_distance,
       round(list_sum(list_transform(diff, lambda a: abs(a))), 6) AS l1,
       CAST(len(list_filter(diff, lambda a: abs(a) > 0.01)) AS INTEGER) AS n_diff FROM n"""


FLOW_NET = S.rule_vae(len(FEATS), [4], 2)


def q_score_upload(spark, sf):
    """Serving prep (stored medians) -> scale (train scaler) -> VAE -> p99 threshold -> run summary."""
    s, med = _medians(spark, sf)
    imp = P.impute(s, med, FEATS, KEY + ["split"])
    scaler = P.fit_scaler(imp.filter(F.col("split") == "train"), FEATS)
    scaled = P.scale(imp, scaler, FEATS, KEY + ["split"]).withColumn("_x", F.array(*FEATS))
    scored = S.vae_score(scaled, FLOW_NET, "_x", KEY + ["split"])
    theta = exact_percentiles(scored.filter(F.col("split") == "val"), "reconstruction_error", [0.99])[0]
    pred = E.classify(scored.filter(F.col("split") == "test"), theta, "reconstruction_error")
    return pred.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("prediction").cast("long").alias("anomaly_count"),
    ).select(
        "total_flows", "anomaly_count", (F.col("total_flows") - F.col("anomaly_count")).alias("normal_count"),
        F.round(F.when(F.col("total_flows") > 0, F.col("anomaly_count") / F.col("total_flows")).otherwise(0.0), 6).alias("anomaly_rate"),
        F.round(F.lit(theta), 6).alias("threshold"),
    )


def _score_upload_sql() -> str:
    from flowlens.plans.q_prep import PREP_VIEWS, _IMPUTED_SQL, _MED_SQL, _SCALER_SQL

    scaled = "scaled AS (SELECT i.split, " + ", ".join(f"(i.{c} - m_{c}) / s_{c} AS {c}" for c in FEATS) + " FROM imputed i CROSS JOIN scaler)"
    views = [*PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL, scaled, *net_sql_views(FLOW_NET, "scaled", list(FEATS), ["split"], "fn")]
    return "WITH " + ",\n".join(views) + """,
th AS (SELECT quantile_cont(recon_error, 0.99) AS theta FROM fn_out WHERE split = 'val'),
p AS (SELECT CAST(recon_error > theta AS INTEGER) AS prediction, theta FROM fn_out, th WHERE split = 'test')
SELECT CAST(count(*) AS BIGINT) AS total_flows, CAST(sum(prediction) AS BIGINT) AS anomaly_count,
       CAST(count(*) - sum(prediction) AS BIGINT) AS normal_count,
       round(CASE WHEN count(*) > 0 THEN sum(prediction) * 1.0 / count(*) ELSE 0.0 END, 6) AS anomaly_rate,
       round(any_value(theta), 6) AS threshold
FROM p"""


QUERIES = {
    "d1_vae_score": (q_vae_score, SQL_VAE_SCORE),
    "d2_latent": (q_latent, SQL_LATENT),
    "d3_build_scores": (q_build_scores, SQL_BUILD_SCORES),
    "f10_false_negative_parts": (q_false_negative_parts, SQL_FALSE_NEGATIVE_PARTS),
    "d7_score_upload": (q_score_upload, _score_upload_sql()),
    "d8_residual_topk": (q_residual_topk, SQL_RESIDUAL_TOPK),
    "d9_unit_contributions": (q_unit_contributions, SQL_UNIT_CONTRIBUTIONS),
    "d10_activation_stats": (q_activation_stats, _act_sql()),
    "d11_vector_distance": (q_vector_distance, SQL_VECTOR_DISTANCE),
}
