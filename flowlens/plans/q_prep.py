"""Registered queries: schema alignment, coercion, cleaning, splitting and feature prep."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.cleaning import canonical_label, coerce_numeric
from flowlens.functions.labels import binary_label
from flowlens.operators import prep as P
from flowlens.plans import bindings as B
from flowlens.plans.q_profile import BENIGN_SOURCE, SPLIT_KEY, split_sql
from flowlens.plans.views_sql import FLOWS, with_views
from flowlens.session import scratch_dir
from flowlens.sources.tables import table

FEATS = ["quantity", "price", "discount", "tax", "line", "qty_num"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CONTRACT = FEATS + ["missing_feature"]
QUOTAS = [("BENIGN", 150), ("ATK_A", 30), ("ATK_R", 20)]  # fixed values: mixed-batch quotas
SAMPLE_N = 50
SEED = 42


_SPLIT_CACHE: dict = {}


def split_flows(spark, sf):
    """flows_dirty with coerced qty_num and the split column (train / val / test).

    Written once per session to the shared scratch folder: medians, scaler,
    scaling and the split reports all read this table instead of re-running
    the source scan and the split for every job.
    """
    key = (spark.sparkContext.applicationId, sf)
    path = _SPLIT_CACHE.get(key)
    if path is None:
        d = B.flows_dirty(spark, sf).withColumn("qty_num", coerce_numeric("qty_text"))
        d = d.withColumn("binary_label", binary_label("label"))
        s, n_tv = P.source_split(d, "source_file", BENIGN_SOURCE, with_count=True)
        tv = P.train_val_split(s.filter(F.col("split") == "train_val").drop("split"), SPLIT_KEY, SEED, 0.2, n=n_tv)
        path = scratch_dir(spark, "split_flows", unique=True)
        tv.unionByName(s.filter(F.col("split") == "test")).write.parquet(path)
        _SPLIT_CACHE[key] = path
    return spark.read.parquet(path)


# split_flows over flows_dirty + qty_num (same split rule as q_profile.split_sql)
PREP_VIEWS = [
    FLOWS,
    """flows_q AS (
  SELECT *, CASE WHEN isfinite(TRY_CAST(trim(qty_text) AS DOUBLE)) THEN TRY_CAST(trim(qty_text) AS DOUBLE) END AS qty_num
  FROM (SELECT *, CASE WHEN discount = 0 THEN 'Infinity' WHEN tax = 0 THEN 'NaN'
                       ELSE CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS qty_text FROM flows) f)""",
    split_sql("flows_q"),
]


def _medians(spark, sf):
    s = split_flows(spark, sf)
    return s, P.fit_medians(s.filter(F.col("split") == "train"), FEATS)


_MED_SQL = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in FEATS) + " FROM split_flows WHERE split = 'train')"
_IMPUTED_SQL = "imputed AS (SELECT " + ", ".join(f"s.{k}" for k in KEY) + ", s.split, s.label, s.l_shipdate, s.l_extendedprice, " + ", ".join(
    f"coalesce(s.{c}, med.{c}, 0.0) AS {c}" for c in FEATS) + " FROM split_flows s CROSS JOIN med)"
_SCALER_SQL = "scaler AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}" for c in FEATS
) + " FROM imputed WHERE split = 'train')"


def _r(cols, digits=6):
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def _r_sql(cols, prefix="", digits=6):
    return ", ".join(f"round({prefix}{c}, {digits}) AS {c}" for c in cols)


def q_align_schema(spark, sf):
    d = B.flows_dirty(spark, sf)
    return P.align_schema(d, ["quantity", "qty_text", "missing_feature", "tax"], "lenient", KEY)


SQL_ALIGN_SCHEMA = with_views(
    "SELECT " + ", ".join(KEY) + ", quantity, qty_text, CAST(NULL AS VARCHAR) AS missing_feature, tax FROM flows_q", *PREP_VIEWS[:2]
)


def q_coerce_numeric(spark, sf):
    d = B.flows_dirty(spark, sf)
    return d.select(*KEY, "qty_text", coerce_numeric("qty_text").alias("qty_num"))


SQL_COERCE_NUMERIC = with_views("SELECT " + ", ".join(KEY) + ", qty_text, qty_num FROM flows_q", *PREP_VIEWS[:2])


def q_drop_columns(spark, sf):
    d = B.flows_dirty(spark, sf).withColumn("qty_num", coerce_numeric("qty_text"))
    kept = P.drop_columns(d, P.CONSTANT_COLS + P.NEAR_CONSTANT_COLS + ["const_col", "sparse_col", "qty_text"])
    return kept.select(*KEY, *[c for c in kept.columns if c in FEATS])


SQL_DROP_COLUMNS = with_views("SELECT " + ", ".join(KEY + FEATS) + " FROM flows_q", *PREP_VIEWS[:2])


def q_dedupe_keep_first(spark, sf):
    f = B.flows(spark, sf)
    li = f.select(F.col("quantity").alias("l_quantity"),
                  F.col("discount").alias("l_discount"), F.col("tax").alias("l_tax"),
                  F.when(F.col("label") == "BENIGN", "B").otherwise(F.col("label")).alias("lab"),
                  "source_file", "l_shipdate", *KEY, "l_extendedprice")
    return P.dedupe_keep_first(
        li, ["l_quantity", "l_discount", "l_tax", "lab"],
        ["source_file", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    ).drop("l_shipdate", "l_extendedprice")


SQL_DEDUPE_KEEP_FIRST = with_views("""
SELECT l_quantity, l_discount, l_tax, lab, source_file, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT quantity AS l_quantity, discount AS l_discount, tax AS l_tax,
         CASE WHEN label = 'BENIGN' THEN 'B' ELSE label END AS lab, source_file, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY quantity, discount, tax, CASE WHEN label = 'BENIGN' THEN 'B' ELSE label END
                            ORDER BY source_file, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM flows) x WHERE rn = 1""", FLOWS)


def q_binary_label(spark, sf):
    f = B.flows(spark, sf)
    return f.groupBy("label", binary_label("label").alias("binary_label")).agg(F.count(F.lit(1)).alias("n"))


SQL_BINARY_LABEL = with_views(
    "SELECT label, CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS binary_label, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY ALL",
    FLOWS,
)


def q_source_split(spark, sf):
    f = B.flows(spark, sf)
    s = P.source_split(f, "source_file", BENIGN_SOURCE)
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


SQL_SOURCE_SPLIT = with_views("""
SELECT CASE WHEN source_file = 'src_1995' THEN 'train_val' ELSE 'test' END AS split, label, CAST(count(*) AS BIGINT) AS n
FROM flows GROUP BY ALL""", FLOWS)


def q_train_val_split(spark, sf):
    s = split_flows(spark, sf)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_orderkey")).alias("key_sum"))


SQL_TRAIN_VAL_SPLIT = with_views(
    "SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM split_flows GROUP BY split",
    *PREP_VIEWS,
)


def q_fit_medians(spark, sf):
    _, med = _medians(spark, sf)
    s = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("median")) for c in FEATS]
    return med.select(F.explode(F.array(*s)).alias("s")).select("s.*")


SQL_FIT_MEDIANS = with_views(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round({c}, 6) AS median FROM med" for c in FEATS), *PREP_VIEWS, _MED_SQL
)


def q_impute(spark, sf):
    s, med = _medians(spark, sf)
    return P.impute(s, med, FEATS, KEY + ["split"]).select(*KEY, "split", *_r(FEATS))


SQL_IMPUTE = with_views(
    "SELECT " + ", ".join(KEY) + ", split, " + _r_sql(FEATS) + " FROM imputed", *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL
)


def _scaled(spark, sf):
    s, med = _medians(spark, sf)
    imp = P.impute(s, med, FEATS, KEY + ["split", "label", "l_shipdate", "l_extendedprice"])
    scaler = P.fit_scaler(imp.filter(F.col("split") == "train"), FEATS)
    return imp, scaler


def q_fit_scaler(spark, sf):
    _, scaler = _scaled(spark, sf)
    return scaler.select("feature", "pos", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


SQL_FIT_SCALER = with_views(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS pos, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale FROM scaler"
        for i, c in enumerate(FEATS)
    ), *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL,
)


def q_scale(spark, sf):
    imp, scaler = _scaled(spark, sf)
    test = imp.filter(F.col("split") == "test")
    return P.scale(test, scaler, FEATS, KEY).select(*KEY, *_r(FEATS))


SQL_SCALE = with_views(
    "SELECT " + ", ".join(KEY) + ", " + ", ".join(f"round((i.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATS)
    + " FROM imputed i CROSS JOIN scaler WHERE i.split = 'test'", *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL,
)


def q_assert_finite(spark, sf):
    imp, scaler = _scaled(spark, sf)
    return P.assert_finite(P.scale(imp, scaler, FEATS), FEATS)


def q_matrix_checks(spark, sf):
    imp, scaler = _scaled(spark, sf)
    return P.matrix_checks(P.scale(imp, scaler, FEATS, ["split", "label"]), FEATS, len(FEATS))


SQL_MATRIX_CHECKS = with_views(
    "SELECT 'non_finite_cells' AS \"check\", CAST(sum("
    + " + ".join(f"CASE WHEN isfinite((i.{c} - m_{c}) / s_{c}) THEN 0 ELSE 1 END" for c in FEATS)
    + ") AS BIGINT) AS n_bad FROM imputed i CROSS JOIN scaler"
    " UNION ALL SELECT 'feature_count', CAST(0 AS BIGINT)"
    " UNION ALL SELECT 'attacks_in_train_val', CAST(count(*) AS BIGINT) FROM imputed"
    " WHERE split IN ('train', 'val') AND label IS DISTINCT FROM 'BENIGN'",
    *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL,
)


SQL_ASSERT_FINITE = with_views(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN isfinite((i.{c} - m_{c}) / s_{c}) THEN 0 ELSE 1 END) AS BIGINT) AS n_bad "
        f"FROM imputed i CROSS JOIN scaler" for c in FEATS
    ), *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL,
)


def q_fixed_batch(spark, sf):
    imp, _ = _scaled(spark, sf)
    test = imp.filter(F.col("split") == "test")
    return P.fixed_batch(test, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 128).select(
        *KEY, *_r(FEATS)
    )


SQL_FIXED_BATCH = with_views(
    "SELECT " + ", ".join(KEY) + ", " + _r_sql(FEATS) + " FROM imputed WHERE split = 'test' "
    "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 128",
    *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL,
)


def q_min_max_scale(spark, sf):
    imp, _ = _scaled(spark, sf)
    train, test = imp.filter(F.col("split") == "train"), imp.filter(F.col("split") == "test")
    return P.min_max_scale(test, train, FEATS, KEY).select(*KEY, *_r(FEATS))


SQL_MIN_MAX_SCALE = with_views(
    "SELECT " + ", ".join(KEY) + ", " + ", ".join(
        f"round((i.{c} - mn_{c}) / CASE WHEN mx_{c} - mn_{c} <= 1e-8 THEN 1.0 ELSE mx_{c} - mn_{c} END, 6) AS {c}" for c in FEATS
    ) + " FROM imputed i CROSS JOIN (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in FEATS)
    + " FROM imputed WHERE split = 'train') r WHERE i.split = 'test'",
    *PREP_VIEWS, _MED_SQL, _IMPUTED_SQL,
)


def q_canonical_label(spark, sf):
    f = B.flows(spark, sf)
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", canonical_label("label").alias("canonical"), "n")


SQL_CANONICAL_LABEL = with_views(
    "SELECT label, CASE WHEN lower(trim(label)) = 'benign' THEN 'BENIGN' END AS canonical, CAST(count(*) AS BIGINT) AS n "
    "FROM flows GROUP BY label", FLOWS,
)

# fixed values: raw label spellings as found in files and their canonical names
RAW_LABELS = [
    ("BENIGN ", "BENIGN"), ("\ufeffHeartbleed", "Heartbleed"), ("DoS  Hulk", "DoS Hulk"),
    ("DoS Slowhttptest", "DoS Slowhttptest"), ("dos slowloris", "DoS slowloris"), ("DoS GoldenEye", "DoS GoldenEye"),
    ("\uff24\uff24\uff4f\uff33", "DDoS"), ("Infiltration", "Infiltration"), ("Bot", "Bot"), ("PortScan", "PortScan"),
    ("FTP-Patator", "FTP-Patator"), ("SSH\u2013Patator", "SSH-Patator"),
    ("Web Attack \ufffd Brute Force", "Web Attack - Brute Force"), ("Web Attack \u2014 XSS", "Web Attack - XSS"),
    ("Web Attack - Sql Injection", "Web Attack - Sql Injection"), ("robot", None), (None, None),
]


def q_canonical_rules(spark, sf):
    """Every order line gets one of the raw spellings by its order key; their distinct values are mapped."""
    raw = F.element_at(F.array(*[F.lit(r).cast("string") for r, _ in RAW_LABELS]),
                       (F.col("l_orderkey") % len(RAW_LABELS) + 1).cast("int"))
    counts = table(spark, sf, "lineitem").select(raw.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", canonical_label("label").alias("canonical"), "n")


def _text(x):
    return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"


SQL_CANONICAL_RULES = (
    "WITH names(k, label, canonical) AS (VALUES "
    + ", ".join(f"({k}, {_text(r)}, {_text(c)})" for k, (r, c) in enumerate(RAW_LABELS))
    + f") SELECT label, canonical, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN names ON l_orderkey % {len(RAW_LABELS)} = k "
    "GROUP BY ALL"
)

_HASH_SQL = ("CAST(('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
             "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42')), 1, 15)) AS BIGINT)")


def q_sample_per_label(spark, sf):
    f = B.flows(spark, sf)
    return P.sample_per_label(f, "label", SAMPLE_N, SEED, SPLIT_KEY).select("label", *KEY)


SQL_SAMPLE_PER_LABEL = with_views(f"""
SELECT label, {', '.join(KEY)} FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH_SQL}, {', '.join(KEY)}) AS rn FROM flows) x
WHERE rn <= {SAMPLE_N}""", FLOWS)


def q_sample_report(spark, sf):
    f = B.flows(spark, sf)
    sample = P.sample_per_label(f, "label", SAMPLE_N, SEED, SPLIT_KEY)
    targets = f.select("label").distinct().unionByName(spark.createDataFrame([("Heartbleed",)], "label string"))
    return P.sample_report(sample, targets, "label", SAMPLE_N)


SQL_SAMPLE_REPORT = with_views(f"""
SELECT t.label, CAST({SAMPLE_N} AS BIGINT) AS requested, CAST(coalesce(c.found, 0) AS BIGINT) AS found,
       CASE WHEN coalesce(c.found, 0) = 0 THEN 'missing' WHEN c.found < {SAMPLE_N} THEN 'partial' ELSE 'ok' END AS status
FROM (SELECT DISTINCT label FROM flows UNION SELECT 'Heartbleed') t
LEFT JOIN (SELECT label, count(*) AS found FROM (
   SELECT label, row_number() OVER (PARTITION BY label ORDER BY {_HASH_SQL}, {', '.join(KEY)}) AS rn FROM flows) x
   WHERE rn <= {SAMPLE_N} GROUP BY label) c ON t.label = c.label""", FLOWS)


def q_mixed_batch(spark, sf):
    f = B.flows(spark, sf)
    quotas = spark.createDataFrame(QUOTAS, "label string, quota int")
    return P.mixed_batch(f, quotas, "label", SEED, SPLIT_KEY).select("label", *KEY)


SQL_MIXED_BATCH = with_views(f"""
SELECT label, {', '.join(KEY)} FROM (
  SELECT f.*, q.quota, row_number() OVER (PARTITION BY f.label ORDER BY {_HASH_SQL}, {', '.join(KEY)}) AS rn
  FROM flows f JOIN (VALUES ('BENIGN', 150), ('ATK_A', 30), ('ATK_R', 20)) q(label, quota) ON f.label = q.label) x
WHERE rn <= quota""", FLOWS)


def q_serving_prep(spark, sf):
    s, med = _medians(spark, sf)
    raw = B.flows_dirty(spark, sf).withColumnRenamed("qty_text", "qty_num").filter(F.col("source_file") != BENIGN_SOURCE)
    out = P.serving_prep(raw, CONTRACT, med, KEY)
    return out.select(*KEY, *_r(CONTRACT))


SQL_SERVING_PREP = with_views(
    "SELECT " + ", ".join(KEY) + ", " + ", ".join(f"round(coalesce(f.{c}, med.{c}, 0.0), 6) AS {c}" for c in FEATS)
    + ", 0.0 AS missing_feature FROM flows_q f CROSS JOIN med WHERE f.source_file <> 'src_1995'",
    *PREP_VIEWS, _MED_SQL,
)


QUERIES = {
    "a5_align_schema": (q_align_schema, SQL_ALIGN_SCHEMA),
    "a6_coerce_numeric": (q_coerce_numeric, SQL_COERCE_NUMERIC),
    "c1_drop_columns": (q_drop_columns, SQL_DROP_COLUMNS),
    "c2_dedupe_keep_first": (q_dedupe_keep_first, SQL_DEDUPE_KEEP_FIRST),
    "c3_binary_label": (q_binary_label, SQL_BINARY_LABEL),
    "c4_source_split": (q_source_split, SQL_SOURCE_SPLIT),
    "c5_train_val_split": (q_train_val_split, SQL_TRAIN_VAL_SPLIT),
    "c6_fit_medians": (q_fit_medians, SQL_FIT_MEDIANS),
    "c6_impute": (q_impute, SQL_IMPUTE),
    "c7_fit_scaler": (q_fit_scaler, SQL_FIT_SCALER),
    "c7_scale": (q_scale, SQL_SCALE),
    "c8_assert_finite": (q_assert_finite, SQL_ASSERT_FINITE),
    "c8_matrix_checks": (q_matrix_checks, SQL_MATRIX_CHECKS),
    "c9_fixed_batch": (q_fixed_batch, SQL_FIXED_BATCH),
    "c10_min_max_scale": (q_min_max_scale, SQL_MIN_MAX_SCALE),
    "c11_canonical_label": (q_canonical_label, SQL_CANONICAL_LABEL),
    "c11_canonical_rules": (q_canonical_rules, SQL_CANONICAL_RULES),
    "c12_sample_per_label": (q_sample_per_label, SQL_SAMPLE_PER_LABEL),
    "c12_sample_report": (q_sample_report, SQL_SAMPLE_REPORT),
    "c13_mixed_batch": (q_mixed_batch, SQL_MIXED_BATCH),
    "c14_serving_prep": (q_serving_prep, SQL_SERVING_PREP),
}
