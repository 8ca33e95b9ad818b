"""Registered queries: profiling (B1-B14) over the flow views."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.cleaning import coerce_numeric, raw_numeric
from flowlens.functions.labels import binary_label
from flowlens.operators import prep as P
from flowlens.operators import profile as PR
from flowlens.plans import bindings as B
from flowlens.plans.views_sql import FLOWS, FLOWS_DIRTY, with_views
from flowlens.sources import flow_files as FF
from flowlens.sources.tables import table

PROFILE_COLS = ["quantity", "price", "discount", "tax", "line", "qty_num", "const_col", "sparse_col"]
DUP_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
BENIGN_SOURCE = "src_1995"
EXPECTED_FILES = 7


def profiled(spark, sf):
    d = B.flows_dirty(spark, sf)
    return d.withColumn("qty_num", coerce_numeric("qty_text")).withColumn("qty_raw", raw_numeric("qty_text"))


PROFILED_SQL = FLOWS_DIRTY + """, profiled AS (
  SELECT *, CASE WHEN isfinite(qty_raw) THEN qty_raw END AS qty_num FROM (
    SELECT *, TRY_CAST(trim(qty_text) AS DOUBLE) AS qty_raw FROM flows_dirty) x)"""


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def q_label_distribution(spark, sf):
    return PR.label_distribution(B.flows(spark, sf))


SQL_LABEL_DISTRIBUTION = with_views("""
SELECT label, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM flows), 3) AS pct,
       label = 'BENIGN' AS is_benign
FROM flows GROUP BY label""", FLOWS)


def q_label_totals(spark, sf):
    return PR.label_totals(B.flows(spark, sf))


SQL_LABEL_TOTALS = with_views("""
SELECT CAST(sum(CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 1 ELSE 0 END) AS BIGINT) AS n_benign,
       CAST(sum(CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END) AS BIGINT) AS n_attack,
       CAST(count(DISTINCT label) AS BIGINT) AS n_labels
FROM flows""", FLOWS)


def q_label_by_source(spark, sf):
    return PR.label_by_source(B.flows(spark, sf))


SQL_LABEL_BY_SOURCE = with_views(
    "SELECT source_file, label, CAST(count(*) AS BIGINT) AS n FROM flows GROUP BY ALL", FLOWS
)


def q_null_profile(spark, sf):
    return PR.null_profile(profiled(spark, sf), PROFILE_COLS)


SQL_NULL_PROFILE = with_views("SELECT * FROM (" + _union([
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
    f"round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS pct FROM profiled"
    for c in PROFILE_COLS]) + ") WHERE n_missing > 0", PROFILED_SQL)


def q_inf_profile(spark, sf):
    d = profiled(spark, sf)
    return PR.inf_profile(d, ["quantity", "price", "discount", "tax", "line", "qty_raw"])


SQL_INF_PROFILE = with_views("SELECT * FROM (" + _union([
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN isinf({c}) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf, "
    f"round(sum(CASE WHEN isinf({c}) THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS pct FROM profiled"
    for c in ["quantity", "price", "discount", "tax", "line", "qty_raw"]]) + ") WHERE n_inf > 0", PROFILED_SQL)


def q_duplicate_profile(spark, sf):
    return PR.duplicate_profile(B.flows_dup(spark, sf), DUP_COLS)


SQL_DUPLICATE_PROFILE = """
SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS n_duplicates,
       CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicated_groups,
       round(CASE WHEN sum(k) > 0 THEN sum(k - 1) * 100.0 / sum(k) ELSE 0.0 END, 3) AS pct
FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag) g"""


def q_duplicate_sample(spark, sf):
    """B5 sample: every member row of 5 duplicated (quantity, discount, tax, returnflag) groups."""
    li = table(spark, sf, "lineitem")
    return PR.duplicate_members_sample(li, DUP_COLS, 5, 42).select(*DUP_COLS, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SQL_DUPLICATE_SAMPLE = """
WITH g AS (SELECT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT * FROM g ORDER BY CAST(('0x' || substr(md5(concat_ws('|', CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR),
                                   CAST(l_tax AS VARCHAR), l_returnflag, '42')), 1, 15)) AS BIGINT),
                               l_quantity, l_discount, l_tax, l_returnflag LIMIT 5)
SELECT l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l SEMI JOIN p USING (l_quantity, l_discount, l_tax, l_returnflag)"""


def q_constant_columns(spark, sf):
    return PR.constant_columns(profiled(spark, sf), PROFILE_COLS)


SQL_CONSTANT_COLUMNS = with_views(_union([
    f"SELECT '{c}' AS feature, (count({c}) = 0 OR min({c}) = max({c})) AS is_constant FROM profiled" for c in PROFILE_COLS
]), PROFILED_SQL)


def q_near_constant(spark, sf):
    return PR.near_constant_columns(profiled(spark, sf), PROFILE_COLS, 0.99)


SQL_NEAR_CONSTANT = with_views("SELECT feature, top_value, share_pct FROM (" + _union([
    f"""SELECT '{c}' AS feature, top_value, round(top * 100.0 / cnt, 2) AS share_pct, top, cnt, mn, mx FROM (
      SELECT (SELECT {c} FROM profiled WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value,
             (SELECT count(*) FROM profiled WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top,
             (SELECT count({c}) FROM profiled) AS cnt, (SELECT min({c}) FROM profiled) AS mn,
             (SELECT max({c}) FROM profiled) AS mx)""" for c in PROFILE_COLS
]) + ") WHERE cnt > 0 AND mn <> mx AND top >= 0.99 * cnt", PROFILED_SQL)


def q_describe(spark, sf):
    d = profiled(spark, sf)
    return PR.describe_extended(d, ["quantity", "price", "discount", "tax", "line", "qty_raw"])


SQL_DESCRIBE = with_views(_union([
    f"""SELECT '{c}' AS feature, CAST(count(v) AS BIGINT) AS count, round(avg(v), 9) AS mean, round(stddev_samp(v), 5) AS std,
       round(min(v), 6) AS min, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.25), 6) AS p25,
       round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95,
       round(max(v), 6) AS max, round(CASE WHEN count(v) > 2 THEN skewness(v) END, 5) AS skewness,
       round(CASE WHEN count(v) > 3 THEN kurtosis(v) END, 5) AS kurtosis,
       CAST(sum(CASE WHEN isinf({c}) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf
    FROM (SELECT {c}, CASE WHEN isfinite({c}) THEN {c} END AS v FROM profiled) x"""
    for c in ["quantity", "price", "discount", "tax", "line", "qty_raw"]]), PROFILED_SQL)


HIST_COLS = ["quantity", "price", "discount"]


def _bin_sql(src: str, key: str, bounds: str) -> str:
    return f"""SELECT {key}, CASE WHEN hi - lo > 0 THEN least(20, CAST(floor((least(greatest(v, lo), hi) - lo) / (hi - lo) * 20) AS INTEGER) + 1)
                   ELSE 1 END AS bucket, CAST(count(*) AS BIGINT) AS n, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi
    FROM {src} JOIN {bounds} USING ({key}) GROUP BY ALL"""


def q_clipped_histogram(spark, sf):
    return PR.clipped_histogram(B.flows(spark, sf), HIST_COLS, 20)


SQL_CLIPPED_HISTOGRAM = with_views(
    _bin_sql("lv", "feature", "bnd"), FLOWS,
    "lv AS (" + _union([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM flows WHERE {c} IS NOT NULL" for c in HIST_COLS]) + ")",
    "bnd AS (SELECT feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM lv GROUP BY feature)",
)


def q_clipped_by_label(spark, sf):
    return PR.clipped_by_label(B.flows(spark, sf), "price", "label", 20)


SQL_CLIPPED_BY_LABEL = with_views(
    _bin_sql("lv", "label", "bnd"), FLOWS,
    "lv AS (SELECT label, price AS v FROM flows WHERE price IS NOT NULL)",
    "bnd AS (SELECT label, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM lv GROUP BY label)",
)


CORR_COLS = ["quantity", "price", "discount", "tax", "line", "qty_num", "const_col"]


def q_correlation(spark, sf):
    return PR.correlation_matrix(profiled(spark, sf), CORR_COLS, 40)


SQL_CORRELATION = with_views(_union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) AS corr FROM profiled"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]
]), PROFILED_SQL)


def q_quality_gates(spark, sf):
    heads = FF.read_headers(spark, FF.list_csv_files(spark, B.flow_files(spark, sf)))
    return PR.quality_gates(profiled(spark, sf), PROFILE_COLS, "source_file", "label", BENIGN_SOURCE, EXPECTED_FILES,
                            file_columns=heads.select(F.size("names").alias("n_cols")))


def _gates_sql() -> str:
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in PROFILE_COLS)
    infs = " + ".join(f"CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN 1 ELSE 0 END" for c in PROFILE_COLS)
    allnull = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in PROFILE_COLS)
    return with_views(f"""
SELECT 'file_count' AS gate, CAST(count(DISTINCT source_file) AS DOUBLE) AS value, count(DISTINCT source_file) = 7 AS passed FROM profiled
UNION ALL SELECT 'label_present', CAST(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS DOUBLE), sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) = 0 FROM profiled
UNION ALL SELECT 'benign_source_all_benign', CAST(sum(CASE WHEN source_file = 'src_1995' AND label IS DISTINCT FROM 'BENIGN' THEN 1 ELSE 0 END) AS DOUBLE),
                 sum(CASE WHEN source_file = 'src_1995' AND label IS DISTINCT FROM 'BENIGN' THEN 1 ELSE 0 END) = 0 FROM profiled
UNION ALL SELECT 'benign_in_many_files', CAST(count(DISTINCT CASE WHEN label = 'BENIGN' THEN source_file END) AS DOUBLE),
                 count(DISTINCT CASE WHEN label = 'BENIGN' THEN source_file END) > 1 FROM profiled
UNION ALL SELECT 'no_all_null_column', CAST({allnull} AS DOUBLE), {allnull} = 0 FROM profiled
UNION ALL SELECT 'benign_source_nulls', CAST(sum(CASE WHEN source_file = 'src_1995' THEN {nulls} ELSE 0 END) AS DOUBLE), true FROM profiled
UNION ALL SELECT 'benign_source_infs', CAST(sum(CASE WHEN source_file = 'src_1995' THEN {infs} ELSE 0 END) AS DOUBLE), true FROM profiled
UNION ALL SELECT 'same_column_count', CAST(count(DISTINCT width) AS DOUBLE), count(DISTINCT width) <= 1
          FROM (SELECT CASE source_file WHEN 'src_2000' THEN 7 WHEN 'src_2001' THEN 5 ELSE 6 END AS width FROM profiled) w""",
        PROFILED_SQL)


def q_candidate_features(spark, sf):
    d = profiled(spark, sf)
    raw = d.withColumn("qty_num", F.col("qty_raw"))
    return PR.candidate_features(
        PR.constant_columns(d, PROFILE_COLS), PR.near_constant_columns(d, PROFILE_COLS), PR.inf_profile(raw, PROFILE_COLS)
    )


SQL_CANDIDATE_FEATURES = with_views("""
SELECT c.feature, CASE WHEN c.is_constant THEN 'constant' WHEN n.feature IS NOT NULL THEN 'near_constant'
                      WHEN i.feature IS NOT NULL THEN 'inf_affected' ELSE 'candidate' END AS category
FROM consts c LEFT JOIN near n ON c.feature = n.feature LEFT JOIN infs i ON c.feature = i.feature""",
    PROFILED_SQL,
    "consts AS (" + _union([f"SELECT '{c}' AS feature, (count({c}) = 0 OR min({c}) = max({c})) AS is_constant FROM profiled" for c in PROFILE_COLS]) + ")",
    "near AS (SELECT feature FROM (" + _union([
        f"""SELECT '{c}' AS feature, (SELECT count(*) FROM profiled WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS top,
               (SELECT count({c}) FROM profiled) AS cnt, (SELECT min({c}) FROM profiled) AS mn, (SELECT max({c}) FROM profiled) AS mx"""
        for c in PROFILE_COLS]) + ") WHERE cnt > 0 AND mn <> mx AND top >= 0.99 * cnt)",
    "infs AS (SELECT feature FROM (" + _union([
        f"SELECT '{c}' AS feature, sum(CASE WHEN isinf(CAST({'qty_raw' if c == 'qty_num' else c} AS DOUBLE)) THEN 1 ELSE 0 END) AS k FROM profiled"
        for c in PROFILE_COLS]) + ") WHERE k > 0)",
)


TEXT_COLS = ["qty_text", "label", "source_file"]


def q_non_numeric_samples(spark, sf):
    """B13 (non-numeric part): text columns with their distinct count and three sample values."""
    return PR.non_numeric_samples(profiled(spark, sf), TEXT_COLS, 3)


SQL_NON_NUMERIC_SAMPLES = with_views("SELECT feature, CAST(count(*) AS BIGINT) AS n_distinct, "
                                     "list(value ORDER BY value)[1:3] AS sample_values FROM (" + _union([
    f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM profiled WHERE {c} IS NOT NULL" for c in TEXT_COLS
]) + ") GROUP BY feature", PROFILED_SQL)


def q_class_balance(spark, sf):
    f = B.flows(spark, sf).withColumn("binary_label", binary_label("label"))
    s = P.source_split(f, "source_file", BENIGN_SOURCE)
    tv = s.filter(F.col("split") == "train_val").drop("split")
    tv = P.train_val_split(tv, SPLIT_KEY, 42, 0.2)
    full = tv.unionByName(s.filter(F.col("split") == "test"))
    return PR.class_balance(full, "split", "binary_label")


SPLIT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
def split_sql(view: str) -> str:
    """CTEs ``hashed`` and ``split_flows`` over ``view`` (same rule as prep.train_val_split)."""
    return f"""hashed AS (
  SELECT *, CAST(('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                                             CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42')), 1, 15)) AS BIGINT) AS h,
         CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS binary_label
  FROM {view}),
split_flows AS (
  SELECT *, CASE WHEN source_file <> 'src_1995' THEN 'test'
                 WHEN h <= (SELECT max(h) FROM (SELECT h FROM hashed WHERE source_file = 'src_1995' ORDER BY h
                            LIMIT (SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) FROM hashed WHERE source_file = 'src_1995')))
                 THEN 'val' ELSE 'train' END AS split
  FROM hashed)"""


SPLIT_SQL = FLOWS + ", " + split_sql("flows")

SQL_CLASS_BALANCE = with_views("""
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN binary_label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_normal,
       CAST(sum(CASE WHEN binary_label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_attack,
       round(sum(CASE WHEN binary_label = 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS pct_normal,
       round(sum(CASE WHEN binary_label = 1 THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS pct_attack
FROM split_flows GROUP BY split""", SPLIT_SQL)


QUERIES = {
    "b1_label_distribution": (q_label_distribution, SQL_LABEL_DISTRIBUTION),
    "b1_label_totals": (q_label_totals, SQL_LABEL_TOTALS),
    "b2_label_by_source": (q_label_by_source, SQL_LABEL_BY_SOURCE),
    "b3_null_profile": (q_null_profile, SQL_NULL_PROFILE),
    "b4_inf_profile": (q_inf_profile, SQL_INF_PROFILE),
    "b5_duplicate_profile": (q_duplicate_profile, SQL_DUPLICATE_PROFILE),
    "b5_duplicate_sample": (q_duplicate_sample, SQL_DUPLICATE_SAMPLE),
    "b6_constant_columns": (q_constant_columns, SQL_CONSTANT_COLUMNS),
    "b7_near_constant": (q_near_constant, SQL_NEAR_CONSTANT),
    "b8_describe_extended": (q_describe, SQL_DESCRIBE),
    "b9_clipped_histogram": (q_clipped_histogram, SQL_CLIPPED_HISTOGRAM),
    "b10_clipped_by_label": (q_clipped_by_label, SQL_CLIPPED_BY_LABEL),
    "b11_correlation": (q_correlation, SQL_CORRELATION),
    "b12_quality_gates": (q_quality_gates, _gates_sql()),
    "b13_candidate_features": (q_candidate_features, SQL_CANDIDATE_FEATURES),
    "b13_non_numeric_samples": (q_non_numeric_samples, SQL_NON_NUMERIC_SAMPLES),
    "b14_class_balance": (q_class_balance, SQL_CLASS_BALANCE),
}
