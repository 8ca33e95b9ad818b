"""SQL twins of ``plans.bindings`` for the DuckDB oracle.

Each constant is a comma-separated list of CTE definitions; ``with_views``
prefixes a query with the ones it needs.
"""

from __future__ import annotations

FLOWS = """flows AS (
  SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         CAST(l_linenumber AS DOUBLE) AS line,
         'src_' || CAST(year(l_shipdate) AS VARCHAR) AS source_file,
         CASE WHEN year(l_shipdate) = 1995 OR l_returnflag = 'N' THEN 'BENIGN'
              ELSE 'ATK_' || l_returnflag END AS label
  FROM lineitem)"""

FLOWS_DIRTY = FLOWS + """, flows_dirty AS (
  SELECT *,
         CASE WHEN discount = 0 THEN 'Infinity' WHEN tax = 0 THEN 'NaN'
              ELSE CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS qty_text,
         1.0::DOUBLE AS const_col,
         CASE WHEN l_orderkey % 200 = 0 THEN quantity ELSE 0.0 END AS sparse_col
  FROM flows)"""

SCORES = """scores AS (
  SELECT event_id, ts, user_id, value AS score,
         CAST(event_type = 'error' AS INTEGER) AS truth, event_type AS label,
         CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' AND event_type <> 'error' THEN 'val'
              ELSE 'test' END AS split
  FROM events)"""

TRUTH_SPARSE = """truth_sparse AS (
  SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS truth, d.source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

VECTORS = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, CAST(label <> 0 AS INTEGER) AS truth
  FROM embeddings)"""

STORE = """store_src AS (
  SELECT user_id AS upload_id, ts, event_id, value AS reconstruction_error, CAST(ts AS DATE) AS day,
         json_object('k', CAST(json_extract_string(props, '$.k') AS BIGINT), 'event_type', event_type,
                     'Label', CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'view' THEN 'BENIGN'
                                              WHEN 'click' THEN 'normal' WHEN 'signup' THEN '0' END
         )::VARCHAR AS payload
  FROM events),
store_base AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY ts, event_id) - 1 AS BIGINT) AS row_index
  FROM store_src),
rows_t AS (SELECT upload_id, row_index, payload FROM store_base),
predictions AS (
  SELECT CAST(upload_id * 1000 + dayofyear(day) AS BIGINT) AS run_id, upload_id, row_index,
         reconstruction_error,
         CAST(reconstruction_error > 150.0 AS INTEGER) AS prediction,
         CASE WHEN reconstruction_error > 150.0 THEN 'anomaly' ELSE 'normal' END AS prediction_label,
         CAST(day AS TIMESTAMP) AS predicted_at
  FROM store_base),
runs AS (
  SELECT run_id, upload_id, predicted_at AS created_at, CAST(count(*) AS BIGINT) AS total_flows,
         CAST(sum(prediction) AS BIGINT) AS anomaly_count,
         CAST(count(*) - sum(prediction) AS BIGINT) AS normal_count,
         round(sum(prediction) * 1.0 / count(*), 6) AS anomaly_rate, 150.0::DOUBLE AS threshold
  FROM predictions GROUP BY run_id, upload_id, predicted_at),
uploads AS (
  SELECT upload_id, 'user_' || CAST(upload_id AS VARCHAR) || '.csv' AS filename,
         CAST(count(*) AS BIGINT) AS row_count, 3 AS col_count, CAST(NULL AS VARCHAR) AS file_sha256,
         min(ts) AS created_at
  FROM store_base GROUP BY upload_id
  UNION ALL
  SELECT CAST(1000000 + n_nationkey AS BIGINT), lower(n_name) || '.csv', CAST(0 AS BIGINT), 3,
         CAST(NULL AS VARCHAR), TIMESTAMP '2024-01-15 00:00:00'
  FROM nation)"""


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with ``WITH <views>``."""
    if not views:
        return body
    return "WITH " + ",\n".join(views) + "\n" + body
