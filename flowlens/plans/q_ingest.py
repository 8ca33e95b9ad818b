"""Registered queries: multi-file CSV ingest, payloads, uploads, artifacts, fingerprints, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.cleaning import coerce_numeric, json_safe_payload
from flowlens.operators import prep as P
from flowlens.plans import bindings as B
from flowlens.plans.q_prep import _IMPUTED_SQL, _MED_SQL, _SCALER_SQL, FEATS, KEY, PREP_VIEWS, _medians, split_flows
from flowlens.plans.views_sql import FLOWS, SCORES, with_views
from flowlens.session import scratch_dir
from flowlens.sources import artifacts as AR
from flowlens.sources import export as EX
from flowlens.sources import flow_files as FF
from flowlens.sources import result_store as RS

NUM_COLS = ["Quantity", "Price", "Discount", "Tax", "Line", "Extra"]


def _source_of(path_col):
    return F.regexp_extract(path_col, r"source=([^/]+)/", 1)


def _read(spark, sf):
    root = B.flow_files(spark, sf)
    df, cols = FF.read_flows(spark, root)
    return root, df, cols


def q_read_flows(spark, sf):
    """A1 + A2 + A13: all CSV files in path order, stripped headers, union by name, file-order row index."""
    _, df, _ = _read(spark, sf)
    idx = FF.with_row_index(df)
    return idx.select(
        _source_of("_file").alias("source"), "row_index",
        *[coerce_numeric(F.col(c)).alias(c.lower()) for c in NUM_COLS], F.col("Label").alias("label"),
    )


_CSV_ROWS = FLOWS + """, csv_rows AS (
  SELECT source_file AS source, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         quantity, price, discount, tax, CASE WHEN source_file = 'src_2001' THEN NULL ELSE line END AS line,
         CASE WHEN source_file = 'src_2000' THEN CAST(l_linenumber * 10 AS DOUBLE) END AS extra, label
  FROM flows)"""

SQL_READ_FLOWS = "WITH " + _CSV_ROWS + """
SELECT source, CAST(row_number() OVER (ORDER BY source, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT)
         AS row_index, quantity, price, discount, tax, line, extra, label
FROM csv_rows"""


def q_dedupe_file_order(spark, sf):
    """C2 as in the cleaning pipeline: read the CSV files (A1), index rows in file order (A13), keep the
    first row of every group of equal (Quantity, Discount, Tax, Label) -- a hash aggregation of min(row_index)."""
    _, df, _ = _read(spark, sf)
    idx = FF.with_row_index(df)
    feats = idx.select("row_index", *[coerce_numeric(F.col(c)).alias(c.lower()) for c in ["Quantity", "Discount", "Tax"]],
                       F.col("Label").alias("label"))
    return P.dedupe_keep_first(feats, ["quantity", "discount", "tax", "label"], ["row_index"])


SQL_DEDUPE_FILE_ORDER = "WITH " + _CSV_ROWS + """, idx AS (
  SELECT *, CAST(row_number() OVER (ORDER BY source, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1
                 AS BIGINT) AS row_index FROM csv_rows)
SELECT quantity, discount, tax, label, min(row_index) AS row_index FROM idx GROUP BY quantity, discount, tax, label"""


def q_normalise_headers(spark, sf):
    """A2: each source folder's raw header cells and their stripped, de-duplicated names."""
    root = B.flow_files(spark, sf)
    df = FF.read_headers(spark, FF.list_csv_files(spark, root))
    return df.groupBy(_source_of("_file").alias("source")).agg(F.first("raw").alias("raw"), F.first("names").alias("names"))


SQL_NORMALISE_HEADERS = with_views("""
SELECT source,
       CASE WHEN source = 'src_2000' THEN ['Quantity', 'Price', 'Discount', 'Tax', 'Line', 'Label', 'Extra']
            WHEN source = 'src_2001' THEN ['Quantity', 'Price', 'Discount', 'Tax', 'Label']
            ELSE ['Quantity', 'Price', 'Discount', 'Tax', 'Line', 'Label'] END AS raw,
       CASE WHEN source = 'src_2000' THEN ['Quantity', 'Price', 'Discount', 'Tax', 'Line', 'Label', 'Extra']
            WHEN source = 'src_2001' THEN ['Quantity', 'Price', 'Discount', 'Tax', 'Label']
            ELSE ['Quantity', 'Price', 'Discount', 'Tax', 'Line', 'Label'] END AS names
FROM (SELECT DISTINCT source_file AS source FROM flows)""", FLOWS)


#: Header cells of the padded files: three of them strip to the same name.
PADDED = ["Quantity", " Quantity ", "  Price", "Label  ", "Quantity  "]


def _padded_files(spark, sf):
    """The flows as CSV files per source whose header cells are padded and repeat a name once they are stripped."""
    root = scratch_dir(spark, "padded_csv", unique=True)
    values = [F.col("quantity"), F.col("quantity") * 2, F.col("price"), F.col("label"), F.col("quantity") * 3]
    (B.flows(spark, sf).select(F.col("source_file").alias("source"), *[v.alias(h) for v, h in zip(values, PADDED, strict=True)])
     .write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy("source").csv(root))
    return root


def q_padded_headers(spark, sf):
    """A1 + A2 + A4 over padded and repeated headers: raw cells and unique names of every source, the
    comparison with the first file (by stripped names), and sums that show which column a name reads."""
    root = _padded_files(spark, sf)
    paths = FF.list_csv_files(spark, root)
    read = FF.read_headers(spark, paths)
    heads = read.groupBy(_source_of("_file").alias("source")).agg(
        F.min(F.concat_ws("|", "raw")).alias("raw"), F.max(F.concat_ws("|", "names")).alias("names"))
    same = FF.schema_diff(spark, paths, read).groupBy(_source_of("_file").alias("source")).agg(F.min(
        F.col("same") & (F.size("missing") == 0) & (F.size("extra") == 0)).alias("same"))
    df, _ = FF.read_flows(spark, paths, read)
    total = lambda c: F.round(F.sum(coerce_numeric(F.col(f"`{c}`"))), 2)
    sums = df.groupBy(_source_of("_file").alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), total("Quantity").alias("q0"), total("Quantity.1").alias("q1"),
        total("Quantity.2").alias("q2"), F.sum((F.col("Label") == "BENIGN").cast("long")).alias("benign"))
    return sums.join(heads, "source").join(same, "source")


SQL_PADDED_HEADERS = with_views(f"""
SELECT source_file AS source, CAST(count(*) AS BIGINT) AS n_rows, round(sum(quantity), 2) AS q0, round(sum(quantity) * 2, 2) AS q1,
       round(sum(quantity) * 3, 2) AS q2, CAST(sum(CASE WHEN label = 'BENIGN' THEN 1 ELSE 0 END) AS BIGINT) AS benign,
       '{"|".join(PADDED)}' AS raw, 'Quantity|Quantity.1|Price|Label|Quantity.2' AS names, true AS same
FROM flows GROUP BY source_file""", FLOWS)


def q_padded_uploads(spark, sf):
    """A8 over padded and repeated headers: the registered column names, rows in the metadata and in the store,
    and a sum over a payload's repeated column."""
    root = _padded_files(spark, sf)
    store = scratch_dir(spark, "uploads", unique=True)
    up = RS.register_uploads(spark, {p: 9_100_000 + i for i, p in enumerate(FF.list_csv_files(spark, root))}, store)
    rows = RS.read_committed(spark, store)["rows"].groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("stored_rows"),
        F.sum(F.get_json_object("payload", "$['Quantity.2']").cast("double")).alias("q2"))
    return up.join(rows, "upload_id").groupBy(_source_of("path").alias("source")).agg(
        F.sum("row_count").alias("row_count"), F.max("columns").alias("columns"), F.max("col_count").alias("col_count"),
        F.sum("stored_rows").alias("stored_rows"), F.round(F.sum("q2"), 2).alias("q2"))


SQL_PADDED_UPLOADS = with_views("""
SELECT source_file AS source, CAST(count(*) AS BIGINT) AS row_count,
       ['Quantity', 'Quantity.1', 'Price', 'Label', 'Quantity.2'] AS columns, 5 AS col_count,
       CAST(count(*) AS BIGINT) AS stored_rows, round(sum(quantity) * 3, 2) AS q2
FROM flows GROUP BY source_file""", FLOWS)


def q_file_profile(spark, sf):
    """A3: rows and columns per source folder; one consistency flag and the total."""
    paths = FF.list_csv_files(spark, B.flow_files(spark, sf))
    heads = FF.read_headers(spark, paths)
    df, _ = FF.read_flows(spark, paths, heads)
    prof = FF.file_profile(spark, paths, df, heads)
    per = prof.groupBy(_source_of("_file").alias("source")).agg(
        F.sum("n_rows").cast("long").alias("n_rows"), F.max("n_cols").alias("n_cols")
    )
    flag = prof.agg(F.first("consistent").alias("consistent"), F.first("total_rows").cast("long").alias("total_rows"))
    return per.crossJoin(flag)


SQL_FILE_PROFILE = "WITH " + _CSV_ROWS + """
SELECT source, CAST(count(*) AS BIGINT) AS n_rows,
       CASE WHEN source = 'src_2000' THEN 7 WHEN source = 'src_2001' THEN 5 ELSE 6 END AS n_cols,
       false AS consistent, (SELECT CAST(count(*) AS BIGINT) FROM csv_rows) AS total_rows
FROM csv_rows GROUP BY source"""


def q_schema_diff(spark, sf):
    """A4: each source folder's stripped header against the first file's."""
    root = B.flow_files(spark, sf)
    paths = FF.list_csv_files(spark, root)
    d = FF.schema_diff(spark, paths)
    return d.groupBy(_source_of("_file").alias("source")).agg(
        F.min(F.col("same").cast("int")).cast("boolean").alias("same"),
        F.first("missing").alias("missing"), F.first("extra").alias("extra"),
    )


SQL_SCHEMA_DIFF = with_views("""
SELECT source, source NOT IN ('src_2000', 'src_2001') AS same,
       CASE WHEN source = 'src_2001' THEN ['Line'] ELSE CAST([] AS VARCHAR[]) END AS missing,
       CASE WHEN source = 'src_2000' THEN ['Extra'] ELSE CAST([] AS VARCHAR[]) END AS extra
FROM (SELECT DISTINCT source_file AS source FROM flows)""", FLOWS)


def q_json_payload(spark, sf):
    """Every dirty flow row as a JSON-safe payload (Infinity / NaN text -> null, duplicates kept)."""
    d = B.flows_dirty(spark, sf)
    cols = [("quantity", "double"), ("discount", "double"), ("qty_text", "string"), ("label", "string")]
    return d.select(*KEY, json_safe_payload(cols).alias("payload"))


SQL_JSON_PAYLOAD = with_views(
    "SELECT " + ", ".join(KEY) + """, json_object('quantity', quantity, 'discount', discount,
       'qty_text', CASE WHEN lower(trim(qty_text)) IN ('nan', 'nat', 'inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')
                        THEN NULL ELSE qty_text END, 'label', label)::VARCHAR AS payload FROM flows_q""",
    *PREP_VIEWS[:2],
)


def q_register_upload(spark, sf):
    """Register every CSV file as one upload; per source folder the rows that metadata and store hold."""
    root = B.flow_files(spark, sf)
    store = scratch_dir(spark, "uploads", unique=True)
    paths = FF.list_csv_files(spark, root)
    up = RS.register_uploads(spark, {p: 9_000_000 + i for i, p in enumerate(paths)}, store)
    rows = RS.read_committed(spark, store)["rows"].groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.max("row_index").alias("max_row_index")
    )
    return up.join(rows, "upload_id").groupBy(_source_of("path").alias("source")).agg(
        F.sum("row_count").alias("row_count"), F.max("columns").alias("columns"), F.max("col_count").alias("col_count"),
        F.sum("stored_rows").alias("stored_rows"),
        F.min((F.col("max_row_index") == F.col("stored_rows") - 1) & (F.length("file_sha256") == 64)).alias("complete"),
    )


SQL_REGISTER_UPLOAD = with_views("""
SELECT source_file AS source, CAST(count(*) AS BIGINT) AS row_count,
       CASE WHEN source_file = 'src_2000' THEN ['Quantity', 'Price', 'Discount', 'Tax', 'Line', 'Label', 'Extra']
            WHEN source_file = 'src_2001' THEN ['Quantity', 'Price', 'Discount', 'Tax', 'Label']
            ELSE ['Quantity', 'Price', 'Discount', 'Tax', 'Line', 'Label'] END AS columns,
       CASE WHEN source_file = 'src_2000' THEN 7 WHEN source_file = 'src_2001' THEN 5 ELSE 6 END AS col_count,
       CAST(count(*) AS BIGINT) AS stored_rows, true AS complete
FROM flows GROUP BY source_file""", FLOWS)


def q_write_splits(spark, sf):
    """A10: features per split written as Parquet partitioned by split; rows per split read back."""
    s = split_flows(spark, sf)
    out = scratch_dir(spark, "splits", unique=True)
    AR.write_splits(s, FEATS, "label", "source_file", out)
    back = spark.read.parquet(f"{out}/features")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("binary_label").cast("long").alias("n_attack"))


SQL_WRITE_SPLITS = with_views(
    "SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(binary_label) AS BIGINT) AS n_attack FROM split_flows GROUP BY split",
    *PREP_VIEWS,
)


def q_prep_artifacts(spark, sf):
    """A10: the medians and the scaler fitted on the training split, written beside the splits and read back."""
    s, med = _medians(spark, sf)
    imp = P.impute(s, med, FEATS, ["split"])
    scaler = P.fit_scaler(imp.filter(F.col("split") == "train"), FEATS)
    paths = AR.write_splits(s, FEATS, "label", "source_file", scratch_dir(spark, "splits", unique=True), med, scaler)
    medians = spark.read.parquet(paths["medians"]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("median")) for c in FEATS])).alias("m")).select("m.*")
    return spark.read.parquet(paths["scaler"]).join(F.broadcast(medians), "feature").select(  # one row per feature
        "feature", "pos", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


SQL_PREP_ARTIFACTS = "WITH " + ",\n".join([*PREP_VIEWS, _MED_SQL, _IMPUTED_SQL, _SCALER_SQL]) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS pos, round(med.{c}, 6) AS median, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale FROM med, scaler"
    for i, c in enumerate(FEATS))


def q_prep_metadata(spark, sf):
    """Counts per split, ratios, dropped columns and policy names (one row)."""
    s = split_flows(spark, sf)
    return AR.prep_metadata(s, dropped=["const_col", "sparse_col"])


SQL_PREP_METADATA = with_views("""
SELECT CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS n_val,
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
       round(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) * 1.0
             / nullif(sum(CASE WHEN split IN ('train', 'val') THEN 1 ELSE 0 END), 0), 6) AS val_ratio,
       round(sum(CASE WHEN split = 'test' AND binary_label = 1 THEN 1 ELSE 0 END) * 1.0
             / nullif(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END), 0), 6) AS test_attack_ratio,
       'const_col,sparse_col' AS dropped_columns, 'median' AS impute_policy, 'standard_population' AS scale_policy
FROM split_flows""", *PREP_VIEWS)


def q_table_fingerprint(spark, sf):
    """Order-independent fingerprint of the scored table plus the run manifest."""
    s = B.scores(spark, sf)
    micros = F.round(F.col("score") * 1_000_000).cast("long").alias("score")
    return AR.table_fingerprint(s.select("event_id", micros), extra={"percentile": 99.0})


SQL_TABLE_FINGERPRINT = with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|' || coalesce(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), '\\N')), 1, 15) AS BIGINT)) AS VARCHAR)
         AS fingerprint, CAST(99.0 AS DOUBLE) AS percentile
FROM scores""", SCORES)


from flowlens.plans.views_sql import STORE as _STORE  # noqa: E402
from flowlens.plans.q_store import _LATEST  # noqa: E402


def q_export_csv(spark, sf):
    """Export every latest run's rows as UTF-8 (BOM) CSV plus a summary output; rows written."""
    from flowlens.operators import results as R

    st = B.store(spark, sf)
    exp = R.export_results(st["predictions"], st["rows"], st["runs"])
    out = scratch_dir(spark, "export", unique=True)
    EX.export_csv(exp, R.export_summary(exp), out)
    back = spark.read.option("header", True).csv(f"{out}/rows")
    return back.agg(F.count(F.lit(1)).alias("rows_written"), F.countDistinct("run_id").alias("runs"))


def q_export_sorted_parts(spark, sf):
    """The export sorted by run and row over all its parts, read back in file order (A1, A13): per run the
    rows, and whether they follow each other by row index in the files; per run its summary lines and the exported count."""
    from flowlens.operators import results as R

    st = B.store(spark, sf)
    exp = R.export_results(st["predictions"], st["rows"], st["runs"])
    paths = EX.export_csv(exp, R.export_summary(exp), scratch_dir(spark, "export", unique=True), order=["run_id", "row_index"])
    df, _ = FF.read_flows(spark, paths["rows"])
    lines = FF.with_row_index(df, "line").select(*[F.col(c).cast("long") for c in ("run_id", "row_index", "line")])
    runs = lines.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("line").alias("from_line"),
        (F.countDistinct(F.col("line") - F.col("row_index")) == 1).alias("in_order"))
    summary = spark.read.option("header", True).csv(paths["summary"]).groupBy(F.col("run_id").cast("long").alias("run_id")).agg(
        F.count(F.lit(1)).alias("summary_lines"),
        F.max(F.when(F.col("metric") == "total_exported", F.col("value"))).cast("long").alias("total_exported"))
    return runs.join(summary, "run_id")


SQL_EXPORT_SORTED_PARTS = with_views("""
SELECT p.run_id, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(count(*)) OVER (ORDER BY p.run_id) - count(*) AS BIGINT) AS from_line,
       max(p.row_index) - min(p.row_index) + 1 = count(*) AS in_order,
       CAST(10 AS BIGINT) AS summary_lines, CAST(count(*) AS BIGINT) AS total_exported
FROM predictions p JOIN latest l ON p.run_id = l.run_id GROUP BY p.run_id""", _STORE, _LATEST)


SQL_EXPORT_CSV = with_views(
    "SELECT CAST(count(*) AS BIGINT) AS rows_written, CAST(count(DISTINCT p.run_id) AS BIGINT) AS runs "
    "FROM predictions p JOIN latest l ON p.run_id = l.run_id", _STORE, _LATEST,
)

QUERIES = {
    "a1_read_flows": (q_read_flows, SQL_READ_FLOWS),
    "a2_normalise_headers": (q_normalise_headers, SQL_NORMALISE_HEADERS),
    "a3_file_profile": (q_file_profile, SQL_FILE_PROFILE),
    "c2_dedupe_file_order": (q_dedupe_file_order, SQL_DEDUPE_FILE_ORDER),
    "a4_schema_diff": (q_schema_diff, SQL_SCHEMA_DIFF),
    "a7_json_payload": (q_json_payload, SQL_JSON_PAYLOAD),
    "a8_register_upload": (q_register_upload, SQL_REGISTER_UPLOAD),
    "a10_prep_artifacts": (q_prep_artifacts, SQL_PREP_ARTIFACTS),
    "a10_write_splits": (q_write_splits, SQL_WRITE_SPLITS),
    "a11_prep_metadata": (q_prep_metadata, SQL_PREP_METADATA),
    "a16_table_fingerprint": (q_table_fingerprint, SQL_TABLE_FINGERPRINT),
    "a17_export_csv": (q_export_csv, SQL_EXPORT_CSV),
    "a17_export_sorted_parts": (q_export_sorted_parts, SQL_EXPORT_SORTED_PARTS),
    "a2_padded_headers": (q_padded_headers, SQL_PADDED_HEADERS),
    "a8_padded_uploads": (q_padded_uploads, SQL_PADDED_UPLOADS),
}
