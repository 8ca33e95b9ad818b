"""Views that bind the operators to the driver tables (FIXTURES.md section 3).

Every view is a DataFrame derived from the given Parquet tables, so the work
of each registered query grows with the tables.  The SQL twins of these views
(for the DuckDB oracle) live in ``plans.views_sql``.

Fixed values of the bindings
----------------------------
* benign source year: 1995; labels BENIGN / ATK_A / ATK_R
* store threshold theta: 150.0
* validation cut for the score view: ts < 2024-01-11 and not an error
* 25 run-less uploads come from ``nation`` with ids 1,000,000 + n_nationkey
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import scratch_dir
from flowlens.sources.tables import table

BENIGN_SOURCE = 1995
STORE_THETA = 150.0
VALIDATION_CUT = "2024-01-11 00:00:00"
NATION_UPLOAD_BASE = 1_000_000

FEATURES = ["quantity", "price", "discount", "tax", "line"]
ORDER_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records: 5 numeric features, a source (year of ship date) and a label."""
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    return li.select(
        *ORDER_KEY,
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"),
        F.concat(F.lit("src_"), year.cast("string")).alias("source_file"),
        F.when((year == BENIGN_SOURCE) | (F.col("l_returnflag") == "N"), F.lit("BENIGN"))
        .otherwise(F.concat(F.lit("ATK_"), F.col("l_returnflag")))
        .alias("label"),
    )


def flows_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows plus a text column with Infinity/NaN cells, a constant and a sparse column."""
    return flows(spark, sf_dir).select(
        "*",
        F.when(F.col("discount") == 0, F.lit("Infinity"))
        .when(F.col("tax") == 0, F.lit("NaN"))
        .otherwise(F.col("quantity").cast("int").cast("string"))
        .alias("qty_text"),
        F.lit(1.0).alias("const_col"),
        F.when(F.col("l_orderkey") % 200 == 0, F.col("quantity")).otherwise(F.lit(0.0)).alias("sparse_col"),
    )


def flows_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection with many duplicate rows."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_discount", "l_tax", "l_returnflag")


def is_validation() -> "F.Column":
    """Validation rows: before the cut and not an error (NULLs are not validation)."""
    return (F.col("ts") < F.lit(VALIDATION_CUT).cast("timestamp_ntz")) & (F.col("event_type") != "error")


def is_test() -> "F.Column":
    """The complement of ``is_validation`` written with plain comparisons, so it reaches the Parquet scan."""
    return (
        (F.col("ts") >= F.lit(VALIDATION_CUT).cast("timestamp_ntz")) | (F.col("event_type") == "error")
        | F.col("ts").isNull() | F.col("event_type").isNull()
    )


def scores(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """Scored rows: score = value, truth = error event, split val/test by time.

    With ``split`` the rows are filtered on the base columns first (pushed to the scan)."""
    ev = table(spark, sf_dir, "events")
    if split == "val":
        ev = ev.filter(is_validation())
    elif split == "test":
        ev = ev.filter(is_test())
    is_err = F.col("event_type") == "error"
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        F.col("value").alias("score"),
        is_err.cast("int").alias("truth"),
        F.col("event_type").alias("label"),
        F.when(F.coalesce(is_validation(), F.lit(False)), F.lit("val")).otherwise(F.lit("test")).alias("split"),
    )


def truth_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left join labels: score = n_chars, truth = toxic (NULL when unlabelled)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("score"),
        F.col("toxic").alias("truth"),
        "source",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as feature arrays; label 0 is benign."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("x"),
        "label",
        (F.col("label") != 0).cast("int").alias("truth"),
    )


# ---------------------------------------------------------------------------
# the result store: uploads, rows, runs, predictions
# ---------------------------------------------------------------------------

def _label_for(event_type):
    return (
        F.when(event_type == "error", F.lit("DDoS"))
        .when(event_type == "view", F.lit("BENIGN"))
        .when(event_type == "click", F.lit("normal"))
        .when(event_type == "signup", F.lit("0"))
    )


def store_rows_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as uploaded rows: one upload per user, payload JSON text."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    payload = F.to_json(
        F.struct(
            k.cast("long").alias("k"),
            F.col("event_type").alias("event_type"),
            _label_for(F.col("event_type")).alias("Label"),
        ),
        {"ignoreNullFields": "false"},
    )
    return ev.select(
        F.col("user_id").alias("upload_id"),
        "ts",
        "event_id",
        F.col("value").alias("reconstruction_error"),
        payload.alias("payload"),
        F.to_date("ts").alias("day"),
    )


_STORE_CACHE: dict[tuple[str, str], dict[str, str]] = {}


def store_paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The store tables, materialised once per session under the shared scratch folder: table -> folder."""
    from flowlens.sources.result_store import build_store_from_rows

    key = (spark.sparkContext.applicationId, sf_dir)
    paths = _STORE_CACHE.get(key)
    if paths is None:
        root = scratch_dir(spark, "store", unique=True)
        nation = table(spark, sf_dir, "nation")
        paths = build_store_from_rows(spark, store_rows_source(spark, sf_dir), nation, STORE_THETA, root)
        _STORE_CACHE[key] = paths
    return paths


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The store tables as frames."""
    return {name: spark.read.parquet(p) for name, p in store_paths(spark, sf_dir).items()}


# ---------------------------------------------------------------------------
# CSV flow files derived from lineitem (one folder per source, differing column sets)
# ---------------------------------------------------------------------------

# fixed values: written header names.  Spark's CSV writer trims header cells, so the
# derived files differ by column sets (an extra and a missing column); header whitespace and
# duplicate names (A2) are exercised by hand-written files in tests/test_flow_files.py.
CSV_HEADER = ["Quantity", "Price", "Discount", "Tax", "Line", "Label"]
CSV_EXTRA_SOURCE = "src_2000"   # gets an extra column
CSV_SHORT_SOURCE = "src_2001"   # lacks the Line column

_CSV_CACHE: dict[tuple[str, str], str] = {}
ROWS_PER_FILE = 1_000_000


def _files_for(df: DataFrame) -> int:
    """Number of output partitions so files hold about ROWS_PER_FILE rows (grows with the data)."""
    return max(1, -(-df.count() // ROWS_PER_FILE))


def flow_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the flows as CSV once per session: ``<root>/source=<src>/part-*.csv``.

    Rows are range-partitioned and sorted by (source, order key) before the
    write, so sorted part-file names within a source folder follow the order
    key: file order is reproducible from the table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    root = _CSV_CACHE.get(key)
    if root:
        return root
    root = scratch_dir(spark, "flow_csv", unique=True)
    f = flows(spark, sf_dir)
    cols = [F.col(c).alias(h) for c, h in zip(["quantity", "price", "discount", "tax", "line", "label"], CSV_HEADER)]
    base = f.select(F.col("source_file").alias("source"), *ORDER_KEY, *cols)
    groups = [
        (base.filter(~F.col("source").isin(CSV_EXTRA_SOURCE, CSV_SHORT_SOURCE)), []),
        (base.filter(F.col("source") == CSV_EXTRA_SOURCE), [(F.col("l_linenumber") * 10).alias("Extra")]),
        (base.filter(F.col("source") == CSV_SHORT_SOURCE).drop("Line"), []),
    ]
    for g, extra in groups:
        n = _files_for(g)
        out = g.select("*", *extra).repartitionByRange(n, "source", *ORDER_KEY).sortWithinPartitions("source", *ORDER_KEY)
        out.drop(*ORDER_KEY).write.mode("append").option("header", True).partitionBy("source").csv(root)
    _CSV_CACHE[key] = root
    return root


_ARRIVALS_CACHE: dict[tuple[str, str], str] = {}


def arrivals(spark: SparkSession, sf_dir: str) -> str:
    """events landed as CSV files, one folder per day (``day=YYYY-MM-DD``), written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    root = _ARRIVALS_CACHE.get(key)
    if root:
        return root
    root = scratch_dir(spark, "arrivals", unique=True)
    ev = table(spark, sf_dir, "events")
    n = _files_for(ev)
    # range-partitioned on (day, event_id): a large day is split over several tasks and files
    (ev.select(F.to_date("ts").cast("string").alias("day"), "event_id", "ts", "user_id", "event_type", "value")
     .repartitionByRange(n, "day", "event_id").write.option("header", True).partitionBy("day").csv(root))
    _ARRIVALS_CACHE[key] = root
    return root
