"""Multi-file CSV flow sources (A1-A4) and the file-order row index.

Files are read in sorted path order.  One text scan finds every file's header
line (the CSV reader would otherwise apply the first file's header to all
files); header names are stripped and made unique by column expressions, files
with the same header are read together by one ``spark.read.csv`` with an
all-string schema, and the groups are unioned by name (missing columns -> NULL).
Each row carries its file path, the byte offset of its split and a position
inside the split, which together give the original file order without a global
sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.ordering import ordered_scan
from flowlens.session import scratch_dir


def list_csv_files(spark: SparkSession, root: str) -> list[str]:
    """All ``*.csv`` files under ``root`` (any depth), sorted by path (Hadoop FileSystem listing)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    it = fs.listFiles(path, True)
    out = []
    while it.hasNext():
        p = it.next().getPath().toString()
        if p.lower().endswith(".csv"):
            out.append(p)
    return sorted(out)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as ``_metadata.file_path`` gives it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def header_cells(line: Column) -> Column:
    """Raw cells of a CSV header line: quotes resolved, byte order mark removed."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(line, "^\ufeff", "")),
                                 F.lit(r',(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0))
    bare = F.transform(cells, lambda c: F.substr(c, F.lit(2)))
    return F.transform(bare, lambda c: F.when(c.rlike(r'(?s)^".*"$'), F.replace(
        F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def normalise_headers(raw: Column) -> Column:
    """Stripped names; a repeated name gets the first free suffix of ``.1``, ``.2`` ..."""
    def add(names: Column, cell: Column) -> Column:
        base = F.regexp_replace(cell, r"^\s+|\s+$", "")
        tries = F.transform(F.sequence(F.lit(1), F.size(names) + 1), lambda k: F.concat(base, F.lit("."), k.cast("string")))
        free = F.filter(tries, lambda t: ~F.array_contains(names, t))
        return F.array_append(names, F.when(F.array_contains(names, base), F.element_at(free, 1)).otherwise(base))

    return F.aggregate(raw, F.array().cast("array<string>"), add)


def _first_lines(lines: DataFrame) -> DataFrame:
    """The first row of every file of (_file, line) rows that each task reads file after file, in line order."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            files = batch.column(0)
            if not len(files):
                continue
            changed = pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
            keep = np.concatenate([[files[0].as_py() != last], np.asarray(changed, dtype=bool)])
            last = files[-1].as_py()
            yield batch.filter(pa.array(keep))

    return lines.mapInArrow(first, lines.schema)


def read_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A2: one row per file that has a first line: _file, raw cells, normalised names.

    One distributed text scan, run once and written (one row per file).  The first line of a
    file is the first row of its split that starts at byte 0, which one task reads from its
    start, so no line is sorted or shuffled.  Empty files have no row.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("_file"), "value", F.col("_metadata.file_block_start").alias("_block"))
    first = _first_lines(lines.filter("_block = 0").select("_file", F.col("value").alias("line")))
    raw = first.select("_file", header_cells(F.col("line")).alias("raw"))
    heads = raw.select("_file", "raw", normalise_headers(F.col("raw")).alias("names"))
    path = scratch_dir(spark, "headers", unique=True)
    heads.write.parquet(path)
    return spark.read.schema(heads.schema).parquet(path)


def csv_groups(spark: SparkSession, paths: Sequence[str], heads: DataFrame | None = None) -> list[tuple[list[str], DataFrame]]:
    """The files as one all-string frame per distinct header, in order of the first path that has it.

    Columns: the normalised names and _file, _source_file, _block, _pos.  The
    driver receives the headers and the paths, which the readers list anyway.
    ``heads``: the files' ``read_headers``, where the caller has them.
    """
    heads = read_headers(spark, paths) if heads is None else heads
    groups = heads.groupBy("names").agg(F.array_sort(F.collect_list("_file")).alias("files")).collect()
    out = []
    for g in sorted(groups, key=lambda g: g["files"][0]):
        names = g["names"]
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        df = (
            spark.read.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
            .schema(schema).csv(g["files"])
        )
        out.append((names, df.select(
            *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_name").alias("_source_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_pos"),
        )))
    return out


def read_csv_with_order(spark: SparkSession, paths: Sequence[str], heads: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Union of the files (all-string columns) with order columns _file, _block, _pos and _source_file."""
    groups = csv_groups(spark, paths, heads) if paths else []
    if not groups:
        raise ValueError("no CSV files")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for _, df in groups])
    return out, list(dict.fromkeys(n for names, _ in groups for n in names))


def read_flows(spark: SparkSession, root_or_paths: str | Sequence[str], heads: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """A1: every CSV under a folder (or the given files) as one frame in file order."""
    paths = list_csv_files(spark, root_or_paths) if isinstance(root_or_paths, str) else sorted(root_or_paths)
    return read_csv_with_order(spark, paths, heads)


MAX_BLOCKS = 1_000_000  # of the broadcast offset table: about 40 MB


def row_blocks(df: DataFrame) -> DataFrame:
    """Rows, first and last position of every block (a split of a file), counted in one pass and written."""
    path = scratch_dir(df.sparkSession, "blocks", unique=True)
    df.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_from"), F.max("_pos").alias("_to")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_row_index(df: DataFrame, col: str = "row_index", group: Sequence[str] = (), max_blocks: int = MAX_BLOCKS,
                   blocks: DataFrame | None = None) -> DataFrame:
    """Dense 0-based index in file order (file path, split offset, position), without moving a row.

    The first pass counts the rows of every block (a split of a file) and finds its first
    position; running sums over that small table give each block its offset, and
    a row's index is the offset plus its place in the block.  The table is broadcast up to
    ``max_blocks`` blocks and joined by the planner beyond.  The reader's positions must be the
    same in both passes: a row whose block or place the first pass did not see stops the
    job with an error.  A frame from which rows were filtered has gaps in its positions
    and is ranked by ``ordered_scan``, as is one that is not grouped by file or not at all.
    ``blocks``: the frame's ``row_blocks``, where the caller has them.
    """
    group = list(group)
    if group not in ([], ["_file"]):
        return ordered_scan(df, order_cols=["_file", "_block", "_pos"], group_cols=group, index_col=col)
    blocks = row_blocks(df) if blocks is None else blocks
    facts = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.max(F.col("_to") - F.col("_from") + 1 - F.col("_n")).alias("gaps")).first()
    if facts["gaps"]:
        return ordered_scan(df, order_cols=["_file", "_block", "_pos"], group_cols=group, index_col=col)
    few = facts["blocks"] <= max_blocks
    if few:
        before = Window.partitionBy(*group).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("_n").over(before), F.lit(0))  # one task, at most ``max_blocks`` rows
        offsets = blocks.withColumn("_start", start)
    else:
        offsets = ordered_scan(blocks, order_cols=["_file", "_block"], group_cols=group, sums=["_n"]).withColumn(
            "_start", F.col("cum__n") - F.col("_n"))
    offsets = offsets.select(F.col("_file").alias("_of"), F.col("_block").alias("_ob"), "_n", "_from", "_start")
    joined = df.join(F.broadcast(offsets) if few else offsets, (F.col("_file") == F.col("_of")) & (F.col("_block") == F.col("_ob")), "left")
    place = F.col("_pos") - F.col("_from")
    index = F.when((place >= 0) & (place < F.col("_n")), F.col("_start") + place).otherwise(
        F.raise_error(F.lit("the files' splits changed between two passes; fix spark.sql.files.minPartitionNum")).cast("long"))
    return joined.withColumn(col, index).drop("_of", "_ob", "_n", "_from", "_start")


def file_profile(spark: SparkSession, paths: Sequence[str], df: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """A3: rows and header columns per file, and whether all files have the same column count."""
    heads = read_headers(spark, paths) if heads is None else heads
    files = spark.createDataFrame([(qualified(spark, p),) for p in paths], "_file string")
    cols = files.join(heads.select("_file", F.size("names").alias("n_cols")), "_file", "left")
    rows = df.groupBy("_file").agg(F.count(F.lit(1)).alias("n_rows"))
    j = cols.join(rows, "_file", "left").select(
        "_file", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_cols", F.lit(0)).alias("n_cols"))
    consistent = j.agg((F.countDistinct("n_cols") == 1).alias("consistent"), F.sum("n_rows").alias("total_rows"))
    return j.crossJoin(consistent)


def schema_diff(spark: SparkSession, paths: Sequence[str], heads: DataFrame | None = None) -> DataFrame:
    """A4: each file's stripped header against the first file's: missing and extra names."""
    heads = (read_headers(spark, paths) if heads is None else heads).select(
        "_file", F.transform("raw", lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")).alias("header"))
    ref = heads.agg(F.min_by("header", "_file").alias("ref"))
    return heads.crossJoin(F.broadcast(ref)).select(
        "_file",
        (F.col("header") == F.col("ref")).alias("same"),
        F.array_sort(F.array_except("ref", "header")).alias("missing"),
        F.array_sort(F.array_except("header", "ref")).alias("extra"),
    )
