"""Order-dependent work without a single-partition window.

``Window.orderBy`` without ``partitionBy`` plans ``Exchange SinglePartition``;
task.  ``ordered_scan`` instead

1. writes the rows to the shared scratch folder, counts them there (Parquet
   footers) and range-partitions them on (group, order) into ``n`` balanced
   partitions of at most about ``ROWS_PER_RANGE`` rows; the range sampling then
   reads the written rows instead of computing the input again.  The partition id
   is pinned as a column (written too, so the ids survive recomputation and
   executor loss),
2. numbers rows / accumulates sums inside each (partition, group) slice -- a
   slice is at most one range partition, so this shuffle is balanced,
3. adds, per slice, the totals of the same group in earlier partitions.  Only
   the first group of a partition can continue from an earlier partition, so
   the offset table has at most ``n`` rows: a proven bound for the broadcast.

Used for row indexes (dense 0-based order inside an upload), prefix sums over
sorted scores (ROC / PR curves), and contiguous buckets of rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import scratch_dir

PID = "_pid"
ROWS_PER_RANGE = 4_000_000


def range_count(rows: int, setting: int) -> int:
    """Ranges of an ordered scan: the session's shuffle partitions, more when they would hold over ``ROWS_PER_RANGE`` rows."""
    return max(setting, -(-rows // ROWS_PER_RANGE))


def _written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "ordered_scan", unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_scan(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    group_cols: Sequence[str] = (),
    sums: Sequence[str] = (),
    index_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``index_col`` (0-based position inside the group) and ``cum_<s>``
    (inclusive running sum of ``s``) for every ``s`` in ``sums``.

    ``order_cols`` must define a total order inside each group, otherwise the
    index of tied rows is arbitrary.  ``num_partitions`` fixes the number of ranges;
    None takes it from the counted rows.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    sort_keys = [*group_cols, *order_cols]
    n = num_partitions
    if n is None:
        df = _written(df)
        n = range_count(df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # pin the partition ids: both branches below read the same ids back
    parted = _written(df.repartitionByRange(n, *sort_keys).withColumn(PID, F.spark_partition_id()))

    # step 2: inside (partition, group) slices; balanced by construction
    slice_w = Window.partitionBy(PID, *group_cols).orderBy(*order_cols)
    running = slice_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted
    if index_col:
        local = local.withColumn(index_col, F.row_number().over(slice_w) - F.lit(1))
    for s in sums:
        local = local.withColumn(f"cum_{s}", F.sum(s).over(running))

    # step 3: offsets from earlier partitions, at most one row per partition
    totals = parted.groupBy(PID, *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums]
    )
    earlier = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        PID,
        *group_cols,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off_n"),
        *[F.sum(f"_t_{s}").over(earlier).alias(f"_off_{s}") for s in sums],
    ).filter(F.col("_off_n") > 0)
    off = offsets.select([F.col(c).alias(f"_o{i}") for i, c in enumerate(offsets.columns)])
    names = dict(zip(offsets.columns, off.columns))
    cond = reduce(
        lambda a, b: a & b,
        [local[PID] == off[names[PID]]] + [local[g].eqNullSafe(off[names[g]]) for g in group_cols],
    )
    joined = local.join(F.broadcast(off), cond, "left")
    out = joined
    if index_col:
        out = out.withColumn(index_col, F.col(index_col) + F.coalesce(F.col(names["_off_n"]), F.lit(0)))
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"cum_{s}") + F.coalesce(F.col(names[f"_off_{s}"]), F.lit(0)))
    return out.drop(*off.columns, PID)
