"""CSV export of results.

The rows are written by every task in parallel (no driver round-trip) in part
files that, read in the order of their names, hold the rows in the asked order; each
part file starts with a UTF-8 byte-order mark in its header line.  A distributed CSV
has no footer, so the summary block (one line per run and metric) is a second output
next to the rows, in parts sorted by run.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"


def export_csv(rows: DataFrame, summary: DataFrame, out: str, order: Sequence[str | Column] = ()) -> dict[str, str]:
    """Write ``rows`` and ``summary`` as CSV under ``out``.

    ``order``: a range-partitioned sort over the parts (one run may fill many of them);
    empty keeps the order that ``rows`` has.  Tables without rows give no part files with lines.
    """
    first = rows.columns[0]
    if order:
        rows = rows.orderBy(*order)
    ordered = rows.select(F.col(first).alias(BOM + first), *rows.columns[1:])
    ordered.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{out}/rows")
    key = summary.columns[0]
    metrics = [c for c in summary.columns if c != key]
    long = summary.select(
        key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics])).alias("s")
    ).select(key, "s.metric", "s.value")
    long.orderBy(key, "metric").write.mode("overwrite").option("header", True).csv(f"{out}/summary")
    return {"rows": f"{out}/rows", "summary": f"{out}/summary"}
