"""Line dedup by overlapping three-line windows.

Lines are the ``\\n``-separated parts of a text that hold a character other
than space, tab, CR, VT or FF; they are numbered 0, 1, ... and every run of
``width`` consecutive ones is a window, compared by exact content (MD5 of the
lines joined by ``\\n``).  All occurrences of a window in the corpus are
ordered by (doc_id, nulls last; key of the row; position); the first one stays
and every later occurrence covers its ``width`` lines.  Covered positions of a
document are merged and its covered lines go.  Blank lines stay.

* null text: stays null; empty text or fewer than ``width`` lines: unchanged
* rows equal in doc_id and text are one document: all keep or lose the same lines
* further columns pass through unchanged
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from flowlens.llm.common import materialise, row_key

WIDTH = 3
BLANK = " \t\r\x0b\x0c"


def _lines(text):
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANK)) != "")


def windows(base: DataFrame, width: int) -> DataFrame:
    """(h, doc, key, pos) for every window of every document."""
    lines = base.select("doc", "key", _lines(F.col("text")).alias("lines")).filter(F.size("lines") >= width)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, width), "\n"))),
    )
    return lines.select("doc", "key", F.posexplode(hashed).alias("pos", "h"))


def _place():
    return F.struct(F.col("doc").isNull().alias("no_doc"), F.col("doc"), F.col("key"), F.col("pos"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, starts: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for body, at, w in zip(text, starts, width, strict=True):
        if body is None or at is None:
            out.append(body)
            continue
        covered = {p for s in at for p in range(int(s), int(s) + int(w))}
        kept, n = [], 0
        for line in body.split("\n"):
            if line.strip(BLANK):
                n += 1
                if n - 1 in covered:
                    continue
            kept.append(line)
        out.append("\n".join(kept))
    return pd.Series(out, dtype=object)


def drop_repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                          width: int = WIDTH) -> DataFrame:
    """(row struct of the input, text, n_lines, n_removed): ``text`` without the repeated windows."""
    base = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("doc"), F.col(text).alias("text"),
        row_key(F.col(doc_id), F.col(text)).alias("key"),
    )
    wins = windows(base.select("doc", "key", "text"), width)
    # partial aggregation collapses a hot window before the shuffle; the written table lets
    # the join below split a hot window over tasks
    first = materialise(
        wins.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    later = (
        wins.join(first, "h").filter(~_place().eqNullSafe(F.col("first")))
        .groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    )
    joined = base.join(later, "key", "left")
    n_lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    covered = F.aggregate(  # merged length of the sorted runs [start, start + width)
        F.coalesce(F.col("starts"), F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.lit(width) - F.greatest(F.lit(0), acc["end"] - s)).alias("n"),
            (s + F.lit(width)).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    return joined.select(
        "row",
        _without(F.col("text"), F.col("starts"), F.lit(width)).alias("text"),
        F.greatest(F.lit(0), n_lines).cast("long").alias("n_lines"),
        covered.cast("long").alias("n_removed"),
    )
