"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words (runs of characters other than
space and \\t-\\r).  Sources in code point order, null last, weigh 5, 2, 1,
repeating; together they are to give 150 % of all words.  No target exceeds twice
its source: the excess goes to the other sources by weight until none is above
(water filling, solved in one pass over the sources sorted by cap per weight).

A source first gives whole copies of itself (0, 1 or 2 of every document).  What
remains of its budget is fitted on the table of its exact document lengths: a
proportional share of every length, a greedy pass for what that leaves beyond
``window`` words, then a bounded-knapsack dynamic program over the sums up to the
remaining budget (a bitset; the first length to reach a sum is kept for the way
back), for which up to half a ``window`` of the share is dealt anew.  The answer is a count per length; documents of a length are chosen in a
seeded order.

A hot (source, length) is ranked in ``BUCKETS`` hash buckets: whole buckets are
taken by their counts and only the one at the boundary is sorted.

* null or empty texts have size 0: taken 0, their rows are still returned
* null sources are one source, the last; a source without words has target 0
* repeated rows count as often as they occur and may be taken differently
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2  # copies of a document at most
BUCKETS = 256
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(lengths: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size, n) rows."""
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1).cast("double")
    sources = sources.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * float(MOST)
    total = sources.agg(F.sum("source_size").alias("total"))
    before = Window.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumns({"cap": cap, "per": cap / F.col("weight")}).crossJoin(F.broadcast(total))  # one row
        .withColumns({
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all": F.sum("weight").over(Window.partitionBy()),
        })
        .withColumn("level", (F.col("total") * SHARE - F.col("spent")) / (F.col("all") - F.col("gone")))
    )
    # the water level is that of the first source (by cap per weight) that it does not fill
    level = ranked.filter("level <= per").agg(F.min_by("level", F.struct("per", "source")).alias("water"))
    return ranked.crossJoin(F.broadcast(level)).select(  # one row
        "source", "source_size",
        F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))).alias("target"),
    )


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that the words come nearest to
    ``budget`` from below.  Lengths are positive and distinct."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    for k in order:
        if left <= window + int(sizes[order[0]]):
            break  # the short lengths are kept for the exact fit
        more = min(int(counts[k] - take[k]), max(0, left - window) // int(sizes[k]))
        take[k] += more
        left -= more * int(sizes[k])
    for k in order:  # room for the exact fit: some of the proportional share is dealt anew
        back = min(int(take[k]), -(-max(0, window // 2 - left) // int(sizes[k])))
        take[k] -= back
        left += back * int(sizes[k])
    mask, reached, by = (1 << (left + 1)) - 1, 1, {}
    for k in order:
        if reached >> left & 1:
            break
        free, part = int(counts[k] - take[k]), 1
        while free > 0 and part * int(sizes[k]) <= left:
            part = min(part, free)
            free -= part
            new = (reached << (part * int(sizes[k]))) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                for s in np.flatnonzero(bits):
                    by[int(s)] = (k, part)
                reached |= new
            part *= 2
    at = reached.bit_length() - 1
    while at:
        k, part = by[at]
        take[k] += part
        at -= part * int(sizes[k])
    return take


def length_plan(lengths: DataFrame, targets: DataFrame, window: int = 1 << 16) -> DataFrame:
    """(source, size, copies, extra): all documents ``copies`` times and ``extra`` of them once more."""
    rows = lengths.join(targets, lengths.source.eqNullSafe(targets.source)).select(
        lengths.source, "size", "n", "source_size", "target")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size").reset_index(drop=True)
        words, target = int(group["source_size"][0]), float(group["target"][0])
        budget = int(np.floor(target + 0.5))
        copies = min(MOST, budget // words) if words else 0
        extra = np.zeros(len(group), np.int64)
        real = group["size"].to_numpy() > 0
        if words and copies < MOST:
            extra[real] = fit_counts(group["size"].to_numpy()[real], group["n"].to_numpy()[real],
                                     budget - copies * words, window)
        return group.assign(copies=copies, extra=extra)[["source", "size", "source_size", "target", "copies", "extra"]]

    # a group is one source's table of distinct lengths, pre-aggregated: bounded by the longest document
    return rows.groupBy("source").applyInPandas(
        plan, "source string, size long, source_size long, target double, copies long, extra long")


def mix(docs: DataFrame, seed: int = 0, window: int = 1 << 16) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = materialise(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        order.alias("ord"), F.pmod(F.shiftright(order, 17), F.lit(BUCKETS)).cast("int").alias("bucket"),
    ))
    buckets = materialise(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    lengths = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    plan = materialise(length_plan(lengths, materialise(source_targets(lengths)), window))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    dealt = before.alias("c").join(
        plan.alias("p"),
        F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")),
    ).select("c.source", "c.size", "c.bucket", "source_size", "target", "copies",
             F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("some"), "n")
    dealt = materialise(dealt)
    joined = rows.alias("r").join(
        dealt.alias("d"),
        F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size"))
        & (F.col("r.bucket") == F.col("d.bucket")),
    ).select("doc_id", "r.source", "r.size", "r.bucket", "ord", "source_size", "target", "copies", "some", "n")
    clear = joined.filter("some = 0 OR some = n").withColumn("more", (F.col("some") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("ord", "doc_id"))
    edge = joined.filter("some > 0 AND some < n").withColumn("more", (rank <= F.col("some")).cast("long"))
    return clear.unionByName(edge).select(
        "doc_id", "size", "source_size", "target",
        ((F.col("copies") + F.col("more")) * F.col("size")).alias("taken"),
    )
