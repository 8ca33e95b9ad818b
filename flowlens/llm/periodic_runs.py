"""Periodic runs of words, found with an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q, at least
``max(min_length, min_exponent * q)`` long, that no neighbouring word extends.

The method
    The documents of a piece share one suffix array over word numbers (every
    document has an alphabet of its own, so no common prefix crosses documents),
    sorted by doubling; groups that are settled leave the sort.  The longest common
    prefixes come from the ranks of the doubling levels.  A border of common prefix d
    parts its interval into two children; for every suffix i of the smaller child,
    i + d and i - d are looked up in the inverse suffix array, and one that lies in the
    other child gives a branching tandem: two copies of d words that the next word
    ends.  Intervals are pairs of array bounds, there are no tree nodes.  All squares of
    a run are rotations of its one branching tandem, so it is rotated to the left, in
    steps of powers of two compared by the level ranks, and the squares merge into the
    run at once.  Of runs with equal bounds the one with the smallest period stays.

Documents are independent: one pass, no shuffle.  A piece holds about ``piece_words``
words or one longer document; memory is about 8 bytes a word for each doubling level
(the logarithm of the longest repeat) and time n log^2 n at worst.

* null and empty texts, and texts of whitespace: 0 words, no runs, empty collapsed text
* repeated rows are computed alike; ids of any type, null ids included, are passed through
* an empty table gives an empty result; further columns are not read
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import as_bytes, slices

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_QUICK = 16  # rounds of pointer jumping before the bounds are found by lifting


@dataclass(frozen=True)
class RunParams:
    min_length: int = 6
    min_exponent: int = 4
    piece_words: int = 1 << 18
    chunk: int = 1 << 22  # bytes split at once; suffixes tested at once


def word_numbers(text: bytes, chunk: int) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words by first occurrence, and the words; long texts are split in chunks."""
    numbers: dict[bytes, int] = {}
    parts, at = [np.empty(0, np.int64)], 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + chunk, len(text)))
        end = cut.start() if cut else len(text)
        words = text[at:end].split()  # bytes split at exactly \x20 and \x09-\x0D
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts), list(numbers)


class EnhancedSuffixArray:
    """Suffix array, inverse, common prefixes and the ranks of all doubling levels."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        small = np.int32 if n < 1 << 31 else np.int64
        sa = np.argsort(symbols, kind="stable")
        sorted_ = symbols[sa]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(n, small)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, self.lcp = [rank], np.zeros(n + 1, np.int64)
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        h = 1
        while len(open_):
            group = rank[sa[open_]].astype(np.int64)
            after = sa[open_] + h
            key = group * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            order = np.argsort(key, kind="stable")
            key, sa[open_] = key[order], sa[open_][order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            parted = np.flatnonzero(new & np.concatenate([[False], group[1:] == group[:-1]]))
            at = open_[parted]
            self.lcp[at] = h + self._common(sa[at - 1] + h, sa[at] + h)
            rank = rank.copy()
            rank[sa[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
            self.levels.append(rank)
            open_ = open_[~(new & np.append(new[1:], True))]
            h *= 2
        self.sa, self.isa = sa, np.empty(n, np.int64)
        self.isa[sa] = np.arange(n)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffix pairs that differ within the last level's length."""
        n, got = len(self.levels[0]), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            x, y = a + got, b + got
            same = (x < n) & (y < n) & (self.levels[k][np.minimum(x, n - 1)] == self.levels[k][np.minimum(y, n - 1)])
            got += same.astype(np.int64) << k
        return got

    def back(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal those before ``i + d``."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            a = i - got - (1 << k)
            level, ok = self.levels[k], a >= 0
            a = np.maximum(a, 0)
            got += (ok & (level[a] == level[a + d])).astype(np.int64) << k
        return got


def nearest_below(v: np.ndarray, at: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each place in ``at`` the nearest one in direction ``step`` whose value is
    smaller (or, with ``equal``, not larger).  The ends of ``v`` are smaller than all in ``at``."""
    near = np.arange(len(v)) + step
    near[0 if step < 0 else -1] -= step

    def lower(x, y):
        return v[x] <= v[y] if equal else v[x] < v[y]

    todo = at
    for _ in range(_QUICK):
        todo = todo[~lower(near[todo], todo)]
        if not len(todo):
            return near[at]
        near[todo] = near[near[todo]]
    # many hops are left: lift over powers of two hops whose values all stay above
    todo = todo[~lower(near[todo], todo)]
    if len(todo):
        hops, least = [near.copy()], [v[near]]
        while (1 << len(hops)) < len(v):
            up, low = hops[-1], least[-1]
            hops.append(up[up])
            least.append(np.minimum(low, low[up]))
        x = near[todo]
        for up, low in zip(reversed(hops), reversed(least)):
            above = low[x] > v[todo] if equal else low[x] >= v[todo]
            x = np.where(above, up[x], x)
        near[todo] = hops[0][x]
    return near[at]


def branching_tandems(esa: EnhancedSuffixArray, p: RunParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, d): the d words at i are repeated at i + d, and the words after both copies differ."""
    n, lcp = len(esa.sa), esa.lcp
    border = np.flatnonzero(lcp > 0)
    left = nearest_below(lcp, border, -1, False)
    right = nearest_below(lcp, border, 1, True)
    wide = right - left >= p.min_exponent  # the suffixes of all copies but the last are in one child
    border, left, right = border[wide], left[wide], right[wide]
    depth = lcp[border]
    low = border - left <= right - border
    first, last = np.where(low, left, border), np.where(low, border, right)  # the smaller child
    other, until = np.where(low, border, left), np.where(low, right, border)
    ends = np.cumsum(last - first)
    at = 0
    while at < len(border):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + p.chunk, "right")))
        size = (last - first)[at:to]
        k = np.repeat(np.arange(at, to), size)
        place = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + first[k]
        i, d = esa.sa[place], depth[k]
        for j, start in ((i + d, i), (i - d, i - d)):
            inside = (j >= 0) & (j < n)
            r = esa.isa[np.where(inside, j, 0)]
            hit = np.flatnonzero(inside & (r >= other[k]) & (r < until[k]))
            yield start[hit], d[hit]
        at = to


def find_runs(symbols: np.ndarray, p: RunParams) -> np.ndarray:
    """Rows (start, end, period) of the runs, by start and period."""
    if not len(symbols):
        return np.empty((0, 3), np.int64)
    esa, found = EnhancedSuffixArray(symbols), [np.empty((0, 3), np.int64)]
    for i, d in branching_tandems(esa, p):
        start, end = i - esa.back(i, d), i + 2 * d
        long = end - start >= np.maximum(p.min_length, p.min_exponent * d)
        found.append(np.stack([start, end, d], axis=1)[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]) if len(runs) else np.empty(0, bool)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def _piece(docs: list[tuple[np.ndarray, list[bytes]]], p: RunParams):
    """Runs (relative to their document) by document, and the collapsed texts."""
    sizes = np.array([len(ids) for ids, _ in docs])
    starts = np.cumsum(sizes) - sizes
    alphabets = np.cumsum([0, *(len(words) for _, words in docs)])
    symbols = np.concatenate([ids + base for (ids, _), base in zip(docs, alphabets)])
    runs = find_runs(symbols, p)
    gone = dropped(len(symbols), runs)
    doc = np.searchsorted(starts + sizes, runs[:, 0], "right")
    texts = []
    for (ids, words), start in zip(docs, starts):
        kept = ids[~gone[start : start + len(ids)]]
        texts.append(b" ".join([words[w] for w in kept.tolist()]))
    counts = np.bincount(doc, minlength=len(docs))
    fields = [runs[:, 0] - starts[doc], runs[:, 1] - runs[:, 0], runs[:, 2]]
    return sizes, counts, fields, texts


def periodic_runs(docs: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: ``runs`` by start, then period;
    ``collapsed`` joins by one space the words that no run contains after its first period."""

    def run(batches):
        for batch in slices(batches):
            held: list[tuple[np.ndarray, list[bytes]]] = []
            size = at = 0
            for k, text in enumerate(as_bytes(batch)):
                held.append(word_numbers(text, p.chunk))
                size += len(held[-1][0])
                if size >= p.piece_words or k + 1 == batch.num_rows:
                    n, counts, fields, texts = _piece(held, p)
                    runs = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                        pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields],
                                                   ["start", "length", "period"]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, len(held)), pa.array(n, pa.int64()), runs,
                         pa.array(texts, pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "runs", "collapsed"])
                    held, size, at = [], 0, k + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """The altered input of the query: where crc32 h of the decimal doc_id ends in 0, the words
    from a = g % n on repeat with period 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10).
    A null doc_id alters nothing; texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def bound(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def altered(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        period = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.get(words, (a + (i - a) % period).cast("int")))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return docs.select("doc_id", F.when((h % 10 == 0) & some, bound(words, altered)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns: the run with the greatest exact length / period (ties: smallest
    start, then period), and the hashes of all runs and of the collapsed text."""
    none = F.lit(None).cast(RUN)
    # runs come by start and period, so a later one wins only if it is strictly better
    best = F.aggregate("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"),
        F.col("b.period").alias("period"), F.expr("b.length * 1000 div b.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256", "n_words")
