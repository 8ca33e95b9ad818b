"""Benchmark decontamination through CGK random-walk embeddings.

Texts and benchmark items are word sequences (ASCII-lower-cased runs of
non-space bytes without edge punctuation).  A CGK walk reads a sequence with one
pointer: at every step it emits the word under the pointer and moves on if a
random bit, drawn per (walk, step, word), says so.  Two sequences within a small edit
distance meet again after each edit, so their embeddings are close in Hamming
distance.  Several tables per walk sample ``bits`` positions of the embedding;
a window that equals an item on all positions of one table is a candidate, and
every candidate is confirmed by the exact word edit distance of the item to the
best substring around the window (semi-global alignment).

An item is cut into segments of at most half as many words as a walk has steps
(a step moves on by half a word); they cover the whole item, the last one flush
with its end, and each proposes the item at its offset, so edits that are bunched
in one place leave other segments whole.  Windows start at every word and are of
segment size: segments fall in length classes, and a class embeds as many words as
its shortest segment has.  Before a window is embedded, a condition is tested that
some segment of every match fulfils: of d disjoint segments with k = (1 - similarity) *
(words of the item) edits in all, one has at most k / d, and a word edit spoils at
most two of the pairs of neighbours in a window, so of its w - 1 pairs at least
w - 1 - 2 * (k / d) are pairs of neighbours of some item.

The benchmark is used in blocks of at most ``block`` items and ``block_bytes`` bytes (or one
item).  The driver holds one block at a time and broadcasts it; a task holds the index of
one block at a time, and with several blocks takes about ``chunk_bytes`` of documents through
all of them.  So the documents are scanned once, without a shuffle, for up to ``pass_bytes``
of items, which bounds what is broadcast; a larger benchmark takes one scan for each such part.

* null or empty texts, items or an empty table: no match
* items of fewer than ``min_words`` words are found without walks, all of them: an item
  with k allowed edits is cut into k + 1 parts, one of which every match holds unchanged
* every item with a word is reported; a document goes only for items of at least
  ``drop_words`` words (fewer, which match verbatim only, are ordinary phrases)
* repeated documents match alike; repeated item texts match under every item_id
* ids keep their types, which may be any
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.llm.common import as_bytes, mix64, slices

EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class CgkParams:
    similarity: float = 0.8  # 1 - edits / words of the item
    min_words: int = 8  # of the items that are embedded
    drop_words: int = 4  # of the items that make a document go
    walks: int = 8
    tables: int = 4  # per walk
    bits: int = 3  # sampled positions per table
    class_ratio: float = 1.25
    longest_walk: int = 96  # steps
    block: int = 20_000  # items of one index
    block_bytes: int = 8 << 20
    pass_bytes: int = 128 << 20
    chunk_bytes: int = 32 << 20  # of documents, where there are several blocks
    seed: int = 11


def tokens(data: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGE) for x in data.lower().split()) if w]


def edit_distance_within(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any substring of ``text`` and the
    end of the first such substring (bit-parallel, one step per text word)."""
    m, full, high = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class ItemIndex:
    """LSH tables of one block of items, per length class."""

    def __init__(self, items: list[tuple[Any, bytes]], p: CgkParams):
        self.p, self.vocabulary, self.items = p, {}, []
        for item_id, data in items:
            words = tokens(data)
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]
                self.items.append((item_id, ids))
        self.words = [frozenset(ids) for _, ids in self.items]
        #: 0 stands beyond the end, 1 for any word that no item has
        size = len(self.vocabulary) + 2
        self.pairs = np.zeros(1 << max(20, (16 * sum(len(ids) for _, ids in self.items)).bit_length()), bool)
        for ids in (ids for _, ids in self.items if len(ids) >= p.min_words):
            self.pairs[self._pair(np.array(ids[:-1]), np.array(ids[1:]))] = True
        rng = np.random.default_rng(p.seed)
        self.moves = rng.integers(0, 2, (p.walks, p.longest_walk, size), np.uint8)
        self.classes = []
        low = p.min_words
        sizes = [self._segment(len(ids)) for _, ids in self.items]
        longest = max(sizes, default=0)
        while low <= longest:
            high = max(low + 1, int(low * p.class_ratio))
            own = [k for k, words in enumerate(sizes) if low <= words < high]
            if own:
                self.classes.append(self._class(own, min(sizes[k] for k in own), rng))
            low = high
        self.parts = self._parts([k for k, words in enumerate(sizes) if words < p.min_words])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x9E3779B1 + right * 0x85EBCA6B) >> 7) & (len(self.pairs) - 1)

    def _segment(self, words: int) -> int:
        """Words of the segments of an item, as many as fit a walk."""
        return words // max(1, min(-(-2 * words // self.p.longest_walk), words // self.p.min_words))

    def _parts(self, own: list[int]) -> list[tuple[int, bool, tuple]]:
        """(words, verbatim, table) of the parts of short items, by their length and
        by whether the part is the whole item."""
        kinds: dict[tuple[int, bool], list[tuple[int, int, list[int]]]] = {}
        for k in own:
            ids = self.items[k][1]
            n = min(self._allowed(len(ids)) + 1, len(ids))
            cuts = [len(ids) * i // n for i in range(n + 1)]
            for lo, hi in zip(cuts, cuts[1:]):
                kinds.setdefault((hi - lo, n == 1), []).append((k, lo, ids[lo:hi]))
        return [
            (words, verbatim, self._table(self._joined(np.array([x for *_, x in parts]).T),
                                          np.array([k for k, *_ in parts]), np.array([o for _, o, _ in parts])))
            for (words, verbatim), parts in sorted(kinds.items())
        ]

    @staticmethod
    def _joined(columns) -> np.ndarray:
        """Keys of word sequences, given as one array for every place."""
        key = np.full(len(columns[0]), len(columns), np.uint64)
        for word in columns:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))
        return key

    @staticmethod
    def _table(keys: np.ndarray, number: np.ndarray, offset: np.ndarray) -> tuple:
        order = np.argsort(keys, kind="stable")
        filled = np.zeros(1 << max(16, (8 * len(keys)).bit_length()), bool)
        filled[(keys & np.uint64(len(filled) - 1)).astype(np.int64)] = True
        return filled, keys[order], number[order], offset[order]

    def _class(self, own: list[int], words: int, rng) -> dict:
        p = self.p
        steps = min(2 * words, p.longest_walk)
        samples = np.sort(rng.permuted(np.tile(np.arange(steps), (p.walks, p.tables, 1)), axis=2)[:, :, : p.bits], axis=2)
        size = {k: len(self.items[k][1]) for k in own}
        edits = max(self._allowed(m) // (m // words) for m in size.values())
        c = {"words": words, "steps": steps, "samples": samples, "least": max(1, words - 1 - 2 * edits)}
        flat, starts, number, offset = [], [], [], []
        at = 0
        for k in own:
            for o in range(0, size[k], words):
                offset.append(min(o, size[k] - words))
                starts.append(at + offset[-1])
                number.append(k)
            flat += [self.items[k][1], [0] * (steps + 1)]
            at += size[k] + steps + 1
        number, offset = np.array(number), np.array(offset)
        ids = np.concatenate(flat).astype(np.int64)
        c["tables"] = [self._table(keys, number, offset) for keys in self._keys(ids, np.array(starts), c)]
        return c

    def _allowed(self, words: int) -> int:
        return words - int(np.ceil(words * self.p.similarity - 1e-9))

    def _keys(self, ids: np.ndarray, starts: np.ndarray, c: dict) -> Iterator[np.ndarray]:
        """Keys of the windows at ``starts``, table by table."""
        for walk in range(self.p.walks):
            at, moves = starts.copy(), self.moves[walk]
            wanted = c["samples"][walk]
            keys = [np.full(len(starts), walk * self.p.tables + t + 1, np.uint64) for t in range(self.p.tables)]
            last = int(wanted.max())
            for step in range(last + 1):
                word = ids[at]
                for t in range(self.p.tables):
                    if step in wanted[t]:
                        keys[t] = mix64(keys[t] * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))
                if step < last:
                    at += moves[step][word]
            yield from keys

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(item number, document, likely start) of the windows that share a table entry; ``ids`` is padded."""
        found: set[tuple[int, int, int]] = set()
        n_words = int(ends[-1]) if len(ends) else 0
        good = (ids[:-1] > 1) & (ids[1:] > 1)
        good &= self.pairs[self._pair(ids[:-1], ids[1:])]
        known = np.concatenate([[0], np.cumsum(good)])
        for c in self.classes:
            until = np.minimum(np.arange(n_words) + c["words"] - 1, n_words)
            starts = np.flatnonzero(known[until] - known[:n_words] >= c["least"])
            if not len(starts):
                continue
            for table, mine in zip(c["tables"], self._keys(ids, starts, c), strict=True):
                found.update(zip(*(x.tolist() for x in self._shared(table, mine, starts, ends)), strict=True))
        for words, verbatim, table in self.parts:
            mine = self._joined([ids[i : n_words + i] for i in range(words)])
            number, doc, at = self._shared(table, mine, np.arange(n_words), ends)
            if verbatim:  # the first occurrence in a document is the best already
                first = np.unique(number * len(ends) + doc, return_index=True)[1]
                number, doc, at = number[first], doc[first], at[first]
            found.update(zip(number.tolist(), doc.tolist(), at.tolist(), strict=True))
        return found

    @staticmethod
    def _shared(table: tuple, mine: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """Item numbers, documents and likely starts, ordered by the place of the window."""
        filled, keys, number, offset = table
        hit = np.flatnonzero(filled[(mine & np.uint64(len(filled) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, mine[hit], "left"), np.searchsorted(keys, mine[hit], "right")
        times = hi - lo
        entry = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        at = np.repeat(starts[hit], times)
        return number[entry], np.searchsorted(ends, at, "right"), at - offset[entry]

    def matches(self, ids: np.ndarray, ends: np.ndarray) -> list[list[tuple[Any, int, int, int]]]:
        """Per document of the concatenated, padded ``ids``: (item_id, edits, item words, end word)."""
        out: list[dict] = [{} for _ in ends]
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for k, doc, at in sorted(self.candidates(ids, ends)):
            if k in out[doc] and not out[doc][k][1]:
                continue  # an earlier occurrence without edits is the best already
            item_id, item = self.items[k]
            m = len(item)
            allowed = self._allowed(m)
            lo = max(int(begins[doc]), at - allowed)
            hi = min(int(ends[doc]), at + m + 2 * allowed)
            near = ids[lo:hi].tolist()
            if sum(map(self.words[k].__contains__, near)) < m - allowed:
                continue  # fewer common words than any match has
            edits, end = edit_distance_within(item, near)
            if edits <= allowed:
                best = out[doc].get(k)
                if best is None or (edits, lo + end) < (best[1], best[3]):
                    out[doc][k] = (item_id, edits, m, lo + end)
        return [
            [(i, e, m, end - int(begins[d])) for i, e, m, end in (found[k] for k in sorted(found))]
            for d, found in enumerate(out)
        ]


def block_matches(batch: pa.RecordBatch, index: ItemIndex) -> list[list[tuple[Any, int, int, int]]]:
    """Matches of every row with the items of one block."""
    number = index.vocabulary | {b"": -1}  # nothing but punctuation is no word
    parts = []
    for data in as_bytes(batch):
        ids = np.array([number.get(w.strip(EDGE), 1) for w in data.lower().split()], np.int64)
        parts.append(ids[ids >= 0])
    pad = np.zeros(index.p.longest_walk + 2, np.int64)
    return index.matches(np.concatenate([*parts, pad]), np.cumsum([len(x) for x in parts]))


def scan(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], p: CgkParams):
    """Batches with the list of matches of every row, over all blocks."""
    if len(blocks) == 1:
        index = ItemIndex(blocks[0].value, p)
        for batch in slices(batches, 512):
            yield batch, block_matches(batch, index)
        return
    for chunk in _chunks(slices(batches, 512), p.chunk_bytes):
        found: list[list[list]] = [[[] for _ in range(b.num_rows)] for b in chunk]
        for block in blocks:
            index = ItemIndex(block.value, p)
            for batch, rows in zip(chunk, found, strict=True):
                for mine, more in zip(rows, block_matches(batch, index), strict=True):
                    mine += more
        yield from zip(chunk, found, strict=True)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches that end as soon as they hold ``size`` bytes."""
    chunk, held = [], 0
    for batch in batches:
        chunk.append(batch)
        held += batch.nbytes
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def item_blocks(benchmark: DataFrame, p: CgkParams) -> Iterator[list[tuple[Any, bytes]]]:
    """Blocks of bounded items and bytes, ordered by id and text; one is held at a time."""
    items = (
        benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
        .orderBy("item_id", "text").toLocalIterator()
    )
    block: list[tuple[Any, bytes]] = []
    held = 0
    for r in items:
        data = r.text.encode("utf-8", "surrogatepass")
        if block and (len(block) == p.block or held + len(data) > p.block_bytes):
            yield block
            block, held = [], 0
        block.append((r.item_id, data))
        held += len(data)
    if block:
        yield block


def passes(benchmark: DataFrame, p: CgkParams) -> Iterator[list[Broadcast]]:
    """Broadcast blocks, as many at a time as hold ``pass_bytes``."""
    context, blocks, held = benchmark.sparkSession.sparkContext, [], 0
    for block in item_blocks(benchmark, p):
        size = sum(len(data) for _, data in block)
        if blocks and held + size > p.pass_bytes:
            yield blocks
            blocks, held = [], 0
        blocks.append(context.broadcast(block))
        held += size
    if blocks:
        yield blocks


def contaminated(docs: DataFrame, benchmark: DataFrame, params: CgkParams = CgkParams()) -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word): the best match of every item in every document."""
    p, out = params, None
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    result = (f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, "
              "edits int, item_words int, end_word long")
    kinds = [to_arrow_type(item_kind), pa.int32(), pa.int32(), pa.int64()]
    for blocks in passes(benchmark, p):

        def run(batches, blocks=blocks):
            for batch, found in scan(batches, blocks, p):
                row = pa.array([k for k, ms in enumerate(found) for _ in ms], pa.int64())
                columns = list(zip(*(m for ms in found for m in ms), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                    ["doc_id", "item_id", "edits", "item_words", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, result)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], result) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: CgkParams = CgkParams()) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no item of ``drop_words`` words or more is found."""
    for blocks in passes(benchmark, params):

        def run(batches, blocks=blocks):
            for batch, found in scan(batches, blocks, params):
                yield batch.filter(pa.array([all(m[2] < params.drop_words for m in ms) for ms in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
