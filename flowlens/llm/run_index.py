"""Repeated passages by a run-length index (run-compressed Burrows-Wheeler transform).

Every byte covered by a ``length``-byte string that starts at two or more places
of the corpus is removed; strings never cross documents and are judged on the input.

How the corpus is cut into indexes of bounded size
    Every ``length``-byte window has an anchor: its ``gram``-byte substring of least hash.
    Equal windows have equal anchors at equal offsets, so a string can only
    repeat among the segments (maximal runs of windows with one anchor
    occurrence) of one anchor.  Anchors that occur once are dropped.  Segments
    that are equal as a whole are one class; a class of two or more is covered
    completely.  Only distinct classes of one anchor still have to be compared.

The index
    The classes of some anchors form one text of about ``index_bytes``.  Its
    suffixes are sorted, the Burrows-Wheeler transform is cut into runs of equal
    bytes, and the longest common prefix with the neighbour in suffix order is
    computed at the ends of the runs only.  Inside a run it is one less than at the
    byte before in the text, so the matching statistics of all positions are
    streamed in text order from the sampled run ends; a position with a statistic
    of ``length`` or more starts a repeated window.  An anchor with more than
    ``group_classes`` classes (a passage in very many surroundings) is split over
    several indexes of that size; windows that are alone in theirs are matched across the
    indexes by counting hashes, first of what ``step`` neighbouring windows have in common.

* null and empty texts and texts shorter than ``length``: nothing removed
* repeated rows repeat each other: texts of ``length`` bytes or more are removed completely
* grams and classes are compared by 64-bit hashes within an anchor, rows by (64-bit hash of id and text, size)
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import as_bytes, materialise, mix64, slices


@dataclass(frozen=True)
class RunIndexParams:
    length: int = 200
    gram: int = 48
    piece: int = 1 << 20  # bytes worked on at once
    index_bytes: int = 1 << 19
    group_classes: int = 2048
    step: int = 16  # windows matched at once across the indexes of one anchor


PACK = 7  # symbols of 9 bits in one sort key
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int, n: int):
        self.up, self.down = self._cum(base, n), self._cum(pow(base, -1, 1 << 64), n)

    @staticmethod
    def _cum(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)], dtype=np.uint64)])

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from block-wise running minima."""
    n = len(v) - w + 1
    pad = (-len(v)) % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Cutter:
    """Cuts texts into segments."""

    def __init__(self, p: RunIndexParams):
        self.p = p
        size = 2 * p.piece + 2 * p.length
        self.grams, self.wholes = _Powers(_BASE, size), _Powers(_BASE2, size)

    def pieces(self, texts: list[bytes]):
        """(numbers, offsets, data) of about ``piece`` bytes; long texts come in overlapping parts."""
        p, group, size = self.p, [], 0
        for k, text in enumerate(texts):
            for at in range(0, len(text) - p.length + 1, p.piece):
                part = text[at : at + p.piece + p.length - 1]
                if size + len(part) > p.piece and group:
                    yield group
                    group, size = [], 0
                group.append((k, at, part))
                size += len(part)
        if group:
            yield group

    def cut(self, group: list[tuple[int, int, bytes]]):
        """Arrays (text number, place, anchor, class) of a group of parts."""
        p, w = self.p, self.p.length - self.p.gram + 1
        x = np.frombuffer(b"".join(part for *_, part in group), np.uint8)
        ends = np.cumsum([len(part) for *_, part in group])
        g = self.grams.prefix(x)
        at = np.arange(len(x) - p.gram + 1)
        gram = mix64(self.grams.of(g, at, at + p.gram))
        low = np.uint64((1 << 31) - 1)
        anchor_at = (sliding_min((gram & ~low) | at.astype(np.uint64), w) & low).astype(np.int64)
        start = np.arange(len(anchor_at))
        part = np.searchsorted(ends, start, "right")
        ok = start + p.length <= ends[part]
        start, part, anchor_at = start[ok], part[ok], anchor_at[ok]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor_at) != 0) | (np.diff(part) != 0)]))
        count = np.diff(np.append(new, len(start)))
        first, part = start[new], part[new]
        h = self.wholes.prefix(x)
        end = first + count - 1 + p.length
        # the anchor's place in the segment belongs to its identity
        kind = mix64(self.wholes.of(h, first, end) + (end - first).astype(np.uint64) * np.uint64(_BASE))
        number = np.array([k for k, *_ in group])[part]
        base = np.array([a for _, a, _ in group])[part]
        begin = np.concatenate([[0], ends[:-1]])[part]
        place = (base + first - begin) << 16 | (anchor_at[new] - first) << 8 | (count - 1)
        return number, place, gram[anchor_at[new]].view(np.int64), kind.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def occurrences(docs: DataFrame, p: RunIndexParams) -> DataFrame:
    """(anchor, kind, key, place); ``place`` holds the first window (from bit 16), the
    anchor's offset in it (8 bits) and the number of windows less one (8 bits)."""

    def run(batches):
        cutter = Cutter(p)
        for batch in slices(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for group in cutter.pieces(as_bytes(batch)):
                number, place, anchor, kind = cutter.cut(group)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(kind), pa.array(keys[number]), pa.array(place)],
                    ["anchor", "kind", "key", "place"])

    return _keyed(docs).mapInArrow(run, "anchor long, kind long, key long, place long")


def packed(docs: DataFrame) -> DataFrame:
    """(key, n_bytes, packed): compressed texts, to move less."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            texts = as_bytes(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([pack(t) for t in texts], pa.binary())], ["doc_id", "key", "n_bytes", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key long, n_bytes long, packed binary")


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a few texts, with the common
    prefixes sampled at the ends of its runs."""

    def __init__(self, texts: list[bytes]):
        #: 0 ends a text; bytes are shifted up by one
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1) - 1
        t = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
        t[self.ends] = 0
        self.text, levels = t, self._ranks(t)
        order = np.empty(len(t), np.int64)
        order[levels[-1]] = np.arange(len(t))
        bwt = np.where(order > 0, t[order - 1], -1)
        border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.runs = len(border) + 1
        # sampled run ends: both sides of a border know their common prefix
        self.run_first, self.run_last = order[border], order[border - 1]
        self.sample = self._common(t, levels, self.run_last, self.run_first)
        self.outer = order[[0, -1]]

    @staticmethod
    def _ranks(t: np.ndarray) -> list[np.ndarray]:
        """Ranks of the prefixes of PACK, 2 PACK, 4 PACK, ... symbols until all suffixes differ."""
        padded = np.concatenate([t + 1, np.zeros(PACK, np.int64)])  # 0: beyond the end
        key = np.zeros(len(t), np.int64)
        for k in range(PACK):
            key = key << 9 | padded[k : k + len(t)]
        levels, step = [], PACK
        while True:
            order = np.argsort(key)  # equal keys get equal ranks, so their order is of no account
            sorted_ = key[order]
            new = np.empty(len(t), np.int64)
            new[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
            levels.append(new)
            most = int(new[order[-1]])
            if most == len(t) - 1:
                return levels
            key = new * (most + 2)
            key[: max(0, len(t) - step)] += new[step:] + 1
            step *= 2

    @staticmethod
    def _common(t: np.ndarray, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of suffix pairs, from the ranks of doubling prefixes."""
        n, got = len(t), np.zeros(len(a), np.int64)
        steps = [(rank, PACK << k) for k, rank in reversed(list(enumerate(levels)))]
        for rank, step in steps + [(t, 1)] * (PACK - 1):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            going = (rank[x] == rank[y]) & (a + got < n) & (b + got < n)
            got += going * step  # a pair that differs at a symbol differs there at every later step
        return got

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest string that starts there and elsewhere
        too, within its text; streamed in text order."""
        n = len(self.text)
        at, best = np.arange(n), np.zeros(n, np.int64)
        for sampled, edge in ((self.run_first, self.outer[0]), (self.run_last, self.outer[1])):
            known = np.zeros(n, np.int64)
            known[sampled] = self.sample
            source = np.zeros(n, np.int64)
            source[sampled] = sampled
            source[edge] = edge  # no neighbour on this side: 0
            source = np.maximum.accumulate(source)
            np.maximum(best, known[source] - (at - source), out=best)
        left = self.ends[np.searchsorted(self.ends, at)] - at
        return np.minimum(best, left)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def index_matches(classes: DataFrame, p: RunIndexParams) -> DataFrame:
    """(key, start, end, anchor, core, body, open) from the run-length index of every bucket.

    Rows without ``core`` are covered spans of single classes.  Buckets of a
    split anchor also give their distinct groups of ``step`` neighbouring windows
    (counted from the anchor): ``core`` is the hash of what those windows have in
    common, ``open`` says that one of them is alone in its bucket.
    """
    names = ["key", "start", "end", "anchor", "core", "body", "open"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("kind", "ascending")])
        texts = table.column("body").to_pylist()
        long = RunLengthIndex(texts).matching_statistics() >= p.length
        split = table.column("split")[0].as_py()
        seen: set[bytes] = set()
        out, at = [], 0
        rows = zip(texts, *(table.column(c).to_pylist() for c in ("key", "place", "n", "anchor")), strict=True)
        for text, key, place, n, anchor in rows:
            first, own = place >> 16, long[at : at + len(text)]
            if n == 1:
                out += [(key, first + a, first + b - 1 + p.length, None, None, None, None) for a, b in _runs(own)]
            offset, last = place >> 8 & 255, place & 255
            for start in range(offset % p.step - p.step, last + 1, p.step) if split else ():
                x, y = max(start, 0), min(start + p.step - 1, last)
                if y < x:
                    continue
                alone = n == 1 and not own[x : y + 1].all()
                body = text[x : y + p.length]
                core = xxhash.xxh3_64_intdigest(text[start + p.step - 1 : start + p.length], offset - start + 256)
                known = body + bytes([x - start])
                if alone or known not in seen:
                    seen.add(known)
                    core = core - (1 << 64) if core >> 63 else core
                    out.append((key, first + x, first + y + p.length, anchor, core, body, alone))
            at += len(text) + 1
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(names, columns, kinds, strict=True)})

    return classes.groupBy("bucket").applyInArrow(
        run, "key long, start long, end long, anchor long, core long, body binary, open boolean")


def matches_across(groups: DataFrame, p: RunIndexParams) -> DataFrame:
    """Covered (key, start, end) of windows that repeat in several indexes of one anchor."""

    def run(batches):
        powers = _Powers(_BASE2, 2 * p.length)
        for batch in slices(batches):
            for anchor, key, first, alone, body in zip(
                    *(batch.column(c).to_pylist() for c in ("anchor", "key", "start", "open", "body")), strict=True):
                start = np.arange(len(body) - p.length + 1)
                prefix = powers.prefix(np.frombuffer(body, np.uint8))
                h = mix64(powers.of(prefix, start, start + p.length)).view(np.int64)
                same = np.ones(len(h), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same * anchor), pa.array(h), pa.array(same * key), pa.array(first + start),
                     pa.array(np.full(len(h), alone))], ["anchor", "window", "key", "start", "open"])

    # groups whose common part is nowhere else hold no repeated window
    several = materialise(groups.groupBy("anchor", "core").agg(F.count("*").alias("times")).filter("times > 1"))
    wins = materialise(groups.join(several, ["anchor", "core"]).select("anchor", "key", "start", "open", "body")
                       .mapInArrow(run, "anchor long, window long, key long, start long, open boolean"))
    often = materialise(wins.groupBy("anchor", "window").agg(F.count("*").alias("times")).filter("times > 1"))
    return wins.filter("open").join(often, ["anchor", "window"]).select(
        "key", "start", (F.col("start") + p.length).alias("end"))


def covered_spans(docs: DataFrame, p: RunIndexParams) -> DataFrame:
    """(key, start, end) byte ranges, overlapping, that cover all repeated windows."""
    found = occurrences(docs, p)
    repeated = materialise(found.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"))
    found = materialise(found.join(repeated, "anchor"))
    classes = materialise(
        found.groupBy("anchor", "kind").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("r"))
        .select("anchor", "kind", "n", "r.*"))
    first = F.shiftright("place", 16)
    last = first + F.col("place").bitwiseAND(255)
    whole = (
        found.join(classes.filter("n > 1").select("anchor", "kind"), ["anchor", "kind"])
        .select("key", first.alias("start"), (last + p.length).alias("end"))
    )
    mixed = materialise(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    open_ = classes.join(mixed, "anchor")

    def bodies(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            rows = []
            for key, data, segments in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(),
                                           batch.column("segments").to_pylist(), strict=True):
                text = unpack(data)
                for s in segments:
                    first = s["place"] >> 16
                    rows.append((s["anchor"], s["kind"], s["n"], s["kinds"], key, s["place"],
                                 text[first : first + (s["place"] & 255) + p.length]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["anchor", "kind", "n", "kinds", "key", "place", "body"])

    wanted = open_.groupBy("key").agg(  # bounded by the length of one document
        F.collect_list(F.struct("anchor", "kind", "n", "kinds", "place")).alias("segments"))
    texts = packed(docs).select("key", "packed").join(wanted, "key")
    cut = materialise(texts.select("key", "packed", "segments").mapInArrow(
        bodies, "anchor long, kind long, n long, kinds long, key long, place long, body binary")
        .dropDuplicates(["anchor", "kind"]))
    size = cut.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(1, -(-int(size) // p.index_bytes))
    block = F.pmod(F.col("kind"), F.ceil(F.col("kinds") / F.lit(p.group_classes)))
    split = F.col("kinds") > p.group_classes
    bucket = F.when(split, F.xxhash64("anchor", block)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    found = materialise(index_matches(
        cut.select("anchor", "kind", "n", "key", "place", "body", split.alias("split"),
                   F.struct(split.alias("split"), bucket.alias("number")).alias("bucket")), p))
    within = found.filter("core IS NULL").select("key", "start", "end")
    return whole.unionByName(within).unionByName(matches_across(found.filter("core IS NOT NULL"), p))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, params: RunIndexParams = RunIndexParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` is the text that stays."""
    p = params
    # bounded by the length of one document
    spans = covered_spans(docs, p).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            out = []
            for data, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, parts, at, n, removed = unpack(data), [], 0, 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if a > end:
                        n += 1
                        parts.append(text[at:a])
                    if b > end:
                        removed += b - max(a, end)
                        at = end = b
                parts.append(text[at:])
                out.append((len(text), removed, n, hashlib.sha256(b"".join(parts)).hexdigest(), b"".join(parts)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = packed(docs).join(spans, "key", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, {RESULT}, kept binary")
