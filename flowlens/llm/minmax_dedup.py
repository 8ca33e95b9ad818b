"""Near-duplicate groups by min-max hashing with exact confirmation.

A document is the set of its distinct word shingles (words are runs of bytes
other than space and \\t-\\r, A-Z lower-cased).  Every permutation (an odd
multiplier and an offset modulo 2^64) is evaluated once and gives two signature
values, the smallest and the largest image of the set, each equal for two sets
with probability J.  ``bands`` bands of ``rows`` values propose candidates; a
pair at the threshold 0.8 shares a band with probability
1 - (1 - 0.8^4)^20 > 0.99997 by default.

Documents with the same word sequence are one node, so copies never multiply.
In every band bucket all nodes are first compared with the node of the most
bucket neighbours (a star, linear in the bucket); the buckets whose members are
then still in different components are compared exactly, in bounded blocks.  Links
are confirmed on whole shingle sets, so every proposed pair is either confirmed,
refuted or already inside one component.

* null or empty texts and texts without a word: empty set, linked with nothing
* fewer words than a shingle: the whole sequence is the only shingle
* repeated doc_ids: every row is returned; equal ids count as one id
* a null doc_id joins groups but never names one unless all ids of the group are null
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

from flowlens.llm.common import Memo, as_bytes, materialise, mix64, row_key, slices
from flowlens.llm.components import connected_components


@dataclass(frozen=True)
class MinMaxParams:
    shingle: int = 4
    percent: int = 80  # link where 100 * |A and B| >= percent * |A or B|
    bands: int = 20
    rows: int = 4
    seed: int = 7
    block_shingles: int = 200_000  # of a block in the exact comparison
    block_nodes: int = 1024


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_set(words: list[bytes], k: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    take = min(k, len(w))
    h = np.full(len(w) - take + 1, take, np.uint64)
    for i in range(take):
        h = (h ^ w[i : len(w) - take + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(mix64(h))


def permutations(p: MinMaxParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    n = (p.bands * p.rows + 1) // 2
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def min_max_signature(sh: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 2048) -> np.ndarray:
    """Smallest images under all permutations, then the largest ones."""
    low = np.full(len(mul), np.iinfo(np.uint64).max)
    high = np.zeros(len(mul), np.uint64)
    for at in range(0, len(sh), block):
        image = sh[at : at + block, None] * mul + add
        np.minimum(low, image.min(axis=0), out=low)
        np.maximum(high, image.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, p: MinMaxParams) -> np.ndarray:
    values = signature[: p.bands * p.rows].reshape(p.bands, p.rows)
    key = np.arange(p.bands, dtype=np.uint64) + np.uint64(1)
    for i in range(p.rows):
        key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + values[:, i])
    return key.view(np.int64)


def _node(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def signatures(docs: DataFrame, p: MinMaxParams, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, node, n_shingles, bands): node is null for an empty set."""
    mul, add = permutations(p)

    def run(batches):
        memo = Memo(_word_hash)
        for batch in slices(batches):
            nodes, sizes, bands = [], [], []
            for data in as_bytes(batch):
                words = data.lower().split()
                sh = shingle_set(words, p.shingle, memo)
                nodes.append(_node(words) if words else None)
                sizes.append(len(sh))
                bands.append(band_keys(min_max_signature(sh, mul, add), p) if words else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))],
                [*carried, "node", "n_shingles", "bands"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return docs.select(*carried, "text").mapInArrow(
        run, f"{kinds}node binary, n_shingles long, bands array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """(node, packed): the compressed word sequence of every document with a word."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            words = [w for w in (data.lower().split() for data in as_bytes(batch)) if w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(w) for w in words], pa.binary()),
                 pa.array([pack(b" ".join(w)) for w in words], pa.binary())], ["node", "packed"])

    return docs.select("text").mapInArrow(run, "node binary, packed binary")


def confirm(pairs: DataFrame, texts: DataFrame, p: MinMaxParams) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "pa", "pb")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        memo = Memo(_word_hash)
        last, held = None, None  # neighbours share their star's centre
        for batch in slices(batches):
            hit = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("pa").to_pylist(),
                               batch.column("pb").to_pylist(), strict=True):
                if a != last:
                    last, held = a, shingle_set(unpack(x).split(), p.shingle, memo)
                other = shingle_set(unpack(y).split(), p.shingle, memo)
                same = len(np.intersect1d(held, other, assume_unique=True))
                hit.append(100 * same >= p.percent * (len(held) + len(other) - same))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def block_links(nodes: list[bytes], sets: list[np.ndarray], labels: list[bytes], blocks: list[int],
                percent: int, columns: int = 4096) -> list[tuple[bytes, bytes]]:
    """Links between documents of different labels: of two blocks against each
    other, or of one block in itself.  Shared shingles are counted exactly, by matrix
    products over the shingles that occur twice, a bounded number of columns at a time."""
    order = sorted(range(len(nodes)), key=lambda k: (blocks[k], nodes[k]))
    split = sum(b == blocks[order[0]] for b in blocks) if order else 0
    left, right = (order[:split], order[split:]) if split < len(order) else (order, order)
    place = np.concatenate([np.full(len(sets[k]), r) for r, k in enumerate(order)])
    _, column, times = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    renumber = np.cumsum(times > 1) - 1
    use = times[column] > 1
    place, column = place[use], renumber[column[use]]
    by_column = np.argsort(column, kind="stable")
    place, column = place[by_column], column[by_column]
    same = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        member = np.zeros((len(order), columns), np.float32)
        member[place[lo:hi], column[lo:hi] - at] = 1
        same += member[: len(left)] @ member[len(order) - len(right) :].T
    size = np.array([len(sets[k]) for k in range(len(nodes))], np.float64)
    union = size[left][:, None] + size[right][None, :] - same
    name = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    label = np.array([name[x] for x in labels])
    hit = (100.0 * same >= percent * union) & (label[left][:, None] != label[right][None, :])
    return [(nodes[left[x]], nodes[right[y]]) for x, y in zip(*np.nonzero(hit), strict=True)]


def compare_in_blocks(members: DataFrame, texts: DataFrame, p: MinMaxParams) -> DataFrame:
    """Links (a, b) between members (bucket, node, n, label) of one bucket and different labels.

    A bucket is cut into blocks of bounded size and every two blocks are compared
    in one task; no pair of documents is a row unless it is a link.
    """
    cuts = members.groupBy("bucket").agg(
        F.greatest(F.ceil(F.sum("n") / F.lit(p.block_shingles)), F.ceil(F.count("*") / F.lit(p.block_nodes))).alias("blocks"))
    dealt = (
        members.join(cuts, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                "block", "node", "label")
        .join(texts, "node")
    )

    def run(table: pa.Table) -> pa.Table:
        unpack, memo = zstandard.ZstdDecompressor().decompress, Memo(_word_hash)
        sets = [shingle_set(unpack(x).split(), p.shingle, memo) for x in table.column("packed").to_pylist()]
        node, label, block = (table.column(c).to_pylist() for c in ("node", "label", "block"))
        links = block_links(node, sets, label, block, p.percent) if len(set(label)) > 1 else []
        return pa.table({c: pa.array([x[k] for x in links], pa.binary()) for k, c in enumerate("ab")})

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "a binary, b binary").distinct()


def _sizes_fit(p: MinMaxParams, x: str, y: str):
    """J <= min / max of the sizes, so other pairs can't be links."""
    return 100 * F.least(x, y) >= p.percent * F.greatest(x, y)


def node_labels(rows: DataFrame, docs: DataFrame, p: MinMaxParams) -> DataFrame:
    """(node, label) of the nodes with a link; ``rows`` are the written signatures of ``docs``."""
    nodes = rows.filter("node IS NOT NULL").dropDuplicates(["node"])
    entries = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = materialise(entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    members = materialise(entries.join(shared, "bucket"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    member = materialise(members.join(degree, "node").select("bucket", "node", "n", "degree"))
    centre = materialise(
        member.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("c"))
        .select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("na"))
    )
    star = materialise(
        member.join(centre, "bucket").filter(F.col("a") != F.col("node")).filter(_sizes_fit(p, "n", "na"))
        .select("a", F.col("node").alias("b")).distinct()
    )
    needed = member.select("node").distinct()
    texts = materialise(_packed(docs).join(needed, "node", "left_semi").dropDuplicates(["node"]))
    links = materialise(confirm(star, texts, p))

    first = connected_components(links)
    placed = member.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_buckets = (
        placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .filter("lo <> hi").select("bucket")
    )
    rest = materialise(placed.join(open_buckets, "bucket", "left_semi").select("bucket", "node", "n", "label"))
    more = materialise(compare_in_blocks(rest, texts, p))
    return connected_components(links.unionByName(more))


def near_duplicates(docs: DataFrame, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows = materialise(signatures(docs, params))
    labels = node_labels(rows, docs, params)
    least = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_group = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialise(grouped.join(of_group, "label").select("node", "component_id"))
    joined = rows.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    group = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def one_of_each_group(docs: DataFrame, params: MinMaxParams = MinMaxParams()) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each group: the one with the smallest doc_id,
    null last, then the least hash of the row.

    Rows equal in all columns are one document, also those without a word, which
    are linked with no other row.  Neither an id nor a null id stands for several rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("")
    key = F.unhex(F.md5(F.concat(row_key(F.col("doc_id"), F.col("text")), F.encode(rest, "UTF-8"))))
    rows = materialise(signatures(docs.select("doc_id", "text", key.alias("key")), params, ("doc_id", "key")))
    labels = node_labels(rows, docs, params)
    one = rows.groupBy("key", "doc_id", "node").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "copies")
    least = one.filter("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("least"))
    grouped = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_group = grouped.groupBy("label").agg(F.min("least").alias("least")).select("least.key", "least.copies")
    kept = materialise(of_group.unionByName(one.filter("node IS NULL").select("key", "copies")))

    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    once = keyed.join(kept.filter("copies = 1"), "key", "left_semi")
    more = keyed.join(kept.filter("copies > 1"), "key", "left_semi").dropDuplicates(["key"])
    return once.unionByName(more).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
