"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree up to ``order`` bytes deep, made of the
counts of its training texts (Unicode lower case, as UTF-8).  The order is variable: a context
of more than ``full_order`` bytes is in the tree only if the language has it ``min_context`` times.
A byte is coded in its longest context that the tree has; a context of total count T with
D distinct followers gives a seen byte count / (T + D) and escapes with D / (T + D) to
the next shorter one, below which all 256 byte values are equally likely.  The
statistics are frozen, so the exact code length of (context, byte) is fixed and a text's
code length is a sum over its grams.  The language with the
shortest code wins; the score is its posterior under equal priors.

The trees are kept per depth as sorted arrays of the grams that occur, each with the
languages that have it and their code lengths, so their size follows the training
text, not the number of possible contexts.  Fitting counts in Spark, from one text of each of at most
``max_docs`` doc_ids per language (a documented bound on rows); a first filter by a hash of the id leaves
about 2.5 * ``max_docs`` ids of a language before they are ranked.  The trees are broadcast
up to ``max_bytes``; beyond that an error is raised before anything is sent.

* null text, or a text without a letter (``str.isalpha``): ``und`` with score 0
* no training row: ``und`` with score 0 for all
* a null lang or null doc_id is never learned from; ties go to the first language by code point
* a doc_id on several rows of one language is learned from once (the text of least md5)
* texts of any length: grams are looked up in pieces of ``PIECE`` bytes
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import as_text, held_out, materialise, one_text_per_id, slices

PAD = 32  # the context before a text
PIECE = 1 << 16
MAX_BROADCAST_IDS = 1_000_000  # beyond, the planner joins the chosen ids


@dataclass(frozen=True)
class PpmParams:
    order: int = 4  # at most 6, so that a gram and its language fit 63 bits
    full_order: int = 2
    min_context: int = 2
    max_docs: int = 1500  # doc_ids per language
    max_bytes: int = 1 << 30  # of all trees together


def training_ids(docs: DataFrame, p: PpmParams) -> DataFrame:
    """(lang, doc_id, ord) of at least ``max_docs`` ids of every language that has so many, about 2.5 times as many
    at most: those under a threshold of a seeded hash, set from the language's count of ids."""
    rows = docs.select("doc_id", F.col("lang").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    rows = rows.withColumn("ord", F.xxhash64(F.lit("ppm"), "doc_id"))
    # written first: its rows, one for each language, are counted before they are broadcast, so that
    # no row is dealt by its language
    share = materialise(rows.groupBy("lang").agg((F.lit(2.5 * p.max_docs) / F.approx_count_distinct("doc_id")).alias("share")))
    if share.count() <= MAX_BROADCAST_IDS:
        share = F.broadcast(share)
    near = rows.join(share, "lang").filter(F.col("ord") / F.lit(2.0**64) + 0.5 < F.col("share"))
    return near.groupBy("lang", "doc_id", "ord").agg(F.lit(1).alias("one")).drop("one")  # a hot id is combined first


def training_sample(docs: DataFrame, p: PpmParams) -> DataFrame:
    """(lang, text) of at most ``max_docs`` doc_ids of every language, by a seeded hash of the id, one text for each."""
    ranked = training_ids(docs, p).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("ord", "doc_id")))
    chosen = materialise(ranked.filter(F.col("k") <= p.max_docs).select("doc_id", "lang"))
    if chosen.count() <= MAX_BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    rows = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    return one_text_per_id(rows, "doc_id", "lang").select("lang", "text")


def context_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): counts of the order + 1 byte grams, as integers in base 256."""

    def run(batches):
        for batch in slices(batches):
            langs, grams, counts = [], [], []
            per: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), as_text(batch), strict=True):
                per.setdefault(lang, []).append(text.lower().encode("utf-8", "surrogatepass"))
            for lang, texts in per.items():
                found = [gram_codes(t, order) for t in texts if t]
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    langs += [lang] * len(g)
                    grams.append(g)
                    counts.append(n)
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate([empty, *grams])),
                 pa.array(np.concatenate([empty, *counts]))], ["lang", "gram", "n"])

    return sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_codes(data: bytes, order: int) -> np.ndarray:
    """The grams of order + 1 bytes that end in each byte of a text, as integers in base 256."""
    return codes_of(bytes([PAD]) * order + data, order)


def codes_of(padded: bytes, order: int) -> np.ndarray:
    x = np.frombuffer(padded, np.uint8).astype(np.int64)
    size = len(padded) - order
    code = x[:size]
    for k in range(1, order + 1):
        code = code * 256 + x[k : k + size]
    return code


class Sparse:
    """Rows of (language, value) under sorted int64 keys."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, values: np.ndarray):
        """``keys`` sorted, one entry for each (key, language)."""
        self.keys, first = np.unique(keys, return_index=True)
        self.ptr = np.append(first, len(keys)).astype(np.int64)
        self.langs, self.values = langs.astype(np.int32), values.astype(np.float32)

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``wanted``, language, value) of all entries under the wanted keys."""
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == wanted)
        start, many = self.ptr[at[place]], self.ptr[at[place] + 1] - self.ptr[at[place]]
        index = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
        return np.repeat(place, many), self.langs[index], self.values[index]

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.ptr.nbytes + self.langs.nbytes + self.values.nbytes


class PpmModel:
    """The languages' context trees: per depth the code lengths in bits of the bytes seen in a
    context, and of the escape from it."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, p: PpmParams):
        """``lang`` (index into the sorted ``langs``), ``gram`` (order + 1 bytes) and ``count`` of every gram."""
        self.order, self.langs = p.order, langs
        self.seen: list[Sparse] = []
        self.escape: list[Sparse] = []
        if not langs:
            return
        size = len(langs)
        for depth in range(p.order + 1):
            key, inverse = np.unique((gram & ((1 << 8 * (depth + 1)) - 1)) * size + lang, return_inverse=True)
            n = np.bincount(inverse.ravel(), weights=count)
            code, of = key // size, key % size
            context, inverse = np.unique((code >> 8) * size + of, return_inverse=True)
            inverse = inverse.ravel()
            total, distinct = np.bincount(inverse, weights=n), np.bincount(inverse)
            kept = total >= (p.min_context if depth > p.full_order else 1)
            own = kept[inverse]
            self.seen.append(Sparse(code[own], of[own], -np.log2(n / (total + distinct)[inverse])[own]))
            self.escape.append(Sparse((context // size)[kept], (context % size)[kept],
                                      -np.log2(distinct / (total + distinct))[kept]))
        if self.nbytes > p.max_bytes:
            raise ValueError(f"the trees of {size} languages take {self.nbytes} bytes, more than max_bytes; "
                             "lower order or max_docs, or raise min_context")

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.seen + self.escape)

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of every (distinct) gram under every language, shortest contexts first."""
        levels = [(grams, None)]
        for depth in range(self.order, 0, -1):
            levels.append(np.unique(levels[-1][0] & ((1 << 8 * depth) - 1), return_inverse=True))
        levels.reverse()  # (grams of depth d, place of each gram of depth d + 1 among them)
        bits = np.full((len(levels[0][0]), len(self.langs)), 8.0, np.float32)
        for depth, (codes, _) in enumerate(levels):
            if depth:
                bits = bits[levels[depth - 1][1].ravel()]
            if len(self.escape[depth].keys):
                at, lang, value = self.escape[depth].entries(codes >> 8)
                bits[at, lang] += value
                at, lang, value = self.seen[depth].entries(codes)
                bits[at, lang] = value
        return bits

    def code_lengths(self, data: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(data), len(self.langs)))
        room = max(PIECE, (1 << 21) // max(1, len(self.langs)))
        owners, pieces, held = [], [], 0
        for k, text in enumerate(data):
            padded = bytes([PAD]) * self.order + text
            for at in range(0, len(text), PIECE):
                owners.append(k)
                pieces.append(codes_of(padded[at : at + PIECE + self.order], self.order))
                held += len(pieces[-1])
                if held >= room:
                    self._add(out, owners, pieces)
                    owners, pieces, held = [], [], 0
        if pieces:
            self._add(out, owners, pieces)
        return out

    def _add(self, out: np.ndarray, owners: list[int], pieces: list[np.ndarray]) -> None:
        grams, inverse = np.unique(np.concatenate(pieces), return_inverse=True)
        starts = np.cumsum([0, *[len(x) for x in pieces[:-1]]])
        sums = np.add.reduceat(self._bits(grams)[inverse.ravel()], starts, axis=0, dtype=np.float64)
        np.add.at(out, owners, sums)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        known = [bool(self.langs) and any(map(str.isalpha, t)) for t in texts]
        data = [t.lower().encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(texts, known, strict=True)]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths(data)
        odds = np.exp2(bits.min(axis=1, keepdims=True) - bits)
        best = bits.argmin(axis=1)
        score = np.where(known, odds.max(axis=1) / odds.sum(axis=1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.round(score, 9)


def fit(docs: DataFrame, params: PpmParams = PpmParams()) -> PpmModel:
    # grams of a bounded sample, as Arrow columns
    rows = context_counts(training_sample(docs, params), params.order).toArrow().combine_chunks()
    names = rows.column("lang").to_numpy()
    langs = sorted(set(names))
    number = {x: k for k, x in enumerate(langs)}
    lang = np.fromiter((number[x] for x in names), np.int64, len(names))
    return PpmModel(langs, lang, rows.column("gram").to_numpy(), rows.column("n").to_numpy(), params)


def identify(docs: DataFrame, params: PpmParams = PpmParams()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, params))

    def run(batches):
        for batch in slices(batches):
            lang, score = model.value.predict(as_text(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
