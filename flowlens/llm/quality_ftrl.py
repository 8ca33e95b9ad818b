"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-Proximal) updates.

Tokens are runs of word characters and runs of other visible characters, case
kept.  Every token and every pair of neighbours is hashed into ``2**bits``
slots; a document is the sparse vector of its slot counts divided by the square
root of its n-gram total, and its score is the logistic of the sparse dot
product with the weights plus a bias.

Fitting reads at most ``max_train`` labelled documents (a documented bound,
chosen by a seeded hash of the id) in one task that holds only their feature
indices; scoring is a map over all documents without any shuffle.

* null or empty text: no features, the score is the logistic of the bias
* one class only: the bias leans to it, so texts without features are predicted as that class
  (below or above 0.5, by the same updates); without a labelled row the score is 0.5 everywhere
* repeated rows are scored alike; further columns are ignored
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Memo, as_text, held_out, labelled_sample, slices

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 18
    max_train: int = 8000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def _slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


def ngram_slots(text: str, memo: Memo, bits: int) -> np.ndarray:
    """Slots of all unigrams and bigrams of a text, with repeats."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    uni = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    pair = uni[:-1] * np.uint64(0x9E3779B97F4A7C15) + uni[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    one = uni * np.uint64(0xFF51AFD7ED558CCD)
    return (np.concatenate([one, pair]) >> np.uint64(64 - bits)).astype(np.int64)


def _features(text: str, memo: Memo, bits: int) -> tuple[np.ndarray, np.ndarray]:
    slots = ngram_slots(text, memo, bits)
    if not len(slots):
        return slots, np.zeros(0)
    index, counts = np.unique(slots, return_counts=True)
    return index, counts / np.sqrt(len(slots))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-Proximal; the last slot is the bias (not regularised)."""

    def __init__(self, p: FtrlParams):
        self.p, size = p, (1 << p.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, index: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[index]
        bias = index == len(self.z) - 1
        l1, l2 = np.where(bias, 0.0, p.l1), np.where(bias, 0.0, p.l2)
        w = -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(self.n[index])) / p.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (_sigmoid(w @ value) - label) * value
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha
        self.z[index] += g - sigma * w
        self.n[index] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1,
        params: FtrlParams = FtrlParams()) -> np.ndarray:
    """Weight vector of ``2**bits + 1`` entries (the last one is the bias)."""
    sample = labelled_sample(docs, labels, label, modulus, remainder, params.max_train)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bias, rows = Memo(_slot), 1 << params.bits, []
        for batch in slices(batches):
            for text, y in zip(as_text(batch), batch.column("label").to_pylist(), strict=True):
                index, value = _features(text, memo, params.bits)
                rows.append((np.append(index, bias).astype(np.int32), np.append(value, 1.0).astype(np.float32), y))
        model = Ftrl(params)
        for _ in range(params.epochs):
            for index, value, y in rows:
                model.update(index, value, y)
        index = np.flatnonzero(model.n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(index, pa.int64()), pa.array(model.weights(index), pa.float64())], ["slot", "weight"])

    ordered = sample.repartition(1).sortWithinPartitions("ord", "doc_id", "text")
    weights = np.zeros((1 << params.bits) + 1)
    for r in ordered.mapInArrow(train, "slot long, weight double").collect():  # at most 2**bits + 1 numbers
        weights[r.slot] = r.weight
    return weights


def score_texts(texts: list[str], weights: np.ndarray, memo: Memo, bits: int) -> np.ndarray:
    z = np.full(len(texts), weights[-1])
    for k, text in enumerate(texts):
        slots = ngram_slots(text, memo, bits)
        if len(slots):
            z[k] += weights[slots].sum() / np.sqrt(len(slots))
    return np.round(_sigmoid(z), 9)


def score(docs: DataFrame, weights: np.ndarray, params: FtrlParams = FtrlParams()) -> DataFrame:
    """(doc_id, score) for every row."""
    weights = weights.astype(np.float32)

    def run(batches):
        memo = Memo(_slot)
        for batch in slices(batches):
            s = score_texts(as_text(batch), weights, memo, params.bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5,
              params: FtrlParams = FtrlParams()) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``threshold``."""
    weights = weights.astype(np.float32)

    def run(batches):
        memo = Memo(_slot)
        for batch in slices(batches):
            keep = score_texts(as_text(batch), weights, memo, params.bits) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) with the fit on rows that are not held out."""
    scored = score(docs, fit(docs, labels, params=params), params)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
