"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
digits or signs that stand for letters become Latin letters.  The lexicon is
learned from labelled documents (at most ``max_train``, a documented bound): a
folded word is an entry if its share among toxic documents exceeds that among
clean ones significantly (likelihood ratio), and its weight is the log odds.
An exception phrase is a pair of neighbouring words with an entry in it that the
clean documents use at least as often as the toxic ones.  One automaton holds
both; a match must be whole words, and an entry inside an exception phrase
does not count.  Lexicon and exceptions hold all terms that pass these tests; they are
words and pairs of the at most ``max_train`` documents, whatever the table's size.

The score is a logistic function, fitted on the same documents, of the matched
weight divided by a power of the number of words.

* null, empty or wordless texts match nothing: the score is the logistic of the bias
* without toxic (or clean) labelled rows the lexicon is empty and every score 0.5
* repeated rows are scored alike; repeated labels of an id count with the largest
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import as_text, held_out, labelled_sample, materialise, slices

#: Characters of other scripts, digits and signs that are read as a Latin letter.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "ѡ": "w", "ց": "g", "ո": "n", "ս": "u", "օ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "​": "",
    "‌": "", "‍": "", "­": "", "﻿": "",
}
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LexiconParams:
    max_train: int = 8000
    least_support: int = 3  # toxic documents with the word
    least_ratio: float = 20.0  # likelihood ratio statistic
    length_power: float = 0.5


_FULL_WIDTH = {0xFEE0 + c: chr(c).lower() for c in range(0x21, 0x7F) if chr(c).isalpha()}
_TABLE = str.maketrans(LOOK_ALIKE) | _FULL_WIDTH


def fold(text: str) -> str:
    return text.lower().translate(_TABLE)


def _term_counts(sample: DataFrame, entries: set[str] | None) -> DataFrame:
    """(term, toxic, clean): labelled documents with the word (``entries`` None) or
    with the pair of words of which one is an entry."""

    def run(batches):
        for batch in slices(batches):
            terms, labels = [], []
            for text, y in zip(as_text(batch), batch.column("label").to_pylist(), strict=True):
                words = WORD.findall(fold(text))
                if entries is None:
                    own = set(words)
                else:
                    own = {f"{a} {b}" for a, b in zip(words, words[1:]) if a in entries or b in entries}
                terms += own
                labels += [int(y)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32())], ["term", "y"])

    return sample.select("text", "label").mapInArrow(run, "term string, y int").groupBy("term").agg(
        F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def _ratio(toxic: str, clean: str, n_toxic: int, n_clean: int):
    """Likelihood ratio statistic of one share against two."""
    share = lambda a, n: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), a / n))
    part = lambda a, n, p: a * F.log(p) + (n - a) * F.log(1 - p)
    t, c = F.col(toxic), F.col(clean)
    both = share(t + c, float(n_toxic + n_clean))
    own_t, own_c = share(t, float(n_toxic)), share(c, float(n_clean))
    return 2 * (part(t, n_toxic, own_t) + part(c, n_clean, own_c) - part(t, n_toxic, both) - part(c, n_clean, both))


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: list[str], p: LexiconParams):
        self.p, self.any = p, bool(weights)
        self.automaton = ahocorasick.Automaton()
        for word, w in sorted(weights.items()):
            self.automaton.add_word(word, (len(word), w))
        for phrase in sorted(exceptions):
            self.automaton.add_word(phrase, (len(phrase), None))
        if self.any:
            self.automaton.make_automaton()

    def density(self, text: str) -> float:
        """Matched weight by length."""
        if not self.any or not text:
            return 0.0
        folded = " ".join(WORD.findall(fold(text)))
        if not folded:
            return 0.0
        found, exempt = [], []
        last = len(folded) - 1
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1] != " ") or (end < last and folded[end + 1] != " "):
                continue
            (exempt if weight is None else found).append((start, end, weight))
        if exempt:
            exempt.sort(key=lambda x: x[0])
            starts, reach = [a for a, *_ in exempt], list(accumulate((b for _, b, _ in exempt), max))
            # inside a phrase: of those that start no later one ends no earlier
            found = [f for f in found if not ((k := bisect_right(starts, f[0])) and reach[k - 1] >= f[1])]
        return sum(w for *_, w in found) / (folded.count(" ") + 1) ** self.p.length_power


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    exceptions: list[str]
    slope: float
    bias: float
    params: LexiconParams


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps with a small ridge."""
    if not len(x):
        return 0.0, 0.0
    a, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -35, 35)))
        grad = a.T @ (p - y) + 1e-2 * theta
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        theta = theta - np.linalg.solve(hess, grad)
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, params: LexiconParams = LexiconParams()) -> ToxicityModel:
    p = params
    # dealt again, so that the terms of the chosen texts are counted in many tasks
    sample = materialise(labelled_sample(docs, labels, "toxic", 5, 0, p.max_train).repartition(-(-p.max_train // 256)))
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, [], 0.0, 0.0, p)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    top = (
        _term_counts(sample, None)
        .filter((F.col("toxic") >= p.least_support) & (odds > 1) & (_ratio("toxic", "clean", n_toxic, n_clean) >= p.least_ratio))
        .select("term", odds.alias("weight")).collect()
    )
    weights = {r.term: round(r.weight, 6) for r in sorted(top)}
    exceptions = sorted(
        r.term for r in _term_counts(sample, set(weights))
        .filter(F.col("clean") >= p.least_support).filter(odds <= 0).select("term").collect()
    )
    matcher = Matcher(weights, exceptions, p)

    def densities(batches):
        for batch in slices(batches):
            x = [matcher.density(t) for t in as_text(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.float64()), batch.column("label").cast(pa.int32())], ["x", "y"])

    # one number and one label of each of the at most max_train documents
    xy = sample.select("text", "label").mapInArrow(densities, "x double, y int").toPandas().sort_values(["x", "y"])
    slope, bias = _logistic(xy["x"].to_numpy(float), xy["y"].to_numpy(float))
    return ToxicityModel(weights, exceptions, round(slope, 6), round(bias, 6), p)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches):
        matcher = Matcher(model.weights, model.exceptions, model.params)
        for batch in slices(batches):
            z = np.array([matcher.density(t) for t in as_text(batch)]) * model.slope + model.bias
            s = np.round(1 / (1 + np.exp(-np.clip(z, -35, 35))), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, params: LexiconParams = LexiconParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) with lexicon and fit from rows that are not held out."""
    return score(docs, fit(docs, labels, params)).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
