"""Quality rules with line labelling by a linear-chain conditional random field.

Every line with a word is described by binary features (length, closing
punctuation, symbols, capitals, digits, repeated words, an equal earlier line) and labelled
content or boilerplate by Viterbi decoding of a two-state linear-chain CRF.  A
document that passes the base rules is kept if content lines hold at least
``content_share`` of its word characters.

The field is trained here by gradient ascent on the regularised conditional
likelihood (exact forward-backward) of at most ``max_train`` documents (a documented
bound, a seeded hash of the id).  With a table of labels, these are labelled documents
(``quality``, rows held out as in the quality classifier): the lines of good ones are content,
those of bad ones boilerplate, whatever their features.  A line that looks the same in
both is decided by its neighbours: the chain learns how much each feature weighs
and how labels follow each other.  Without labels, or without both kinds of them, the labels are
distant ones: a line with two or more warning features, or with symbols beside most words,
is boilerplate.

Base rules: see ``base_counts``.  ``base_failed`` holds for fewer than 50 words,
or if more than half of the words stand in repeated three-word windows.

* null, empty and wordless texts: all counts 0, base_failed, not kept
* an empty table trains nothing and returns no row; repeated rows are judged alike
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import as_bytes, labelled_sample, materialise, one_text_per_id, slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
FEATURES = (
    "bias", "few_words", "some_words", "many_words", "no_end_mark", "symbols", "capitals", "digits",
    "same_words", "earlier_line", "few_letters",
)
WARNINGS = ("symbols", "capitals", "digits", "same_words", "earlier_line", "few_letters")


@dataclass(frozen=True)
class CrfParams:
    max_train: int = 1500
    steps: int = 80
    rate: float = 0.5
    ridge: float = 1e-3
    content_share: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = data.split()
    points = np.frombuffer(data.translate(None, SPACES), np.uint8)
    word_chars = int(np.count_nonzero((points & 0xC0) != 0x80))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a ``width``-word window found twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    window = code[: n - width + 1]
    for k in range(1, width):
        if len(number) ** 3 > 2**62:
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(number) + code[k : n - width + 1 + k]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:n]))


LETTERS = bytes(c for c in range(256) if not (chr(c).isalpha() and c < 128) and c < 128)
CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
MARKS = b"#*$%&|<>!"


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of the lines with a word, and their word characters (bytes)."""
    rows, chars, seen = [], [], set()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), sum(map(len, words))
        marks = size - len(line.translate(None, MARKS)) + len(line) - size
        rows.append((
            1, n < 4, 4 <= n < 12, n >= 12, line.rstrip(SPACES)[-1:] not in b".!?:;\"'", marks * 12 > size or marks * 3 > n * 2,
            len(line.translate(None, CAPITALS)) * 2 > size, len(line.translate(None, DIGITS)) * 5 > size,
            n >= 8 and len(set(words)) * 2 < n, line in seen, len(line.translate(None, LETTERS)) * 5 < size * 3,
        ))
        seen.add(line)
        chars.append(size)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(chars, np.int64)


def distant_labels(x: np.ndarray) -> np.ndarray:
    """1 for boilerplate."""
    warned = x[:, [FEATURES.index(f) for f in WARNINGS]].sum(axis=1)
    bare = x[:, FEATURES.index("few_words")] * x[:, FEATURES.index("no_end_mark")]
    return ((warned >= 2) | (x[:, FEATURES.index("symbols")] > 0) | (warned + bare >= 2)).astype(int)


class Chain:
    """Emission weights (features x 2) and transition weights (2 x 2)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @staticmethod
    def _by_position(sizes: np.ndarray):
        """For sequences sorted by falling length: per position, the rows of the
        sequences that reach it."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for t in range(int(sizes[0]) if len(sizes) else 0):
            yield t, starts[: np.searchsorted(-sizes, -t, "left")] + t

    def viterbi(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of the concatenated sequences (lengths falling)."""
        score, back = x @ self.emit, np.zeros((len(x), 2), np.int64)
        rows = [r for _, r in self._by_position(sizes)]
        for here in rows[1:]:
            options = score[here - 1][:, :, None] + self.move
            back[here] = options.argmax(axis=1)
            score[here] += options.max(axis=1)
        label = np.zeros(len(x), np.int64)
        for t in range(len(rows) - 1, -1, -1):
            here, longer = rows[t], len(rows[t + 1]) if t + 1 < len(rows) else 0
            label[here[longer:]] = score[here[longer:]].argmax(axis=1)
            if longer:
                after = here[:longer] + 1
                label[here[:longer]] = back[after, label[after]]
        return label

    def gradient(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log likelihood, by forward-backward."""
        emit = np.exp(x @ self.emit - (x @ self.emit).max(axis=1, keepdims=True))
        move = np.exp(self.move)
        alpha, beta = emit.copy(), np.ones_like(emit)
        rows = [r for _, r in self._by_position(sizes)]
        for t, here in enumerate(rows):
            if t:
                alpha[here] *= alpha[here - 1] @ move
            alpha[here] /= alpha[here].sum(axis=1, keepdims=True)
        for here in reversed(rows[1:]):
            b = (emit[here] * beta[here]) @ move.T
            beta[here - 1] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        onehot = np.eye(2)[y]
        g_emit, g_move = x.T @ (onehot - p), np.zeros((2, 2))
        for here in rows[1:]:
            pair = alpha[here - 1][:, :, None] * move * (emit[here] * beta[here])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            g_move += onehot[here - 1].T @ onehot[here] - pair.sum(axis=0)
        return g_emit / len(x), g_move / len(x)


def train_chain(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, p: CrfParams) -> Chain:
    """Adagrad on the concatenated sequences (lengths falling)."""
    chain = Chain(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    if not len(x):
        return chain
    square = [np.full_like(chain.emit, 1e-8), np.full_like(chain.move, 1e-8)]
    for _ in range(p.steps):
        for w, g, s in zip((chain.emit, chain.move), chain.gradient(x, y, sizes), square, strict=True):
            g = g - p.ridge * w
            s += g * g
            w += p.rate * g / np.sqrt(s)
    return chain


def _stack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, sizes, document numbers) with the longest sequence first."""
    parts = [line_features(t) for t in texts]
    sizes = np.array([len(c) for _, c in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    x = np.concatenate([parts[k][0] for k in order]) if len(parts) else np.zeros((0, len(FEATURES)))
    chars = np.concatenate([parts[k][1] for k in order]) if len(parts) else np.zeros(0, np.int64)
    return x, chars, sizes[order], order


def labelled_lines(docs: DataFrame, labels: DataFrame, p: CrfParams) -> DataFrame:
    """(ord, text, label) of training documents; label 1: its lines are boilerplate."""
    rows = materialise(labelled_sample(docs, labels, "quality", 3, 1, p.max_train))
    return rows.select("ord", "text", (F.col("label") != 1).cast("int").alias("label"))


def distant_lines(docs: DataFrame, p: CrfParams) -> DataFrame:
    """(ord, text, label) of training documents; label null: lines are judged by ``distant_labels``."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    ids = ids.withColumn("ord", F.xxhash64(F.lit("crf"), "doc_id")).orderBy("ord", "doc_id").limit(p.max_train)
    # max_train ids: small enough to broadcast
    sample = one_text_per_id(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "ord", "doc_id")
    return sample.select("ord", "text", F.lit(None).cast("int").alias("label"))


def fit(docs: DataFrame, p: CrfParams = CrfParams(), labels: DataFrame | None = None) -> Chain:
    sample = None if labels is None else labelled_lines(docs, labels, p)
    if sample is None or sample.select("label").distinct().count() < 2:
        sample = distant_lines(docs, p)

    def run(batches):
        texts, marks = [], []
        for b in slices(batches):
            texts += as_bytes(b)
            marks += b.column("label").to_pylist()
        x, _, sizes, order = _stack(texts)
        distant = not marks or marks[0] is None
        y = distant_labels(x) if distant else np.repeat(np.array(marks, np.int64)[order], sizes)
        chain = train_chain(x, y, sizes, p)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chain.emit.ravel().tolist()]), pa.array([chain.move.ravel().tolist()])], ["emit", "move"])

    ordered = sample.repartition(1).sortWithinPartitions("ord", "text")
    got = ordered.mapInArrow(run, "emit array<double>, move array<double>").collect()  # one row of weights
    if not got:
        return Chain(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    return Chain(np.array(got[-1].emit).reshape(-1, 2), np.array(got[-1].move).reshape(2, 2))


def content_shares(texts: list[bytes], chain: Chain) -> np.ndarray:
    """Share of each text's word characters in lines labelled content (0 without lines)."""
    x, chars, sizes, order = _stack(texts)
    content = np.where(chain.viterbi(x, sizes) == 0, chars, 0)
    out = np.zeros(len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    total, good = np.concatenate([[0], np.cumsum(chars)]), np.concatenate([[0], np.cumsum(content)])
    out[order] = (good[at[1:]] - good[at[:-1]]) / np.maximum(total[at[1:]] - total[at[:-1]], 1)
    return out


def judge(docs: DataFrame, params: CrfParams = CrfParams(), labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""
    p, chain = params, fit(docs, params, labels)

    def run(batches):
        for batch in slices(batches):
            texts = as_bytes(batch)
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            share = content_shares(texts, chain)
            failed = (counts[:, 0] < p.min_words) | (100 * counts[:, 4] > p.repeat_percent * counts[:, 0])
            kept = ~failed & (share >= p.content_share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(kept),
                 pa.array(np.round(share, 9))], NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
         "content_share"]
RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, content_share double")
