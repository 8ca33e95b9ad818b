"""Operator 2: FTRL by a plain dictionary of sums, row by row; a single class; a very long text."""

import math
import random
import re
import zlib

import pytest

from flowlens.llm import quality_ftrl
from flowlens.llm.common import labelled_sample

from .conftest import EDGE

P = quality_ftrl.FtrlParams(bits=12)
MASK = (1 << 64) - 1


def _vector(text, p):
    tokens = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    grams = [t * 0xFF51AFD7ED558CCD for t in tokens]
    grams += [a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F for a, b in zip(tokens, tokens[1:])]
    out = {}
    for g in grams:
        slot = (g & MASK) >> (64 - p.bits)
        out[slot] = out.get(slot, 0) + 1 / math.sqrt(len(grams))
    return out | {"bias": 1.0}


def _weight(slot, z, n, p):
    l1, l2 = (0, 0) if slot == "bias" else (p.l1, p.l2)
    s = z.get(slot, 0.0)
    return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((p.beta + math.sqrt(n.get(slot, 0.0))) / p.alpha + l2)


def _scores(training, texts, p):
    z, n = {}, {}
    for _ in range(p.epochs):
        for text, y in training:
            x = _vector(text, p)
            w = {s: _weight(s, z, n, p) for s in x}
            prob = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items())))
            for s, v in x.items():
                g, old = (prob - y) * v, n.get(s, 0.0)
                n[s] = old + g * g
                z[s] = z.get(s, 0.0) + g - (math.sqrt(n[s]) - math.sqrt(old)) / p.alpha * w[s]
    return [1 / (1 + math.exp(-sum(_weight(s, z, n, p) * v for s, v in _vector(t, p).items()))) for t in texts]


@pytest.mark.parametrize("classes", [(0, 1), (1,), (0,)])
def test_scores_equal_plain_ftrl(docs_of, labels_of, classes):
    rnd = random.Random(1)
    words = ["river", "Stone", "walk,", "light", "house!!", "é", "1,5"]
    rows = [(i, " ".join(rnd.choice(words[: 4 + 3 * (i % 2)]) for _ in range(rnd.randrange(1, 15)))) for i in range(10, 130)]
    long = " ".join(rnd.choice(words) for _ in range(100_000))
    docs = docs_of(rows + EDGE + [(900, long)])
    labels = labels_of([(i, i % 2 if len(classes) == 2 else classes[0], 0) for i, _ in rows])
    sample = labelled_sample(docs, labels, "quality", 3, 1, P.max_train).collect()
    training = [(r.text, r.label) for r in sorted(sample, key=lambda r: (r.ord, r.doc_id))]
    assert 60 < len(training) < len(rows)
    got = sorted(quality_ftrl.classify(docs, labels, P).collect(), key=lambda r: (repr(r.doc_id), r.score))
    ids, texts = zip(*rows, *EDGE, (900, long), strict=True)
    want = sorted(zip(map(repr, ids), _scores(training, texts, P), strict=True))
    assert [repr(r.doc_id) for r in got] == [i for i, _ in want]
    assert all(abs(r.score - s) < 1e-4 for r, (_, s) in zip(got, want, strict=True))
    if len(classes) == 1:  # a bias towards the only class, for texts without a word too
        assert all(r.predicted == classes[0] for r in got)


def test_quality_of_an_empty_table(docs_of, labels_of):
    assert quality_ftrl.classify(docs_of([]), labels_of([(1, 1, 0)])).collect() == []
