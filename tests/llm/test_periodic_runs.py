import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import periodic_runs as m
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, p=m.RunParams()):
    """Brute force: maximal stretches for every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // p.min_exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(p.min_length, p.min_exponent * q):
                best.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, digest, kept)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([5, 1 << 22]))
def test_runs_agree_with_all_periods(words, chunk):
    got = m.find_runs(np.array(words, np.int64), m.RunParams(chunk=chunk))
    assert sorted((s, e - s, q) for s, e, q in got.tolist()) == runs_of(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=200), st.booleans())
def test_nearest_below_by_lifting(values, equal):
    """Many hops are lifted over; brute force scans."""
    v, quick = np.array([0, *values, 0]), m._QUICK
    at = np.arange(1, len(v) - 1)
    try:
        m._QUICK = 1
        for step in (-1, 1):
            got = m.nearest_below(v, at, step, equal)
            for k, g in zip(at, got):
                x = k + step
                while not (v[x] <= v[k] if equal else v[x] < v[k]):
                    x += step
                assert g == x
    finally:
        m._QUICK = quick


def test_runs_of_long_texts_in_a_moment():
    same = m.find_runs(np.zeros(300_000, np.int64), m.RunParams())
    assert same.tolist() == [[0, 300_000, 1]]
    assert m.find_runs(np.arange(200_000) % 50_000, m.RunParams()).tolist() == [[0, 200_000, 50_000]]


def test_query_rows(spark, docs_of):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "é"], rng.integers(0, 60))) for _ in range(150)]
    rows = EDGE + list(enumerate(texts, start=100)) + [(100, texts[0])]
    rows += [(900, "x\ty\n" * 40), (901, "a  b b " * 9), (902, "ab" * 40_000), (903, "z " * 5000)]
    out = m.digests(m.periodic_runs(m.with_periods(docs_of(rows)), m.RunParams(piece_words=50)))
    got = [tuple(r)[:8] for r in out.collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t)


def test_operator_gives_runs_and_texts(docs_of):
    row = m.periodic_runs(docs_of([(1, "s a b a b\na b a b e")])).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (10, [(1, 8, 2)], "s a b e")


def test_text_ids_and_empty_table(spark, docs_of):
    texts = spark.createDataFrame([("x1", "a a a a a a")], "doc_id string, text string")
    assert m.periodic_runs(m.with_periods(texts)).first().doc_id == "x1"
    assert m.digests(m.periodic_runs(m.with_periods(docs_of([])))).count() == 0
