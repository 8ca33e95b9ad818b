"""Operators 1, 4 and 6 against brute force."""

import hashlib
import random

import pytest

from flowlens.llm import line_windows, minmax_dedup, run_index
from flowlens.llm.components import connected_components

from .conftest import EDGE


def _texts(seed, n, size, alphabet="abcdefgh \n"):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(size))) for _ in range(n)]
    passage = "".join(rnd.choice(alphabet) for _ in range(230))
    out = []
    for t in base:
        at = rnd.randrange(len(t) + 1)
        out.append(rnd.choice([t, t[:at] + passage + t[at:], rnd.choice(base), t + "z" + t[:at]]))
    return list(enumerate(out))


def _remaining(rows, length):
    data = [(t or "").encode() for _, t in rows]
    places = {}
    for k, t in enumerate(data):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i:i + length], []).append((k, i))
    covered = [bytearray(len(t)) for t in data]
    for hits in places.values():
        for k, i in hits if len(hits) > 1 else ():
            covered[k][i:i + length] = b"\1" * length
    out = []
    for (d, _), t, c in zip(rows, data, covered):
        runs = sum(1 for i, x in enumerate(c) if x and not (i and c[i - 1]))
        kept = bytes(b for b, x in zip(t, c) if not x)
        out.append((d, len(t), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("classes", [2, 2048])
def test_run_index_brute_force(docs_of, classes):
    rows = _texts(1, 60, 900) + EDGE + [(90, "ab" * 300), (91, "\0é" * 200), (92, "q" * 199), (93, "q" * 199)]
    p = run_index.RunIndexParams(group_classes=classes, piece=1 << 12, index_bytes=1 << 12)
    out = run_index.remove_repeats(docs_of(rows), p).drop("kept").collect()
    assert sorted(map(tuple, out), key=repr) == _remaining(rows, 200)


def test_run_index_empty(docs_of):
    assert run_index.remove_repeats(docs_of([])).collect() == []


def test_matching_statistics():
    rnd = random.Random(4)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(1, 6))]
        got, at = run_index.RunLengthIndex(texts).matching_statistics(), 0
        count = {}
        for t in texts:
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    count[t[i:j]] = count.get(t[i:j], 0) + 1
        for t in texts:
            for i in range(len(t)):
                assert got[at + i] == max([j - i for j in range(i + 1, len(t) + 1) if count[t[i:j]] > 1], default=0)
            at += len(t) + 1


def _line_dedup(rows):
    """Brute force over distinct (doc_id, text) rows in the documented order."""
    def key(d, t):
        return hashlib.md5(("n" if d is None else f"i{d}").encode() + b"\1" + ("n" if t is None else "t" + t).encode()).digest()

    docs = sorted({(d is None, d or 0, key(d, t), d, t) for d, t in rows}, key=lambda x: x[:3])
    seen, kept = set(), {}
    for *_, d, t in docs:
        lines = [] if t is None else [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        covered = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if w in seen:
                covered |= {i, i + 1, i + 2}
            seen.add(w)
        out, n = [], 0
        for x in [] if t is None else t.split("\n"):
            if x.strip(" \t\r\x0b\x0c"):
                n += 1
                if n - 1 in covered:
                    continue
            out.append(x)
        kept[d, t] = (None if t is None else "\n".join(out), len(lines), len(covered))
    return sorted(((d, *kept[d, t]) for d, t in rows), key=repr)


def test_line_windows_brute_force(docs_of):
    rnd = random.Random(2)
    rows = [(k % 35, "\n".join(rnd.choice(["a", "b", "c", "", "  ", "d d"]) for _ in range(rnd.randrange(14)))) for k in range(60)]
    rows += EDGE + rows[:4] + [(99, "x\n" * 3000)]
    out = line_windows.drop_repeated_windows(docs_of(rows))
    got = [(r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(got, key=repr) == _line_dedup(rows)
    assert line_windows.drop_repeated_windows(docs_of([])).count() == 0


def _near(rows, k=4):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("nodes", [3, 1024])
def test_minmax_brute_force(docs_of, nodes):
    rnd = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(12, 90))]
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(own).upper() if rnd.random() < 0.3 else "\n".join(own)))
    rows += EDGE
    p = minmax_dedup.MinMaxParams(bands=40, rows=3, block_nodes=nodes)
    got = [tuple(r) for r in minmax_dedup.near_duplicates(docs_of(rows), p).collect()]
    assert sorted(got, key=repr) == _near(rows)
    assert minmax_dedup.near_duplicates(docs_of([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50)], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50}
