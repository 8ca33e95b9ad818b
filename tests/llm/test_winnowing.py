import hashlib

import regex
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import winnowing as m
from tests.llm.conftest import EDGE

TOKEN = regex.compile(r"(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])[\p{L}\p{M}\p{N}])+|[^\s\x1c-\x1f\x85\p{Z}]|[\x1c-\x1f\x85\p{Z}--[ ]]", regex.V1)
PLACE = (1 << 31) - 1


def chained(tokens):
    h = 42
    for t in tokens:
        h = xxhash.xxh64(t.encode(), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(text, p=m.WinnowParams()):
    """Every window by itself."""
    words = TOKEN.findall((text or "").lower())
    grams = [chained(words[i : i + p.gram]) for i in range(len(words) - p.gram + 1)]
    if words and not grams:
        grams = [chained(words)]
    kept = set()
    for at in range(max(1, len(grams) - p.window + 1) if grams else 0):
        part = range(at, min(at + p.window, len(grams)))
        kept.add(min(part, key=lambda i: (grams[i] >> 31, -i)))
    return [(grams[i], i) for i in sorted(kept)]


def shown(prints):
    return ",".join(f"{h % (1 << 64):X}@{i}" for h, i in prints)


def alike(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows):
    def place(r):
        tie = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        return (r[0] is not None, r[0] or 0, tie - (1 << 64) if tie >> 63 else tie)

    order = sorted(rows, key=place, reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other = brute(text), brute(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other),
                    round(alike(own, other), 12), round(alike(own, brute(following)), 12)))
    return sorted(out, key=str)


def compared(df):
    return sorted(((r[0], *r[1:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, m.compared(df).collect())), key=str)


def test_query_rows(docs_of):
    text = "The quick brown fox, jumps over the lazy dog. 漢字かな交じり文 é é "
    rows = EDGE + [(k, text[k % 20 :] * (k % 5)) for k in range(10, 60)] + [(12, "same id"), (61, "long " * 30_000)]
    assert compared(docs_of(rows)) == expected(rows)


def test_one_row_is_its_own_next(docs_of):
    assert compared(docs_of([(7, "one two three four five six")])) == expected([(7, "one two three four five six")])


def test_order_over_few_and_many_ranges(docs_of):
    """A repeated id and equal rows fall over the ranges' bounds; the order stays whole."""
    rows = [(k % 7 or None, f"text {k % 11}") for k in range(120)] + [(3, "hot")] * 60
    for parts in (1, 2, 40):
        got = m.beside_next(docs_of(rows), parts=parts).select("doc_id", "text", "next_text").collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _tie(r[1])), reverse=True)
        want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _tie(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_a_shared_passage_is_always_found(spark):
    """gram + window - 1 common tokens leave a common hash, wherever they stand."""
    p = m.WinnowParams(gram=5, window=6)
    passage = " ".join(f"w{k}" for k in range(p.gram + p.window - 1))
    rows = [(f"{' '.join(f'a{k}x{j}' for j in range(k))} {passage}", f"{passage} {' '.join(f'b{k}x{j}' for j in range(9 - k))}")
            for k in range(10)]
    df = spark.createDataFrame(rows, "a string, b string")
    shared = F.arrays_overlap(m.hashes_of(m.winnow(F.col("a"), p)), m.hashes_of(m.winnow(F.col("b"), p)))
    assert all(r[0] for r in df.select(shared).collect())


def test_ties_take_the_rightmost(spark):
    df = spark.createDataFrame([("a " * 12,)], "t string")
    prints = df.select(m.winnow(F.col("t"))).first()[0]
    assert [x.place for x in prints] == [3, 4, 5, 6, 7, 8]


def test_no_python_on_the_main_path(docs_of):
    plan = m.compared(docs_of([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_and_text_ids(spark, docs_of):
    assert m.compared(docs_of([])).count() == 0
    ids = spark.createDataFrame([("b", "one two"), ("a", "three four")], "doc_id string, text string")
    assert {r.doc_id: r.next_text for r in m.beside_next(ids).collect()} == {"b": "three four", "a": "one two"}
