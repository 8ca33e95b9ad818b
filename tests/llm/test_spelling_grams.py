import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import spelling_grams as m
from tests.llm.conftest import EDGE

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans(m.UPPER, m.LOWER)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def expected(rows):
    counts = Counter()
    for i, text in rows:
        for w in RUN.findall((text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def corpus(seed=3):
    import random

    rng = random.Random(seed)
    stems = ["".join(rng.choice(["an", "er", "ré", "st", "o", "th"]) for _ in range(rng.randint(2, 5))) for _ in range(60)]

    def typo(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aezÉ") + w[k:], w[:k] + rng.choice("aezÉ") + w[k + 1 :]])

    return [(k, " ".join(typo(w) if rng.random() < 0.3 else w.upper() if rng.random() < 0.1 else w
                         for w in rng.choices(stems, k=80))) for k in range(150)]


@pytest.mark.parametrize("p", [m.GramParams(), m.GramParams(list_size=2, max_gram=4), m.GramParams(list_size=2),
                               m.GramParams(list_size=1, max_entries=20), m.GramParams(min_gram=3, max_gram=4, list_size=1)])
def test_query_rows(docs_of, p):
    rows = EDGE + corpus() + [(None, "erstan ERSTAN× erstan aerstan"), (999, "erstan-" * 3000)]
    got = {tuple(r) for r in m.spelling_groups(docs_of(rows), p).collect()}
    want = expected(rows)
    assert got == want
    assert any(f for _, f, *_ in want) and any(r != f and f for _, f, r, *_ in want)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=5, max_size=9), st.integers(0, 8), st.sampled_from("abé"), st.integers(0, 2),
       st.sets(st.text("^abé$", min_size=2, max_size=4), max_size=40))
def test_near_words_share_a_merged_list(word, at, letter, kind, known):
    """Whatever the dictionary holds: the lists merged for two near words meet, and no edit changes more grams than the bound."""
    p, at = m.GramParams(), at % len(word)
    other = (word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :])[kind]
    if len(other) < 5 or other == word:
        return
    known = {g: 10 + k for k, g in enumerate(sorted(known))}

    def keys(w, grams):
        return {(g, 0, k) for k, g in grams} | {(g, 1, len(w) - k) for k, g in grams}

    assert ((m.letters(word) ^ m.letters(other)) & (2**64 - 1)).bit_count() <= 2
    a, b = m.decompose(word, known, p), m.decompose(other, known, p)
    assert keys(word, m.merged_lists(a, len(word), known)) & keys(other, m.merged_lists(b, len(other), known))
    there = keys(other, b)
    changed = sum((g, 0, k) not in there and (g, 1, len(word) - k) not in there for k, g in a)
    assert changed <= m.affected(a, len(word)) < len(a)


def test_dictionary_is_bounded(spark):
    vocab = spark.createDataFrame([(a + b + c + "xyz", 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    known = m.gram_dictionary(vocab, m.GramParams(list_size=1, max_entries=30))
    assert known and max(Counter(map(len, known)).values()) < 30


def test_dictionary_counts(spark):
    words = [w for _, text in corpus() for w in text.lower().split() if len(w) >= 5]
    words = sorted(set(words))
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    counts = Counter(f"^{w}$"[k : k + q] for w in words for q in (2, 3, 4, 5) for k in range(len(w) + 3 - q))
    assert m.gram_dictionary(vocab, m.GramParams(list_size=4)) == {g: n for g, n in counts.items() if n > 4}


def test_nothing_near_and_empty(docs_of):
    got = [tuple(r) for r in m.spelling_groups(docs_of([(1, "abcdef " * 5 + "zzzzz " * 3)])).collect()]
    assert sorted(got) == [("abcdef", None, "abcdef", 5, 0, None), ("zzzzz", None, "zzzzz", 3, 0, None)]
    assert m.spelling_groups(docs_of([])).count() == 0
    assert m.spelling_groups(docs_of([(1, None), (2, "")])).count() == 0


def test_chains_of_forms(spark, docs_of):
    text = " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48)
    out = m.spelling_groups(docs_of([(1, text)]), change=lambda word, doc_id: word)
    assert {r.word: r.root for r in out.collect()} == dict.fromkeys(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb"], "abbbb")


def test_an_unsafe_gram_length_is_refused():
    with pytest.raises(ValueError):
        m.GramParams(max_gram=6)
