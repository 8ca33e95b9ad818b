"""Operators 8 and 9: the lexicon by a naive matcher, line labels decided by neighbours."""

import math
import random
import time

import numpy as np
import pytest

from flowlens.llm import crf_rules, lexicon_toxicity
from flowlens.llm.lexicon_toxicity import LexiconParams, Matcher

from .conftest import EDGE

P = LexiconParams()


def _naive_density(text, weights, exceptions):
    """Whole words one by one; a word in a neighbouring pair that is an exception does not count."""
    words = lexicon_toxicity.WORD.findall(lexicon_toxicity.fold(text or ""))
    total = 0.0
    for k, word in enumerate(words):
        pairs = {" ".join(words[k - 1 : k + 1]) if k else "", " ".join(words[k : k + 2])}
        if word in weights and not pairs & set(exceptions):
            total += weights[word]
    return total / len(words) ** P.length_power if words else 0.0


def test_matcher_equals_naive_words():
    rnd = random.Random(1)
    words = ["a", "ab", "abc", "b", "bc", "c", "ca", "é"]
    for _ in range(200):
        weights = {w: float(rnd.randrange(1, 9)) for w in rnd.sample(words, rnd.randrange(1, 5))}
        pairs = [f"{a} {b}" for a in words for b in words if a in weights or b in weights]
        exceptions = rnd.sample(pairs, rnd.randrange(len(pairs)))
        matcher = Matcher(weights, exceptions, P)
        text = " ".join(rnd.choice([*words, "A8", "4b", "С", ",", "1"]) for _ in range(rnd.randrange(30)))
        assert matcher.density(text) == pytest.approx(_naive_density(text, weights, exceptions)), (text, weights, exceptions)


def test_exceptions_take_linear_time():
    matcher = Matcher({"vile": 1.0, "foul": 2.0}, ["vile weather"], P)
    took = []
    for n in (50_000, 200_000):
        began = time.monotonic()
        got = matcher.density("vile weather " * n + "foul")
        took.append(time.monotonic() - began)
        assert got == pytest.approx(2 / math.sqrt(2 * n + 1))
    assert took[1] < 12 * max(took[0], 0.2)


def _spelled(k):
    return "".join(chr(ord("a") + int(d)) for d in f"{k:05d}")


def test_no_term_of_the_lexicon_is_cut(docs_of, labels_of):
    toxic = " ".join(f"zz{_spelled(k)}" for k in range(5200))
    rows = [(i, toxic if i % 2 else "the river walks along the stone") for i in range(60)]
    labels = labels_of([(i, 1, i % 2) for i, _ in rows])
    model = lexicon_toxicity.fit(docs_of(rows), labels)
    assert len(model.weights) == 5200 and model.exceptions == []


def test_score_equals_the_formula_on_every_row(docs_of, labels_of):
    rnd = random.Random(2)
    words = ["river", "stone", "walk", "light", "vile", "foul", "weather"]
    rows = [(i, " ".join(rnd.choice(words[:4]) for _ in range(12))
             + (rnd.choice([" vile thing", " foul V1LЕ"]) if i % 3 == 0 else rnd.choice([" vile weather", " foul weather"] + [""] * 8)))
            for i in range(300)]
    long = " ".join(rnd.choice(words) for _ in range(200_000))
    docs = docs_of(rows + EDGE + [(900, long)])
    model = lexicon_toxicity.fit(docs, labels_of([(i, 1, int(i % 3 == 0)) for i, _ in rows]))
    assert {"vile", "foul"} <= set(model.weights) and "vile weather" in model.exceptions
    got = sorted(lexicon_toxicity.score(docs, model).collect(), key=repr)
    want = sorted(((i, 1 / (1 + math.exp(-(_naive_density(t, model.weights, model.exceptions) * model.slope + model.bias))))
                   for i, t in rows + EDGE + [(900, long)]), key=repr)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert all(abs(r.score - s) < 1e-8 for r, (_, s) in zip(got, want, strict=True))


@pytest.mark.parametrize("toxic", [0, 1])
def test_toxicity_of_a_single_class(docs_of, labels_of, toxic):
    rows = [(i, "vile thing") for i in range(20)]
    got = lexicon_toxicity.classify(docs_of(rows + EDGE), labels_of([(i, 1, toxic) for i in range(20)])).collect()
    assert len(got) == len(rows + EDGE) and {r.score for r in got} == {0.5}
    assert lexicon_toxicity.classify(docs_of([]), labels_of([])).collect() == []


LIST = "Menu Login page"  # the same features in good and bad documents
PROSE = "The old river walks along the quiet green stone houses of the town."
JUNK = "WIN!! CASH!! NOW!! $$$ *** CLICK!! HERE!! TODAY!! FREE!! GIFT!! CARDS!! $$$"


def _training(docs_of, labels_of):
    good = "\n".join([PROSE, LIST, PROSE.replace("old", "new"), PROSE.replace("river", "road")])
    bad = "\n".join([JUNK, LIST, JUNK + " A", JUNK + " B"])
    rows = [(i, (good if i % 2 else bad) + f"\nThe number of this page is {i}.") for i in range(200)]
    return docs_of(rows + EDGE), labels_of([(i, i % 2, 0) for i, _ in rows])


def test_neighbours_change_the_label_of_a_line(docs_of, labels_of):
    docs, labels = _training(docs_of, labels_of)
    chain = crf_rules.fit(docs, labels=labels)

    def decoded(*lines):
        x, _ = crf_rules.line_features("\n".join(lines).encode())
        return chain.viterbi(x, np.array([len(x)])).tolist()

    assert decoded(PROSE, LIST, PROSE + "x") == [0, 0, 0]
    assert decoded(JUNK, LIST, JUNK + "x") == [1, 1, 1]
    x, _ = crf_rules.line_features(f"{JUNK}\n{LIST}\n{JUNK}x".encode())
    assert crf_rules.distant_labels(x).tolist() == [1, 0, 1]  # the line's own features say content
    assert chain.move[0, 0] > chain.move[0, 1] and chain.move[1, 1] > chain.move[1, 0]


def test_rules_with_labels(docs_of, labels_of):
    docs, labels = _training(docs_of, labels_of)
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("ri", "sto", "wal", "ho") for b in ("ver", "ne", "king", "use", "my")]
    words = [a + b for a in words for b in words]  # few repeated three-word windows
    clean = "\n".join(" ".join(rnd.choice(words) for _ in range(14)) + "." for _ in range(3000))
    junk = "\n".join(" ".join(rnd.choice(words).upper() + "!!" for _ in range(14)) + " $$$ ***" for _ in range(20))
    out = {r.doc_id: r for r in crf_rules.judge(docs_of([(500, clean), (501, junk), *EDGE]), labels=labels).collect()}
    # the labelled rows are not among these documents: distant labels
    assert out[500].kept and not out[501].kept and not out[501].base_failed
    both = docs.unionByName(docs_of([(500, clean), (501, junk)]))
    out = {r.doc_id: r for r in crf_rules.judge(both, labels=labels).collect()}
    assert out[500].kept and out[500].n_words == 42_000 and not out[501].kept and not out[501].base_failed
    one_class = crf_rules.fit(docs, labels=labels_of([(i, 1, 0) for i in range(200)]))
    plain = crf_rules.fit(docs)
    assert np.array_equal(one_class.emit, plain.emit) and np.array_equal(one_class.move, plain.move)
    assert crf_rules.judge(docs_of([]), labels=labels_of([])).collect() == []
