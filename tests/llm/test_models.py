"""Operators 2, 5, 8 and 9: held-out accuracy, formulas by brute force, edge cases."""

import itertools
import random

import numpy as np
import pytest

from flowlens.llm import crf_rules, lexicon_toxicity, ppm_langid, quality_ftrl
from flowlens.llm.common import labelled_sample

from .conftest import EDGE

GOOD = ["river", "stone", "walk", "light", "green", "house", "long", "story"]


def _prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


def test_quality_separates_held_out(docs_of, labels_of):
    rnd = random.Random(1)
    rows = [(i, _prose(rnd, GOOD, 30) if i % 2 else _prose(rnd, [w.upper() + "!!" for w in GOOD], 30)) for i in range(100, 400)]
    labels = labels_of([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0), (3, None, None)])
    out = quality_ftrl.classify(docs_of(rows + EDGE), labels).collect()
    assert len(out) == len(rows) + len(EDGE) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and (r.doc_id or 0) >= 100]
    assert len(held) > 50 and all(r.predicted == r.doc_id % 2 for r in held)
    no_labels = quality_ftrl.classify(docs_of(EDGE), labels_of([])).collect()
    assert {r.score for r in no_labels} == {0.5}


def test_ftrl_learns_a_sign():
    m = quality_ftrl.Ftrl(quality_ftrl.FtrlParams(bits=4))
    for _ in range(50):
        m.update(np.array([1, 16]), np.array([1.0, 1.0]), 1)
        m.update(np.array([2, 16]), np.array([1.0, 1.0]), 0)
    w = m.weights(np.array([1, 2, 3]))
    assert w[0] > 0 > w[1] and w[2] == 0


def _ppm_model(texts, p):
    """texts: language -> training texts."""
    langs, lang, gram, count = sorted(texts), [], [], []
    for k, name in enumerate(langs):
        found = {}
        for text in texts[name]:
            for g in ppm_langid.gram_codes(text, p.order).tolist():
                found[g] = found.get(g, 0) + 1
        lang += [k] * len(found)
        gram += list(found)
        count += list(found.values())
    return ppm_langid.PpmModel(langs, np.array(lang), np.array(gram), np.array(count), p)


def _ppm_bits(train, text, p):
    """Code length by the rule, byte by byte, from the training texts themselves."""
    pad = [ppm_langid.PAD] * p.order
    chains, chain, bits = [[*pad, *t] for t in train], [*pad, *text], 0.0
    for i in range(p.order, len(chain)):
        prob = 1 / 256
        for depth in range(p.order + 1):
            follow = [c[j] for c in chains for j in range(p.order, len(c)) if c[j - depth : j] == chain[i - depth : i]]
            if len(follow) >= (p.min_context if depth > p.full_order else 1):
                n, distinct = follow.count(chain[i]), len(set(follow))
                prob = n / (len(follow) + distinct) if n else distinct / (len(follow) + distinct) * prob
        bits -= np.log2(prob)
    return bits


def test_ppm_code_lengths_by_hand():
    rnd = random.Random(4)
    train = {"x": [b"abab", b"ba"], "y": [b"bcbcbcab", b"cab"], "z": [bytes(rnd.choice(b"abcd") for _ in range(60))]}
    texts = [b"ab", b"abba", b"aqb", b"zz", bytes(rnd.choice(b"abcde") for _ in range(50)), b""]
    for p in (ppm_langid.PpmParams(), ppm_langid.PpmParams(order=2), ppm_langid.PpmParams(order=5, full_order=1, min_context=3)):
        got = _ppm_model(train, p).code_lengths(texts)
        for i, text in enumerate(texts):
            for k, name in enumerate(sorted(train)):
                assert abs(got[i, k] - _ppm_bits(train[name], text, p)) < 1e-3, (text, name, p)


def test_ppm_long_texts_in_pieces():
    model = _ppm_model({"x": [b"abab" * 9], "y": [b"bcb" * 9]}, ppm_langid.PpmParams())
    text = b"abcb" * 100_000
    whole = model._bits(ppm_langid.gram_codes(text, 4)[:0])
    assert whole.shape == (0, 2)
    grams, times = np.unique(ppm_langid.gram_codes(text, 4), return_counts=True)
    want = (model._bits(grams).astype(float) * times[:, None]).sum(axis=0)
    assert np.allclose(model.code_lengths([b"", text, b"a"])[1], want)


def test_ppm_size_is_checked():
    small = ppm_langid.PpmParams(max_bytes=1000)
    with pytest.raises(ValueError, match="max_bytes"):
        _ppm_model({"x": [bytes(range(256))]}, small)


def test_ppm_training_rows_are_bounded(spark, docs_of):
    p = ppm_langid.PpmParams(max_docs=100)
    rows = [(i, f"text {i}", "fr" if i % 3 else "de", "s") for i in range(6000)]
    rows += [(5, f"copy {i}", "fr", "s") for i in range(3000)]  # one hot id
    docs = docs_of(rows)
    plan = ppm_langid.training_ids(docs, p)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang#" in plan and all("doc_id" in x for x in plan.split("hashpartitioning(")[1:])  # never by language alone
    found = {r["lang"]: r["count"] for r in ppm_langid.training_ids(docs, p).groupBy("lang").count().collect()}
    assert set(found) == {"fr", "de"} and all(100 <= n <= 400 for n in found.values())
    sample = ppm_langid.training_sample(docs, p).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample} == {"fr": 100, "de": 100}


def test_ppm_letters(docs_of):
    rows = [(i, "the hill", "en", "s") for i in range(50)] + [(100, "² ½ ①", "en", "s"), (101, "", "en", "s"), (102, "é", None, "s")]
    out = {r.doc_id: r.lang_pred for r in ppm_langid.identify(docs_of(rows)).collect()}
    assert (out[100], out[101], out[102]) == ("und", "und", "en")
    assert ppm_langid.identify(docs_of(rows).filter("doc_id < 0")).collect() == []


def test_ppm_languages(docs_of):
    rnd = random.Random(2)
    rows = [(i, _prose(rnd, ["the", "and", "hill", "with"], 20), "en", "s") if i % 2 else
            (i, _prose(rnd, ["und", "der", "straße", "über"], 20), "de", "s") for i in range(100, 300)]
    rows += [(7, "und der", None, None), (8, "123 !", "en", "s"), (9, None, "en", "s")]
    out = {r.doc_id: r for r in ppm_langid.identify(docs_of(rows)).collect()}
    assert all(out[i].lang_pred == g for i, _, g, _ in rows if i >= 100)
    assert out[7].lang_pred == "de" and (out[8].lang_pred, out[8].score) == ("und", 0) and out[9].lang_pred == "und"
    assert {r.lang_pred for r in ppm_langid.identify(docs_of([(1, "abc", None, None)])).collect()} == {"und"}


def test_toxicity_folds_and_excepts(docs_of, labels_of):
    rnd = random.Random(3)
    rows = [(i, _prose(rnd, GOOD, 25) + (" vile creature" if i % 4 == 0 else " vile weather" if i % 4 == 1 else ""))
            for i in range(100, 500)]
    hard = [(1000, _prose(rnd, GOOD, 10) + " V1LЕ creature"), (1001, _prose(rnd, GOOD, 10) + " vile weather")]
    labels = labels_of([(i, 1, int(i % 4 == 0)) for i, _ in rows])
    out = {r.doc_id: r for r in lexicon_toxicity.classify(docs_of(rows + hard), labels).collect()}
    assert all(out[i].predicted == int(i % 4 == 0) for i, _ in rows)
    assert out[1000].predicted == 1 and out[1001].predicted == 0
    plain = lexicon_toxicity.classify(docs_of(EDGE), labels_of([])).collect()
    assert len(plain) == len(EDGE) and {r.score for r in plain} == {0.5}


def _chain(seed=0):
    rnd = np.random.default_rng(seed)
    return crf_rules.Chain(rnd.normal(size=(len(crf_rules.FEATURES), 2)), rnd.normal(size=(2, 2)))


def test_viterbi_and_gradient_by_enumeration():
    rnd, chain = np.random.default_rng(1), _chain()
    sizes = np.array([5, 3, 1, 0])
    x = rnd.integers(0, 2, (9, len(crf_rules.FEATURES))).astype(float)
    y = rnd.integers(0, 2, 9)

    def score(part, labels):
        e = part @ chain.emit
        return sum(e[i, k] for i, k in enumerate(labels)) + sum(chain.move[a, b] for a, b in zip(labels, labels[1:]))

    want, at = [], 0
    for n in sizes:
        want += max(itertools.product((0, 1), repeat=int(n)), key=lambda c: score(x[at:at + n], c)) if n else ()
        at += n
    assert chain.viterbi(x, sizes).tolist() == want

    def likelihood():
        total, at = 0.0, 0
        for n in sizes[:3]:
            part = x[at:at + n]
            total += score(part, y[at:at + n]) - np.logaddexp.reduce(
                [score(part, c) for c in itertools.product((0, 1), repeat=int(n))])
            at += n
        return total / 9

    g_emit, g_move = chain.gradient(x, y, sizes)
    for w, g, at in ((chain.emit, g_emit, (3, 1)), (chain.move, g_move, (0, 1)), (chain.move, g_move, (1, 1))):
        w[at] += 1e-5
        up = likelihood()
        w[at] -= 2e-5
        down = likelihood()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_rules_counts_and_verdicts(docs_of):
    rnd = random.Random(5)
    clean = "\n".join(_prose(rnd, [a + b for a in GOOD for b in GOOD], 14) for _ in range(8))
    junk = "\n".join(" | ".join(rnd.choice(GOOD) + str(rnd.random()) for _ in range(12)) for _ in range(8))
    loop = "a b c d\n" * 40
    rows = [(100, clean), (101, junk), (102, loop), *EDGE]
    out = {r.doc_id: r for r in crf_rules.judge(docs_of(rows)).collect() if r.doc_id}
    assert out[100].kept and not out[101].kept and not out[101].base_failed
    assert out[102].base_failed and (out[102].n_words, out[102].n_dup_lines, out[102].n_repeat_words) == (160, 39, 160)
    assert (out[1].n_words, out[1].word_chars, out[1].base_failed, out[1].kept) == (0, 0, True, False)
    assert out[6].word_chars == 5
    assert crf_rules.repeated_words([b"a"] * 4) == 4 and crf_rules.repeated_words([b"a"] * 3) == 0
    assert crf_rules.judge(docs_of([])).count() == 0


def test_a_repeated_id_is_one_training_document(docs_of, labels_of):
    rows = [(i, f"text {i} of many") for i in range(30)] + [(7, f"other {i % 9}") for i in range(60)] + [(8, None), (8, None)]
    labels = labels_of([(i, i % 2, 0) for i in range(30)])
    got = labelled_sample(docs_of(rows), labels, "quality", 3, 1, 20).collect()
    again = labelled_sample(docs_of(rows[::-1]), labels, "quality", 3, 1, 20).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) <= 20 and sorted(got) == sorted(again)
    assert all((r.doc_id, r.text) in rows for r in got)

    line = "The river walks along the green stone house."
    rows = [(i, line + f"\n* menu | {i} | login") for i in range(12)]
    chain = crf_rules.fit(docs_of(rows))
    more = crf_rules.fit(docs_of(rows + [(3, rows[3][1])] * 40))
    assert np.array_equal(chain.emit, more.emit) and np.array_equal(chain.move, more.move)
