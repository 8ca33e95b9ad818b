"""Operators 3, 7 and 10, the pipeline and the registered SQL."""

import random
import re
import time

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from flowlens.llm import cgk_decontam, mix_budget, secret_dfa
from flowlens.llm.queries import QUERIES

from .conftest import EDGE

SF = "/root/testdata/sf0.001"


def test_fit_counts_is_nearest_from_below():
    rnd = random.Random(1)
    for _ in range(150):
        sizes = np.array(sorted(rnd.sample(range(1, 40), rnd.randrange(1, 6))))
        counts = np.array([rnd.randrange(1, 5) for _ in sizes])
        budget = rnd.randrange(0, int((sizes * counts).sum()) + 1)
        take = mix_budget.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (sizes * take).sum() <= budget
        sums = {0}  # all subsets: the window covers these budgets, so the fit is the exact one
        for s, c in zip(sizes, counts):
            sums = {x + int(s) * k for x in sums for k in range(int(c) + 1)}
        assert (sizes * take).sum() == max(x for x in sums if x <= budget)


def test_fit_counts_beyond_the_window():
    sizes, counts = np.array([3, 7, 1000, 1001]), np.array([1500, 5, 900, 800])
    take = mix_budget.fit_counts(sizes, counts, 777_777, window=4000)
    assert 0 <= 777_777 - (sizes * take).sum() < 3


def test_mix_targets(docs_of):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randrange(1, 40)), "en", rnd.choice(["a", "b", "c", "é", None])) for i in range(300)]
    rows += [(i, "x " * 9, "en", "big") for i in range(1000, 1400)] + [(i, t, "en", "z") for i, t in EDGE] + rows[:5]
    got = mix_budget.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, _, s in rows:
        total[s] = total.get(s, 0) + words(t)
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * total[s] if s in full else share[s] for s in order}
    by_target = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by_target[round(r.target, 6), r.source_size] = by_target.get((round(r.target, 6), r.source_size), 0) + r.taken
    for s in order:
        assert abs(by_target[round(target[s], 6), total[s]] - target[s]) <= (9 if s == "big" else 1)  # all sizes of big are 9
    again = mix_budget.mix(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mix_budget.mix(docs_of([])).count() == 0


def _distance(item, text):
    best, row = len(item), list(range(len(item) + 1))
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance_by_table():
    rnd = random.Random(3)
    for _ in range(300):
        item = [rnd.randrange(5) for _ in range(rnd.randrange(1, 12))]
        text = [rnd.randrange(5) for _ in range(rnd.randrange(0, 20))]
        assert cgk_decontam.edit_distance_within(item, text)[0] == _distance(item, text)


@pytest.mark.parametrize("block", [7, 1000])
def test_contamination_recall_and_precision(spark, docs_of, block):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(8, 50)))) for k in range(40)]
    rows, leaks = list(EDGE), set()
    for k, text in items:
        words = text.split()
        for _ in range(len(words) // 6):
            words[rnd.randrange(len(words))] = "edited"
        around = [rnd.choice(vocabulary) for _ in range(60)]
        rows.append((100 + k, " ".join(around[:30] + [w.title() + "," for w in words] + around[30:])))
        leaks.add((100 + k, k))
        rows.append((200 + k, " ".join(rnd.choice(vocabulary) for _ in range(80))))
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "too few words")], "item_id long, text string")
    p = cgk_decontam.CgkParams(block=block)
    got = {(r.doc_id, r.item_id): r for r in cgk_decontam.contaminated(docs_of(rows), bench, p).collect()}
    for (d, i), r in got.items():  # every result is confirmed by the plain table
        item = cgk_decontam.tokens(dict(items)[i].encode())
        text = cgk_decontam.tokens(dict(rows)[d].encode())
        assert _distance(item, text) <= r.edits <= len(item) - 0.8 * len(item) + 1e-9
    assert len(leaks & set(got)) >= 0.95 * len(leaks)
    clean = cgk_decontam.drop_contaminated(docs_of(rows), bench, p)
    assert clean.columns == docs_of(rows).columns
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted(
        (d or -1) for d, _ in rows if d not in {x for x, _ in got})
    none = spark.createDataFrame([], "item_id long, text string")
    assert cgk_decontam.contaminated(docs_of(rows), none).count() == 0


@pytest.mark.parametrize("where", ["start", "middle", "end", "spread"])
def test_contamination_of_long_items(spark, docs_of, where):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(2000)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(100 + 20 * k))) for k in range(16)]
    rows = []
    for k, text in items:
        words = text.split()
        m, edits = len(words), len(words) // 5
        first = {"start": 0, "middle": (m - edits) // 2, "end": m - edits}.get(where)
        for j in sorted(rnd.sample(range(m), edits) if first is None else range(first, first + edits), reverse=True):
            words[j:j + 1] = rnd.choice([["edited"], ["edited", words[j]], []])
        around = [rnd.choice(vocabulary) for _ in range(60)]
        rows.append((k, " ".join(around[:30] + words + around[30:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in cgk_decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(k, k) for k, _ in items}


@pytest.mark.parametrize("block", [5, 1000])
def test_short_items_are_found_by_brute_force(spark, docs_of, block):
    rnd = random.Random(12)
    items = [(k, " ".join(rnd.choice("abcde") for _ in range(1 + k % 7))) for k in range(42)] + [(50, "What is it?")]
    rows = [(100 + k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(14)))) for k in range(150)]
    rows += [(1, "Tell: what IS it"), (2, "what is"), (3, "it what"), (None, "what is it"), (4, None)]
    bench = spark.createDataFrame(items + [(51, ""), (52, "?!"), (53, None)], "item_id long, text string")
    p = cgk_decontam.CgkParams(block=block)
    want, clean = set(), []
    for d, t in rows:
        words = cgk_decontam.tokens((t or "").encode())
        found = [(i, _distance(x, words), len(x)) for i, x in ((i, cgk_decontam.tokens(y.encode())) for i, y in items)]
        found = [f for f in found if f[1] <= f[2] * 0.2 + 1e-9]
        want |= {(d, *f) for f in found}
        clean += [] if any(m >= 4 for *_, m in found) else [d]
    out = cgk_decontam.contaminated(docs_of(rows), bench, p).collect()
    assert len(out) == len(want) and {(r.doc_id, r.item_id, r.edits, r.item_words) for r in out} == want
    got = cgk_decontam.drop_contaminated(docs_of(rows), bench, p).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((d or -1) for d in clean)
    assert {1, None} <= {r.doc_id for r in got}  # an item of three words is reported only


ASSIGN = re.compile("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def _base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_equal_the_rules(docs_of):
    rnd = random.Random(5)
    parts = ["password", "Token", "api_key", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF12", "0123456789abcdef",
             "deadbeef", "é", "\n", ",", "ſecret", "ghp_" + "a" * 22, "-----BEGIN RSA PRIVATE KEY-----", "Z9", "."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(800)]
    scanner = secret_dfa.Scanner(stretch=64)
    for t, found in zip(texts, scanner.scan([t.encode() for t in texts])):
        assert [f for f in found if f[1] < 3] == _base(t)
    rows = [(k, t) for k, t in enumerate(texts[:50])] + EDGE
    out = secret_dfa.find_secrets(docs_of(rows)).collect()
    assert len(out) == len(rows)
    empty = [r for r in out if r.doc_id == 6][0]
    assert (empty.n_assign, empty.n_access, empty.n_hex) == (0, 0, 0) or dict(rows)[6]
    github = secret_dfa.find_secrets(docs_of([(1, "é ghp_" + "a" * 22)])).first()
    assert github.spans == "github:2:28" and github.n_hex == 0


def _naive_spans(rule, text):
    """Leftmost, longest, not overlapping, by trying every end of every start with ``re``."""
    whole, head = re.compile(rule.head + rule.body + "+"), re.compile(rule.head)
    out, at = [], 0
    while at < len(text):
        ends = [e for e in range(at + 1, len(text) + 1) if whole.fullmatch(text, at, e)]
        if not ends:
            at += 1
            continue
        end = ends[-1]
        start_of_body = max(e for e in range(at, end) if head.fullmatch(text, at, e))
        if end - start_of_body >= rule.least:
            out.append((at, end))
        at = end
    return out


def test_secrets_more_rules_than_a_byte(docs_of):
    added = tuple(secret_dfa.Rule(f"z{k}", f"zz{k:02d}", "[a-z]", 2) for k in range(70))
    scanner = secret_dfa.Scanner(secret_dfa.RULES + added)
    text = " ".join(f"zz{k:02d}abcd" for k in range(70))
    assert [k for _, k, _ in scanner.scan([text.encode()])[0]] == [len(secret_dfa.RULES) + k for k in range(70)]
    row = secret_dfa.find_secrets(docs_of([(1, "é zz13ab")]), secret_dfa.RULES + added).first()
    assert row.spans == "z13:2:8" and (row.n_assign, row.n_hex) == (0, 0)


def test_secrets_spans_equal_a_naive_search():
    rnd = random.Random(8)
    rules = secret_dfa.RULES + (secret_dfa.Rule("loop", "(ab*c|a)*d", "[ab]", 2), secret_dfa.Rule("far", "a(b|c)*", "d", 2))
    parts = ["eyJ", "eyJabc.", ".", "a", "b", "c", "d", "dd", "ab", "-----BEGIN", " RSA", " PRIVATE KEY", "-----", "token", "=",
             " ", "abcdef123456", "xoxb-", "\n", ","]
    scanner = secret_dfa.Scanner(rules, stretch=16)
    for _ in range(250):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        want = sorted((a, k, b) for k, r in enumerate(rules) for a, b in _naive_spans(r, text))
        assert scanner.scan([text.encode()])[0] == want, text


def test_secrets_time_is_linear_on_failing_starts():
    scanner = secret_dfa.Scanner()
    jwt = b"eyJabcdefgh.eyJabcdefgh.abcdefghijkl"
    took = []
    for n in (100_000, 400_000):
        text = jwt + b" " + b"eyJ" * n + b" token" + b" " * n + b"AKIA" * n
        began = time.monotonic()
        found = scanner.scan([text])[0]
        took.append(time.monotonic() - began)
        assert (0, 5, len(jwt)) in found and any(k == 1 for _, k, _ in found)
    assert took[1] < 60 and took[1] < 12 * max(took[0], 0.5)


def test_secrets_empty_table(docs_of):
    assert secret_dfa.find_secrets(docs_of([(1, "x")]).filter("doc_id = 2")).collect() == []


def test_automaton_is_minimal():
    d = secret_dfa.Dfa(["ab|cb", "x+"], floating=False)
    assert len(d.table) == 5  # start, after a or c, ab, x+, dead


def test_pipeline_on_a_small_table(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert 0 < out.count() < docs.count()
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns, name
        assert [t for _, t in stage.dtypes] == [t for _, t in docs.dtypes], name


@pytest.mark.parametrize("name", sorted(k for k, v in QUERIES.items() if v[1]))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(QUERIES[name][1])
    columns = [c[0] for c in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name][0](spark, SF).collect()), key=repr)
    assert got == want


def test_registered():
    names = set(E.queries())
    assert {"pipeline"} | set(QUERIES) <= names and len(QUERIES) == 13
