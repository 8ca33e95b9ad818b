"""Rows of the pipeline's near-dedup stage against brute force."""

import random

import corpus_pipeline

from .test_repeats import _near


def _edited(words, *at):
    return " ".join(f"edit{k}" if k in at else w for k, w in enumerate(words))


def test_near_dedup_compares_five_words(spark, docs_of):
    words = [f"w{k}" for k in range(90)]
    # 76 of 96 five-word shingles (79 of 95 four-word ones) in common: below 0.8
    rows = [(1, " ".join(words)), (2, _edited(words, 20, 60)), (3, _edited(words, 1))]
    rnd = random.Random(6)
    for _ in range(5):
        base = [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40, 140))]
        rows += [(len(rows) + k, _edited(base, *(rnd.randrange(len(base)) for _ in range(n)))) for k, n in enumerate((0, 1, 2, 2, 3), 1)]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect())
    assert {1, 2} <= set(got) and 3 not in got
    assert got == sorted(d for d, _, _, kept in _near(rows, 5) if kept)


def test_near_dedup_keeps_one_row_of_each_group(spark, docs_of):
    rnd = random.Random(8)
    base = [[f"{c}{rnd.randrange(10**6)}" for _ in range(40)] for c in "abcdef"]
    rows = [(1, " ".join(base[0]))] * 5 + [(4, _edited(base[0], 3))]  # repeated rows
    rows += [(7, " ".join(base[1])), (7, _edited(base[0], 39)), (7, " ".join(base[2])), (7, _edited(base[1], 0))]  # one id
    rows += [(None, ""), (None, ""), (None, None), (None, " ".join(base[3])), (None, _edited(base[3], 0)),
             (None, " ".join(base[2]).upper())]
    rows += [(None, " ".join(base[4])), (9, _edited(base[4], 1)), (8, _edited(base[4], 0)), (8, _edited(base[4], 0))]
    rows += [(11, ""), (12, ""), (12, ""), (None, " ".join(base[5])), (None, " ".join(base[5]))]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()]

    groups = []  # brute force over distinct rows, in the order in which one is kept
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        near = [g for g in groups if any(_near([(1, t), (2, u)], 5)[1][2] == 1 for _, u in g)]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [(d, t)]]
    assert len(got) == len(groups) == len(set(got))
    for g in groups:  # one row, and none with a larger id
        first = min((d is None, d or 0) for d, _ in g)
        assert [(d is None, d or 0) for d, t in got if (d, t) in g] == [first]


def test_near_dedup_tells_rows_by_all_columns(spark, docs_of):
    docs = docs_of([(1, "a b c"), (1, "a b c"), (2, "")]).unionByName(docs_of([(2, "", "fr", "s"), (2, "", "en", None)]))
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.lang, r.source or "") for r in out.collect()) == [
        (1, "en", "s"), (2, "en", ""), (2, "en", "s"), (2, "fr", "s")]
    assert corpus_pipeline.near_dedup(spark, docs_of([]), "").count() == 0
