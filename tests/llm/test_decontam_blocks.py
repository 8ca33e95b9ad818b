"""Operator 7: many items in one scan, ids of any type, empty and very long texts."""

import random

import pytest

from flowlens.llm import cgk_decontam
from flowlens.llm.cgk_decontam import CgkParams

from .conftest import EDGE


def _words(rnd, n, many=3000):
    return " ".join(f"w{rnd.randrange(many)}" for _ in range(n))


def _edited(rnd, text, share):
    words = text.split()
    for j in rnd.sample(range(len(words)), int(len(words) * share)):
        words[j] = "edited"
    return " ".join(words)


def test_many_items_in_one_scan(spark, docs_of):
    rnd = random.Random(1)
    items = [(k, _words(rnd, rnd.randrange(8, 40))) for k in range(20_001)]  # two blocks
    rows = [(k, _words(rnd, 30) + " " + _edited(rnd, items[k * 200][1], 0.15) + " " + _words(rnd, 30)) for k in range(101)]
    docs = docs_of(rows + [(1000 + k, _words(rnd, 80)) for k in range(100)])
    out = cgk_decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert len({(k, k * 200) for k in range(101)} & got) >= 97
    assert not {d for d, _ in got} & set(range(1000, 1100))


@pytest.mark.parametrize("p", [CgkParams(), CgkParams(block=3), CgkParams(block_bytes=200), CgkParams(chunk_bytes=1, block=5),
                               CgkParams(block=2, pass_bytes=300)])
def test_blocks_chunks_and_passes_find_the_same(spark, docs_of, p):
    rnd = random.Random(2)
    items = [(f"item-{k}", _words(rnd, 8 + k)) for k in range(20)] + [(None, "three plain words"), ("x", None), ("y", "")]
    items += [("again", items[3][1])]
    rows = [(f"d{k}", "lead " + t + " tail") for k, (_, t) in enumerate(items[:20])]
    rows += [(None, "Three plain words!"), ("e", None), ("f", ""), ("d0", "lead " + items[0][1]), ("long", _words(rnd, 60_000) + " " + items[7][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id string, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = cgk_decontam.contaminated(docs, bench, p)
    assert out.dtypes[:2] == [("doc_id", "string"), ("item_id", "string")]
    want = [(f"d{k}", f"item-{k}", 0) for k in range(20)] + [("d0", "item-0", 0), ("d3", "again", 0), (None, None, 0), ("long", "item-7", 0)]
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in out.collect()), key=repr) == sorted(want, key=repr)
    kept = cgk_decontam.drop_contaminated(docs, bench, p)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "" for r in kept.collect())) == ["", "e", "f"]  # an item of three words is reported only


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "one item of nine words is here to find")], "item_id long, text string")
    assert cgk_decontam.contaminated(docs_of([]), bench).collect() == []
    assert cgk_decontam.drop_contaminated(docs_of([]), bench).collect() == []
    none = bench.filter("item_id = 2")
    assert cgk_decontam.contaminated(docs_of(EDGE), none).collect() == []
    assert cgk_decontam.drop_contaminated(docs_of(EDGE), none).count() == len(EDGE)
