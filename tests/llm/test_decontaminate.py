import random

import pytest
from cases import mixed, table, words

from graphloom.llm import decontaminate as D

ITEM = "item_id bigint, text string, doc_id bigint"


def _bench(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], ITEM)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(12, 40)))) for i in range(12)] + [(20, "w1 w2 w3"), (21, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (22, "Only, One!")]
    docs = mixed()[:30]
    for i in range(6):
        w = docs[i][1].split(" ")
        docs[i] = (docs[i][0], " ".join([*w[:5], items[i][1].upper(), *w[5:]]))
    for i in range(6, 10):  # a word in between every few: close, not exact
        w = items[i][1].split()
        docs[i] = (docs[i][0], "a b " + " ".join(x for j, y in enumerate(w) for x in ([y, "zz"] if j % 9 == 8 else [y])) + " c d")
    return docs + [(50, "w1 " * 40), (51, "x w1 w2, w3 y"), (52, "only   one")], items


def test_same_rows_as_sql(spark, planted, same_as_sql):
    docs, items = planted
    d, b = table(spark, docs), _bench(spark, items)
    rows = same_as_sql(D.find_matches(d, b), D.sql(), documents=d, benchmark=b)
    assert len(rows) >= 12


def test_blocks_of_items_give_the_same(spark, planted):
    docs, items = planted
    d, b = table(spark, docs), _bench(spark, items)
    assert sorted(map(tuple, D.find_matches(d, b, block_tokens=30).collect())) == sorted(map(tuple, D.find_matches(d, b).collect()))


def test_edge_cases(spark):
    d = table(spark, mixed())
    for items in ([], [(1, None), (None, "w1 w2"), (2, ""), (3, "...")]):
        assert D.find_matches(d, _bench(spark, items)).collect() == []
    assert D.find_matches(table(spark, []), _bench(spark, [(1, "w1 w2")])).collect() == []
    # an item inside a very long text, and rows that repeat an id
    long = dict(mixed())[105]
    item = " ".join(long.split()[20000:20030])
    assert [(r.doc_id, r.phrase_windows, r.first_position) for r in D.find_matches(d, _bench(spark, [(1, item)])).collect()] == [(105, 21, 20000)]
    own = " ".join(dict(mixed())[106].split()[:12])
    assert {r.doc_id for r in D.find_matches(d, _bench(spark, [(1, own)])).where("contaminated").collect()} >= {106}


def test_drop_keeps_the_rest_and_all_columns(spark, planted):
    docs, items = planted
    d = table(spark, docs + [(None, "keep me")])
    kept = D.drop_contaminated(d, _bench(spark, items[:10]))
    assert kept.columns == d.columns
    gone = {r.doc_id for r in d.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == set(range(10)) and any(r.doc_id is None for r in kept.collect())
