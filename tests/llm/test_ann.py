import itertools

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import ann

FORM = "vec_id bigint, embedding array<float>, label int, id string, vec string"


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y") for i, v in rows], FORM)


def _exact(x, n):
    d = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return [set(np.lexsort((np.arange(len(x)), row))[:n].tolist()) for row in d]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=(900, 16)), np.repeat(rng.normal(size=(30, 16)), 30, axis=0) + 0.1 * rng.normal(size=(900, 16))):
        x = x.astype(np.float32)
        got = ann.nearest_neighbours(_table(spark, enumerate(x)), per_cell=20).collect()
        near = {}
        for r in got:
            near.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.distance)
        assert len(near) == 900 and all(sorted(v) == list(range(1, 11)) for v in near.values())
        want = _exact(x.astype(np.float64), 10)
        assert np.mean([len(want[i] & {a for a, _ in v.values()}) / 10 for i, v in near.items()]) >= 0.9
        for i, v in itertools.islice(near.items(), 50):
            assert all(abs(np.linalg.norm(x[i].astype(float) - x[a].astype(float)) - d) < 1e-4 for a, d in v.values())
            assert [d for _, d in (v[k] for k in sorted(v))] == sorted(d for _, d in v.values())


def test_walk_is_in_ascending_order():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.random(9), rng.random(9), rng.integers(0, 4, (9, 9))
    walked = ann.cells_of_query(a, b, sizes, 10**9)
    assert walked == [(i, j) for _, i, j in sorted((a[i] + b[j], i, j) for i in range(9) for j in range(9) if sizes[i, j])]
    some = ann.cells_of_query(a, b, sizes, 20)
    assert some == walked[: len(some)] and sum(sizes[i, j] for i, j in some) >= 20 > sum(sizes[i, j] for i, j in some[:-1])


def test_edge_cases(spark):
    rows = [(1, [0, 0]), (2, [0, 1]), (3, [0, 2]), (3, [9, 9]), (4, [0, 0]), (None, [0, 0]), (5, None), (6, []), (7, [None, 1]), (8, [float("nan"), 1]), (9, [float("inf"), 1]), (10, [1, 2, 3])]
    got = sorted(tuple(r) for r in ann.nearest_neighbours(_table(spark, rows), n=2).collect())
    assert got == [(1, 2, 2, 1.0), (1, 4, 1, 0.0), (2, 1, 1, 1.0), (2, 3, 2, 1.0), (3, 1, 2, 2.0), (3, 2, 1, 1.0), (4, 1, 1, 0.0), (4, 2, 2, 1.0)]
    assert ann.nearest_neighbours(_table(spark, [])).collect() == [] and ann.nearest_neighbours(_table(spark, [(1, [1, 2])])).collect() == []
    one = ann.nearest_neighbours(_table(spark, [(1, [5]), (2, [7])])).collect()
    assert sorted((r.vec_id, r.neighbour_id, r.distance) for r in one) == [(1, 2, 2.0), (2, 1, 2.0)]


def test_asked_vectors_among_all_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.normal(size=(20, 16)), 30, axis=0) + 0.3 * rng.normal(size=(600, 16))).astype(np.float32)
    want = _exact(x.astype(np.float64), 10)
    t = _table(spark, enumerate(x))
    plain = lambda rows: sorted((*r[:3], round(r.distance, 9)) for r in rows)
    whole = plain(ann.nearest_neighbours(t, asked=F.col("id") % 20 == 0).collect())
    assert {r[0] for r in whole} == set(range(0, 600, 20)) and len(whole) == 300
    assert np.mean([r[1] in want[r[0]] for r in whole]) >= 0.9
    # cutting the centroids' entries into blocks changes nothing, and neither does asking for all
    monkeypatch.setattr(ann, "BLOCK", 25)
    assert plain(ann.nearest_neighbours(t, asked=F.col("id") % 20 == 0).collect()) == whole
    assert plain(r for r in ann.nearest_neighbours(t).collect() if r.vec_id % 20 == 0) == whole
    # codebooks of a sample index every vector all the same
    monkeypatch.setattr(ann, "FIT", 200)
    sampled = ann.nearest_neighbours(t, asked=F.col("id") % 20 == 0).collect()
    assert len(sampled) == 300 and np.mean([r.neighbour_id in want[r.vec_id] for r in sampled]) >= 0.9
