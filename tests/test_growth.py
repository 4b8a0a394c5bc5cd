"""Steps that keep memory and exchange in bounds give the same rows, and are taken."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.operators.expand import trails


def graph(spark, arcs, n):
    return spark.range(1, n).select("id"), spark.createDataFrame(arcs, "id bigint, s bigint, t bigint")


def test_hops_of_other_zones_are_left_out(spark):
    hops = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (9 << 48, 4, 3)], "f bigint, t bigint, id bigint")
    # a hop of the other zone that reaches the join divides by zero
    hops = hops.select("f", "t", F.expr(f"id + 1 div (f - {9 << 48})").alias("id"))
    got = trails(spark.createDataFrame([(1,)], "s bigint"), hops, 1, None)
    assert sorted((r.s, r.e) for r in got.collect()) == [(1, 2), (1, 3)]


def test_closeness_writes_no_level_that_leads_nowhere(spark, monkeypatch):
    written, real = [], A.durable
    monkeypatch.setattr(A, "durable", lambda df, what: written.append(what) or real(df, what))
    far = 5 << 48
    v, e = spark.createDataFrame([(1,), (2,), (far,)], "id bigint"), spark.createDataFrame([(1, 1, far), (2, 2, far)], "id bigint, s bigint, t bigint")
    assert sorted(map(tuple, A.closeness(v, e).collect())) == [(1, 1, 1, 0.5), (2, 1, 1, 0.5), (far, 0, 0, 0.0)]
    assert written == ["hops"]


def plain_dfs(arcs, direction, starts, known, max_depth, target):
    near = {}
    for e, s, t in sorted(arcs):
        if direction != "in":
            near.setdefault(s, []).append((0, e, t))
        if direction != "out":
            near.setdefault(t, []).append((1, e, s))
    seen, out = set(), []

    def visit(v, depth, parent, edge):
        seen.add(v)
        out.append((v, depth, parent, edge, len(out)))
        if v == target:
            return True
        if max_depth is None or depth < max_depth:
            for _, e, w in sorted(near.get(v, [])):
                if w not in seen and visit(w, depth + 1, v, e):
                    return True
        return False

    for s in starts:
        if s in known and s not in seen and visit(s, 0, None, None):
            break
    return out


@pytest.mark.parametrize("direction, max_depth, target", [("out", None, None), ("both", 3, None), ("in", None, 7)])
def test_dfs_holds_arrays(spark, monkeypatch, direction, max_depth, target):
    monkeypatch.setattr(A, "single_task", None)
    rng = random.Random(3)
    arcs = [(i + 1, rng.randrange(1, 14), rng.randrange(1, 14)) for i in range(40)] + [(100, 3, 50), (101, 50, 51)]
    v, e = graph(spark, arcs, 14)
    got = A.dfs(v, e, [2, 5, 99], direction=direction, max_depth=max_depth, target=target).collect()
    assert sorted(map(tuple, got), key=lambda r: r[4]) == plain_dfs(arcs, direction, [2, 5, 99], set(range(1, 14)), max_depth, target)


def plain_louvain(nodes, arcs, resolution=1.0, max_iterations=32, max_levels=32, tolerance=1e-12):
    """All components together, in dicts."""
    place = {v: i for i, v in enumerate(nodes)}
    near = [{} for _ in nodes]
    for _, s, t in sorted(arcs):
        if s != t:
            near[place[s]][place[t]] = near[place[t]][place[s]] = 1.0
    base, total = near, float(sum(map(len, near)))
    member, levels, iterations, converged = list(range(len(nodes))), 0, 0, False
    while levels < max_levels:
        degree = [sum(x.values()) for x in near]
        own, mass, least = list(range(len(near))), list(degree), tolerance * total
        for turn in range(1, max_iterations + 1):
            any_moved = False
            for v, links in enumerate(near):
                if not degree[v]:
                    continue
                here = own[v]
                weight = {here: 0.0}
                for w, x in links.items():
                    if w != v:
                        weight[own[w]] = weight.get(own[w], 0.0) + x
                mass[here] -= degree[v]
                gain = {c: x - resolution * degree[v] * mass[c] / total for c, x in weight.items()}
                best, high, now = here, gain[here], gain[here]
                for c, x in gain.items():
                    if x > high + least or (x > now + least and abs(x - high) <= least and c < best):
                        best, high = c, x
                own[v] = best
                mass[best] += degree[v]
                any_moved |= best != here
            if not any_moved:
                break
        levels, iterations = levels + 1, iterations + turn
        names = {c: i for i, c in enumerate(sorted(set(own)))}
        if len(names) == len(near):
            converged = True
            break
        member = [names[own[c]] for c in member]
        joined = [{} for _ in names]
        for v, links in enumerate(near):
            for w, x in links.items():
                a, b = names[own[v]], names[own[w]]
                joined[a][b] = joined[a].get(b, 0.0) + x
        near = joined
    first = {}
    for i, c in enumerate(member):
        first.setdefault(c, nodes[i])
    inside = sum(1 for i, x in enumerate(base) for w in x if member[w] == member[i])
    around = {}
    for i, x in enumerate(base):
        around[member[i]] = around.get(member[i], 0) + len(x)
    q = inside / total - resolution * sum((a / total) ** 2 for a in around.values())
    return sorted((nodes[i], first[c], member.count(c), round(q, 9), levels, iterations, converged) for i, c in enumerate(member))


def test_louvain_by_groups_of_components(spark, monkeypatch):
    monkeypatch.setattr(A, "LOUVAIN_PAIRS", 40)
    rng = random.Random(5)
    arcs = [(rng.randrange(1 << 40), 100 * k + rng.randrange(30), 100 * k + rng.randrange(30)) for k in range(4) for _ in range(40 + 15 * k)]
    nodes = sorted({x for _, s, t in arcs for x in (s, t)} | {1000})
    v, e = spark.createDataFrame([(x,) for x in nodes], "id bigint"), spark.createDataFrame(arcs, "id bigint, s bigint, t bigint")
    got = sorted((*r[:3], round(r.modularity, 9), *r[4:]) for r in A.louvain(v, e).collect())
    assert got == plain_louvain(nodes, arcs)
