import random
from collections import deque

import pytest

from graphloom.operators import algorithms as A
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import Graph
from graphloom.session import GraphSession

VERTEX = "__gql_id bigint, __gql_label array<string>, name string"
EDGE = "__gql_edge_id bigint, __gql_source_id bigint, __gql_target_id bigint, __gql_type string, miles bigint"


@pytest.fixture(scope="module")
def session(spark):
    names = ["one", "two", "three", "four", "five", "isolated"]
    v = spark.createDataFrame([(i + 1, ["node", "even" if i % 2 else "odd"], n) for i, n in enumerate(names)], VERTEX)
    arcs = [(1, 2, "route"), (1, 3, "express"), (2, 4, "route"), (3, 4, "route"), (4, 5, "route"), (5, 3, "route")]
    e = spark.createDataFrame([(i + 1, s, t, k, 100 * (i + 1)) for i, (s, t, k) in enumerate(arcs)], EDGE)
    out = GraphSession(spark)
    out.register(Graph("algo_graph", v, e))
    return out


def rows(session, text):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in session.sql(text).collect()]


def test_traversals(session):
    want = [(1, 0, None, None, 0), (2, 1, 1, 1, 1), (3, 1, 1, 2, 2), (4, 2, 2, 3, 3), (5, 3, 4, 5, 4)]
    assert rows(session, "CALL algo.bfs('algo_graph', 1)") == want
    assert rows(session, "SELECT * FROM system.algo.bfs('algo_graph', 1)") == want
    assert rows(session, "CALL algo.bfs('algo_graph', 1, max_depth := 1)") == want[:3]
    assert rows(session, "CALL algo.bfs('algo_graph', 1, target_vertex_id := 4)") == want[:4]
    assert rows(session, "CALL algo.bfs('algo_graph', 1, edge_label := 'route')") == [want[0], want[1], (4, 2, 2, 3, 2), (5, 3, 4, 5, 3), (3, 4, 5, 6, 4)]
    assert sorted(r[0] for r in rows(session, "CALL algo.bfs('algo_graph', 1, vertex_label := 'odd')")) == [1, 3]
    assert sorted(rows(session, "CALL algo.dfs('algo_graph', 1)"), key=lambda r: r[4]) == [(1, 0, None, None, 0), (2, 1, 1, 1, 1), (4, 2, 2, 3, 2), (5, 3, 4, 5, 3), (3, 4, 5, 6, 4)]
    assert session.sql("CALL algo.sssp('algo_graph', 1)").columns == ["vertex_id", "distance", "parent_vertex_id", "edge_id", "settled_order"]
    assert rows(session, "CALL algo.bfs('algo_graph', 1) YIELD vertex_id, miles RETURN vertex_id, miles ORDER BY vertex_id") == [(1, None), (2, 100), (3, 200), (4, 300), (5, 500)]
    with pytest.raises(GqlError, match="outside the vertex-label projection"):
        session.sql("CALL algo.bfs('algo_graph', 2, vertex_label := 'odd')")


def test_whole_graph(session):
    out = {1: [2, 3], 2: [4], 3: [4], 4: [5], 5: [3], 6: []}
    rank = dict.fromkeys(out, 1 / 6)
    for _ in range(8):
        loose = sum(rank[v] for v in out if not out[v])
        rank = {v: 0.15 / 6 + 0.85 * (loose / 6 + sum(rank[u] / len(out[u]) for u in out if v in out[u])) for v in out}
    got = session.sql("CALL algo.pagerank('algo_graph', max_iterations := 8)").collect()
    assert {r.vertex_id: r["rank"] for r in got} == pytest.approx(rank, abs=1e-12) and {(r.iterations, r.converged) for r in got} == {(8, False)}
    assert session.sql("CALL algo.pagerank('algo_graph', tolerance := 0.5)").first().converged
    assert sorted(rows(session, "CALL algo.wcc('algo_graph')")) == [(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 1, 5), (5, 1, 5), (6, 6, 1)]
    assert sorted(rows(session, "CALL algo.scc('algo_graph')")) == [(1, 1, 1), (2, 2, 1), (3, 3, 3), (4, 3, 3), (5, 3, 3), (6, 6, 1)]
    assert sorted(rows(session, "CALL algo.triangle_count('algo_graph')")) == [(1, 0, 2, 0, 1), (2, 0, 2, 0, 1), (3, 1, 3, 0.333333, 1), (4, 1, 3, 0.333333, 1), (5, 1, 2, 1, 1), (6, 0, 0, 0, 1)]
    assert sorted(rows(session, "CALL algo.lcc('algo_graph')")) == [(1, 2, 0, 0), (2, 2, 0, 0), (3, 3, 1, 0.166667), (4, 3, 1, 0.166667), (5, 2, 1, 0.5), (6, 0, 0, 0)]
    assert sorted(rows(session, "CALL algo.degree('algo_graph')")) == [(1, 2, 0, 2), (2, 1, 1, 2), (3, 1, 2, 3), (4, 1, 2, 3), (5, 1, 1, 2), (6, 0, 0, 0)]
    assert sorted(rows(session, "CALL algo.closeness('algo_graph')")) == [(1, 4, 7, 0.457143), (2, 3, 6, 0.3), (3, 2, 3, 0.266667), (4, 2, 3, 0.266667), (5, 2, 3, 0.266667), (6, 0, 0, 0)]
    assert sorted(rows(session, "CALL algo.degree('algo_graph', 'odd') YIELD vertex_id, total_degree RETURN vertex_id, total_degree ORDER BY vertex_id")) == [(1, 1), (3, 2), (5, 1)]
    for bad, message in (("pagerank('algo_graph', damping := 1.0)", "between 0 and 1"), ("nothing('algo_graph')", "does not exist"), ("wcc('algo_graph', size := 1)", "no option")):
        with pytest.raises(GqlError, match=message):
            session.sql(f"CALL algo.{bad}")


def test_pipelines(session):
    seeds = "MATCH (s:node) FILTER s.name = 'one' OR s.name = 'isolated' "
    one = "MATCH (s:node) FILTER s.name = 'one' "
    assert sorted(rows(session, seeds + "CALL algo.bfs('algo_graph', element_id(s)) YIELD vertex_id, depth, visit_order RETURN vertex_id, depth, visit_order")) == [(1, 0, 0), (2, 1, 2), (3, 1, 3), (4, 2, 4), (5, 3, 5), (6, 0, 1)]
    assert rows(session, one + "CALL algo.bfs('algo_graph', element_id(s), 'node', 'route', 4) YIELD depth RETURN depth ORDER BY depth DESC LIMIT 1") == [(2,)]
    for end, distance in (("four", 2), ("isolated", -1), ("one", 0)):
        assert rows(session, f"MATCH (s:node), (t:node) FILTER s.name = 'one' AND t.name = '{end}' CALL algo.shortest_path_length('algo_graph', element_id(s), element_id(t), 'Node', 'ROUTE') YIELD distance RETURN distance") == [(distance,)]
    assert sorted(rows(session, "MATCH (s:Missing) CALL algo.wcc('algo_graph') YIELD vertex_id, component_id RETURN component_id, COUNT(*) AS n")) == [(1, 5), (6, 1)]
    with pytest.raises(GqlError, match="exactly one distinct source"):
        session.sql(seeds + "CALL algo.sssp('algo_graph', element_id(s)) YIELD vertex_id RETURN vertex_id")


def test_louvain(spark):
    v = spark.createDataFrame([(i, ["node"], "") for i in range(1, 8)], VERTEX)
    arcs = [(1, 2), (2, 3), (3, 1), (2, 1), (1, 2), (1, 1), (4, 5), (5, 6), (6, 4), (3, 4)]
    g = Graph("g", v, spark.createDataFrame([(i + 1, s, t, "route", 0) for i, (s, t) in enumerate(arcs)], EDGE))
    out = sorted((r.vertex_id, r.community_id, r.community_size, round(r.modularity, 6)) for r in A.louvain(*A.projection(g)).collect())
    assert out == [(i, 1, 3, 0.357143) for i in (1, 2, 3)] + [(i, 4, 3, 0.357143) for i in (4, 5, 6)] + [(7, 7, 1, 0.357143)]
    assert A.louvain(*A.projection(g), resolution=10.0).select("community_id").distinct().count() == 7


def _fifo(n, arcs, start):
    near = {}
    for e, s, t in arcs:
        near.setdefault(s, []).append((t, e))
    seen, out, queue = {start}, [(start, 0, None, None, 0)], deque([(start, 0)])
    while queue:
        v, d = queue.popleft()
        for w, e in near.get(v, ()):
            if w not in seen:
                seen.add(w)
                out.append((w, d + 1, v, e, len(out)))
                queue.append((w, d + 1))
    return out


def test_random_graphs_against_plain_python(spark):
    rng = random.Random(4)
    for _ in range(2):
        n = 14
        arcs = [(i + 1, rng.randrange(1, n), rng.randrange(1, n)) for i in range(24)]
        v, e = spark.range(1, n).select("id"), spark.createDataFrame(arcs, "id bigint, s bigint, t bigint")
        assert [tuple(r) for r in A.bfs(v, e, [1]).collect()] == _fifo(n, arcs, 1)
        reach = {a: {x[0] for x in _fifo(n, arcs, a)} for a in range(1, n)}
        strong = sorted((a, min(b for b in reach[a] if a in reach[b]), sum(a in reach[b] for b in reach[a])) for a in range(1, n))
        assert sorted(map(tuple, A.scc(v, e).collect())) == strong
        assert sorted(map(tuple, A.scc(v, e, kernel_edges=0).collect())) == strong
        both = {(s, t) for _, s, t in arcs} | {(t, s) for _, s, t in arcs}
        weak = {a: {x[0] for x in _fifo(n, [(0, *p) for p in both], a)} for a in range(1, n)}
        assert sorted(map(tuple, A.wcc(v, e).collect())) == sorted((a, min(weak[a]), len(weak[a])) for a in weak)
        simple = {(s, t) for s, t in both if s != t}
        tri = {a: sum(1 for b in range(1, n) for c in range(b + 1, n) if (a, b) in simple and (b, c) in simple and (a, c) in simple) for a in range(1, n)}
        assert {r.vertex_id: r.triangle_count for r in A.triangle_count(v, e).collect()} == tri


def test_empty_graph(spark):
    v, e = spark.range(0).select("id"), spark.createDataFrame([], "id bigint, s bigint, t bigint")
    for f in (A.wcc, A.scc, A.triangle_count, A.lcc, A.louvain, A.degree, A.closeness, A.pagerank):
        assert f(v, e).count() == 0
    assert A.bfs(v, e, [1]).count() == 0
