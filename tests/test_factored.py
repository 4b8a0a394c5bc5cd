"""Aggregates of patterns that fall apart at a node: the same rows as by pairing, and none of the pairs in the plan."""

import random

import pytest

from graphloom.plans import factored
from graphloom.plans.graph import Graph
from graphloom.session import GraphSession


@pytest.fixture(scope="module")
def star(spark):
    rng = random.Random(7)
    nan = float("nan")
    v = [(i, ["hub"], None if i == 3 else f"h{i // 2}", None) for i in range(4)]
    v += [(10 + i, ["leaf", "red" if i % 3 else "blue"], f"l{i % 7}", [0.0, -0.0, nan, None, float(i % 5), 2.5][i % 6]) for i in range(40)]
    e = [(i, 10 + rng.randrange(40), rng.randrange(4), "in" if i % 2 else "by") for i in range(90)] + [(900 + i, 1, 1, "in") for i in range(2)]
    s = GraphSession(spark)
    s.register(Graph("star", spark.createDataFrame(v, "__gql_id bigint, __gql_label array<string>, name string, x double"), spark.createDataFrame(e, "__gql_edge_id bigint, __gql_source_id bigint, __gql_target_id bigint, __gql_type string")))
    return s


QUERIES = [
    "MATCH (a:Red)-[:IN]->(n:Hub), (b:Leaf)-[:IN]->(n) RETURN n.name AS k, COUNT(DISTINCT a) AS a, COUNT(DISTINCT b.name) AS b, COUNT(*) AS n, MAX(b.x) AS x, COUNT(b) AS m",
    "MATCH (a:Red)-[:IN]->(n:Hub), (b:Leaf)-[:BY]->(n), (c:Blue)-[]->(n) WHERE a.x >= 1 RETURN COUNT(*) AS n, COUNT(DISTINCT c) AS c",
    "MATCH (a:Red)-[:NONE]->(n:Hub), (b:Leaf)-[:BY]->(n) RETURN COUNT(*) AS n, COUNT(DISTINCT b) AS b",
    "MATCH (a:Leaf)-[:IN]->(n:Hub)<-[:IN]-(b:Leaf) RETURN n.name AS k, COUNT(*) AS n",
    "MATCH (a)-[]->(n:Hub)-[]-(b) RETURN n.name AS k, COUNT(*) AS n",
    *[f"MATCH (a:Leaf)-[:IN]->(n:Hub)<-[:{t}]-(b:Leaf) WHERE a.x {op} b.x RETURN n.name AS k, COUNT(*) AS n" for op in ("<", "<=", ">", ">=") for t in ("IN", "BY")],
    "MATCH (a:Leaf)-[:IN]->(n:Hub), (b:Leaf)-[:IN]->(n) WHERE b.x + 1 < a.x AND n.name = 'h0' RETURN COUNT(*) AS n",
]


@pytest.mark.parametrize("text", QUERIES)
def test_same_rows_as_by_pairing(star, text, monkeypatch):
    rows = lambda: sorted((tuple(str(x) for x in r) for r in star.sql(text).collect()))
    used, real = [], factored.aggregated
    monkeypatch.setattr(factored, "aggregated", lambda *a: used.append(real(*a)) or used[-1])
    got = rows()
    assert used and used[0] is not None
    monkeypatch.setattr(factored, "aggregated", lambda *a: None)
    assert got == rows()


def test_other_patterns_are_left(star, monkeypatch):
    used, real = [], factored.aggregated
    monkeypatch.setattr(factored, "aggregated", lambda *a: used.append(real(*a)) or used[-1])
    for text in (
        "MATCH (a:Leaf)-[:IN]->(n:Hub)<-[:IN]-(b:Leaf) RETURN n.name AS k, COUNT(DISTINCT a) AS n",
        "MATCH (a:Leaf)-[:IN]->(n:Hub), (a)-[:BY]->(n) RETURN n.name AS k, COUNT(*) AS n",
        "MATCH (a:Leaf)-[:IN]->(n:Hub), (b:Leaf)-[:IN]->(n) WHERE a.x < b.x AND a.name > b.name RETURN COUNT(*) AS n",
        "MATCH (a:Leaf)-[:IN]->(n:Hub), (b:Leaf)-[:IN]->(n) RETURN a.name AS k, COUNT(*) AS n",
    ):
        star.sql(text).collect()
    assert used == [None] * 4
