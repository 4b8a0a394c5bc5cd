import pytest
from pyspark.sql import functions as F

from graphloom.plans.errors import GqlError
from graphloom.plans.graph import Graph
from graphloom.session import GraphSession


@pytest.fixture(scope="module")
def basic(spark):
    v = spark.createDataFrame([(1, ["person"], 42, "Ada"), (2, ["person"], 35, "Grace"), (3, ["person"], 30, "Ada")], "__gql_id bigint, __gql_label array<string>, age bigint, name string")
    e = spark.createDataFrame([(1, 1, 2, "knows"), (2, 2, 3, "knows")], "__gql_edge_id bigint, __gql_source_id bigint, __gql_target_id bigint, __gql_type string")
    s = GraphSession(spark)
    s.register(Graph("basic", v, e))
    return s


def rows(session, text):
    return sorted((tuple(r) for r in session.sql(text).collect()), key=str)


CASES = [
    ("MATCH (p:Person) RETURN DISTINCT p.name AS name", [("Ada",), ("Grace",)]),
    ("OPTIONAL MATCH (p:Missing) RETURN p", [(None,)]),
    ("OPTIONAL MATCH (p:Person) WHERE p.age > 100 RETURN p.name AS n", [(None,)]),
    ("OPTIONAL MATCH (p:Person) FILTER p.age > 100 RETURN p.name AS n", [(None,)]),
    ("OPTIONAL MATCH q = (a:Missing)-[r]->(b) RETURN q", [(None,)]),
    ("MATCH (p:Person) RETURN p.name AS n, element_id(p) AS i ORDER BY n DESC, i ASC OFFSET 1 LIMIT 1", [("Ada", 1)]),
    ("MATCH (p:Person) WHERE p.name = 'Ada' RETURN LOWER(p.name) AS a, UPPER(p.name) AS b, LEFT(p.name, 2) AS c, RIGHT(p.name, 2) AS d, CHAR_LENGTH(p.name) AS e, MOD(p.age, 10) AS f", [("ada", "ADA", "Ad", "da", 3, 0), ("ada", "ADA", "Ad", "da", 3, 2)]),
    ("MATCH (p) WHERE p.age = 42 RETURN TRIM('  x ') AS a, p.name || ' L' AS b, TRIM(LEADING 'x' FROM 'xxax') AS c, NORMALIZE('é') AS d", [("x", "Ada L", "ax", "é")]),
    ("MATCH (p) WHERE p.age = 42 RETURN 7/2 AS a, 1/0 AS b, CEIL(1.5) AS c, FLOOR(-1.5) AS d, ABS(-3) AS e, SQRT(9) AS f, LEFT('abc', -1) AS g", [(3.5, float("inf"), 2.0, -2.0, 3, 3.0, "ab")]),
    ("MATCH (p) RETURN COALESCE(p.missing, p.name, 'x') AS n", [("Ada",), ("Ada",), ("Grace",)]),
    ("MATCH (p) WHERE p.age = 42 RETURN COALESCE(NULL, NULL) AS n", [(None,)]),
    ("MATCH (s) WHERE s.age = 42 OPTIONAL MATCH (s)-[]->(m)-[]->(d) RETURN m.name AS a, d.name AS b", [("Grace", "Ada")]),
    ("MATCH (s) WHERE s.age = 35 OPTIONAL MATCH (s)-[]->(m)-[]->(d) RETURN m.name AS a, d.name AS b", [(None, None)]),
    ("MATCH (s) WHERE s.age = 42 OPTIONAL MATCH (s)-[]->(m), (m)-[]->(d) RETURN m.name AS a, d.name AS b", [("Grace", "Ada")]),
    ("MATCH (a)-[x:KNOWS]->(b), (a)-[y:KNOWS]->(b) RETURN element_id(x), element_id(y)", [(1, 1), (2, 2)]),
    ("MATCH (a)-[x:KNOWS]->(b) MATCH (a)-[y:KNOWS]->(b) RETURN element_id(x), element_id(y)", [(1, 1), (2, 2)]),
    ("MATCH (a)-[x:KNOWS]->(b) OPTIONAL MATCH (a)-[y:KNOWS]->(b) RETURN element_id(x), element_id(y)", [(1, 1), (2, 2)]),
    ("MATCH (a:Person), (b:Person) WHERE a.age = 42 AND b.age = 30 OPTIONAL MATCH (a)-[:KNOWS]->(m:Person)-[:KNOWS]->(b) RETURN a.name, m.name, element_id(b)", [("Ada", "Grace", 3)]),
    ("MATCH (s) WHERE s.age = 42 OPTIONAL MATCH (s)-[]->(m) OPTIONAL MATCH (m)-[]->(d) WHERE d.age > 100 RETURN m.name AS a, d.name AS b", [("Grace", None)]),
    ("OPTIONAL MATCH (x:Missing) MATCH (p:Person) WHERE p.age = 42 RETURN x.name AS a, p.name AS b", [(None, "Ada")]),
    ("MATCH (s) WHERE s.age = 35 OPTIONAL MATCH (s)-[]->(m:Person) WHERE m.age > 100 MATCH (m)-[]->(d) RETURN d.name AS n", []),
    ("MATCH (p) WHERE p.age = 42 OPTIONAL MATCH (p:Person) WHERE p.age > 100 RETURN p.name AS n", [("Ada",)]),
    ("MATCH (s) WHERE s.age = 42 OPTIONAL MATCH (s)-[]->(d) LET x = d.age FILTER x > 100 RETURN s.name AS n", []),
    ("MATCH (s) WHERE s.age = 42 OPTIONAL MATCH (s)-[]->(d) FILTER d.age > 100 RETURN s.name AS a, d.name AS b", [("Ada", None)]),
    ("MATCH (s) FILTER s.age = 42 MATCH (s)-[]->(t) FILTER t.age = 35 RETURN s.name AS a, t.name AS b", [("Ada", "Grace")]),
    ("MATCH (s) MATCH (s)-[]->(t) FILTER s.age > t.age RETURN s.name AS a, t.name AS b", [("Ada", "Grace"), ("Grace", "Ada")]),
    ("MATCH (p) RETURN COUNT(*) AS n", [(3,)]),
    ("MATCH (p) RETURN COUNT(DISTINCT p.name) AS n", [(2,)]),
    ("MATCH (p) RETURN SUM(p.age) AS a, MIN(p.age) AS b, MAX(p.age) AS c, COUNT(p) * 10 AS d", [(107, 30, 42, 30)]),
    ("MATCH (p) RETURN p.name AS n, COUNT(*) AS c GROUP BY p", [("Ada", 2), ("Grace", 1)]),
    ("OPTIONAL MATCH (p:Missing) RETURN p.name AS n LIMIT 0", []),
    ("MATCH (a)-[r]-(b) RETURN element_id(a), element_id(b)", [(1, 2), (2, 1), (2, 3), (3, 2)]),
    ("MATCH (a)->{2}(b) RETURN element_id(a), element_id(b)", [(1, 3)]),
    ("MATCH (a)->{1,2}(b) RETURN element_id(a), element_id(b)", [(1, 2), (1, 3), (2, 3)]),
    ("MATCH (a)->*(b) WHERE a.age = 42 RETURN element_id(b)", [(1,), (2,), (3,)]),
    ("MATCH (a)->+(b) RETURN element_id(a), element_id(b)", [(1, 2), (1, 3), (2, 3)]),
    ("MATCH (a)<-[:KNOWS]-{2,}(b) RETURN element_id(a), element_id(b)", [(3, 1)]),
    ("MATCH (a)-[:NONE]->*(b) WHERE a.age = 42 RETURN element_id(b)", [(1,)]),
    ("MATCH (a) RETURN a:Person AS x, a IS NOT LABELED Robot AS y LIMIT 1", [(True, True)]),
    ("MATCH (a) WHERE a.age = 30 XOR a.name = 'Ada' RETURN element_id(a)", [(1,)]),
    ("MATCH (a) WHERE NOT a.age > 31 AND a.name IS NOT NULL RETURN element_id(a)", [(3,)]),
    ("MATCH (a)-[e]->(b) MATCH (c)-[e]->(d) RETURN element_id(a), element_id(d)", [(1, 2), (2, 3)]),
    ("MATCH (a {name: 'Grace'}) RETURN element_id(a)", [(2,)]),
]


@pytest.mark.parametrize("text,expected", CASES, ids=range(len(CASES)))
def test_rows(basic, text, expected):
    assert rows(basic, text) == sorted(expected, key=str)


def test_values(basic):
    node = basic.sql("MATCH (p:Person) WHERE p.age = 42 RETURN p").first()[0]
    assert node.asDict() == {"vertex_id": 1, "__gql_labels": "person", "age": 42, "name": "Ada"}
    path = basic.sql("MATCH q = (d:Person)<-[r:KNOWS]-(s:Person) WHERE d.age = 35 RETURN q").first()[0]
    assert [n.vertex_id for n in path.nodes] == [2, 1] and [e.edge_id for e in path.edges] == [1]
    assert basic.sql("MATCH q = (p) WHERE p.age = 42 RETURN q").first()[0].edges == []
    star = basic.sql("MATCH (p:Person)-[k:KNOWS]->(f:Person) WHERE element_id(p) = 1 RETURN *")
    assert star.columns == ["f", "k", "p"]
    assert basic.sql("MATCH (p) LET x = p.name RETURN *").columns == ["p", "x"]
    assert [r[0] for r in basic.sql("MATCH (p) RETURN p.name AS n ORDER BY p.age ASC").collect()] == ["Ada", "Grace", "Ada"]
    assert basic.sql("MATCH (p)-[k]->(q) RETURN p.name, element_id(k), 1 + 1").columns == ["p.name", "element_id(k)", "expression"]


ERRORS = [
    ("MATCH (p) RETURN DISTINCT p.name AS n ORDER BY p.age", "must appear in RETURN"),
    ("MATCH () RETURN *", "at least one visible variable"),
    ("MATCH (p) RETURN * GROUP BY p", "not implemented"),
    ("MATCH (s) FILTER future.age = 35 MATCH (s)-[]->(future) RETURN future.name", "'future' is not defined"),
    ("MATCH p = (s)-[]->+(t) RETURN p", "quantified path value projection"),
    ("MATCH p = (p) RETURN p", "already defined"),
    ("MATCH (a)~[b]~(c) RETURN a", "not implemented"),
    ("MATCH (a) WHERE a.x IN [1] RETURN a", "not implemented"),
    ("MATCH (a) RETURN CASE WHEN true THEN 1 END", "not implemented"),
    ("MATCH (a) WHERE count(a) > 1 RETURN a", "not allowed"),
    ("MATCH (a) RETURN sum(count(a))", "cannot be nested"),
    ("MATCH (a)-[e]->{1,2}(b) RETURN e", "group variables"),
    ('MATCH ("a") RETURN 1', "delimited"),
    ("/*+ CSR */ MATCH (a) RETURN a", "hint"),
    ("MATCH (a) RETURN a.x &", "syntax error"),
]


@pytest.mark.parametrize("text,message", ERRORS, ids=range(len(ERRORS)))
def test_errors(basic, text, message):
    with pytest.raises(GqlError, match=message):
        basic.sql(text)


def test_no_graph_selected(spark):
    with pytest.raises(GqlError, match="No graph selected"):
        GraphSession(spark).sql("MATCH (a) RETURN a")


def test_explain_and_pushdown(basic, spark, tmp_path):
    assert "Join" in basic.sql("EXPLAIN MATCH (a)-[e]->(b) RETURN a.name").first()[0]
    assert '"rows": 2' in basic.sql("EXPLAIN (ANALYZE, FORMAT JSON) MATCH (a)-[e]->(b) RETURN a.name").first()[0]
    g = basic.graph()
    g.vertices.write.parquet(str(tmp_path / "v"))
    s = GraphSession(spark)
    s.register(Graph("stored", spark.read.parquet(str(tmp_path / "v")), g.edges))
    plan = s.sql("EXPLAIN MATCH (a) WHERE a.age = 42 RETURN a.name").first()[0]
    assert "EqualTo(age,42)" in plan and "ReadSchema: struct<age:bigint,name:string>" in plan.replace("__gql_id:bigint,", "")


def test_loops_and_parallel_edges(spark):
    v = spark.range(1, 4).select(F.col("id").alias("__gql_id"), F.array().cast("array<string>").alias("__gql_label"))
    e = spark.createDataFrame([(1, 1, 1, "x"), (2, 1, 2, "x"), (3, 1, 2, "x"), (4, 2, 3, "x")], "__gql_edge_id bigint, __gql_source_id bigint, __gql_target_id bigint, __gql_type string")
    s = GraphSession(spark)
    s.register(Graph("g", v, e))
    assert s.sql("MATCH (a)-[r]-(b) RETURN count(*)").first()[0] == 7
    # trails 1 -> 3: each of the two parallel edges, with or without the loop first
    assert s.sql("MATCH (a)->+(b) WHERE element_id(a) = 1 AND element_id(b) = 3 RETURN count(*)").first()[0] == 4
    assert s.sql("MATCH (a)->+(a) RETURN count(*)").first()[0] == 1
    assert s.sql("MATCH (a)-[p]->(b)<-[q]-(a) WHERE element_id(b) = 2 RETURN count(*)").first()[0] == 2


def test_cycles_in_either_spelling(spark):
    # brute force over a random graph of two edge types with unlike degrees
    import itertools
    import random

    rng = random.Random(3)
    arcs = [(i, rng.randrange(12), rng.randrange(12), rng.choice(["few", "many", "many", "many"])) for i in range(70)]
    v = spark.range(12).select(F.col("id").alias("__gql_id"), F.array().cast("array<string>").alias("__gql_label"))
    e = spark.createDataFrame(arcs, "__gql_edge_id bigint, __gql_source_id bigint, __gql_target_id bigint, __gql_type string")
    s = GraphSession(spark)
    s.register(Graph("g", v, e))
    few, many = ([a for a in arcs if a[3] == k] for k in ("few", "many"))
    want = sorted((p[1], q[1], q[2]) for p in few for q, r in itertools.permutations(many, 2) if p[2] == q[1] and q[2] == r[1] and r[2] == p[1])
    ids = "RETURN element_id(a), element_id(b), element_id(c)"
    for text in ("(a)-[:FEW]->(b)-[:MANY]->(c)-[:MANY]->(a)", "(b)-[:MANY]->(c)-[:MANY]->(a)-[:FEW]->(b)", "(c)<-[:MANY]-(b)<-[:FEW]-(a)<-[:MANY]-(c)"):
        assert sorted(tuple(r) for r in s.sql(f"MATCH {text} {ids}").collect()) == want, text
    path = s.sql("MATCH p = (a)-[:FEW]->(b)-[:MANY]->(a) RETURN p").collect()
    assert sorted(tuple(n.vertex_id for n in r.p.nodes) for r in path) == sorted((p[1], p[2], p[1]) for p in few for q in many if p[2] == q[1] and q[2] == p[1])
