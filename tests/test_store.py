import gzip

import pytest
import zstandard

from graphloom.plans.errors import GqlError
from graphloom.session import GraphSession

VERTICES = "external_id:ID(People),name:string,age:int,city:string,:LABEL\np1,Ada,42,London,Person;Engineer\np2,Grace,35,Arlington,Person\np3,Solo,30,,Person\n"
EDGES = ":START_ID(People),:END_ID(People),:TYPE,since:int\np1,p2,KNOWS,2020\n"


@pytest.fixture()
def people(spark, tmp_path):
    (tmp_path / "v.csv").write_text(VERTICES)
    (tmp_path / "e.csv").write_text(EDGES)
    s = GraphSession(spark, str(tmp_path / "graphs"))
    s.sql(f"CREATE GRAPH people ANY; COPY GRAPH people FROM (VERTICES '{tmp_path}/v.csv', EDGES '{tmp_path}/e.csv') FORMAT GRAPH; SESSION SET GRAPH people")
    return s


def names(s, where="true"):
    return sorted(tuple(r) for r in s.sql(f"MATCH (p:Person) WHERE {where} RETURN p.name AS n, p.age AS a").collect())


def test_copy_and_catalog(people, spark, tmp_path):
    assert [tuple(r)[1:5] for r in people.sql("SELECT * FROM gql_graphs()").collect()] == [("people", 2, 3, 1)]
    assert people.sql("MATCH (a)-[k:KNOWS]->(b) RETURN a.external_id AS x, b.name AS y, k.since AS z").first() == ("p1", "Grace", 2020)
    assert people.sql("MATCH (a:Engineer) RETURN a").first()[0]["__gql_labels"] == "person;engineer"
    again = GraphSession(spark, str(tmp_path / "graphs"))
    assert again.sql("SESSION SET GRAPH people; MATCH (a) RETURN count(*)").first()[0] == 3
    with pytest.raises(GqlError, match="must be empty before COPY GRAPH"):
        people.sql(f"COPY GRAPH people FROM (VERTICES '{tmp_path}/v.csv', EDGES '{tmp_path}/e.csv') FORMAT GRAPH")
    people.sql("CALL gql_create_property_index('people', 'AGE'); CALL gql_create_property_index('people', 'age')")
    assert people.sql("CALL gql_property_indexes()").count() == 1
    with pytest.raises(GqlError, match="not mapped"):
        people.sql("CALL gql_create_property_index('people', 'nothing')")
    assert people.sql("CALL gql_drop_property_index('people', 'age'); CALL gql_property_indexes()").count() == 0
    assert [tuple(r) for r in people.sql("CALL gql_neighbors('people', 1, 'out')").collect()] == [(2, 1)]
    assert people.sql("CALL gql_build_csr('people')").first().edge_count == 1
    assert people.sql("SELECT * FROM gql_csr_stats('people')").first().cached
    assert tuple(people.sql("CALL gql_csr_edge_stats('people')").first())[:4] == ("knows", 1, 1, 1)
    assert people.sql("DROP GRAPH people; DROP GRAPH IF EXISTS people; CALL gql_graphs()").count() == 0


@pytest.mark.parametrize("kind", ["csv.gz", "csv.zst", "parquet"])
def test_formats(spark, tmp_path, kind):
    for name, text in (("v", VERTICES), ("e", EDGES)):
        if kind == "parquet":
            spark.read.option("header", True).csv(spark.sparkContext.parallelize(text.strip().split("\n"))).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            (tmp_path / f"{name}.{kind}").write_bytes((gzip.compress if kind == "csv.gz" else zstandard.compress)(text.encode()))
    s = GraphSession(spark, str(tmp_path / "g"))
    s.sql(f"CREATE GRAPH g ANY; COPY GRAPH g FROM (VERTICES '{tmp_path}/v.{kind}', EDGES '{tmp_path}/e.{kind}') FORMAT GRAPH; SESSION SET GRAPH g")
    assert s.sql("MATCH (a)-[k]->(b) RETURN a.age + k.since AS x, b.city AS y").first() == (2062, "Arlington")


@pytest.mark.parametrize(
    "vertices,edges,message",
    [
        ("i:ID\n1\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "must be unique"),
        ("i:ID\n1\n", ":START_ID,:END_ID,:TYPE\n1,9,x\n", "must reference imported node"),
        ("i:ID\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,A;B\n", "exactly one non-empty type"),
        ("i:ID(A)\n1\n", ":START_ID(B),:END_ID(B),:TYPE\n1,1,x\n", "groups"),
        ("i:ID,x:nothing\n1,2\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "not supported"),
        ("i\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "lacks :ID"),
    ],
)
def test_bad_files(spark, tmp_path, vertices, edges, message):
    (tmp_path / "v.csv").write_text(vertices)
    (tmp_path / "e.csv").write_text(edges)
    s = GraphSession(spark, str(tmp_path / "g"))
    s.sql("CREATE GRAPH g ANY")
    with pytest.raises(GqlError, match=message):
        s.sql(f"COPY GRAPH g FROM (VERTICES '{tmp_path}/v.csv', EDGES '{tmp_path}/e.csv') FORMAT GRAPH")
    assert s.sql("CALL gql_graphs()").first().vertex_count == 0


def test_dangling_edges_without_validation(spark, tmp_path):
    (tmp_path / "v.csv").write_text("i:ID\n1\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\n1,9,x\n1,1,x\n")
    s = GraphSession(spark, str(tmp_path / "g"))
    s.sql(f"CREATE GRAPH g ANY; COPY GRAPH g FROM (VERTICES '{tmp_path}/v.csv', EDGES '{tmp_path}/e.csv') FORMAT GRAPH OPTIONS (VALIDATE FALSE); SESSION SET GRAPH g")
    assert s.graph().edges.count() == 2
    assert s.sql("MATCH ()-[e]->() RETURN count(*)").first()[0] == 1


def test_typed_values(spark, tmp_path):
    (tmp_path / "v.csv").write_text("i:ID,day:date,scores:long[],at:localdatetime,any:variant\n1,2024-02-29,3;4,2024-01-01T10:00:00,i:7\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\n1,1,x\n")
    s = GraphSession(spark, str(tmp_path / "g"))
    s.sql(f"CREATE GRAPH g ANY; COPY GRAPH g FROM (VERTICES '{tmp_path}/v.csv', EDGES '{tmp_path}/e.csv') FORMAT GRAPH; SESSION SET GRAPH g")
    row = s.sql("MATCH (a) RETURN a.day AS d, a.scores AS s, a.at AS t").first()
    assert str(row.d) == "2024-02-29" and row.s == [3, 4] and row.t.hour == 10


def test_set_and_remove(people):
    people.sql("MATCH (p:Person) WHERE p.name = 'Ada' SET p.age = p.age + 1, p.city = 'Cambridge', p:Reviewed:Checked")
    assert names(people, "p:Reviewed") == [("Ada", 43)]
    people.sql("MATCH (p:Person)-[k]->(q) LET m = {since: k.since + 1} SET p += {age: p.age * 2}, k = m")
    assert people.sql("MATCH (a)-[k]->() RETURN a.age AS x, k.since AS y").first() == (86, 2021)
    people.sql("MATCH (p) WHERE p.name = 'Grace' SET p = {name: 'Amazing Grace', age: p.age + 1}")
    assert people.sql("MATCH (p) WHERE p.age = 36 RETURN p.city AS c, p.name AS n").first() == (None, "Amazing Grace")
    people.sql("MATCH (p:Reviewed) REMOVE p:Checked, p.city")
    assert people.sql("MATCH (p:Reviewed) RETURN p:Checked AS x, p.city AS y").first() == (False, None)
    before = people.store.meta("people")["version"]
    people.sql("MATCH (p) SET p += {}; MATCH (p:Missing) SET p.age = 1")
    assert people.store.meta("people")["version"] == before
    for text, message in (("MATCH (p) SET p.nothing = 1", "not mapped"), ("MATCH ()-[k]->() SET k:Other", "exactly one immutable type"), ("MATCH (p) SET p.age = count(p)", "aggregate")):
        with pytest.raises(GqlError, match=message):
            people.sql(text)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        people.sql("MATCH (p) SET p.city = 'x', p.age = 'not an integer'")
    assert people.store.meta("people")["version"] == before


def test_insert_and_merge(people):
    people.sql("INSERT (a:Person&Engineer {external_id: 'p4', name: 'Linus', age: 31})-[:KNOWS {since: 2031}]->(:Person {external_id: 'p5', name: 'Edsger', age: 40})")
    assert people.sql("MATCH (a:Engineer)-[k]->(b) WHERE k.since = 2031 RETURN a.name AS x, b.name AS y").first() == ("Linus", "Edsger")
    people.sql("MATCH (a:Person), (b:Person) WHERE a.name = 'Solo' AND b.age > 35 INSERT (a)-[:KNOWS {since: b.age}]->(b)")
    assert people.sql("MATCH (a)-[k]->(b) WHERE a.name = 'Solo' RETURN count(*), sum(k.since)").first() == (2, 82)
    people.sql("MATCH (a:Engineer) INSERT (a)-[:MADE]->(:Thing {name: a.name})<-[:OWNS]-(a)")
    assert people.sql("MATCH (t:Thing)<-[k]-(a) RETURN count(DISTINCT t), count(k)").first() == (2, 4)
    made = people.sql("INSERT (x:Person {name: 'New', age: 1}) RETURN x AS created").first()[0]
    assert made.name == "New" and made.vertex_id == 8
    people.sql("MERGE (x:Person {name: 'New', age: 1}); MERGE (x:Person {name: 'Other'})")
    assert len(names(people, "p.name = 'New'")) == 1 and len(names(people, "p.name = 'Other'")) == 1
    ids = [r[0] for r in people.sql("MATCH (p) RETURN element_id(p) AS i").collect()]
    assert len(set(ids)) == len(ids) == 9
    for text, message in (("INSERT (p:Person {nothing: 1})", "not mapped"), ("MATCH (a) INSERT (a:Other)-[:K]->(:Person)", "cannot have labels"), ("INSERT (:Person)-[:A&B]->(:Person)", "exactly one type"), ("MERGE (:Person {name: 'x'}) ON CREATE SET x.name = 'y'", "not implemented")):
        with pytest.raises(GqlError, match=message):
            people.sql(text)


def test_delete(people):
    with pytest.raises(GqlError, match="use DETACH DELETE"):
        people.sql("MATCH (p) WHERE p.name = 'Ada' DELETE p")
    people.sql("MATCH (p) WHERE p.name = 'Solo' DELETE p, NULL")
    assert len(names(people)) == 2
    people.sql("MATCH q = (a)-[k]->(b) WHERE k.since = 2020 DELETE {all: [q]}.all")
    assert len(names(people)) == 0 and people.graph().edges.count() == 0
    people.sql("INSERT (:Person {name: 'x'})-[:KNOWS]->(:Person {name: 'y'})")
    people.sql("MATCH (p) WHERE p.name = 'x' DETACH DELETE p")
    assert names(people) == [("y", None)] and people.graph().edges.count() == 0
    with pytest.raises(GqlError, match="DELETE targets"):
        people.sql("MATCH (p) DELETE [p, 1 + 1]")


def test_transactions(people, spark):
    people.sql("BEGIN; INSERT (:Person {name: 'T', age: 9})")
    assert names(people, "p.name = 'T'") == [("T", 9)]
    assert GraphSession(spark, people.store.root).sql("SESSION SET GRAPH people; MATCH (p) RETURN count(*)").first()[0] == 3
    with pytest.raises(GqlError, match="inside a transaction"):
        people.sql("CREATE GRAPH other ANY")
    people.sql("ROLLBACK")
    assert names(people, "p.name = 'T'") == []
    people.sql("BEGIN TRANSACTION; INSERT (:Person {name: 'T', age: 9}); COMMIT")
    assert GraphSession(spark, people.store.root).sql("SESSION SET GRAPH people; MATCH (p) RETURN count(*)").first()[0] == 4


def test_typed_graph(spark, tmp_path):
    s = GraphSession(spark, str(tmp_path / "g"))
    s.sql("CREATE GRAPH t TYPED {(Person :Person {id INT64 NOT NULL, name STRING}), (Person)-[:KNOWS {since INT32}]->(Person)}; SESSION SET GRAPH t")
    s.sql("INSERT (a:Person {id: 1, name: 'Alice'})-[:KNOWS {since: 2020}]->(b:Person {id: 2, name: 'Bob'})")
    assert s.sql("MATCH (a:Person)-[r:KNOWS]->(b) RETURN a.name, b.name, r.since").first() == ("Alice", "Bob", 2020)
    for text, message in (("INSERT (:Person {name: 'x'})", "constraint"), ("INSERT (:Robot {id: 1})", "constraint"), ("MATCH (a), (b) INSERT (a)-[:LIKES]->(b)", "constraint"), ("CREATE GRAPH u TYPED {(A {x NOTHING})}", "not supported"), ("CREATE GRAPH u TYPED {(A {x INT}), (A)-[:K]->(B)}", "not defined"), ("CREATE GRAPH t ANY", "already exists")):
        with pytest.raises(GqlError, match=message):
            s.sql(text)
    assert s.sql("MATCH (a) RETURN count(*)").first()[0] == 2


@pytest.mark.parametrize("kind", ["csv", "csv.gz"])
def test_values_with_newlines_and_quotes(spark, tmp_path, kind):
    pack = gzip.compress if kind == "csv.gz" else bytes
    (tmp_path / f"v.{kind}").write_bytes(pack(b'i:ID,note\n1,"two\nlines, ""quoted"""\n2,plain\n'))
    (tmp_path / f"e.{kind}").write_bytes(pack(b":START_ID,:END_ID,:TYPE\n1,2,x\n"))
    s = GraphSession(spark, str(tmp_path / "g"))
    s.sql(f"CREATE GRAPH g ANY; COPY GRAPH g FROM (VERTICES '{tmp_path}/v.{kind}', EDGES '{tmp_path}/e.{kind}') FORMAT GRAPH; SESSION SET GRAPH g")
    assert s.sql("MATCH (a)->(b) RETURN a.note AS x, b.note AS y").first() == ('two\nlines, "quoted"', "plain")
