"""Registered queries over managed graphs: loading, the catalog, mutations and refusals, each with the SQL of its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.durable import shared_folder
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE
from graphloom.plans.tables import OFFSET, business_graph, ring_graph, table
from graphloom.session import GraphSession

Query = Callable[[SparkSession, str], DataFrame]

#: Every node with each of its outgoing edges.
_READ = "MATCH (x) OPTIONAL MATCH (x)-[e]->(y) RETURN x.name AS name, x.size AS size, y.name AS target, e.weight AS weight"
_BASE = "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS size, r_name AS target, CAST(n_nationkey AS BIGINT) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey"
_REGIONS = "SELECT r_name AS name, CAST(NULL AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS weight FROM region"


def places(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A session on a managed graph of all nations and regions, and the edges between them."""
    s = GraphSession(spark)
    g = business_graph(spark, sf_dir)
    s.sql("CREATE GRAPH places ANY")
    v = g.vertices.where(f"array_contains({LABELS}, 'nation') OR array_contains({LABELS}, 'region')")
    nation = F.array_contains(LABELS, "nation")
    offset = F.lit(OFFSET["nation"] + 1)
    v = v.select(ID, LABELS, F.coalesce("n_name", "r_name").alias("name"), F.when(nation, F.col(ID) - offset).alias("size"))
    e = g.edges.where(f"{TYPE} = 'in_region'").select(EDGE_ID, SOURCE, TARGET, TYPE, (F.col(SOURCE) - offset).alias("weight"))
    s.store.publish("places", v, e, 1 << 60, 1 << 61)
    s.sql("SESSION SET GRAPH places")
    return s


def _changed(*statements: str, read: str = _READ) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = places(spark, sf_dir)
        for x in statements:
            s.sql(x)
        return s.sql(read)

    return run


#: name -> (query, SQL)
STORED: dict[str, tuple[Query, str]] = {
    "insert_nodes": (
        _changed("INSERT (:Nation {name: 'A', size: 1}), (:Region {name: 'B'})<-[:IN_REGION {weight: 99}]-(:Nation&Island {name: 'C'})"),
        f"{_BASE} UNION ALL {_REGIONS} UNION ALL SELECT 'A', 1, NULL, NULL UNION ALL SELECT 'B', NULL, NULL, NULL UNION ALL SELECT 'C', NULL, 'B', 99",
    ),
    "insert_path": (
        _changed("MATCH (n:Nation)-[k]->(r) WHERE n.size < 10 INSERT (n)-[:HAS {weight: k.weight + 100}]->(:City {name: n.name || ' CITY'})-[:NEAR]->(r)"),
        f"WITH b AS ({_BASE}) SELECT * FROM b UNION ALL {_REGIONS} UNION ALL SELECT name, size, name || ' CITY', weight + 100 FROM b WHERE size < 10 UNION ALL SELECT name || ' CITY', NULL, target, NULL FROM b WHERE size < 10",
    ),
    "set_record": (
        _changed("MATCH (n:Nation) WHERE n.name > 'NATION_2' SET n = {name: n.name || '!'}"),
        f"SELECT CASE WHEN name > 'NATION_2' THEN name || '!' ELSE name END AS name, CASE WHEN name > 'NATION_2' THEN NULL ELSE size END AS size, target, weight FROM ({_BASE}) UNION ALL {_REGIONS}",
    ),
    "set_merged_record": (
        _changed("MATCH (n:Nation)-[k]->() WHERE n.name > 'NATION_2' SET n += {size: n.size * 2}, k += {weight: -1}"),
        f"SELECT name, CASE WHEN name > 'NATION_2' THEN 2 * size ELSE size END AS size, target, CASE WHEN name > 'NATION_2' THEN -1 ELSE weight END AS weight FROM ({_BASE}) UNION ALL {_REGIONS}",
    ),
    "remove_items": (
        _changed("MATCH (n:Nation) WHERE n.size >= 20 REMOVE n.size, n:Nation", read="MATCH (x) RETURN x.name AS name, x.size AS size, x:Nation AS nation"),
        "SELECT n_name AS name, CAST(CASE WHEN n_nationkey < 20 THEN n_nationkey END AS BIGINT) AS size, n_nationkey < 20 AS nation FROM nation UNION ALL SELECT r_name, NULL, false FROM region",
    ),
    "delete_edges": (
        _changed("MATCH (n:Nation)-[e]->(r) WHERE r.name = 'ASIA' DELETE e", "MATCH (r:Region) WHERE r.name = 'ASIA' NODETACH DELETE r"),
        f"SELECT name, size, CASE WHEN target <> 'ASIA' THEN target END AS target, CASE WHEN target <> 'ASIA' THEN weight END AS weight FROM ({_BASE}) UNION ALL SELECT * FROM ({_REGIONS}) WHERE name <> 'ASIA'",
    ),
    "delete_collections": (
        _changed("MATCH p = (n:Nation)-[e]->(r) WHERE r.name = 'EUROPE' DELETE {all: [p]}.all, NULL", "MATCH (n:Nation)-[e]->() WHERE n.size = 0 DELETE [e, n]"),
        f"SELECT * FROM ({_BASE}) WHERE target <> 'EUROPE' AND size > 0 UNION ALL SELECT * FROM ({_REGIONS}) WHERE name <> 'EUROPE'",
    ),
    "detach_delete": (
        _changed("MATCH (n:Nation) WHERE n.size >= 12 DETACH DELETE n"),
        f"SELECT * FROM ({_BASE}) WHERE size < 12 UNION ALL {_REGIONS}",
    ),
    "merge_nodes": (
        _changed("MERGE (:Nation {name: 'NATION_7'})", "MERGE (:Nation {name: 'ATLANTIS', size: 5})", "MERGE (:Nation {name: 'ATLANTIS', size: 5})", "MERGE (:Nation {name: 'ATLANTIS', size: 6})"),
        f"{_BASE} UNION ALL {_REGIONS} UNION ALL SELECT 'ATLANTIS', 5, NULL, NULL UNION ALL SELECT 'ATLANTIS', 6, NULL, NULL",
    ),
    "transactions": (
        _changed("BEGIN", "INSERT (:Nation {name: 'LOST'})", "ROLLBACK", "BEGIN TRANSACTION", "INSERT (:Nation {name: 'KEPT'})", "MATCH (n:Nation) WHERE n.name = 'KEPT' SET n.size = 77", "COMMIT"),
        f"{_BASE} UNION ALL {_REGIONS} UNION ALL SELECT 'KEPT', 77, NULL, NULL",
    ),
    "property_index": (
        _changed("CALL gql_create_property_index('places', 'NAME')", read="MATCH (n:Nation) WHERE n.name = 'NATION_7' OR n.name = 'NATION_16' RETURN element_id(n) > 0 AS found, n.size AS size"),
        "SELECT true AS found, CAST(n_nationkey AS BIGINT) AS size FROM nation WHERE n_name IN ('NATION_7', 'NATION_16')",
    ),
}


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = places(spark, sf_dir)
    return s.sql("CALL gql_create_property_index('places', 'name'); CALL gql_create_property_index('places', 'name'); CALL gql_create_property_index('places', 'size'); CALL gql_drop_property_index('places', 'size'); CALL gql_property_indexes()").drop("table_name")


def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = places(spark, sf_dir).sql("INSERT (x:Nation&Island {name: 'NEW', size: 7})<-[:NEAR]-(:Nation {name: 'OTHER'}) RETURN x AS created")
    return made.select("created.name", "created.size", F.col("created.__gql_labels").alias("labels"))


def graph_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = places(spark, sf_dir)
    s.sql("CREATE GRAPH empty ANY; MATCH (n:Nation) SET n.size = 0; MATCH (x:Nothing) SET x.size = 1; INSERT (:Nation {name: 'NEW'})")
    return s.sql("SELECT * FROM gql_graphs()").select("graph_name", "graph_version", "vertex_count", "edge_count")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = places(spark, sf_dir)
    s.sql("CREATE GRAPH IF NOT EXISTS places ANY; CREATE GRAPH gone ANY; DROP GRAPH gone; DROP GRAPH IF EXISTS gone; CREATE GRAPH people TYPED {(Person :Person {id INT64 NOT NULL, name STRING}), (Person)-[:KNOWS {since INT32}]->(Person)}; SESSION SET GRAPH people")
    s.sql("INSERT (a:Person {id: 1, name: 'Alice'})-[:KNOWS {since: 2020}]->(b:Person {id: 2})")
    rows = s.sql("MATCH (a:Person)-[k]->(b:Person) RETURN 'row' AS what, a.name AS name, k.since + b.id AS n")
    return rows.unionByName(s.sql("CALL gql_graphs()").select(F.lit("graph").alias("what"), F.col("graph_name").alias("name"), F.col("vertex_count").alias("n")))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the snapshot of kept edges says of itself, and the statistics before and after it."""
    s = places(spark, sf_dir)
    before = s.sql("CALL gql_csr_stats('places')")
    built = s.sql("CALL gql_build_csr('places')")
    after = s.sql("SELECT * FROM gql_csr_stats('places')")
    cols = ["graph_name", "vertex_count", "edge_count", "build_count"]
    parts = [before.select(F.lit("before").alias("what"), *cols, "cached", "has_outgoing"), built.select(F.lit("built").alias("what"), *cols, F.lit(True).alias("cached"), F.lit(True).alias("has_outgoing")), after.select(F.lit("after").alias("what"), *cols, "cached", "has_outgoing")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(content))
    stream.close()


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers and nations, and the edges between them, with typed headers."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    v = customer.select(key("c", "c_custkey").alias("key:ID(Place)"), F.col("c_name").alias("name:string"), F.col("c_acctbal").alias("balance:double"), F.concat(F.lit("Customer; "), "c_mktsegment").alias(":LABEL"))
    v = v.unionByName(nation.select(key("n", "n_nationkey").alias("key:ID(Place)"), F.col("n_name").alias("name:string"), F.lit(None).cast("double").alias("balance:double"), F.lit("Nation").alias(":LABEL")))
    e = customer.select(key("c", "c_custkey").alias(":START_ID(Place)"), key("n", "c_nationkey").alias(":END_ID(Place)"), F.lit("LIVES").alias(":TYPE"), F.col("c_custkey").alias("since:int"))
    return v, e


_LOADED = "MATCH (c:Customer)-[k:LIVES]->(n:Nation) RETURN n.key AS nation, n.name AS name, COUNT(*) AS customers, SUM(k.since) AS since, MIN(c.balance) AS least, COUNT(DISTINCT c.key) AS keys"
_LOADED_SQL = "SELECT 'n' || n_nationkey AS nation, n_name AS name, count(*) AS customers, CAST(sum(c_custkey) AS BIGINT) AS since, min(c_acctbal) AS least, count(DISTINCT c_custkey) AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"


def _load(spark: SparkSession, vertices: str, edges: str, options: str = "") -> GraphSession:
    s = GraphSession(spark)
    s.sql(f"CREATE GRAPH loaded ANY; COPY GRAPH loaded FROM (VERTICES '{vertices}', EDGES '{edges}') FORMAT GRAPH {options}; SESSION SET GRAPH loaded")
    return s


def _loader(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
        for name, df in zip("ve", _files(spark, sf_dir)):
            path = f"{folder}/{name}.{kind}"
            if kind == "parquet":
                df.write.parquet(path)
            else:
                df.write.option("header", True).option("escape", '"').option("compression", "gzip" if kind.endswith("gz") else "none").csv(path)
        return _load(spark, f"{folder}/v.{kind}", f"{folder}/e.{kind}").sql(_LOADED)

    return run


def load_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions from compressed files, with quoted delimiters in the names."""
    import zstandard

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    v = nation.selectExpr("'n' || n_nationkey AS k", "n_name AS x", "'Nation' AS l").unionByName(region.selectExpr("'r' || r_regionkey AS k", "r_name AS x", "'Region;Place' AS l"))
    lines = [f'{r.k},"{r.x}, ""the""",{r.l}' for r in v.collect()]
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _put(spark, f"{folder}/v.csv.zst", zstandard.compress("\n".join([":ID,name,:LABEL", *lines]).encode()))
    _put(spark, f"{folder}/e.csv.zst", zstandard.compress("\n".join([":START_ID,:END_ID,:TYPE,weight:long", *[f"n{r.n_nationkey},r{r.n_regionkey},In,{r.n_nationkey}" for r in nation.collect()]]).encode()))
    return _load(spark, f"{folder}/v.csv.zst", f"{folder}/e.csv.zst").sql("MATCH (n:Nation)-[k:IN]->(r:Place) RETURN n.name AS nation, r.name AS region, k.weight AS weight")


def load_unvalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are unknown stay, with NULL ends that no pattern matches."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    v, e = _files(spark, sf_dir)
    v.where("`:LABEL` <> 'Nation' OR `name:string` <> 'NATION_7'").write.parquet(f"{folder}/v.parquet")
    e.write.parquet(f"{folder}/e.parquet")
    s = _load(spark, f"{folder}/v.parquet", f"{folder}/e.parquet", "OPTIONS (VALIDATE FALSE)")
    kept = s.graph().edges.agg(F.count("*").alias("edges"), F.count(SOURCE).alias("sources"), F.count(TARGET).alias("targets"))
    return kept.crossJoin(s.sql("MATCH (c)-[k]->(n) RETURN COUNT(*) AS matched"))


def _refusals(spark: SparkSession, cases: list[tuple[str, Callable[[], object]]]) -> DataFrame:
    """What each case is refused with."""
    rows = []
    for name, run in cases:
        try:
            run()
            rows.append((name, None))
        except GqlError as e:
            rows.append((name, str(e).splitlines()[0]))
    return spark.createDataFrame(rows, "what string, message string")


_BAD_FILES = {
    "repeated id": ("i:ID\n1\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "", "GQL node :ID values must be unique and not NULL"),
    "missing id": ("i:ID,n\n1,a\n,b\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "", "GQL node :ID values must be unique and not NULL"),
    "unknown end": ("i:ID\n1\n", ":START_ID,:END_ID,:TYPE\n1,9,x\n", "", "GQL relationship endpoints must reference imported nodes"),
    "two types": ("i:ID\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,A;B\n", "", "GQL relationships need exactly one non-empty type"),
    "two types unvalidated": ("i:ID\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,A;B\n", "OPTIONS (VALIDATE FALSE)", "GQL relationships need exactly one non-empty type"),
    "no type unvalidated": ("i:ID\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,\n", "OPTIONS (VALIDATE FALSE)", "GQL relationships need exactly one non-empty type"),
    "other groups": ("i:ID(A)\n1\n", ":START_ID(B),:END_ID(B),:TYPE\n1,1,x\n", "", "GQL :ID groups of vertices and edges must be equal"),
    "no id column": ("i\n1\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "", "GQL header lacks :ID"),
    "unknown type": ("i:ID,x:nothing\n1,2\n", ":START_ID,:END_ID,:TYPE\n1,1,x\n", "", "GQL property type 'nothing' is not supported"),
}


def load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    cases = []
    for i, (name, (v, e, options, _)) in enumerate(_BAD_FILES.items()):
        for x, text in (("v", v), ("e", e)):
            _put(spark, f"{folder}/{x}{i}.csv", text.encode())
        cases.append((name, lambda i=i, options=options: _load(spark, f"{folder}/v{i}.csv", f"{folder}/e{i}.csv", options)))
    return _refusals(spark, cases)


#: name -> (statements, message); all but the last statement are accepted
_BAD_CHANGES = {
    "unmapped in SET": (["MATCH (n) SET n.size = 1, n.nothing = 2"], "GQL property 'nothing' is not mapped"),
    "unmapped in INSERT": (["INSERT (:Nation {nothing: 1})"], "GQL property 'nothing' is not mapped"),
    "aggregate in SET": (["MATCH (n) SET n.size = COUNT(n)"], "GQL aggregate functions are not allowed in SET"),
    "label of an edge": (["MATCH ()-[k]->() SET k:Other"], "GQL edges have exactly one immutable type"),
    "edge of two types": (["INSERT (:Nation)-[:A&B]->(:Nation)"], "GQL inserted edges need exactly one type"),
    "bound node with labels": (["MATCH (n:Nation) INSERT (n:Other)-[:K]->(:Nation)"], "GQL bound variable 'n' cannot have labels or properties in INSERT"),
    "delete with edges": (["MATCH (r:Region) DELETE r"], "GQL nodes with edges cannot be deleted; use DETACH DELETE"),
    "delete of a number": (["MATCH (r:Region) DELETE [r, 1 + 1]"], "GQL DELETE targets must be nodes, edges, paths or collections of them"),
    "create in a transaction": (["BEGIN", "CREATE GRAPH other ANY"], "GQL CREATE GRAPH cannot run inside a transaction"),
    "drop in a transaction": (["BEGIN", "DROP GRAPH places"], "GQL DROP GRAPH cannot run inside a transaction"),
    "index in a transaction": (["BEGIN", "CALL gql_create_property_index('places', 'name')"], "GQL index creation cannot run inside a transaction"),
    "two transactions": (["BEGIN", "BEGIN"], "GQL transaction is already open"),
    "no transaction": (["COMMIT"], "GQL no transaction is open"),
    "graph exists": (["CREATE GRAPH places ANY"], "GQL graph 'places' already exists"),
    "no such graph": (["SESSION SET GRAPH nowhere"], "GQL graph 'nowhere' does not exist"),
    "graph is not empty": (["COPY GRAPH places FROM (VERTICES 'v.csv', EDGES 'e.csv') FORMAT GRAPH"], "GQL graph 'places' must be empty before COPY GRAPH"),
}


def mutation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and that the graph stays as it was."""
    s = places(spark, sf_dir)

    def attempt(statements: list[str]) -> None:
        try:
            for x in statements:
                s.sql(x)
        finally:
            if s.store.staged is not None:
                s.sql("ROLLBACK")

    out = _refusals(spark, [(name, lambda x=x: attempt(x)) for name, (x, _) in _BAD_CHANGES.items()])
    left = s.sql("MATCH (x) RETURN COUNT(*) AS n, SUM(x.size) AS total").select(F.lit("left").alias("what"), F.concat_ws(" ", "n", "total").alias("message"))
    return out.unionByName(left)


_BAD_READS = {
    "sort key that DISTINCT hides": ("MATCH (n) RETURN DISTINCT n.name AS n ORDER BY n.size", "GQL ORDER BY expressions must appear in RETURN when DISTINCT or CALL is used"),
    "nothing to return": ("MATCH () RETURN *", "GQL RETURN * requires at least one visible variable"),
    "name of a later clause": ("MATCH (n) FILTER m.size = 1 MATCH (n)->(m) RETURN m.name", "GQL binding variable 'm' is not defined"),
    "path over a quantifier": ("MATCH p = (a)-[]->+(b) RETURN p", "GQL feature not implemented: GQL quantified path value projection"),
    "path variable twice": ("MATCH p = (p) RETURN p", "GQL path variable 'p' is already defined"),
    "aggregate in WHERE": ("MATCH (n) WHERE COUNT(n) > 1 RETURN n", "GQL aggregate functions are not allowed in a predicate"),
    "nested aggregate": ("MATCH (n) RETURN SUM(COUNT(n))", "GQL aggregate functions cannot be nested"),
    "aggregate in LET": ("MATCH (n) LET c = COUNT(n) RETURN c", "GQL aggregate functions are not allowed in LET"),
    "LET twice": ("MATCH (n) LET n = 1 RETURN n", "GQL binding variable 'n' is already defined"),
    "node and edge": ("MATCH (a)-[a]->(b) RETURN b", "GQL variable 'a' is used as node and as edge"),
}
_UNSUPPORTED = {
    "undirected": "MATCH (a)~[b]~(c) RETURN a", "IN": "MATCH (a) WHERE a.x IN [1] RETURN a", "CASE": "MATCH (a) RETURN CASE WHEN true THEN 1 END", "group variable": "MATCH (a)-[e]->{1,2}(b) RETURN e",
    "no lower bound": "MATCH (a)->{,2}(b) RETURN a", "quantifier from zero": "MATCH (a)->{0,2}(b) RETURN a", "delimited": 'MATCH ("a") RETURN 1', "COLLECT_LIST": "MATCH (a) RETURN COLLECT_LIST(a.x)", "STDDEV_POP": "MATCH (a) RETURN STDDEV_POP(a.x)",
    "GROUP BY with *": "MATCH (a) RETURN * GROUP BY a", "MERGE ON CREATE": "MERGE (:Nation {name: 'x'}) ON CREATE SET x.name = 'y'",
}


def language_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = places(spark, sf_dir)
    refused = _refusals(spark, [(name, lambda x=x: s.sql(x)) for name, (x, _) in _BAD_READS.items()])
    open_ = _refusals(spark, [(name, lambda x=x: s.sql(x)) for name, x in _UNSUPPORTED.items()])
    hint = _refusals(spark, [("hint", lambda: s.sql("/*+ CSR */ MATCH (a) RETURN a"))])
    cut = F.regexp_replace("message", r" \(line.*\)$", "").alias("message")
    started = F.substring("message", 1, 27).alias("message")
    return refused.select("what", cut).unionByName(open_.select("what", started)).unionByName(hint.select("what", F.contains("message", F.lit("hint")).cast("string").alias("message")))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts each form of EXPLAIN gives."""
    s = places(spark, sf_dir)
    forms = {"plain": "EXPLAIN", "analyze": "EXPLAIN ANALYZE", "json": "EXPLAIN (FORMAT JSON)", "both": "EXPLAIN (ANALYZE, FORMAT JSON)", "call": "EXPLAIN"}
    parts = None
    for name, form in forms.items():
        what = "CALL algo.degree('places')" if name == "call" else "MATCH (n:Nation)-[e]->(r) RETURN n.name, r.name"
        text = F.col("explain")
        one = s.sql(f"{form} {what}").select(F.lit(name).alias("form"), F.contains(text, F.lit("Join")).alias("joins"), text.startswith("{").alias("json"), F.regexp_like(text, F.lit('rows"?: 25')).alias("counted"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).sql("/*+ NATIVE */ MATCH (n:Nation)-[e]->(r) RETURN r.name AS region, COUNT(e) AS nations")


def _ring(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = GraphSession(spark)
        s.register(ring_graph(spark, sf_dir))
        return s.sql(text)

    return run


def _values(rows: list[tuple[str, str]]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows) + ") t(what, message)"


_SAME_REGION = "nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"
STORED |= {
    "index_catalog": (_indexes, "SELECT 'places' AS graph_name, 'name' AS property_name, 'places_name_idx' AS index_name, 'name' AS column_name"),
    "insert_returning": (insert_returning, "SELECT 'NEW' AS name, CAST(7 AS BIGINT) AS size, 'nation;island' AS labels"),
    "graph_list": (graph_list, "SELECT 'places' AS graph_name, CAST(4 AS BIGINT) AS graph_version, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1 AS vertex_count, (SELECT count(*) FROM nation) AS edge_count UNION ALL SELECT 'empty', 1, 0, 0"),
    "catalog": (catalog, "SELECT 'row' AS what, 'Alice' AS name, CAST(2022 AS BIGINT) AS n UNION ALL SELECT 'graph', 'people', 2 UNION ALL SELECT 'graph', 'places', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)"),
    "snapshot": (snapshot, "SELECT what, 'places' AS graph_name, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS vertex_count, (SELECT count(*) FROM nation) AS edge_count, CAST(CASE WHEN what = 'before' THEN 0 ELSE 1 END AS BIGINT) AS build_count, what <> 'before' AS cached, what <> 'before' AS has_outgoing FROM (VALUES ('before'), ('built'), ('after')) t(what)"),
    "load_csv": (_loader("csv"), _LOADED_SQL),
    "load_gzip": (_loader("csv.gz"), _LOADED_SQL),
    "load_zstd": (load_zstd, "SELECT n_name || ', \"the\"' AS nation, r_name || ', \"the\"' AS region, CAST(n_nationkey AS BIGINT) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "load_parquet": (_loader("parquet"), _LOADED_SQL),
    "load_unvalidated": (load_unvalidated, "SELECT count(*) AS edges, count(*) AS sources, count(*) FILTER (n_name <> 'NATION_7') AS targets, count(*) FILTER (n_name <> 'NATION_7') AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "load_errors": (load_errors, _values([(k, x[3]) for k, x in _BAD_FILES.items()])),
    "mutation_errors": (mutation_errors, _values([(k, x[1]) for k, x in _BAD_CHANGES.items()]) + " UNION ALL SELECT 'left', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) || ' ' || (SELECT sum(n_nationkey) FROM nation)"),
    "language_errors": (language_errors, _values([*[(k, x[1]) for k, x in _BAD_READS.items()], *[(k, "GQL feature not implemented") for k in _UNSUPPORTED], ("hint", "true")])),
    "explain_forms": (explained, "SELECT * FROM (VALUES ('plain', true, false, false), ('analyze', true, false, true), ('json', true, true, false), ('both', true, true, true), ('call', true, false, false)) t(form, joins, json, counted)"),
    "native_hint": (hinted, "SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    # each region's nations lie on a ring, so a trail goes round once and ends where it began
    "ring_closed": (_ring("MATCH (a:Nation)->*(a) RETURN a.n_name AS nation, COUNT(*) AS n"), "SELECT n_name AS nation, CAST(2 AS BIGINT) AS n FROM nation"),
    "ring_plus": (_ring("MATCH (a:Nation)->+(b:Nation) RETURN a.n_name AS a, b.n_name AS b"), f"SELECT a.n_name AS a, b.n_name AS b FROM {_SAME_REGION}"),
    "ring_at_least": (
        _ring("MATCH (a:Nation)->{3,}(b:Nation) RETURN a.n_name AS a, b.n_name AS b"),
        f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation) SELECT a.n_name AS a, b.n_name AS b FROM r a JOIN r b ON a.n_regionkey = b.n_regionkey WHERE (b.i - a.i + a.m - 1) % a.m + 1 >= 3",
    ),
    "ring_bfs": (
        _ring("MATCH (a:Nation) FILTER a.n_name = 'NATION_7' CALL algo.bfs('ring', element_id(a)) YIELD n_name, depth, visit_order RETURN n_name AS nation, depth, visit_order"),
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation) SELECT b.n_name AS nation, CAST((b.i - a.i + a.m) % a.m AS INTEGER) AS depth, (b.i - a.i + a.m) % a.m AS visit_order FROM r a JOIN r b ON a.n_regionkey = b.n_regionkey WHERE a.n_name = 'NATION_7'",
    ),
    "ring_dfs": (
        _ring("MATCH (a:Nation) FILTER a.n_name = 'NATION_7' CALL algo.dfs('ring', element_id(a)) YIELD n_name, depth, visit_order RETURN n_name AS nation, depth, visit_order"),
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation) SELECT b.n_name AS nation, CAST((b.i - a.i + a.m) % a.m AS INTEGER) AS depth, (b.i - a.i + a.m) % a.m AS visit_order FROM r a JOIN r b ON a.n_regionkey = b.n_regionkey WHERE a.n_name = 'NATION_7'",
    ),
    "ring_louvain": (
        _ring("CALL algo.louvain('ring') YIELD n_regionkey, community_id, community_size RETURN n_regionkey AS region, COUNT(DISTINCT community_id) AS communities, MIN(community_size) AS size"),
        "SELECT n_regionkey AS region, CAST(1 AS BIGINT) AS communities, count(*) AS size FROM nation GROUP BY n_regionkey",
    ),
    "ring_scc": (
        _ring("CALL algo.scc('ring') YIELD n_regionkey, component_id, component_size RETURN n_regionkey AS region, COUNT(DISTINCT component_id) AS components, MAX(component_size) AS size"),
        "SELECT n_regionkey AS region, CAST(1 AS BIGINT) AS components, count(*) AS size FROM nation GROUP BY n_regionkey",
    ),
}
