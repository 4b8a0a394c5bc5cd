"""The registered queries over the driver's tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.store_queries import STORED
from graphloom.plans.tables import OFFSET, business_graph, part_graph
from graphloom.session import GraphSession

Query = Callable[[SparkSession, str], DataFrame]


def session(spark: SparkSession, sf_dir: str, parts: bool = False) -> GraphSession:
    s = GraphSession(spark)
    if parts:
        s.register(part_graph(spark, sf_dir))
    else:
        s.register(business_graph(spark, sf_dir))
    return s


def _id(kind: str, key: str) -> str:
    return f"(CAST({key} AS BIGINT) + {OFFSET[kind] + 1})"


#: name -> (statement, SQL)
MATCHES: dict[str, tuple[str, str]] = {
    "scan_filter": (
        "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 5000 RETURN element_id(c) AS id, c.c_name AS name, c.c_acctbal AS balance",
        f"SELECT {_id('customer', 'c_custkey')} AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    ),
    "edge_out": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region",
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "edge_in": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN r.r_name AS region, COUNT(s) AS suppliers",
        "SELECT r_name AS region, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name",
    ),
    "edge_any": (
        "MATCH (n:Nation)-[e]-(x) RETURN n.n_name AS nation, COUNT(*) AS links",
        "SELECT n_name AS nation, CAST(1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS links FROM nation",
    ),
    "edge_properties": (
        "MATCH (o:Order)-[k:CONTAINS]->(p:Part) WHERE k.quantity >= 49 AND k.discount > 0.05 RETURN p.p_brand AS brand, COUNT(*) AS lines, SUM(k.quantity) AS quantity, MAX(k.price) AS price",
        "SELECT p_brand AS brand, count(*) AS lines, sum(l_quantity) AS quantity, max(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49 AND l_discount > 0.05 GROUP BY p_brand",
    ),
    "multi_hop": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[k:CONTAINS]->(p:Part) WHERE c.c_mktsegment = 'MACHINERY' RETURN p.p_type AS kind, COUNT(*) AS lines, COUNT(DISTINCT c) AS customers, AVG(k.quantity) AS quantity",
        "SELECT p_type AS kind, count(*) AS lines, count(DISTINCT c_custkey) AS customers, avg(l_quantity) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY' GROUP BY p_type",
    ),
    "comma_patterns": (
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation), (c:Customer)-[:IN_NATION]->(n) RETURN n.n_name AS nation, COUNT(DISTINCT s) AS suppliers, COUNT(DISTINCT c) AS customers, COUNT(*) AS pairs",
        "SELECT n_name AS nation, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers, count(*) AS pairs FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "cross_product": (
        "MATCH (a:Region), (b:Region) WHERE a.r_name < b.r_name RETURN a.r_name AS a, b.r_name AS b",
        "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name",
    ),
    "cyclic_pattern": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:SUPPLIED]-(s:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(c) RETURN n.n_name AS nation, COUNT(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON x.l_suppkey = s_suppkey JOIN lineitem l ON l.l_partkey = x.l_partkey JOIN orders ON o_orderkey = l.l_orderkey AND o_custkey = c_custkey GROUP BY n_name",
    ),
    "cyclic_from_customers": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIED]->(p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c) RETURN n.n_name AS nation, COUNT(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON x.l_suppkey = s_suppkey JOIN lineitem l ON l.l_partkey = x.l_partkey JOIN orders ON o_orderkey = l.l_orderkey AND o_custkey = c_custkey GROUP BY n_name",
    ),
    "leading_optional": (
        "OPTIONAL MATCH (c:Customer) WHERE c.c_acctbal > 1000000 RETURN c.c_name AS customer, COUNT(*) AS n",
        "SELECT CAST(NULL AS VARCHAR) AS customer, CAST(1 AS BIGINT) AS n",
    ),
    "match_after_optional": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 MATCH (o)-[:CONTAINS]->(p:Part) RETURN c.c_name AS customer, COUNT(*) AS lines",
        "SELECT c_name AS customer, count(*) AS lines FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY c_name",
    ),
    "default_names": (
        "MATCH (n:Nation) RETURN n.n_name, element_id(n), n.n_name || '!'",
        f"""SELECT n_name AS "n.n_name", {_id('nation', 'n_nationkey')} AS "element_id(n)", n_name || '!' AS expression FROM nation""",
    ),
    "distinct_aggregates": (
        "MATCH (p:Part) RETURN p.p_brand AS brand, SUM(DISTINCT p.p_size) AS total, AVG(DISTINCT p.p_size) AS middle, MIN(DISTINCT p.p_type) AS first, MAX(DISTINCT p.p_type) AS last, COUNT(DISTINCT p.p_type) AS kinds",
        "SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS total, avg(DISTINCT p_size) AS middle, min(p_type) AS first, max(p_type) AS last, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand",
    ),
    "group_by": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, COUNT(*) AS n GROUP BY c",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "constructors": (
        "MATCH (p:Part) LET r = {size: p.p_size, inner: {brand: p.p_brand}}, twice = r.size * 2, brand = r.inner.brand RETURN brand AS brand, twice AS twice, r.missing IS NULL AS missing, SQRT(r.size) AS root",
        "SELECT p_brand AS brand, p_size * 2 AS twice, true AS missing, sqrt(p_size) AS root FROM part",
    ),
    "null_order": (
        "MATCH (x) WHERE x:Region OR x:Nation RETURN x.n_name AS nation, x.r_name AS region ORDER BY nation DESC, region LIMIT 28",
        "SELECT * FROM (SELECT n_name AS nation, NULL AS region FROM nation UNION ALL SELECT NULL, r_name FROM region) ORDER BY nation DESC NULLS LAST, region LIMIT 28",
    ),
    "trail": (
        "MATCH (a:Nation)-[x:IN_REGION]->(r:Region)<-[y:IN_REGION]-(b:Nation) RETURN a.n_name AS a, b.n_name AS b",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "theta_join": (
        "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Supplier) WHERE a.s_acctbal > b.s_acctbal + 1000 RETURN n.n_name AS nation, COUNT(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier a ON a.s_nationkey = n_nationkey JOIN supplier b ON b.s_nationkey = n_nationkey WHERE a.s_acctbal > b.s_acctbal + 1000 AND a.s_suppkey <> b.s_suppkey GROUP BY n_name",
    ),
    "second_match": (
        "MATCH (n:Nation) WHERE n.n_name > 'M' MATCH (c:Customer)-[:IN_NATION]->(n) FILTER c.c_acctbal < 0 RETURN n.n_name AS nation, c.c_name AS customer",
        "SELECT n_name AS nation, c_name AS customer FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name > 'M' AND c_acctbal < 0",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN c.c_name AS customer, COUNT(o) AS orders, MAX(o.o_totalprice) AS most",
        "SELECT c_name AS customer, count(o_orderkey) AS orders, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_name",
    ),
    "optional_chain": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIED]->(p:Part) FILTER p.p_size > 45 RETURN n.n_name AS nation, COUNT(p) AS parts",
        "SELECT n_name AS nation, count(p_partkey) AS parts FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey, l_suppkey, l_partkey, p_partkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey AND p_size > 45) x ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "anti_join": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 LET none = element_id(o) FILTER none IS NULL RETURN c.c_name AS customer",
        "SELECT c_name AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "let_bindings": (
        "MATCH (p:Part) LET tax = p.p_retailprice * 2, big = tax > 1900 FILTER big AND p.p_size < 10 RETURN p.p_name AS name, tax AS doubled",
        "SELECT p_name AS name, p_retailprice * 2 AS doubled FROM part WHERE p_retailprice * 2 > 1900 AND p_size < 10",
    ),
    "return_distinct": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT c.c_mktsegment AS segment, n.n_name AS nation",
        "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "order_limit": (
        "MATCH (o:Order) RETURN element_id(o) AS id, o.o_totalprice AS price ORDER BY price DESC, id OFFSET 5 LIMIT 20",
        f"SELECT {_id('order', 'o_orderkey')} AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 20 OFFSET 5",
    ),
    "hidden_order_key": (
        "MATCH (c:Customer) RETURN c.c_name AS name ORDER BY c.c_acctbal, c.c_name LIMIT 10",
        "SELECT c_name AS name FROM customer ORDER BY c_acctbal, c_name LIMIT 10",
    ),
    "aggregate_expressions": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS segment, COUNT(o) * 10 + COUNT(DISTINCT c) AS score, COUNT(*) > 100 AS many, MIN(o.o_orderdate) AS first",
        "SELECT c_mktsegment AS segment, count(*) * 10 + count(DISTINCT c_custkey) AS score, count(*) > 100 AS many, min(o_orderdate) AS first FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ),
    "empty_aggregate": (
        "MATCH (c:Missing) RETURN COUNT(*) AS n, SUM(c.c_acctbal) AS total",
        "SELECT count(*) AS n, sum(c_acctbal) AS total FROM customer WHERE false",
    ),
    "scalar_functions": (
        "MATCH (c:Customer) RETURN UPPER(c.c_name) AS a, LOWER(c.c_mktsegment) AS b, LEFT(c.c_name, 4) AS c, RIGHT(c.c_name, 3) AS d, CHAR_LENGTH(c.c_name) AS e, ABS(c.c_acctbal) AS f, CEIL(c.c_acctbal) AS g, FLOOR(c.c_acctbal) AS h, LEFT(c.c_name, -2) AS i, RIGHT(c.c_name, -2) AS j, TRIM(BOTH 'C' FROM c.c_name) AS k, LTRIM(c.c_name, 'Cu') AS l, c.c_name || '!' AS m, NORMALIZE(c.c_name) AS n",
        "SELECT upper(c_name) AS a, lower(c_mktsegment) AS b, left(c_name, 4) AS c, right(c_name, 3) AS d, CAST(length(c_name) AS INTEGER) AS e, abs(c_acctbal) AS f, ceil(c_acctbal) AS g, floor(c_acctbal) AS h, left(c_name, -2) AS i, right(c_name, -2) AS j, trim(c_name, 'C') AS k, ltrim(c_name, 'Cu') AS l, c_name || '!' AS m, nfc_normalize(c_name) AS n FROM customer",
    ),
    "arithmetic": (
        "MATCH (p:Part) RETURN element_id(p) AS id, p.p_size / 7 AS a, MOD(p.p_size, 7) AS b, -p.p_size + 3 AS c, p.p_size * p.p_size - 1 AS d, p.p_size > 10 XOR p.p_size < 40 AS e, COALESCE(p.nothing, p.p_brand) AS f",
        f"SELECT {_id('part', 'p_partkey')} AS id, p_size / 7 AS a, p_size % 7 AS b, -p_size + 3 AS c, p_size * p_size - 1 AS d, (p_size > 10) <> (p_size < 40) AS e, p_brand AS f FROM part",
    ),
    "label_predicate": (
        "MATCH (n:Nation)-[e]-(x) WHERE NOT x:Customer AND (x IS LABELED Supplier OR x:Region) RETURN n.n_name AS nation, x:Region AS region, COUNT(*) AS n",
        "SELECT n_name AS nation, true AS region, CAST(1 AS BIGINT) AS n FROM nation UNION ALL SELECT n_name, false, count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "fixed_length_path": (
        "MATCH (s:Supplier)->{2}(r:Region) RETURN s.s_name AS supplier, r.r_name AS region",
        "SELECT s_name AS supplier, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "range_path": (
        "MATCH (s:Supplier)->{1,2}(x) WHERE x:Nation OR x:Region RETURN s.s_name AS supplier, COALESCE(x.n_name, x.r_name) AS place",
        "SELECT s_name AS supplier, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "star_path": (
        "MATCH (n:Nation)->*(x) RETURN n.n_name AS nation, COALESCE(x.n_name, x.r_name) AS place",
        "SELECT n_name AS nation, n_name AS place FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "plus_path": (
        "MATCH (c:Customer)->+(x) WHERE c.c_acctbal > 9000 RETURN COALESCE(x.n_name, x.r_name, x.o_orderpriority, x.p_brand) AS what, COUNT(*) AS n",
        "WITH c AS (SELECT * FROM customer WHERE c_acctbal > 9000) SELECT what, count(*) AS n FROM (SELECT n_name AS what FROM c JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name FROM c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT o_orderpriority FROM c JOIN orders ON o_custkey = c_custkey UNION ALL SELECT p_brand FROM c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) GROUP BY what",
    ),
    "at_least_path": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-{1,}(x:Supplier) RETURN r.r_name AS region, COUNT(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name",
    ),
}

_NEXT = f"next AS (SELECT {_id('part', 'a.l_partkey')} AS s, {_id('part', 'b.l_partkey')} AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1), v AS (SELECT {_id('part', 'p_partkey')} AS id FROM part)"
_SIMPLE = _NEXT + ", d AS (SELECT DISTINCT s, t FROM next WHERE s <> t), u AS (SELECT s, t FROM d UNION SELECT t, s FROM d), deg AS (SELECT s AS id, count(*) AS degree FROM u GROUP BY s)"
_START = OFFSET["part"] + 1
_BFS = f"WITH RECURSIVE {_NEXT}, walk AS (SELECT CAST({_START} AS BIGINT) AS id, 0 AS depth UNION SELECT t, depth + 1 FROM walk JOIN next ON s = id WHERE depth < 14)"


#: All vertices and edges of the business graph.
_VERTICES = "v AS (" + " UNION ALL ".join(f"SELECT {_id(kind, key)} AS id FROM {name}" for kind, name, key in (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("supplier", "supplier", "s_suppkey"), ("customer", "customer", "c_custkey"), ("part", "part", "p_partkey"), ("order", "orders", "o_orderkey"))) + ")"
_EDGES = "e AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS edge_label, {_id(a, x)} AS s, {_id(b, y)} AS t FROM {name}"
    for kind, a, x, b, y, name in (
        ("in_region", "nation", "n_nationkey", "region", "n_regionkey", "nation"), ("in_nation", "customer", "c_custkey", "nation", "c_nationkey", "customer"), ("in_nation", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier"),
        ("placed", "customer", "o_custkey", "order", "o_orderkey", "orders"), ("contains", "order", "l_orderkey", "part", "l_partkey", "lineitem"), ("supplied", "supplier", "l_suppkey", "part", "l_partkey", "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x"),
    )
) + ")"

#: Every turn's ranks until their summed change is within the tolerance.
_PAGERANK = f"""WITH RECURSIVE {_NEXT}, n AS (SELECT count(*) AS n FROM v), w AS (SELECT s, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) AS w FROM next), loose AS (SELECT id FROM v WHERE id NOT IN (SELECT s FROM next)),
r(turn, id, rank, done) AS (SELECT 0, id, 1.0::DOUBLE / n, false FROM v, n UNION ALL SELECT turn + 1, id, new, sum(abs(new - old)) OVER () <= 1e-8 FROM (
  SELECT o.turn, o.id, o.rank AS old, 0.15::DOUBLE / n.n + 0.85::DOUBLE * d.d / n.n + 0.85::DOUBLE * coalesce(g.g, 0) AS new
  FROM r o CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(rank), 0) AS d FROM r WHERE id IN (SELECT id FROM loose)) d LEFT JOIN (SELECT t, sum(rank * w) AS g FROM r JOIN w ON r.id = w.s GROUP BY t) g ON g.t = o.id WHERE NOT o.done AND o.turn < 100))
SELECT id AS vertex_id, round(rank, 9) AS rank, CAST(turn AS BIGINT) AS iterations, done AS converged FROM r WHERE turn = (SELECT max(turn) FROM r)"""


#: name -> (statement, SQL or None)
CALLS: dict[str, tuple[str, str | None]] = {
    "algo_bfs": (f"CALL algo.bfs('parts', {_START}) YIELD vertex_id, depth RETURN vertex_id, depth", _BFS + " SELECT id AS vertex_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id"),
    "algo_sssp": (f"CALL algo.sssp('parts', {_START}) YIELD vertex_id, distance RETURN vertex_id, distance", _BFS + " SELECT id AS vertex_id, CAST(min(depth) AS INTEGER) AS distance FROM walk GROUP BY id"),
    "algo_dfs": (f"CALL algo.dfs('parts', {_START})", None),
    "algo_wcc": (
        "CALL algo.wcc('business')",
        f"WITH RECURSIVE {_EDGES}, {_VERTICES}, u AS (SELECT s, t FROM e UNION SELECT t, s FROM e), c(id, root) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT u.t, min(c.root) FROM c JOIN u ON u.s = c.id JOIN recurring.c AS r ON r.id = u.t WHERE c.root < r.root GROUP BY u.t) SELECT id AS vertex_id, root AS component_id, count(*) OVER (PARTITION BY root) AS component_size FROM c",
    ),
    "algo_wcc_in_nation": (
        "CALL algo.wcc('business', edge_label := 'in_nation')",
        f"WITH m AS (SELECT {_id('nation', 'n_nationkey')} AS id, {_id('nation', 'n_nationkey')} AS root FROM nation UNION ALL SELECT {_id('customer', 'c_custkey')}, {_id('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {_id('supplier', 's_suppkey')}, {_id('nation', 's_nationkey')} FROM supplier UNION ALL SELECT {_id('region', 'r_regionkey')}, {_id('region', 'r_regionkey')} FROM region UNION ALL SELECT {_id('part', 'p_partkey')}, {_id('part', 'p_partkey')} FROM part UNION ALL SELECT {_id('order', 'o_orderkey')}, {_id('order', 'o_orderkey')} FROM orders) SELECT id AS vertex_id, root AS component_id, count(*) OVER (PARTITION BY root) AS component_size FROM m",
    ),
    "algo_closeness": (
        "CALL algo.closeness('business')",
        f"WITH RECURSIVE {_EDGES}, {_VERTICES}, a AS (SELECT DISTINCT s, t FROM e), w AS (SELECT s AS src, t AS v, 1 AS d FROM a UNION SELECT src, t, d + 1 FROM w JOIN a ON s = w.v), best AS (SELECT src, v, min(d) AS d FROM w WHERE src <> v GROUP BY src, v), own AS (SELECT src, count(*) AS r, CAST(sum(d) AS BIGINT) AS d FROM best GROUP BY src) "
        "SELECT id AS vertex_id, coalesce(r, 0) AS reachable_count, coalesce(d, 0) AS distance_sum, CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE r * r / ((SELECT count(*) - 1 FROM v) * d) END AS closeness_centrality FROM v LEFT JOIN own ON src = id",
    ),
    "yield_properties": (
        "CALL algo.degree('parts') YIELD vertex_id, p_brand, out_degree RETURN p_brand AS brand, SUM(out_degree) AS links, COUNT(vertex_id) AS parts",
        f"WITH {_NEXT} SELECT p_brand AS brand, CAST(sum((SELECT count(*) FROM next WHERE s = {_id('part', 'p_partkey')})) AS BIGINT) AS links, count(*) AS parts FROM part GROUP BY p_brand",
    ),
    "batch_call": (
        "MATCH (a:Part) FILTER a.p_brand = 'Brand#11' CALL algo.bfs('parts', element_id(a)) YIELD vertex_id, depth RETURN depth, COUNT(*) AS n",
        f"WITH RECURSIVE {_NEXT}, walk AS (SELECT {_id('part', 'p_partkey')} AS id, 0 AS depth FROM part WHERE p_brand = 'Brand#11' UNION SELECT t, depth + 1 FROM walk JOIN next ON s = id WHERE depth < 14) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM walk GROUP BY id) GROUP BY depth",
    ),
    "algo_scc": (
        "CALL algo.scc('parts')",
        f"WITH RECURSIVE {_NEXT}, a AS (SELECT DISTINCT s, t FROM next WHERE s <> t), w AS (SELECT s, t FROM a UNION SELECT w.s, a.t FROM w JOIN a ON a.s = w.t), m AS (SELECT v.id, least(v.id, coalesce(min(x.t), v.id)) AS root FROM v LEFT JOIN (SELECT p.s, p.t FROM w p JOIN w q ON p.s = q.t AND p.t = q.s) x ON x.s = v.id GROUP BY v.id) SELECT id AS vertex_id, root AS component_id, count(*) OVER (PARTITION BY root) AS component_size FROM m",
    ),
    "algo_scc_business": (
        "CALL algo.scc('business')",
        f"WITH {_VERTICES} SELECT id AS vertex_id, id AS component_id, CAST(1 AS BIGINT) AS component_size FROM v",
    ),
    "algo_louvain": ("CALL algo.louvain('parts')", None),
    "algo_degree": (
        "CALL algo.degree('parts')",
        f"WITH {_NEXT} SELECT v.id AS vertex_id, (SELECT count(*) FROM next WHERE s = v.id) AS out_degree, (SELECT count(*) FROM next WHERE t = v.id) AS in_degree, (SELECT count(*) FROM next WHERE s = v.id) + (SELECT count(*) FROM next WHERE t = v.id) AS total_degree FROM v",
    ),
    "algo_triangle_count": (
        "CALL algo.triangle_count('parts') YIELD vertex_id, triangle_count, degree, local_clustering_coefficient, global_triangle_count RETURN vertex_id, triangle_count, degree, local_clustering_coefficient, global_triangle_count",
        f"WITH {_SIMPLE}, tri AS (SELECT a.s AS id, count(*) AS n FROM u a JOIN u b ON a.s = b.s AND a.t < b.t JOIN u c ON c.s = a.t AND c.t = b.t GROUP BY a.s) SELECT v.id AS vertex_id, CAST(coalesce(n, 0) AS BIGINT) AS triangle_count, CAST(coalesce(degree, 0) AS BIGINT) AS degree, CASE WHEN coalesce(degree, 0) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(n, 0) / (degree * (degree - 1)) END AS local_clustering_coefficient, CAST((SELECT sum(n) / 3 FROM tri) AS BIGINT) AS global_triangle_count FROM v LEFT JOIN tri ON tri.id = v.id LEFT JOIN deg ON deg.id = v.id",
    ),
    "algo_lcc": (
        "CALL algo.lcc('parts') YIELD vertex_id, degree, directed_neighbor_edge_count, local_clustering_coefficient RETURN vertex_id, degree, directed_neighbor_edge_count, local_clustering_coefficient",
        f"WITH {_SIMPLE}, near AS (SELECT a.s AS id, count(*) AS n FROM u a JOIN u b ON a.s = b.s AND a.t <> b.t JOIN d c ON c.s = a.t AND c.t = b.t GROUP BY a.s) SELECT v.id AS vertex_id, CAST(coalesce(degree, 0) AS BIGINT) AS degree, CAST(coalesce(n, 0) AS BIGINT) AS directed_neighbor_edge_count, CASE WHEN coalesce(degree, 0) < 2 THEN 0.0::DOUBLE ELSE coalesce(n, 0) / (degree * (degree - 1)) END AS local_clustering_coefficient FROM v LEFT JOIN near ON near.id = v.id LEFT JOIN deg ON deg.id = v.id",
    ),
    "algo_shortest_path": (
        f"MATCH (a:Part), (b:Part) FILTER element_id(a) = {_START} AND element_id(b) = {_START + 100} CALL algo.shortest_path_length('parts', element_id(a), element_id(b)) YIELD distance RETURN distance",
        _BFS + f" SELECT CAST(coalesce(min(depth), -1) AS BIGINT) AS distance FROM walk WHERE id = {_START + 100}",
    ),
    "call_after_match": (
        "MATCH (a:Part) FILTER a.p_brand = 'Brand#11' CALL algo.degree('parts') YIELD vertex_id, total_degree RETURN total_degree, COUNT(*) AS n",
        f"WITH {_NEXT} SELECT total_degree, count(*) AS n FROM (SELECT (SELECT count(*) FROM next WHERE s = v.id) + (SELECT count(*) FROM next WHERE t = v.id) AS total_degree FROM v) GROUP BY total_degree",
    ),
}

def _statement(text: str) -> Query:
    return lambda spark, sf_dir: session(spark, sf_dir, "'parts'" in text).sql(text)


def node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node, edge and path values; structs are checked by tests."""
    return session(spark, sf_dir).sql("MATCH p = (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n, e, p")


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, True).sql("CALL algo.pagerank('parts')").withColumn("rank", F.round("rank", 9))


def named_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of path values, one column each."""
    p = session(spark, sf_dir).sql("MATCH p = (s:Supplier)-[:IN_NATION]->(n:Nation)-[e:IN_REGION]->(r:Region) RETURN p")
    return p.select(F.size("p.nodes").alias("nodes"), F.size("p.edges").alias("edges"), F.col("p.nodes")[0]["s_name"].alias("supplier"), F.col("p.nodes")[1]["n_name"].alias("nation"), F.col("p.nodes")[2]["__gql_labels"].alias("last"), F.col("p.edges")[1]["__gql_type"].alias("kind"), F.col("p.edges")[1]["__gql_target"].alias("target"))


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql(f"SELECT * FROM gql_neighbors('business', {OFFSET['nation'] + 8}, 'in')").select("neighbor_id")


def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("CALL gql_csr_edge_stats('business')")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies the graph of nations into a managed graph, changes it by statements and reads it."""
    s = GraphSession(spark)
    g = business_graph(spark, sf_dir)
    s.sql("CREATE GRAPH places ANY")
    v = g.vertices.where("array_contains(__gql_label, 'nation') OR array_contains(__gql_label, 'region')").select("__gql_id", "__gql_label", F.coalesce("n_name", "r_name").alias("name"), F.lit(None).cast("bigint").alias("size"))
    s.store.publish("places", v, g.edges.where("__gql_type = 'in_region'").select("__gql_edge_id", "__gql_source_id", "__gql_target_id", "__gql_type"), 10**13, 10**13)
    s.sql("""SESSION SET GRAPH places;
        MATCH (n:Nation) SET n.size = CHAR_LENGTH(n.name), n:Sized;
        MATCH (n:Nation)-[:IN_REGION]->(r) WHERE r.name = 'ASIA' INSERT (n)-[:TRADES]->(:Port {name: n.name || ' PORT'});
        MATCH (r:Region) WHERE r.name = 'EUROPE' DETACH DELETE r;
        MERGE (:Region {name: 'ATLANTIS'}); MERGE (:Region {name: 'ATLANTIS'})""")
    return s.sql("MATCH (x) OPTIONAL MATCH (x)-[e]->(y) RETURN x.name AS name, x.size AS size, x:Sized AS sized, y.name AS target")


_MUTATED = """
WITH p AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name AS name, CAST(length(n_name) AS BIGINT) AS size, true AS sized, CASE WHEN r_name = 'EUROPE' THEN NULL ELSE r_name END AS target FROM p
UNION ALL SELECT n_name, CAST(length(n_name) AS BIGINT), true, n_name || ' PORT' FROM p WHERE r_name = 'ASIA'
UNION ALL SELECT n_name || ' PORT', NULL, false, NULL FROM p WHERE r_name = 'ASIA'
UNION ALL SELECT r_name, NULL, false, NULL FROM region WHERE r_name <> 'EUROPE'
UNION ALL SELECT 'ATLANTIS', NULL, false, NULL"""

QUERIES: dict[str, Query] = {k: _statement(text) for k, (text, _) in MATCHES.items()}
QUERIES |= {k: _statement(text) for k, (text, _) in CALLS.items()}
QUERIES |= {k: f for k, (f, _) in STORED.items()}
QUERIES |= {"node_values": node_values, "named_path": named_path, "algo_pagerank": pagerank, "neighbors": neighbors, "edge_stats": edge_stats, "mutations": mutations}

ORACLES: dict[str, str] = {k: sql for k, (_, sql) in [*MATCHES.items(), *CALLS.items()] if sql}
ORACLES |= {k: sql for k, (_, sql) in STORED.items()}
ORACLES |= {
    "algo_pagerank": _PAGERANK,
    "named_path": f"SELECT 3 AS nodes, 2 AS edges, s_name AS supplier, n_name AS nation, 'region' AS last, 'in_region' AS kind, {_id('region', 'r_regionkey')} AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "neighbors": f"SELECT {_id('customer', 'c_custkey')} AS neighbor_id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT {_id('supplier', 's_suppkey')} FROM supplier WHERE s_nationkey = 7",
    "edge_stats": f"WITH {_EDGES}, o AS (SELECT edge_label, s, count(*) AS d FROM e GROUP BY ALL), i AS (SELECT edge_label, t, count(*) AS d FROM e GROUP BY ALL) SELECT o.*, i.* EXCLUDE (l) FROM (SELECT edge_label, CAST(sum(d) AS BIGINT) AS edge_count, count(*) AS outgoing_vertex_count, avg(d) AS avg_outgoing_degree, max(d) AS max_outgoing_degree FROM o GROUP BY edge_label) o JOIN (SELECT edge_label AS l, count(*) AS incoming_vertex_count, avg(d) AS avg_incoming_degree, max(d) AS max_incoming_degree FROM i GROUP BY edge_label) i ON o.edge_label = i.l",
    "mutations": _MUTATED,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders down to the parts: the largest quantities by segment and brand."""
    return session(spark, sf_dir).sql("MATCH (c:Customer)-[:PLACED]->(o:Order)-[k:CONTAINS]->(p:Part) WHERE k.discount >= 0.05 RETURN c.c_mktsegment AS segment, p.p_brand AS brand, COUNT(*) AS lines, SUM(k.quantity) AS quantity ORDER BY quantity DESC, segment, brand LIMIT 20")
