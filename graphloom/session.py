"""The entry point: one session runs statements of the query language and gives DataFrames."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import procedures
from graphloom.plans import syntax as S
from graphloom.plans.build import Builder
from graphloom.plans.errors import GqlError, unsupported
from graphloom.plans.graph import EDGE_ID, SOURCE, TARGET, TYPE, Graph
from graphloom.plans.mutate import Mutation
from graphloom.sources import importer, typed
from graphloom.sources.store import Store

_CHANGES = (S.Insert, S.Set, S.Remove, S.Delete)


class GraphSession:
    """*root* is the folder of the graphs; a new one under the shared folder by default."""

    def __init__(self, spark: SparkSession, root: str | None = None, max_paths: int | None = None):
        self.spark, self.store, self.max_paths = spark, Store(spark, root), max_paths
        self.selected: str | None = None
        self.cached: dict[str, tuple[int, Graph]] = {}

    def register(self, graph: Graph, select: bool = True) -> None:
        """Make a graph over any two DataFrames readable under its name, without copying it."""
        self.store.transient[graph.name.lower()] = Graph(graph.name.lower(), graph.vertices, graph.edges)
        if select:
            self.selected = graph.name.lower()

    def sql(self, text: str) -> DataFrame:
        """Run a statement, or several separated by semicolons, and return the last one's rows."""
        out = None
        for one in S.split(text):
            out = self.run(S.parse(one))
        if out is None:
            raise GqlError("GQL statement is empty")
        return out

    # ---- statements

    def run(self, s) -> DataFrame:
        if isinstance(s, S.Query):
            return self.query(s)
        if isinstance(s, S.Explain):
            return self.explain(s)
        if isinstance(s, S.TableFunction):
            return self.function(s)
        if isinstance(s, S.CreateGraph):
            schema = typed.schema_of(s.typed) if s.typed is not None else None
            self.store.create(s.name, s.if_missing, schema, typed.empty_tables(self.spark, schema) if schema is not None else None)
            return self.done(s.name)
        if isinstance(s, S.DropGraph):
            self.store.drop(s.name, s.if_exists)
            if self.selected == s.name:
                self.selected = None
            return self.done(s.name)
        if isinstance(s, S.UseGraph):
            if s.name not in self.store.transient:
                self.store.meta(s.name)
            self.selected = s.name
            return self.done(s.name)
        if isinstance(s, S.CopyGraph):
            return self.copy(s)
        if isinstance(s, S.Merge):
            return Mutation(self.store, self.name()).merge(s.node)
        if isinstance(s, S.Transaction):
            {"begin": self.store.begin, "commit": self.store.commit, "rollback": self.store.rollback}[s.what]()
            return self.spark.createDataFrame([(True,)], "success boolean")
        raise unsupported(type(s).__name__)

    def done(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(True, name)], "success boolean, graph_name string")

    def name(self) -> str:
        if self.selected is None:
            raise GqlError("No graph selected")
        return self.selected

    def graph(self, name: str | None = None) -> Graph:
        name = name.lower() if name else self.name()
        held = self.cached.get(name)
        if held and name not in self.store.transient and held[0] == self.store.meta(name)["version"]:
            return held[1]
        return self.store.graph(name)

    def copy(self, s: S.CopyGraph) -> DataFrame:
        self.store.autocommit_only("COPY GRAPH")
        m = self.store.meta(s.name)
        if m["vertex_count"] or m["edge_count"] or m["typed"] is not None:
            raise GqlError(f"GQL graph '{s.name}' must be empty before COPY GRAPH")
        v, e, nv, ne = importer.load(self.spark, s.vertices, s.edges, s.validate)
        self.store.publish(s.name, v, e, nv + 1, ne + 1)
        return self.spark.createDataFrame([(True, s.name, nv, ne)], "success boolean, graph_name string, vertex_count bigint, edge_count bigint")

    def query(self, q: S.Query) -> DataFrame:
        first = q.clauses[0]
        if isinstance(first, S.Procedure):
            return self.call(first, q.clauses[1:])
        if any(isinstance(c, _CHANGES) for c in q.clauses):
            if self.name() in self.store.transient:
                raise GqlError("GQL registered graphs are read-only")
            return Mutation(self.store, self.name()).run(q)
        if not isinstance(q.clauses[-1], S.Return):
            raise GqlError("GQL query must end with RETURN")
        return Builder(self.spark, self.graph(), self.max_paths).run(q.clauses)

    def literal(self, e):
        if isinstance(e, S.Un) and e.op == "-" and isinstance(e.arg, S.Lit):
            return -e.arg.value
        if isinstance(e, S.Var):
            return e.name
        if not isinstance(e, S.Lit):
            raise GqlError("GQL procedure arguments must be literals here")
        return e.value

    def call(self, c: S.Procedure, rest: list) -> DataFrame:
        args = [self.literal(a) for a in c.args]
        named = {k: self.literal(v) for k, v in c.named.items()}
        if not c.name.startswith(("algo.", "system.algo.")):
            if c.yields is not None:
                raise unsupported("YIELD of this procedure")
            return self.function(S.TableFunction(c.name, c.args, c.named))
        if not args or not isinstance(args[0], str):
            raise GqlError("GQL procedures take a graph's name first")
        graph = self.graph(args[0])
        out = procedures.standalone(graph, c.name, args[1:], named)
        if c.yields is None:
            if rest:
                raise unsupported("RETURN after CALL without YIELD")
            return out
        if len(rest) != 1 or not isinstance(rest[0], S.Return):
            raise unsupported("CALL without RETURN")
        build = Builder(self.spark, graph)
        build.yielded(c, out)
        return build.returned(rest[0])

    def explain(self, s: S.Explain) -> DataFrame:
        began = time.time()
        df = self.run(s.inner)
        text = df._jdf.queryExecution().toString() if not s.analyze else ""
        metrics = {}
        if s.analyze:
            metrics = {"rows": df.count(), "seconds": round(time.time() - began, 3)}
            text = df._jdf.queryExecution().executedPlan().toString()
        if s.json:
            text = json.dumps({"plan": text} | metrics)
        elif metrics:
            text += "\n" + ", ".join(f"{k}: {v}" for k, v in metrics.items())
        return self.spark.createDataFrame([(text,)], "explain string")

    # ---- table functions

    def function(self, s: S.TableFunction) -> DataFrame:
        args = [self.literal(a) for a in s.args]
        if s.name.startswith("system.algo."):
            return procedures.standalone(self.graph(args[0]), s.name, args[1:], {k: self.literal(v) for k, v in s.named.items()})
        known = {"gql_graphs": self.store.graphs, "gql_property_indexes": self.store.indexes, "gql_create_property_index": self.store.create_index, "gql_drop_property_index": self.store.drop_index, "gql_neighbors": self.neighbors, "gql_build_csr": self.build_snapshot, "gql_csr_stats": self.stats, "gql_csr_edge_stats": self.edge_stats}
        if s.name not in known:
            raise GqlError(f"GQL function '{s.name}' does not exist")
        return known[s.name](*args)

    def neighbors(self, name: str, vertex: int, direction: str = "out") -> DataFrame:
        e = self.graph(name).edges
        here, there = {"out": (SOURCE, TARGET), "in": (TARGET, SOURCE)}[direction.lower()]
        return e.where(F.col(here) == vertex).select(F.col(there).alias("neighbor_id"), F.col(EDGE_ID).alias("edge_id"))

    def build_snapshot(self, name: str) -> DataFrame:
        """Keep the graph's edges partitioned by source while this version is current."""
        name = name.lower()
        old = self.cached.pop(name, None)
        if old:
            old[1].edges.unpersist()
        graph = self.store.graph(name)
        kept = Graph(name, graph.vertices, graph.edges.repartition(SOURCE).persist())
        version = 0 if name in self.store.transient else self.store.meta(name)["version"]
        self.cached[name] = (version, kept)
        rows = [(name, version, kept.vertices.count(), kept.edges.count(), None, 1)]
        return self.spark.createDataFrame(rows, "graph_name string, graph_version bigint, vertex_count bigint, edge_count bigint, memory_bytes bigint, build_count bigint")

    def stats(self, name: str) -> DataFrame:
        """Sizes and state of the kept edges; figures of memory layout have no counterpart and are NULL."""
        name = name.lower()
        graph = self.store.graph(name)
        version = 0 if name in self.store.transient else self.store.meta(name)["version"]
        held = self.cached.get(name)
        cached = held is not None and held[0] == version
        row = {"graph_name": name, "graph_version": version, "vertex_count": graph.vertices.count(), "edge_count": graph.edges.count(), "build_count": int(held is not None), "cached": cached}
        names = "graph_name string, graph_version bigint, vertex_count bigint, edge_count bigint, memory_bytes bigint, build_count bigint, cached boolean, neighbor_width_bytes bigint, vertex_ids_explicit boolean, edge_labels_uniform boolean, topology_bytes bigint, identity_bytes bigint, label_bytes bigint, auxiliary_bytes bigint, build_auxiliary_bytes bigint, capability_mask bigint, has_outgoing boolean, has_incoming boolean, has_edge_ids boolean, has_edge_labels boolean, has_vertex_labels boolean, has_vertex_label_postings boolean, has_edge_stats boolean"
        flags = {x.split()[0]: cached for x in names.split(", ") if x.startswith("has_")}
        row |= flags | {"edge_labels_uniform": graph.edges.select(TYPE).distinct().limit(2).count() < 2}
        return self.spark.createDataFrame([tuple(row.get(x.split()[0]) for x in names.split(", "))], names)

    def edge_stats(self, name: str) -> DataFrame:
        e = self.graph(name).edges.select(TYPE, SOURCE, TARGET)
        ends = e.select(TYPE, F.explode(F.array(F.struct(F.lit(True).alias("out"), F.col(SOURCE).alias("v")), F.struct(F.lit(False).alias("out"), F.col(TARGET).alias("v")))).alias("x")).groupBy(TYPE, "x.out", "x.v").agg(F.count("*").alias("d"))
        out = F.col("out")
        return ends.groupBy(F.col(TYPE).alias("edge_label")).agg(
            F.sum(F.when(out, F.col("d"))).alias("edge_count"), F.count(F.when(out, 1)).alias("outgoing_vertex_count"), F.count(F.when(~out, 1)).alias("incoming_vertex_count"),
            F.avg(F.when(out, F.col("d"))).alias("avg_outgoing_degree"), F.avg(F.when(~out, F.col("d"))).alias("avg_incoming_degree"), F.max(F.when(out, F.col("d"))).alias("max_outgoing_degree"), F.max(F.when(~out, F.col("d"))).alias("max_incoming_degree"),
        )


