"""Mutations: every expression reads one snapshot of the match; new tables replace the old as one version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import EdgeBinding, NodeBinding, PathBinding, Scope, column, node_value, quoted, resolve
from graphloom.operators.algorithms import numbered
from graphloom.operators.durable import durable
from graphloom.plans import syntax as S
from graphloom.plans.build import Builder
from graphloom.plans.errors import GqlError, unsupported
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE
from graphloom.sources import typed
from graphloom.sources.store import Store


class Mutation:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.spark = store, name, store.spark
        self.meta = store.meta(name)
        self.graph = store.graph(name)
        self.vertices, self.edges = self.graph.vertices, self.graph.edges
        self.next_vertex, self.next_edge = self.meta["next_vertex"], self.meta["next_edge"]
        self.new_vertices = self.new_edges = False

    def run(self, query: S.Query) -> DataFrame:
        kinds = (S.Insert, S.Set, S.Remove, S.Delete)
        cut = next(i for i, c in enumerate(query.clauses) if isinstance(c, kinds))
        matched, changes = query.clauses[:cut], query.clauses[cut:]
        last = changes.pop() if isinstance(changes[-1], S.Return) else None
        if any(not isinstance(c, kinds) for c in changes):
            raise unsupported("reading after a mutation")
        build = Builder(self.spark, self.graph)
        build.run(matched)
        if last is not None and (matched or len(changes) > 1 or not isinstance(changes[0], S.Insert) or last.items is None or len(last.items) != 1):
            raise unsupported("RETURN after this mutation")
        self.scope = build.scope
        rows = build.rows()
        if any(isinstance(c, S.Insert) for c in changes):
            rows = rows.withColumn("__row", F.monotonically_increasing_id())
        self.rows = durable(rows, "snapshot")
        created: dict[str, int] = {}
        for c in changes:
            if isinstance(c, S.Insert):
                for p in c.paths:
                    created |= self.insert(p)
            elif isinstance(c, (S.Set, S.Remove)):
                self.assign(c)
            else:
                self.delete(c)
        self.publish()
        if last is None:
            return self.spark.createDataFrame([(True,)], "success boolean")
        e, alias = last.items[0]
        if not isinstance(e, S.Var) or e.name not in created:
            raise GqlError("GQL INSERT RETURN needs a node that the statement inserts")
        build = Builder(self.spark, self.store.graph(self.name))
        df, b = build.nodes(())
        return df.where(quoted(b.id) == created[e.name]).select(node_value(b).alias(alias or e.name))

    def publish(self) -> None:
        if not (self.new_vertices or self.new_edges):
            return
        v, e = self.vertices if self.new_vertices else None, self.edges if self.new_edges else None
        if self.meta["typed"] is not None:
            v, e = (durable(x, "checked") if x is not None else None for x in (v, e))
            typed.check(self.meta["typed"], v, e)
        self.store.publish(self.name, v, e, self.next_vertex, self.next_edge)

    # ---- INSERT

    def valued(self, part, names: list[str], types: dict) -> list[Column]:
        own = dict(part.props or ())
        for name, e in own.items():
            if name not in names:
                raise GqlError(f"GQL property '{name}' is not mapped")
            if isinstance(e, S.Lit) and e.value is None:
                raise unsupported("NULL literal in INSERT")
            if S.has_aggregate(e):
                raise GqlError("GQL aggregate functions are not allowed in INSERT")
        return [(column(own[n], self.scope) if n in own else F.lit(None)).cast(types[n]).alias(n) for n in names]

    def insert(self, path: S.Path) -> dict[str, int]:
        if path.var or any(isinstance(x, S.Edge) and (x.quantified or x.direction == "any") for x in path.parts):
            raise unsupported("INSERT of this pattern")
        nodes, arcs = path.parts[::2], path.parts[1::2]
        rows, ends = self.rows, []
        for x in nodes:
            if x.var in self.scope and isinstance(self.scope[x.var], NodeBinding):
                if x.labels or x.props:
                    raise GqlError(f"GQL bound variable '{x.var}' cannot have labels or properties in INSERT")
                rows = rows.where(quoted(self.scope[x.var].id).isNotNull())
        if len(nodes) == 1 and nodes[0].var in self.scope:
            raise unsupported("INSERT of a bound node alone")
        rows = durable(numbered(rows, "__row", "__n", 0), "insert")
        count, types = rows.count(), {f.name: f.dataType for f in [*self.vertices.schema.fields, *self.edges.schema.fields]}
        made: dict[str, tuple[int, int]] = {}
        fresh = []
        for x in nodes:
            if x.var in self.scope and isinstance(self.scope[x.var], NodeBinding):
                ends.append(quoted(self.scope[x.var].id))
            elif x.var in made:
                if x.labels or x.props:
                    raise GqlError(f"GQL variable '{x.var}' is already inserted")
                ends.append(made[x.var])
            else:
                made[x.var or f"?{len(fresh)}"] = place = (self.next_vertex, len(fresh))
                fresh.append(x)
                ends.append(place)
        width = len(fresh)
        ends = [F.lit(e[0]) + F.col("__n") * width + e[1] if isinstance(e, tuple) else e for e in ends]
        base = self.next_vertex
        for j, x in enumerate(fresh):
            self.vertices = self.vertices.unionByName(rows.select((F.lit(base) + F.col("__n") * width + j).cast("long").alias(ID), F.array(*[F.lit(y) for y in x.labels]).cast("array<string>").alias(LABELS), *self.valued(x, self.graph.vertex_props, types)))
        for j, x in enumerate(arcs):
            if len(x.labels) != 1:
                raise GqlError("GQL inserted edges need exactly one type")
            s, t = (ends[j], ends[j + 1]) if x.direction == "out" else (ends[j + 1], ends[j])
            self.edges = self.edges.unionByName(rows.select((F.lit(self.next_edge) + F.col("__n") * len(arcs) + j).cast("long").alias(EDGE_ID), s.cast("long").alias(SOURCE), t.cast("long").alias(TARGET), F.lit(x.labels[0]).alias(TYPE), *self.valued(x, self.graph.edge_props, types)))
        if count:
            self.new_vertices |= bool(fresh)
            self.new_edges |= bool(arcs)
        self.next_vertex += count * width
        self.next_edge += count * len(arcs)
        return {n: b + j for n, (b, j) in made.items() if not n.startswith("?")}

    # ---- SET and REMOVE

    def assign(self, c: S.Set | S.Remove) -> None:
        removing = isinstance(c, S.Remove)
        by: dict[str, list[S.Assign]] = {}
        for a in c.items:
            b = self.scope.find(a.var)
            if not isinstance(b, (NodeBinding, EdgeBinding)):
                raise GqlError(f"GQL variable '{a.var}' cannot be changed")
            by.setdefault(a.var, []).append(a)
        for var, items in by.items():
            self.change(var, items, removing)

    def change(self, var: str, items: list[S.Assign], removing: bool) -> None:
        b = self.scope[var]
        is_node = isinstance(b, NodeBinding)
        names = self.graph.vertex_props if is_node else self.graph.edge_props
        base = self.vertices if is_node else self.edges
        key = ID if is_node else EDGE_ID
        values: dict[str, Column] = {}
        clear, labels, touched = set(), None, False
        for a in items:
            if a.kind == "labels":
                if not is_node:
                    raise GqlError("GQL edges have exactly one immutable type")
                old = labels if labels is not None else F.col(LABELS)
                own = F.array(*[F.lit(x) for x in a.labels])
                labels = F.array_except(old, own) if removing else F.array_union(old, own)
                touched = True
                continue
            if a.kind == "property":
                pairs = [(a.name, S.Lit(None) if removing else a.value)]
            else:
                record = resolve(a.value, self.scope)
                if not isinstance(record, S.Record):
                    raise GqlError("GQL SET of all properties needs a record")
                pairs = list(record.items)
                if a.kind == "replace":
                    clear, values, touched = set(names), {}, True
            for name, e in pairs:
                if name not in names:
                    raise GqlError(f"GQL property '{name}' is not mapped")
                if S.has_aggregate(e):
                    raise GqlError("GQL aggregate functions are not allowed in SET")
                values[name] = column(e, self.scope).cast(base.schema[name].dataType)
                touched = True
        if not touched:
            return
        order = sorted(values)
        snap = self.rows.where(quoted(b.id).isNotNull()).select(quoted(b.id).alias("__id"), F.struct(F.lit(1).alias("__set"), *[values[n].alias(n) for n in order]).alias("__new"))
        snap = durable(snap.groupBy("__id").agg(F.min("__new").alias("__new")), "assign")
        if not snap.limit(1).count():
            return
        hit = F.col("__id").isNotNull()
        out = []
        for col in base.columns:
            if col in values:
                out.append(F.when(hit, F.col(f"__new.`{col}`")).otherwise(F.col(f"`{col}`")).alias(col))
            elif col in clear:
                out.append(F.when(~hit, F.col(f"`{col}`")).alias(col))
            elif col == LABELS and labels is not None:
                out.append(F.when(hit, labels).otherwise(F.col(LABELS)).alias(col))
            else:
                out.append(F.col(f"`{col}`"))
        changed = base.join(snap, base[key] == snap["__id"], "left").select(*out)
        if is_node:
            self.vertices, self.new_vertices = changed, True
        else:
            self.edges, self.new_edges = changed, True

    # ---- DELETE

    def targets(self, e) -> list[NodeBinding | EdgeBinding]:
        e = resolve(e, self.scope)
        if isinstance(e, S.Lit) and e.value is None:
            return []
        if isinstance(e, S.ListOf):
            return [b for x in e.items for b in self.targets(x)]
        if isinstance(e, S.Record):
            return [b for _, x in e.items for b in self.targets(x)]
        if isinstance(e, S.Var):
            b = self.scope.find(e.name)
            if isinstance(b, (NodeBinding, EdgeBinding)):
                return [b]
            if isinstance(b, PathBinding):
                return list(b.parts)
        raise GqlError("GQL DELETE targets must be nodes, edges, paths or collections of them")

    def delete(self, c: S.Delete) -> None:
        found = [b for e in c.targets for b in self.targets(e)]
        ids = lambda kind: [self.rows.select(quoted(b.id).alias("__id")).where("__id IS NOT NULL") for b in found if isinstance(b, kind)]
        gone = {k: durable(reduce(DataFrame.unionByName, parts).distinct(), "delete") for k, parts in (("edge", ids(EdgeBinding)), ("node", ids(NodeBinding))) if parts}
        gone = {k: d for k, d in gone.items() if d.limit(1).count()}
        if "edge" in gone:
            self.edges, self.new_edges = self.edges.join(gone["edge"], self.edges[EDGE_ID] == F.col("__id"), "left_anti"), True
        if "node" in gone:
            nodes = gone["node"]
            for end in (SOURCE, TARGET):
                if c.detach:
                    self.edges = self.edges.join(nodes, self.edges[end] == nodes["__id"], "left_anti")
                    self.new_edges = True
                elif self.edges.join(nodes, self.edges[end] == nodes["__id"], "left_semi").limit(1).count():
                    raise GqlError("GQL nodes with edges cannot be deleted; use DETACH DELETE")
            self.vertices, self.new_vertices = self.vertices.join(nodes, self.vertices[ID] == nodes["__id"], "left_anti"), True

    # ---- MERGE

    def merge(self, node: S.Node) -> DataFrame:
        if not node.labels and not node.props:
            raise unsupported("MERGE without labels and properties")
        test = F.lit(True)
        for x in node.labels:
            test = test & F.coalesce(F.array_contains(LABELS, x), F.lit(False))
        for name, e in node.props or ():
            if name not in self.graph.vertex_props:
                raise GqlError(f"GQL property '{name}' is not mapped")
            if not isinstance(e, (S.Lit, S.Un)) or isinstance(e, S.Lit) and e.value is None:
                raise unsupported("MERGE with values that are no literals")
            test = test & F.col(f"`{name}`").eqNullSafe(column(e, Scope()).cast(self.vertices.schema[name].dataType))
        if not self.vertices.where(test).limit(1).count():
            return self.run(S.Query([S.Insert([S.Path(None, (S.Node(None, node.labels, node.props),))])]))
        return self.spark.createDataFrame([(True,)], "success boolean")
