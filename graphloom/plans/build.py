"""From a clause stream to one DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import EdgeBinding, LetBinding, NodeBinding, PathBinding, Scope, ValueBinding, column, has_labels, path_value, quoted, resolve, variables
from graphloom.operators import procedures
from graphloom.operators.durable import durable
from graphloom.operators.expand import trails
from graphloom.plans import factored
from graphloom.plans import syntax as S
from graphloom.plans.errors import GqlError, unsupported
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE, Graph


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


class Builder:
    """Bindings are columns with a prefix of their own in one row table; None stands for the unit table."""

    def __init__(self, spark, graph: Graph, max_paths: int | None = None):
        self.spark, self.graph, self.max_paths = spark, graph, max_paths
        self.df: DataFrame | None = None
        self.scope = Scope()
        self.count = 0
        self.called = False
        #: The match and its filters where RETURN reads nothing else.
        self.only: tuple[S.Match, list] | None = None

    # ---- relations

    def prefix(self) -> str:
        self.count += 1
        return f"b{self.count}"

    def nodes(self, labels: tuple[str, ...]) -> tuple[DataFrame, NodeBinding]:
        p = self.prefix()
        v = self.graph.vertices
        for x in labels:
            v = v.where(F.array_contains(F.col(LABELS), x))
        b = NodeBinding(f"{p}_id", f"{p}_labels", {c: f"{p}_p_{c}" for c in self.graph.vertex_props})
        return v.select(F.col(ID).alias(b.id), F.col(LABELS).alias(b.labels), *[F.col(f"`{c}`").alias(n) for c, n in b.props.items()]), b

    def edges(self, part: S.Edge) -> tuple[DataFrame, EdgeBinding, str, str]:
        """The edge rows as seen in the part's direction, with the columns they come from and lead to."""
        p = self.prefix()
        e = self.graph.edges
        for x in part.labels:
            e = e.where(F.col(TYPE) == x)
        b = EdgeBinding(f"{p}_id", f"{p}_type", f"{p}_src", f"{p}_dst", {c: f"{p}_p_{c}" for c in self.graph.edge_props})
        own = [F.col(EDGE_ID).alias(b.id), F.col(TYPE).alias(b.type), F.col(SOURCE).alias(b.src), F.col(TARGET).alias(b.dst), *[F.col(f"`{c}`").alias(n) for c, n in b.props.items()]]
        frm, to = f"{p}_from", f"{p}_to"
        ahead = e.select(*own, F.col(SOURCE).alias(frm), F.col(TARGET).alias(to))
        back = e.select(*own, F.col(TARGET).alias(frm), F.col(SOURCE).alias(to))
        if part.direction == "out":
            return ahead, b, frm, to
        if part.direction == "in":
            return back, b, frm, to
        # a loop is one edge in either direction
        return ahead.unionByName(back.where(quoted(b.src) != quoted(b.dst))), b, frm, to

    # ---- clauses

    def run(self, clauses: list) -> DataFrame | None:
        i, result = 0, None
        while i < len(clauses):
            c = clauses[i]
            if isinstance(c, S.Match):
                filters = S.conjuncts(c.where)
                while i + 1 < len(clauses) and isinstance(clauses[i + 1], S.Filter):
                    i += 1
                    filters += S.conjuncts(clauses[i].where)
                first = self.df is None and not self.scope
                self.match(c, filters)
                self.only = (c, filters) if first and i + 2 == len(clauses) and isinstance(clauses[-1], S.Return) else None
            elif isinstance(c, S.Filter):
                self.rows()
                self.check_scalar(c.where)
                self.df = self.df.where(column(c.where, self.scope))
            elif isinstance(c, S.Let):
                for name, e in c.items:
                    if name in self.scope:
                        raise GqlError(f"GQL binding variable '{name}' is already defined")
                    for x in variables(e, self.scope):
                        self.scope.find(x)
                    if S.has_aggregate(e):
                        raise GqlError("GQL aggregate functions are not allowed in LET")
                    self.scope[name] = LetBinding(e)
            elif isinstance(c, S.Procedure):
                self.call(c)
            elif isinstance(c, S.Return):
                result = self.returned(c)
            else:
                raise unsupported(type(c).__name__.upper())
            i += 1
        return result

    def rows(self) -> DataFrame:
        if self.df is None:
            self.df = self.spark.range(1).select(F.lit(True).alias("b0_present"))
        return self.df

    def check_scalar(self, e) -> None:
        if S.has_aggregate(e):
            raise GqlError("GQL aggregate functions are not allowed in a predicate")

    # ---- MATCH

    def match(self, c: S.Match, filters: list) -> None:
        self.check_names(c.paths)
        visible = set(self.scope) | {v for p in c.paths for v in ([p.var] if p.var else []) + [x.var for x in p.parts if x.var]}
        for f in filters:
            self.check_scalar(f)
            for x in variables(f, self.scope):
                if x not in visible:
                    raise GqlError(f"GQL binding variable '{x}' is not defined")
        if c.optional:
            return self.optional(c, filters)
        self.df, self.scope, rest = self.grow(self.df, self.scope, c.paths, filters, set())
        if rest:
            self.df = self.rows().where(both([column(f, self.scope) for f in rest]))

    def check_names(self, paths: list[S.Path]) -> None:
        kinds: dict[str, str] = {n: "node" if isinstance(b, NodeBinding) else "edge" if isinstance(b, EdgeBinding) else "value" for n, b in self.scope.items()}
        for p in paths:
            if p.var:
                if p.var in kinds or any(x.var == p.var for x in p.parts):
                    raise GqlError(f"GQL path variable '{p.var}' is already defined")
                if any(isinstance(x, S.Edge) and x.quantified for x in p.parts):
                    raise unsupported("GQL quantified path value projection")
            for x in p.parts:
                kind = "node" if isinstance(x, S.Node) else "edge"
                if x.var and kinds.setdefault(x.var, kind) != kind:
                    raise GqlError(f"GQL variable '{x.var}' is used as node and as edge")

    def grow(self, df, scope: Scope, paths: list[S.Path], filters: list, outer: set[str]):
        """Extend the rows by the paths; *outer* names are known elsewhere by their id alone. Returns what filters are left."""
        scope, todo, left = Scope(scope), list(paths), list(filters)
        fixed = self.anchored(filters)

        while todo:
            todo.sort(key=lambda p: -max([3 * (x.var in scope) + 2 * (x.var in fixed or x.props is not None) for x in p.parts if isinstance(x, S.Node)]))
            path = todo.pop(0)
            df, scope = self.path(df, scope, path, fixed, outer, lambda d, s: self.apply(d, s, left, outer))
            left = [f for f in left if not self.usable(f, scope, outer)]
        return df, scope, left

    def usable(self, f, scope: Scope, outer: set[str]) -> bool:
        names = variables(f, scope)
        return bool(names) and names <= set(scope) and not names & outer

    def apply(self, df: DataFrame, scope: Scope, filters: list, outer: set[str]) -> DataFrame:
        now = [column(f, scope) for f in filters if self.usable(f, scope, outer)]
        return df.where(both(now)) if now else df

    def anchored(self, filters: list) -> set[str]:
        """Variables with a literal equality."""
        out = set()
        for f in filters:
            if isinstance(f, S.Bin) and f.op == "=":
                for a, b in ((f.left, f.right), (f.right, f.left)):
                    x = a.base if isinstance(a, S.Prop) else a.args[0] if isinstance(a, S.Call) and a.name == "element_id" and a.args else None
                    if isinstance(x, S.Var) and isinstance(b, S.Lit):
                        out.add(x.name)
        return out

    def path(self, df, scope: Scope, path: S.Path, fixed: set[str], outer: set[str], filtered):
        """One path: start at a bound or selective node, then grow to the right and to the left."""
        parts = self.unroll(path.parts)
        spots = [i for i in range(0, len(parts), 2)]
        begin = max(spots, key=lambda i: (parts[i].var in scope, parts[i].var in fixed or parts[i].props is not None, parts[i].var in outer, bool(parts[i].labels), -i))
        bound: dict[int, NodeBinding | EdgeBinding] = {}
        seen: list[tuple[str, bool]] = []
        start = parts[begin]
        whole = path.var is not None
        lazy = start.var in outer and start.var not in scope and len(parts) > 1 and not (parts[begin + 1] if begin + 1 < len(parts) else parts[begin - 1]).quantified
        if start.var in scope:
            bound[begin] = scope[start.var]
            df = df.where(has_labels(bound[begin], start.labels) & quoted(bound[begin].id).isNotNull())
        elif start.var in outer:
            if not lazy:
                p = self.prefix()
                ids = self.df.select(quoted(self.scope[start.var].id).alias(f"{p}_id")).where(quoted(f"{p}_id").isNotNull()).distinct()
                df = ids if df is None else df.crossJoin(ids)
                bound[begin] = scope[start.var] = NodeBinding(f"{p}_id")
        else:
            rel, b = self.nodes(start.labels)
            df = rel if df is None else df.crossJoin(rel)
            bound[begin] = b
            if start.var:
                scope[start.var] = b
        if begin in bound:
            df = self.with_props(df, bound[begin], start, scope)
            df = filtered(df, scope)
        for at, there, here in self.steps(parts, begin, bound, scope):
            edge, target = parts[at], parts[there]
            if there < at:
                edge = S.Edge(edge.var, edge.labels, {"out": "in", "in": "out"}.get(edge.direction, "any"), edge.least, edge.most, edge.props)
            df, to = self.hop(df, scope, edge, parts[here], bound, at, here, seen)
            df = self.arrive(df, scope, target, to, bound, there, outer, whole)
            df = filtered(df, scope)
        if path.var:
            scope[path.var] = PathBinding([bound[i] for i in range(len(parts))])
            df = filtered(df, scope)
        return df, scope

    def steps(self, parts: list, begin: int, bound: dict, scope: Scope):
        """Places of the edge to join next, of the node it leads to, and of the node it comes from.

        A path in which no node comes twice grows to the right and then to the
        left. In a cycle the order decides how many rows there are on the way, so
        the known node goes on where the edges fan out least, and an edge
        between two known nodes comes first.
        """
        nodes = [x.var for x in parts[::2] if x.var]
        if len(set(nodes)) == len(nodes) or any(x.quantified for x in parts[1::2]) or begin not in bound:
            yield from [(i, i + 1, i - 1) for i in range(begin + 1, len(parts), 2)] + [(i, i - 1, i + 1) for i in range(begin - 1, -1, -2)]
            return
        todo = set(range(1, len(parts), 2))
        known = lambda i: i in bound or parts[i].var in scope
        turned = {"out": "in", "in": "out"}
        while todo:
            ways = []
            for i in todo:
                for here, there in ((i - 1, i + 1), (i + 1, i - 1)):
                    if known(here):
                        direction = parts[i].direction if there > here else turned.get(parts[i].direction, "any")
                        ways.append((0.0 if known(there) else self.graph.fan_out(parts[i].labels, direction), i, there, here))
            _, at, there, here = min(ways)
            if here not in bound:
                bound[here] = scope[parts[here].var]
            todo.remove(at)
            yield at, there, here

    def unroll(self, parts: tuple) -> list:
        """`{n}` as n hops with nameless nodes between."""
        out = [parts[0]]
        for edge, node in zip(parts[1::2], parts[2::2]):
            if edge.quantified and edge.least == edge.most:
                one = S.Edge(None, edge.labels, edge.direction, props=edge.props)
                for _ in range(edge.least - 1):
                    out += [one, S.Node(None)]
                out += [one, node]
            else:
                out += [edge, node]
        return out

    def with_props(self, df: DataFrame, b, part, scope: Scope) -> DataFrame:
        for name, e in part.props or ():
            df = df.where((quoted(b.props[name]) if name in b.props else F.lit(None)) == column(e, scope))
        return df

    def hop(self, df, scope: Scope, edge: S.Edge, origin: S.Node, bound: dict, at: int, here: int, seen: list):
        """Join an edge (or trails of edges) to the rows; returns the column it leads to."""
        if edge.var in scope:
            b = scope[edge.var]
            known = quoted(bound[here].id)
            src, dst = quoted(b.src), quoted(b.dst)
            to = f"{self.prefix()}_to"
            if edge.direction == "out":
                df = df.where(known == src).withColumn(to, dst)
            elif edge.direction == "in":
                df = df.where(known == dst).withColumn(to, src)
            else:
                df = df.where((known == src) | (known == dst)).withColumn(to, F.when(known == src, dst).otherwise(src))
            df = df.where(has_labels(b, edge.labels))
            mark = (b.id, False)
        else:
            rel, b, frm, to = self.edges(edge)
            for name, e in edge.props or ():
                rel = rel.where((quoted(b.props[name]) if name in b.props else F.lit(None)) == column(e, Scope()))
            if edge.quantified:
                hops = rel.where(quoted(frm).isNotNull() & quoted(to).isNotNull()).select(quoted(frm).alias("f"), quoted(to).alias("t"), quoted(b.id).alias("id"))
                starts = df.select(quoted(bound[here].id).alias("s")).where("s IS NOT NULL").distinct()
                p = self.prefix()
                reach = trails(starts, hops, edge.least, edge.most, self.max_paths).select(F.col("s").alias(f"{p}_s"), F.col("e").alias(f"{p}_to"), F.col("trail").alias(f"{p}_trail"))
                df = df.join(reach, quoted(bound[here].id) == quoted(f"{p}_s"))
                to, mark = f"{p}_to", (f"{p}_trail", True)
            else:
                if here not in bound:
                    # the origin is known elsewhere: the edges themselves are the start
                    start = NodeBinding(frm)
                    df = rel if df is None else df.crossJoin(rel)
                    bound[here] = scope[origin.var] = start
                else:
                    df = df.join(rel, quoted(bound[here].id) == quoted(frm))
                mark = (b.id, False)
                if edge.var:
                    scope[edge.var] = b
            bound[at] = b
        if edge.var in scope:
            bound[at] = scope[edge.var]
        for other, many in seen:
            x, y = quoted(other), quoted(mark[0])
            if many and mark[1]:
                df = df.where(~F.arrays_overlap(x, y))
            elif many or mark[1]:
                df = df.where(~F.array_contains(x, y) if many else ~F.array_contains(y, x))
            else:
                df = df.where(x != y)
        seen.append(mark)
        return df, to

    def arrive(self, df: DataFrame, scope: Scope, target: S.Node, to: str, bound: dict, there: int, outer: set[str], whole: bool) -> DataFrame:
        if target.var in scope:
            b = scope[target.var]
            df = df.where((quoted(b.id) == quoted(to)) & (F.lit(True) if target.var in outer else has_labels(b, target.labels)))
        elif target.var in outer or (target.var is None and not target.labels and not target.props and not whole):
            b = NodeBinding(to)
            df = df.where(quoted(to).isNotNull())
        else:
            rel, b = self.nodes(target.labels)
            df = df.join(rel, quoted(to) == quoted(b.id))
        bound[there] = b
        if target.var:
            scope[target.var] = b
        return self.with_props(df, b, target, scope)

    def optional(self, c: S.Match, filters: list) -> None:
        left = self.rows()
        outer = {x.var for p in c.paths for x in p.parts if x.var and x.var in self.scope}
        nodes = [x for p in c.paths for x in p.parts]
        if all(len(p.parts) == 1 and p.parts[0].var in outer and not p.var for p in c.paths):
            return  # nothing new is introduced: the row stays
        if any(isinstance(x, S.Edge) and x.var in outer for x in nodes):
            raise unsupported("OPTIONAL MATCH over an edge variable of an earlier clause")
        bare = [S.Path(p.var, tuple(S.Node(x.var) if isinstance(x, S.Node) and x.var in outer else x for x in p.parts)) for p in c.paths]
        if any(p.var and any(x.var in outer for x in p.parts) for p in bare):
            return self.optional_path(c, filters)
        lets = Scope({n: b for n, b in self.scope.items() if isinstance(b, LetBinding)})
        right, scope, rest = self.grow(None, lets, bare, filters, outer)
        on = [quoted(self.scope[v].id) == quoted(scope[v].id) for v in outer if v in scope]
        for x in nodes:
            if isinstance(x, S.Node) and x.var in outer:
                on.append(has_labels(self.scope[x.var], x.labels))
                for name, e in x.props or ():
                    b = self.scope[x.var]
                    on.append((quoted(b.props[name]) if name in b.props else F.lit(None)) == column(e, self.scope))
        merged = Scope({**scope, **self.scope})
        on += [column(f, merged) for f in rest]
        self.df = left.join(right, both(on), "left")
        self.scope = merged

    def optional_path(self, c: S.Match, filters: list) -> None:
        """A named path through earlier variables needs their values: match on the rows themselves and join back by row."""
        p = self.prefix()
        left = self.rows().withColumn(f"{p}_row", F.monotonically_increasing_id())
        left = durable(left, "rows")
        kept = self.scope
        right, scope, rest = self.grow(left, kept, c.paths, filters, set())
        if rest:
            right = right.where(both([column(f, scope) for f in rest]))
        new = [n for n in right.columns if n not in left.columns]
        paths = {n: b for n, b in scope.items() if isinstance(b, PathBinding) and n not in kept}
        right = right.select(quoted(f"{p}_row").alias(f"{p}_there"), *[quoted(n) for n in new], *[path_value(b).alias(f"{p}_{n}") for n, b in paths.items()])
        self.df = left.join(right, quoted(f"{p}_row") == quoted(f"{p}_there"), "left")
        self.scope = Scope({**scope, **{n: ValueBinding(f"{p}_{n}") for n in paths}})

    # ---- CALL

    def call(self, c: S.Procedure) -> None:
        if c.named:
            raise GqlError("GQL CALL in MATCH takes no named options")
        args = []
        frontier = None
        for a in c.args:
            names = variables(a, self.scope)
            if names:
                df = self.rows().select(column(a, self.scope).cast("long").alias("vertex_id")).where("vertex_id IS NOT NULL").distinct()
                frontier = (frontier or []) + [df]
            else:
                args.append(a.value if isinstance(a, S.Lit) else a)
        out = procedures.pipeline(self.graph, c.name, args, frontier)
        self.yielded(c, out)

    def yielded(self, c: S.Procedure, out: DataFrame) -> None:
        p = self.prefix()
        wanted = c.yields if c.yields is not None else [(x, x) for x in out.columns]
        if len({a for _, a in wanted}) != len(wanted):
            raise GqlError("GQL YIELD names must be unique")
        out = procedures.with_properties(self.graph, out, [x for x, _ in wanted])
        self.df = out.select(*[quoted(x).alias(f"{p}_{a}") for x, a in wanted])
        self.scope = Scope({a: ValueBinding(f"{p}_{a}") for _, a in wanted})
        self.called = True

    # ---- RETURN

    def default_name(self, e) -> str:
        if isinstance(e, S.Prop) and isinstance(e.base, S.Var):
            return f"{e.base.name}.{e.name}"
        if isinstance(e, S.Var):
            return e.name
        if isinstance(e, S.Call) and e.name == "element_id" and isinstance(e.args[0], S.Var):
            return f"element_id({e.args[0].name})"
        return "expression"

    def returned(self, r: S.Return) -> DataFrame:
        df = self.rows()
        items = r.items
        if items is None:
            names = sorted(n for n, b in self.scope.items() if not (isinstance(b, LetBinding) and isinstance(resolve(b.expression, self.scope), (S.Record, S.ListOf))))
            if not names:
                raise GqlError("GQL RETURN * requires at least one visible variable")
            items = [(S.Var(n), n) for n in names]
        for v in r.group:
            self.scope.find(v)
        names = [a or self.default_name(e) for e, a in items]
        aliases = {a: i for i, (_, a) in enumerate(items) if a}
        solved = [resolve(e, self.scope) for e, _ in items]
        keys, hidden = [], []
        for e, down, first in r.order:
            if isinstance(e, S.Var) and e.name in aliases:
                i = aliases[e.name]
            else:
                e = resolve(self.inlined(e, aliases, items), self.scope)
                if e in solved:
                    i = solved.index(e)
                elif r.distinct or self.called:
                    raise GqlError("GQL ORDER BY expressions must appear in RETURN when DISTINCT or CALL is used")
                else:
                    i = len(solved)
                    solved.append(e)
                    hidden.append(i)
            keys.append((i, down, first))
        cols = [f"r{i}" for i in range(len(solved))]
        if any(S.has_aggregate(e) for e in solved):
            plain = [i for i, e in enumerate(solved) if not S.has_aggregate(e)]
            sums = [column(e, self.scope, True).alias(cols[i]) for i, e in enumerate(solved) if S.has_aggregate(e)]
            apart = factored.aggregated(self, *self.only, solved, cols) if self.only else None
            df = apart if apart is not None else df.groupBy(*[column(solved[i], self.scope).alias(cols[i]) for i in plain]).agg(*sums).select(*cols)
        else:
            df = df.select(*[column(e, self.scope).alias(cols[i]) for i, e in enumerate(solved)])
        if r.distinct:
            df = df.distinct()
        if keys:
            order = [(F.col(cols[i]).desc_nulls_first() if first else F.col(cols[i]).desc_nulls_last()) if down else (F.col(cols[i]).asc_nulls_first() if first else F.col(cols[i]).asc_nulls_last()) for i, down, first in keys]
            df = df.orderBy(*order)
        if r.offset:
            df = df.offset(r.offset)
        if r.limit is not None:
            df = df.limit(r.limit)
        return df.select(*cols[: len(names)]).toDF(*names)

    def inlined(self, e, aliases: dict[str, int], items: list):
        """The expression with output names replaced by what they stand for, unless a variable has the name."""
        own = Scope({a: LetBinding(items[i][0]) for a, i in aliases.items() if a not in self.scope})
        return resolve(e, own) if own else e
