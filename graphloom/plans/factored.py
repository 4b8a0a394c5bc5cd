"""Aggregates over patterns that fall apart at one node, without the rows that pair the branches.

The rows of such a pattern are, for each match of the node, all combinations of
its branches' rows. COUNT(*) is the sum of the products of the branches' counts;
COUNT(DISTINCT x), MIN and MAX read the branch of x alone, where the others are
not empty. Between two branches one inequality may hold, for which pairs are
counted along the order of the values, and one pair of edges may have to differ,
for which the pairs with the same edge are subtracted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import EdgeBinding, NodeBinding, Scope, column, quoted, variables
from graphloom.plans import syntax as S

_TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_ORDERED = _INTEGRAL | {"float", "double", "string", "date", "timestamp", "timestamp_ntz", "boolean"}


def aggregated(build, match: S.Match, filters: list, solved: list, cols: list[str]) -> DataFrame | None:
    """The grouped rows of the *solved* items as *cols*, or None where the pattern or the items don't allow it."""
    aggregates = [(i, e) for i, e in enumerate(solved) if S.has_aggregate(e)]
    plain = [(i, e) for i, e in enumerate(solved) if not S.has_aggregate(e)]
    if match.optional or any(p.var or any(isinstance(x, S.Edge) and x.quantified for x in p.parts) for p in match.paths):
        return None
    none = Scope()
    nodes = {x.var for p in match.paths for x in p.parts if isinstance(x, S.Node) and x.var}
    keys = {v for _, e in plain for v in variables(e, none)}
    for centre in sorted(nodes) if not keys else keys & nodes if len(keys) == 1 else ():
        out = _about(build, centre, match.paths, filters, plain, aggregates, cols)
        if out is not None:
            return out
    return None


def _pieces(paths: list[S.Path], centre: str) -> tuple[list[tuple[int, tuple]], list[S.Node]] | None:
    """(path, parts) between the ends of paths and the centre, which stands there by name alone, and the centre as written."""
    pieces, seen = [], []
    for n, p in enumerate(paths):
        cut = [i for i in range(0, len(p.parts), 2) if p.parts[i].var == centre]
        seen += [p.parts[i] for i in cut]
        if len(cut) > 1:
            return None
        bare = [S.Node(x.var) if isinstance(x, S.Node) and x.var == centre else x for x in p.parts]
        sides = [bare[: cut[0] + 1], bare[cut[0] :]] if cut else [bare]
        pieces += [(n, tuple(x)) for x in sides if len(x) > 1 or not cut]
    return pieces, seen


def _names(parts: tuple, centre: str) -> set[str]:
    return {x.var for x in parts if x.var and x.var != centre}


def _about(build, centre: str, paths: list[S.Path], filters: list, plain: list, aggregates: list, cols: list[str]) -> DataFrame | None:
    none = Scope()
    if (cut := _pieces(paths, centre)) is None:
        return None
    pieces, seen = cut
    of_props = [v for p in paths for x in p.parts for _, e in x.props or () for v in variables(e, none)]
    read = [variables(f, none) for f in filters]
    if of_props or any(not r or centre in r and len(r) > 1 for r in read):
        return None

    # pieces that share a name, or that a filter joins, are one branch; one inequality may lie between two
    group = list(range(len(pieces)))

    def join(some: list[int]) -> None:
        for i in some[1:]:
            old, new = group[i], group[some[0]]
            group[:] = [new if g == old else g for g in group]

    names = [_names(p, centre) for _, p in pieces]
    for v in sorted(set().union(*names)):
        join([i for i, n in enumerate(names) if v in n])
    between = []
    for f, r in zip(filters, read):
        touched = [i for i, n in enumerate(names) if n & r]
        if len({group[i] for i in touched}) == 2 and isinstance(f, S.Bin) and f.op in _TURNED:
            between.append((f, touched))
        else:
            join(touched)
    crossing = [(f, t) for f, t in between if len({group[i] for i in t}) > 1]
    for _, t in crossing[1:]:
        join(t)
    crossing = [f for f, t in crossing if len({group[i] for i in t}) > 1]
    branches = [[i for i in range(len(pieces)) if group[i] == g] for g in sorted(set(group))]
    if len(branches) < 2 or any(all(all(x.var != centre for x in pieces[i][1]) for i in b) for b in branches):
        return None
    own = [set().union(*(names[i] for i in b)) for b in branches]

    # edges of one path differ; those of differing types do anyway
    may_meet = []
    for i, (n, a) in enumerate(pieces):
        for j, (m, b) in enumerate(pieces[:i]):
            if n == m and group[i] != group[j]:
                may_meet += [(j, y, i, x) for x in range(1, len(a), 2) for y in range(1, len(b), 2) if not (a[x].labels and b[y].labels and set(a[x].labels) != set(b[y].labels))]
    paired = bool(crossing or may_meet)
    if paired and len(branches) > 2 or len(may_meet) > 1:
        return None

    # what each aggregate reads
    counts, reads = [], []
    for i, e in aggregates:
        if not isinstance(e, S.Call) or e.name not in ("count", "min", "max"):
            return None
        bound = e.args[0] if e.args and not e.star else None
        if e.name == "count" and not e.distinct and (e.star or isinstance(bound, S.Var) and bound.name in own_names(own, centre)):
            counts.append(i)
            continue
        where = [b for b, o in enumerate(own) if (v := variables(bound, none)) and v <= o]
        if paired or len(where) != 1 or e.name == "count" and not e.distinct:
            return None
        reads.append((i, e, where[0]))

    # edges that may meet need names to be compared by
    edge_name = lambda b: f"edge of {b}"
    parts = [list(p) for _, p in pieces]
    met: dict[int, str] = {}
    for i, x, j, y in may_meet:
        for p, at in ((i, x), (j, y)):
            b = next(k for k, m in enumerate(branches) if p in m)
            edge = parts[p][at]
            met[b] = edge.var or edge_name(b)
            parts[p][at] = S.Edge(met[b], edge.labels, edge.direction, props=edge.props)

    grown: list[tuple[DataFrame, Scope]] = []
    for b, members in enumerate(branches):
        mine = [f for f, r in zip(filters, read) if f not in crossing and r <= own[b]]
        df, scope, rest = build.grow(None, Scope(), [S.Path(None, tuple(parts[i])) for i in members], mine, {centre})
        if rest or centre not in scope:
            return None
        grown.append((df, scope))

    rel, node = build.nodes(tuple(dict.fromkeys(x for n in seen for x in n.labels)))
    scope = Scope({centre: node})
    for n in seen:
        rel = build.with_props(rel, node, n, scope)
    for f, r in zip(filters, read):
        if r == {centre}:
            rel = rel.where(column(f, scope))
    keys = [cols[i] for i, _ in plain]
    hub = rel.select(quoted(node.id).alias("hub"), *[column(e, scope).alias(cols[i]) for i, e in plain])

    if paired:
        rows = _pairs(grown, centre, crossing[0] if crossing else None, own, met)
        if rows is None:
            return None
        hub = hub.join(rows, "hub")
    else:
        for b, (df, s) in enumerate(grown):
            hub = hub.join(df.groupBy(quoted(s[centre].id).alias("hub")).agg(F.count("*").alias(f"n{b}")), "hub")
        hub = hub.select("hub", *keys, reduce(lambda x, y: x * y, [F.col(f"n{b}") for b in range(len(grown))]).alias("n"))
    out = hub.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    out = out.select(*keys, *[F.col("n").alias(cols[i]) for i in counts])
    for b in sorted({b for *_, b in reads}):
        df, s = grown[b]
        mine = [(i, e) for i, e, at in reads if at == b]
        rows = df.join(hub.drop("n"), quoted(s[centre].id) == F.col("hub"))
        rows = rows.groupBy(*keys).agg(*[column(e, s, True).alias(cols[i]) for i, e in mine])
        other = rows.select(*[F.col(k).alias(f"own_{k}") for k in keys], *[cols[i] for i, _ in mine])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]) if keys else F.lit(True)
        out = out.join(other, on).drop(*[f"own_{k}" for k in keys])
    return out.select(*cols)


def own_names(own: list[set[str]], centre: str) -> set[str]:
    return set().union(*own) | {centre}


def _pairs(grown: list[tuple[DataFrame, Scope]], centre: str, f: S.Bin | None, own: list[set[str]], met: dict[int, str]) -> DataFrame | None:
    """(hub, n): the pairs of two branches' rows for which the inequality *f* holds and the named edges differ, where there are any."""
    none = Scope()
    sides, op = [F.lit(0), F.lit(0)], None
    if f is not None:
        left, right = variables(f.left, none), variables(f.right, none)
        if left <= own[0] and right <= own[1] and left and right:
            ends, op = (f.left, f.right), f.op
        elif left <= own[1] and right <= own[0] and left and right:
            ends, op = (f.right, f.left), _TURNED[f.op]
        else:
            return None
        if any(isinstance(e, S.Var) and isinstance(s.get(e.name), (NodeBinding, EdgeBinding)) for e, (_, s) in zip(ends, grown)):
            return None
        sides = [column(e, s) for e, (_, s) in zip(ends, grown)]
    rows = []
    for b, (df, s) in enumerate(grown):
        edge = quoted(s[met[b]].id) if met else F.lit(0)
        rows.append(df.select(quoted(s[centre].id).alias("hub"), sides[b].alias("v"), edge.alias("edge")))
    kinds = [dict(r.dtypes)["v"] for r in rows]
    if kinds[0] != kinds[1]:
        if not set(kinds) <= _INTEGRAL | {"double"}:
            return None
        rows = [r.withColumn("v", F.col("v").cast("double" if "double" in kinds else "bigint")) for r in rows]
    elif kinds[0] not in _ORDERED:
        return None
    tally = [r.groupBy("hub", "v").agg(F.count("*").alias("n")) for r in rows]
    a = tally[0].select("hub", "v", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    both = a.unionByName(tally[1].select("hub", "v", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).where("v IS NOT NULL").groupBy("hub", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    if op is None:
        near = F.col("b")
    else:
        order = F.col("v") if op in (">", ">=") else F.col("v").desc()
        span = Window.partitionBy("hub").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if op in ("<", ">") else 0)
        near = F.coalesce(F.sum("b").over(span), F.lit(0))
    n = both.select("hub", (F.col("a") * near).alias("n")).groupBy("hub").agg(F.sum("n").alias("n"))
    if met:
        one = [r.select(*[F.col(c).alias(f"{c}_{i}") for c in r.columns]) for i, r in enumerate(rows)]
        alike = one[0].join(one[1], (F.col("hub_0") == F.col("hub_1")) & (F.col("edge_0") == F.col("edge_1")))
        if op is not None:
            alike = alike.where(_holds(op))
        alike = alike.groupBy(F.col("hub_0").alias("hub")).agg(F.count("*").alias("same"))
        n = n.join(alike, "hub", "left").select("hub", (F.col("n") - F.coalesce("same", F.lit(0))).alias("n"))
    return n.where("n > 0")


def _holds(op: str) -> Column:
    x, y = F.col("v_0"), F.col("v_1")
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
