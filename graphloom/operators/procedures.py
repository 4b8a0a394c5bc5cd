"""The callable procedures: names, arguments and how rows become sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import EDGE_ID, ID, Graph

_TRAVERSALS = {"bfs": A.bfs, "dfs": A.dfs, "sssp": A.sssp}
_WHOLE = {"pagerank": A.pagerank, "wcc": A.wcc, "scc": A.scc, "triangle_count": A.triangle_count, "lcc": A.lcc, "louvain": A.louvain, "degree": A.degree, "closeness": A.closeness}
_OPTIONS = {
    "bfs": {"direction", "max_depth", "target_vertex_id"}, "dfs": {"direction", "max_depth", "target_vertex_id"}, "sssp": {"direction", "max_depth", "target_vertex_id"},
    "pagerank": {"damping", "max_iterations", "tolerance"}, "louvain": {"resolution", "max_iterations", "max_levels", "tolerance"}, "closeness": {"direction"},
}
NAMES = sorted([*_TRAVERSALS, *_WHOLE, "shortest_path_length"])


def _short(name: str) -> str:
    low = name.lower().removeprefix("system.")
    if not low.startswith("algo.") or low[5:] not in NAMES:
        raise GqlError(f"GQL procedure '{name}' does not exist")
    return low[5:]


def _number(x):
    return float(x) if not isinstance(x, (int, str, bool)) and x is not None else x


def standalone(graph: Graph, name: str, args: list, named: dict) -> DataFrame:
    """A call with literal arguments after the graph's name."""
    kind = _short(name)
    args, named = [_number(a) for a in args], {k: _number(v) for k, v in named.items()}
    if kind == "shortest_path_length":
        raise GqlError("algo.shortest_path_length is only available after MATCH")
    allowed = _OPTIONS.get(kind, set()) | {"edge_label", "vertex_label"}
    for k in named:
        if k not in allowed:
            raise GqlError(f"GQL procedure algo.{kind} has no option '{k}'")
    start = None
    if kind in _TRAVERSALS:
        if not args or not isinstance(args[0], int):
            raise GqlError(f"algo.{kind} needs a start vertex id")
        start = args.pop(0)
    if args:
        if len(args) > 1 or not isinstance(args[0], str):
            raise GqlError(f"algo.{kind} got unexpected arguments")
        if "vertex_label" in named:
            raise GqlError("vertex_label is given twice")
        named["vertex_label"] = args[0]
    v, e = A.projection(graph, named.pop("vertex_label", None), named.pop("edge_label", None))
    if start is None:
        return _WHOLE[kind](v, e, **named)
    if not v.where(F.col("id") == start).count():
        if graph.vertices.where(F.col(ID) == start).count():
            raise GqlError(f"vertex {start} is outside the vertex-label projection")
        raise GqlError(f"vertex {start} does not exist")
    if "target_vertex_id" in named:
        named["target"] = named.pop("target_vertex_id")
    return _TRAVERSALS[kind](v, e, [start], **named)


def pipeline(graph: Graph, name: str, args: list, frontier: list[DataFrame] | None) -> DataFrame:
    """A call after MATCH: the rows give the sources, all together; literals after them are labels and a target."""
    kind = _short(name)
    if not args or not isinstance(args[0], str) or args[0].lower() != graph.name.lower():
        raise GqlError("GQL procedures in MATCH take the selected graph's name first")
    rest = args[1:]
    if kind in _WHOLE:
        return standalone(graph, name, rest, {})
    sources = frontier or []
    label = lambda i: rest[i] if len(rest) > i else None
    v, e = A.projection(graph, label(0), label(1))
    if kind == "shortest_path_length":
        if len(sources) != 2:
            raise GqlError("algo.shortest_path_length needs a source and a target")
        ends = []
        for what, df in zip(("source", "target"), sources):
            ids = [r[0] for r in df.limit(2).collect()]
            if len(ids) != 1:
                raise GqlError(f"shortest_path_length requires exactly one distinct {what} vertex")
            ends.append(ids[0])
        return A.shortest_path_length(v, e, *ends)
    if len(sources) != 1:
        raise GqlError(f"algo.{kind} needs one source argument")
    target = label(2)
    if kind == "sssp" and sources[0].limit(2).count() != 1:
        raise GqlError("SSSP requires exactly one distinct source vertex")
    if kind == "dfs":
        return A.dfs(v, e, [r[0] for r in sources[0].collect()], target=target)
    return _TRAVERSALS[kind](v, e, sources[0], target=target)


def with_properties(graph: Graph, out: DataFrame, wanted: list[str]) -> DataFrame:
    """*out* joined with the properties among *wanted*: of its vertices, or of its edges."""
    extra = [x for x in wanted if x not in out.columns]
    if not extra:
        return out
    has_vertex, has_edge = "vertex_id" in out.columns, "edge_id" in out.columns
    of_vertex = [x for x in extra if has_vertex and x in graph.vertex_props]
    of_edge = [x for x in extra if has_edge and x in graph.edge_props]
    for x in extra:
        if x in of_vertex and x in of_edge:
            raise GqlError(f"GQL YIELD name '{x}' is ambiguous")
        if x not in of_vertex and x not in of_edge:
            raise GqlError(f"GQL YIELD name '{x}' does not exist")
    if of_vertex:
        out = out.join(graph.vertices.select(F.col(ID).alias("vertex_id"), *[F.col(f"`{x}`") for x in of_vertex]), "vertex_id")
    if of_edge:
        out = out.join(graph.edges.select(F.col(EDGE_ID).alias("edge_id"), *[F.col(f"`{x}`") for x in of_edge]), "edge_id", "left")
    return out
