"""A property graph: one table of vertices and one of edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID, LABELS = "__gql_id", "__gql_label"
EDGE_ID, SOURCE, TARGET, TYPE = "__gql_edge_id", "__gql_source_id", "__gql_target_id", "__gql_type"


@dataclass
class Graph:
    name: str
    vertices: DataFrame
    edges: DataFrame
    _degrees: dict[str, tuple[int, int, int]] | None = field(default=None, repr=False)

    def fan_out(self, types: tuple[str, ...], direction: str) -> float:
        """Edges for each of the vertices that have any, of the given types (all if there are none), by one pass over the edges."""
        if self._degrees is None:
            rows = self.edges.groupBy(TYPE).agg(F.count("*"), F.approx_count_distinct(SOURCE), F.approx_count_distinct(TARGET)).collect()
            self._degrees = {r[0]: tuple(r[1:]) for r in rows}
        own = [d for t, d in self._degrees.items() if all(x == t for x in types)]
        ways = {"out": [1], "in": [2]}.get(direction, [1, 2])
        return sum(d[0] / max(1, d[i]) for d in own for i in ways)

    @property
    def vertex_props(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in (ID, LABELS)]

    @property
    def edge_props(self) -> list[str]:
        return [c for c in self.edges.columns if c not in (EDGE_ID, SOURCE, TARGET, TYPE)]
