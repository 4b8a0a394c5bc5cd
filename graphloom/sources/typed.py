"""Typed graph schemas: property types, materialisation and the check of a new version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import syntax as S
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE

_TYPES: dict[str, str] = {}
for spelling, spark_type in (
    ("bool boolean", "boolean"), ("string char varchar", "string"), ("bytes binary varbinary", "binary"), ("int8 integer8", "tinyint"), ("int16 integer16 smallint smallinteger uint8", "smallint"),
    ("int32 integer32 int integer uint16 usmallint", "int"), ("int64 integer64 bigint biginteger uint32 uint", "bigint"), ("int128 integer128 uint128", "decimal(38,0)"), ("uint64 ubigint", "decimal(20,0)"),
    ("float32 real float", "float"), ("float64 double doubleprecision", "double"), ("date", "date"), ("time localtime", "time(6)"), ("zonedtime", "string"), ("localdatetime timestamp", "timestamp_ntz"), ("zoneddatetime", "timestamp"),
):
    _TYPES |= dict.fromkeys(spelling.split(), spark_type)


def spark_type(kind: str, size: tuple[int, ...] = ()) -> str:
    if kind in ("decimal", "dec"):
        return f"decimal({','.join(map(str, size or (18, 3)))})"
    if kind not in _TYPES:
        raise GqlError(f"GQL property type '{kind.upper()}' is not supported")
    return _TYPES[kind]


def schema_of(elements: list[S.TypedElement]) -> list[dict]:
    """The schema as stored in the manifest, after its own checks."""
    out, shared = [], {}
    nodes = {e.alias: e for e in elements if e.kind == "node"}
    seen: set[tuple[str, ...]] = set()
    for e in elements:
        props = {}
        for name, kind, size, nullable in e.props:
            if name in props:
                raise GqlError(f"GQL property '{name}' is declared twice")
            props[name] = [spark_type(kind, size), nullable]
            if shared.setdefault((e.kind, name), props[name][0]) != props[name][0]:
                raise GqlError(f"GQL property '{name}' has two types")
        labels = sorted(set(e.labels)) or ([e.alias] if e.kind == "node" and e.alias else [])
        if e.kind == "node":
            if tuple(labels) in seen:
                raise GqlError("GQL node types need distinct label sets")
            seen.add(tuple(labels))
        else:
            for end in (e.source, e.target):
                if end not in nodes:
                    raise GqlError(f"GQL node type '{end}' is not defined")
            if not labels:
                raise GqlError("GQL edge types need a label")
        out.append({"kind": e.kind, "labels": labels, "props": props})
    return out


def empty_tables(spark: SparkSession, schema: list[dict]) -> tuple[DataFrame, DataFrame]:
    form = {"node": f"{ID} bigint, {LABELS} array<string>", "edge": f"{EDGE_ID} bigint, {SOURCE} bigint, {TARGET} bigint, {TYPE} string"}
    for kind in form:
        props: dict[str, str] = {}
        for e in schema:
            if e["kind"] == kind:
                props |= {n: t for n, (t, _) in e["props"].items()}
        form[kind] += "".join(f", `{n}` {t}" for n, t in sorted(props.items()))
    return spark.createDataFrame([], form["node"]), spark.createDataFrame([], form["edge"])


def check(schema: list[dict], vertices: DataFrame | None, edges: DataFrame | None) -> None:
    """Raise unless every row has a declared type, its required properties and no undeclared ones."""
    for kind, df, base in (("node", vertices, (ID, LABELS)), ("edge", edges, (EDGE_ID, SOURCE, TARGET, TYPE))):
        if df is None:
            continue
        names = [c for c in df.columns if c not in base]
        good = []
        for e in schema:
            if e["kind"] != kind:
                continue
            test = F.array_sort(F.array_distinct(LABELS)) == F.array(*[F.lit(x) for x in e["labels"]]).cast("array<string>") if kind == "node" else F.col(TYPE) == e["labels"][0]
            for n in names:
                if n not in e["props"]:
                    test = test & F.col(f"`{n}`").isNull()
                elif not e["props"][n][1]:
                    test = test & F.col(f"`{n}`").isNotNull()
            good.append(test)
        bad = ~F.coalesce(reduce(lambda a, b: a | b, good), F.lit(False)) if good else F.lit(True)
        if df.where(bad).limit(1).count():
            raise GqlError(f"GQL typed graph constraint failed: {'a node' if kind == 'node' else 'an edge'} fits no declared type")


