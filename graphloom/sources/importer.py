"""Bulk loading of a graph from CSV (.csv, .csv.gz, .csv.zst) or Parquet files with typed headers."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.algorithms import numbered
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE

_HEADER = re.compile(r"(?P<name>[^:{]*)(?::(?P<kind>[A-Za-z_]+)(?P<many>\[\])?(?:\((?P<group>[^)]*)\))?)?(?:\{.*\})?")
_NUMBERS = {"boolean": "boolean", "bool": "boolean", **dict.fromkeys(("byte", "short", "int", "integer", "long"), "bigint"), "float": "double", "double": "double", "string": "string", "char": "string"}
_TIMES = {"date": "date", "localtime": "time(6)", "localdatetime": "timestamp_ntz", "datetime": "timestamp"}


@dataclass
class Header:
    column: str
    name: str
    kind: str | None
    many: bool
    group: str | None


def header(column: str) -> Header:
    m = _HEADER.fullmatch(column.strip())
    if not m:
        raise GqlError(f"GQL header '{column}' is not valid")
    return Header(column, m["name"].strip().lower(), m["kind"], bool(m["many"]), (m["group"] or "").strip().lower() or None)


def _zstd_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of zstd-compressed CSV files, each decompressed by one task."""
    import zstandard

    files = spark.read.format("binaryFile").load(path).select("content")
    opened = lambda raw: io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8", newline="")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([next(csv.reader(opened(x.as_py())), []) for x in batch.column(0)], pa.list_(pa.string()))], names=["row"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                reader = csv.reader(opened(x.as_py()))
                next(reader, None)
                part: list[list[str | None]] = []
                for row in reader:
                    part.append([v or None for v in row])
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], names=["row"])
                        part = []
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], names=["row"])

    names = files.mapInArrow(first, "row array<string>").first()["row"]
    return files.mapInArrow(rows, "row array<string>").select(*[F.col("row")[i].alias(n) for i, n in enumerate(names)])


def read(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower()
    if low.endswith((".csv", ".csv.gz")):
        # a line with an odd number of quotes opens or closes a value that holds a newline; only then files can't be split
        odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
        whole = not spark.read.text(path).where(odd).isEmpty()
        return spark.read.option("header", True).option("multiLine", whole).option("escape", '"').csv(path)
    if low.endswith(".csv.zst"):
        return _zstd_csv(spark, path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise GqlError(f"GQL file format of '{path}' is not supported")


def _cast(c: Column, kind: str) -> Column:
    low = kind.lower()
    if low in _NUMBERS:
        return c.cast(_NUMBERS[low])
    if low in _TIMES:
        return c.cast(_TIMES[low])
    if low == "variant":
        text = c.cast("string")
        body = F.when(text.rlike("^[idbs]:"), F.substring(text, 3, 1 << 30)).otherwise(text)
        listed = F.to_json(F.array(body))
        return F.parse_json(F.when(text.rlike("^[idb]:"), body).otherwise(F.substr(listed, F.lit(2), F.length(listed) - 2)))
    raise GqlError(f"GQL property type '{kind}' is not supported")


def _property(h: Header) -> Column:
    c = F.col(f"`{h.column}`")
    if h.kind is None:
        return c.alias(h.name)
    if h.many:
        return F.transform(F.split(c.cast("string"), ";"), lambda x: _cast(x, h.kind)).alias(h.name)
    return _cast(c, h.kind).alias(h.name)


def _split(headers: list[Header], special: set[str]) -> tuple[dict[str, Header], list[Header]]:
    roles, props = {}, []
    for h in headers:
        if h.kind in special:
            if h.kind in roles:
                raise GqlError(f"GQL header has :{h.kind} twice")
            roles[h.kind] = h
        else:
            props.append(h)
    if len({h.name for h in props}) != len(props) or any(not h.name for h in props):
        raise GqlError("GQL property names in a header must be unique")
    return roles, props


def load(spark: SparkSession, vertex_path: str, edge_path: str, validate: bool = True) -> tuple[DataFrame, DataFrame, int, int]:
    """Vertices, edges and their numbers; ids count from 1 in file order."""
    raw_v, raw_e = read(spark, vertex_path), read(spark, edge_path)
    vertex, vertex_props = _split([header(c) for c in raw_v.columns], {"ID", "LABEL"})
    edge, edge_props = _split([header(c) for c in raw_e.columns], {"START_ID", "END_ID", "TYPE"})
    for role, where in (("ID", vertex), ("START_ID", edge), ("END_ID", edge), ("TYPE", edge)):
        if role not in where:
            raise GqlError(f"GQL header lacks :{role}")
    for role in ("START_ID", "END_ID"):
        if edge[role].group != vertex["ID"].group:
            raise GqlError("GQL :ID groups of vertices and edges must be equal")
    key = F.col(f"`{vertex['ID'].column}`").cast("string")
    if validate:
        n, known, distinct = raw_v.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
        if not n == known == distinct:
            raise GqlError("GQL node :ID values must be unique and not NULL")
    kind = F.lower(F.trim(F.col(f"`{edge['TYPE'].column}`").cast("string")))
    if raw_e.where(F.coalesce(kind, F.lit("")).isin("") | F.coalesce(kind, F.lit("")).contains(";")).limit(1).count():
        raise GqlError("GQL relationships need exactly one non-empty type")
    labels = F.array().cast("array<string>")
    if "LABEL" in vertex:
        parts = F.split(F.lower(F.coalesce(F.col(f"`{vertex['LABEL'].column}`").cast("string"), F.lit(""))), ";")
        labels = F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != ""))
    own = [key.alias(vertex["ID"].name)] if vertex["ID"].name else []
    v = raw_v.select(key.alias("__key"), labels.alias(LABELS), *own, *[_property(h) for h in vertex_props], F.monotonically_increasing_id().alias("__order"))
    v = numbered(v, "__order", ID, 1).drop("__order")
    ends = {r: F.col(f"`{edge[r].column}`").cast("string") for r in ("START_ID", "END_ID")}
    e = raw_e.select(ends["START_ID"].alias("__start"), ends["END_ID"].alias("__end"), kind.alias(TYPE), *[_property(h) for h in edge_props], F.monotonically_increasing_id().alias("__order"))
    e = numbered(e, "__order", EDGE_ID, 1).drop("__order")
    keys = v.select("__key", ID)
    e = e.join(keys.select(F.col("__key").alias("__start"), F.col(ID).alias(SOURCE)), "__start", "left").join(keys.select(F.col("__key").alias("__end"), F.col(ID).alias(TARGET)), "__end", "left")
    if validate and e.where(F.col(SOURCE).isNull() | F.col(TARGET).isNull()).limit(1).count():
        raise GqlError("GQL relationship endpoints must reference imported nodes")
    v = v.select(ID, LABELS, *[f"`{c}`" for c in v.columns if c not in ("__key", ID, LABELS)])
    e = e.select(EDGE_ID, SOURCE, TARGET, TYPE, *[f"`{c}`" for c in e.columns if c not in ("__start", "__end", EDGE_ID, SOURCE, TARGET, TYPE)])
    return v, e, raw_v.count(), raw_e.count()
