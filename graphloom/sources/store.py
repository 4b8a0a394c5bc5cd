"""Named, versioned graphs in one folder: Parquet tables for each version and one manifest.

A version's tables are never changed; a statement writes new tables and then
replaces the manifest by a rename, so readers see all of it or nothing. One
writer at a time. All access goes through Hadoop's file systems, so the folder
may lie wherever the cluster's executors can reach it.
"""

from __future__ import annotations

import copy
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.durable import shared_folder
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE, Graph

_VERTEX = f"{ID} bigint, {LABELS} array<string>"
_EDGE = f"{EDGE_ID} bigint, {SOURCE} bigint, {TARGET} bigint, {TYPE} string"


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}").rstrip("/")
        self.staged: dict | None = None
        self.transient: dict[str, Graph] = {}
        self.manifest = self._read()

    # ---- manifest

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _read(self) -> dict:
        path = self._path("manifest.json")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {"next": 1, "graphs": {}}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temporary, path = self._path(f"manifest-{uuid.uuid4().hex}.json"), self._path("manifest.json")
        fs = path.getFileSystem(conf)
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(self.manifest).encode()))
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(fs.makeQualified(temporary), fs.makeQualified(path), how)

    def begin(self) -> None:
        if self.staged is not None:
            raise GqlError("GQL transaction is already open")
        self.staged = copy.deepcopy(self.manifest)

    def commit(self) -> None:
        if self.staged is None:
            raise GqlError("GQL no transaction is open")
        self.staged = None
        self._write()

    def rollback(self) -> None:
        if self.staged is None:
            raise GqlError("GQL no transaction is open")
        self.manifest, self.staged = self.staged, None

    def autocommit_only(self, what: str) -> None:
        if self.staged is not None:
            raise GqlError(f"GQL {what} cannot run inside a transaction")

    def save(self) -> None:
        if self.staged is None:
            self._write()

    # ---- graphs

    def meta(self, name: str) -> dict:
        if name not in self.manifest["graphs"]:
            raise GqlError(f"GQL graph '{name}' does not exist")
        return self.manifest["graphs"][name]

    def graph(self, name: str) -> Graph:
        if name in self.transient:
            return self.transient[name]
        m = self.meta(name)
        read = lambda path, form: self.spark.read.parquet(path) if path else self.spark.createDataFrame([], form)
        return Graph(name, read(m["vertices"], _VERTEX), read(m["edges"], _EDGE))

    def create(self, name: str, if_missing: bool, typed: list | None, props: tuple[DataFrame, DataFrame] | None = None) -> bool:
        self.autocommit_only("CREATE GRAPH")
        if name in self.manifest["graphs"] or name in self.transient:
            if if_missing:
                return False
            raise GqlError(f"GQL graph '{name}' already exists")
        m = {"id": self.manifest["next"], "version": 1, "created_at": datetime.now(timezone.utc).isoformat(), "mode": "EMPTY", "vertices": None, "edges": None, "typed": typed, "next_vertex": 1, "next_edge": 1, "vertex_count": 0, "edge_count": 0, "indexes": []}
        self.manifest["next"] += 1
        self.manifest["graphs"][name] = m
        if props is not None:
            m |= {"mode": "TABLE_BACKED", "vertices": self.table(name, "vertices", props[0]), "edges": self.table(name, "edges", props[1])}
        self.save()
        return True

    def drop(self, name: str, if_exists: bool) -> bool:
        self.autocommit_only("DROP GRAPH")
        if self.transient.pop(name, None) is not None:
            return True
        if name not in self.manifest["graphs"]:
            if if_exists:
                return False
            raise GqlError(f"GQL graph '{name}' does not exist")
        del self.manifest["graphs"][name]
        self.save()
        return True

    def table(self, name: str, what: str, df: DataFrame) -> str:
        """A new table of the graph; vertices lie sorted by id within files, edges by source, so that scans can skip."""
        path = f"{self.root}/{name}/{what}-{uuid.uuid4().hex}"
        df.sortWithinPartitions(ID if what == "vertices" else SOURCE).write.parquet(path)
        return path

    def publish(self, name: str, vertices: DataFrame | None, edges: DataFrame | None, next_vertex: int | None = None, next_edge: int | None = None) -> None:
        """A new version of the graph; what is None stays."""
        old = self.meta(name)
        m = dict(old) | {"version": old["version"] + 1, "mode": "TABLE_BACKED"}
        if vertices is not None:
            m["vertices"] = self.table(name, "vertices", vertices)
        if edges is not None:
            m["edges"] = self.table(name, "edges", edges)
        m["vertex_count"] = self.spark.read.parquet(m["vertices"]).count() if m["vertices"] else 0
        m["edge_count"] = self.spark.read.parquet(m["edges"]).count() if m["edges"] else 0
        m |= {k: v for k, v in (("next_vertex", next_vertex), ("next_edge", next_edge)) if v is not None}
        self.manifest["graphs"][name] = m
        self.save()

    # ---- views of the catalog

    def graphs(self) -> DataFrame:
        rows = [(m["id"], n, m["version"], m["vertex_count"], m["edge_count"], m["created_at"]) for n, m in sorted(self.manifest["graphs"].items())]
        form = "graph_id bigint, graph_name string, graph_version bigint, vertex_count bigint, edge_count bigint, created_at string"
        return self.spark.createDataFrame(rows, form).withColumn("created_at", F.to_timestamp("created_at"))

    def create_index(self, name: str, prop: str) -> DataFrame:
        self.autocommit_only("index creation")
        m, prop = self.meta(name), prop.lower()
        if prop not in self.graph(name).vertex_props:
            raise GqlError(f"GQL property '{prop}' is not mapped")
        if prop not in m["indexes"]:
            m["indexes"].append(prop)
            self.save()
        return self.spark.createDataFrame([(True, name, prop, f"{name}_{prop}_idx")], "success boolean, graph_name string, property_name string, index_name string")

    def drop_index(self, name: str, prop: str) -> DataFrame:
        self.autocommit_only("index removal")
        m = self.meta(name)
        if prop.lower() in m["indexes"]:
            m["indexes"].remove(prop.lower())
            self.save()
        return self.spark.createDataFrame([(True,)], "success boolean")

    def indexes(self) -> DataFrame:
        rows = [(n, p, f"{n}_{p}_idx", m["vertices"], p) for n, m in sorted(self.manifest["graphs"].items()) for p in m["indexes"]]
        return self.spark.createDataFrame(rows, "graph_name string, property_name string, index_name string, table_name string, column_name string")
