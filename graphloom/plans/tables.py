"""Property graphs over the driver's relational tables: ids by arithmetic, one branch of a union for each kind.

A label or type test is a constant in every branch, so Catalyst drops the
branches that can't match and prunes the columns of the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE, Graph

#: Each kind of vertex has ids of its own high bits.
OFFSET = {kind: i << 56 for i, kind in enumerate(("region", "nation", "supplier", "customer", "part", "order"), 1)}
_NODES = {
    "region": ("region", "r_regionkey", ["r_name"]),
    "nation": ("nation", "n_nationkey", ["n_name"]),
    "supplier": ("supplier", "s_suppkey", ["s_name", "s_acctbal"]),
    "customer": ("customer", "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"]),
    "part": ("part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "order": ("orders", "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def vertex_id(kind: str, key: str):
    return F.col(key).cast("long") + F.lit(OFFSET[kind] + 1)


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, (name, key, props) in _NODES.items():
        parts.append(table(spark, sf_dir, name).select(vertex_id(kind, key).alias(ID), F.array(F.lit(kind)).alias(LABELS), *props))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def business_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, suppliers, customers, parts and orders."""
    read = lambda t: table(spark, sf_dir, t)
    edge = lambda i, s, t, kind: (i.cast("long").alias(EDGE_ID), s.alias(SOURCE), t.alias(TARGET), F.lit(kind).alias(TYPE))
    step = 1 << 58
    nation, customer, supplier, orders, lineitem = (read(t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    supplied = lineitem.select("l_suppkey", "l_partkey").distinct()
    parts = [
        nation.select(*edge(F.col("n_nationkey") + F.lit(1 * step), vertex_id("nation", "n_nationkey"), vertex_id("region", "n_regionkey"), "in_region")),
        customer.select(*edge(F.col("c_custkey") + F.lit(2 * step), vertex_id("customer", "c_custkey"), vertex_id("nation", "c_nationkey"), "in_nation")),
        supplier.select(*edge(F.col("s_suppkey") + F.lit(3 * step), vertex_id("supplier", "s_suppkey"), vertex_id("nation", "s_nationkey"), "in_nation")),
        orders.select(*edge(F.col("o_orderkey") + F.lit(4 * step), vertex_id("customer", "o_custkey"), vertex_id("order", "o_orderkey"), "placed")),
        lineitem.select(*edge(F.shiftrightunsigned(F.xxhash64(*lineitem.columns), 1), vertex_id("order", "l_orderkey"), vertex_id("part", "l_partkey"), "contains"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")),
        supplied.select(*edge(F.lit(5 * step) + F.col("l_suppkey") * F.lit(1 << 32) + F.col("l_partkey"), vertex_id("supplier", "l_suppkey"), vertex_id("part", "l_partkey"), "supplied")),
    ]
    return Graph("business", _vertices(spark, sf_dir), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, each leading to the part of the next line of an order it is in; it has loops, cycles and parallel edges."""
    part = table(spark, sf_dir, "part").select(vertex_id("part", "p_partkey").alias(ID), F.array(F.lit("part")).alias(LABELS), "p_name", "p_brand")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pairs = line.join(after, ["l_orderkey", "l_linenumber"])
    e = pairs.select(F.shiftrightunsigned(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "next"), 1).alias(EDGE_ID), vertex_id("part", "l_partkey").alias(SOURCE), vertex_id("part", "next").alias(TARGET), F.lit("next").alias(TYPE))
    return Graph("parts", part, e)


def ring_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, each leading to the next one of its region by key, and the last to the first."""
    nation = table(spark, sf_dir, "nation")
    v = nation.select(vertex_id("nation", "n_nationkey").alias(ID), F.array(F.lit("nation")).alias(LABELS), "n_name", "n_regionkey")
    own = Window.partitionBy("n_regionkey")
    after = F.coalesce(F.lead("n_nationkey").over(own.orderBy("n_nationkey")), F.min("n_nationkey").over(own))
    e = nation.withColumn("next", after).select((F.col("n_nationkey").cast("long") + 1).alias(EDGE_ID), vertex_id("nation", "n_nationkey").alias(SOURCE), vertex_id("nation", "next").alias(TARGET), F.lit("next").alias(TYPE))
    return Graph("ring", v, e)
