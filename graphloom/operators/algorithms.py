"""Graph algorithms over vertices (id) and edges (id, s, t).

Loops run on the driver, the data stays on the executors; each round is written
to the shared folder, so lineage doesn't grow and lost executors cost one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.durable import durable
from graphloom.operators.kernels import DFS_EDGES, depth_first, louvain_groups, scc_kernel, single_task
from graphloom.operators.zones import within, within_pairs, zone_pairs
from graphloom.plans.errors import GqlError
from graphloom.plans.graph import EDGE_ID, ID, LABELS, SOURCE, TARGET, TYPE, Graph

#: Strongly connected components of a graph with fewer edges are found in one task.
SCC_KERNEL_EDGES = 500_000
#: Pairs of vertices for each group of components that Louvain takes in one task.
LOUVAIN_PAIRS = 250_000


def projection(graph: Graph, vertex_label: str | None = None, edge_label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The induced sub-graph; a label that nothing has selects nothing."""
    v, e = graph.vertices, graph.edges
    if vertex_label:
        v = v.where(F.array_contains(LABELS, vertex_label.lower()))
    if edge_label:
        e = e.where(F.col(TYPE) == edge_label.lower())
    v = v.select(F.col(ID).alias("id"))
    e = e.select(F.col(EDGE_ID).alias("id"), F.col(SOURCE).alias("s"), F.col(TARGET).alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    if vertex_label:
        e = e.join(v.select(F.col("id").alias("s")), "s", "left_semi").join(v.select(F.col("id").alias("t")), "t", "left_semi")
    return v, e.select("id", "s", "t")


def hops(edges: DataFrame, direction: str) -> DataFrame:
    """f, t, edge id and phase (outgoing before incoming)."""
    out = edges.select(F.col("s").alias("f"), F.col("t").alias("t"), F.col("id").alias("e"), F.lit(0).alias("phase"))
    back = edges.select(F.col("t").alias("f"), F.col("s").alias("t"), F.col("id").alias("e"), F.lit(1).alias("phase"))
    if direction not in ("out", "in", "both"):
        raise GqlError("direction must be out, in or both")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def numbered(df: DataFrame, key: str, name: str, base: int) -> DataFrame:
    """*df* with ranks from *base* in the order of *key*, which is unique; no single task sorts it all."""
    parts = durable(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranked")
    counts, before = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}, []
    for p in sorted(counts):
        before.append((p, base))
        base += counts[p]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before bigint")
    ranked = parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1)
    return ranked.drop("__part", "__before")


def bfs(vertices: DataFrame, edges: DataFrame, starts: list[int] | DataFrame, direction: str = "out", max_depth: int | None = None, target: int | None = None) -> DataFrame:
    """vertex_id, depth, parent_vertex_id, edge_id, visit_order in first-in-first-out order.

    A vertex's parent is the first in visiting order to reach it, by its first
    edge in adjacency order. The walk ends with the target's row.
    """
    spark = vertices.sparkSession
    first = spark.createDataFrame([(x,) for x in sorted(set(starts))], "vertex_id bigint") if isinstance(starts, list) else starts.distinct()
    none = F.lit(None).cast("bigint")
    first = first.join(vertices.select(F.col("id").alias("vertex_id")), "vertex_id", "left_semi")
    level = numbered(first, "vertex_id", "visit_order", 0).select("vertex_id", F.lit(0).alias("depth"), none.alias("parent_vertex_id"), none.alias("edge_id"), "visit_order")
    level = durable(level, "level")
    levels, n, depth = [level], level.count(), 0
    step = durable(hops(edges, direction), "hops")
    total = n
    while n and (max_depth is None or depth < max_depth):
        if target is not None and level.where(F.col("vertex_id") == target).count():
            break
        depth += 1
        seen = reduce(DataFrame.unionByName, levels).select("vertex_id")
        reached = level.select(F.col("vertex_id").alias("f"), "visit_order").join(step, "f").select(F.col("t").alias("vertex_id"), F.struct(F.col("visit_order").alias("o"), "phase", "e", F.col("f").alias("p")).alias("by"))
        fresh = reached.join(seen, "vertex_id", "left_anti").groupBy("vertex_id").agg(F.min("by").alias("by"))
        level = numbered(fresh, "by", "visit_order", total)
        level = durable(level.select("vertex_id", F.lit(depth).alias("depth"), F.col("by.p").alias("parent_vertex_id"), F.col("by.e").alias("edge_id"), "visit_order"), "level")
        n = level.count()
        total += n
        levels.append(level)
    out = reduce(DataFrame.unionByName, levels)
    if target is not None:
        end = out.where(F.col("vertex_id") == target).agg(F.min("visit_order")).first()[0]
        if end is not None:
            out = out.where(F.col("visit_order") <= end)
    return out.orderBy("visit_order")


def dfs(vertices: DataFrame, edges: DataFrame, starts: list[int], direction: str = "out", max_depth: int | None = None, target: int | None = None) -> DataFrame:
    """vertex_id, depth, parent_vertex_id, edge_id, visit_order; one task has the targets of all edges, four bytes each."""
    edges = durable(edges, "edges")
    step = hops(edges, direction)
    tree = durable(depth_first(vertices, step, edges.count() * (2 if direction == "both" else 1), sorted(set(starts)), max_depth, target, DFS_EDGES), "tree")
    # of parallel edges the first leads on
    by = step.join(tree.select(F.col("parent_vertex_id").alias("f"), F.col("vertex_id").alias("t")), ["f", "t"]).groupBy("t").agg(F.min(F.struct("phase", "e")).alias("by"))
    return tree.join(by, F.col("vertex_id") == F.col("t"), "left").select("vertex_id", "depth", "parent_vertex_id", F.col("by.e").alias("edge_id"), "visit_order")


def sssp(vertices: DataFrame, edges: DataFrame, start, **how) -> DataFrame:
    return bfs(vertices, edges, start, **how).withColumnsRenamed({"depth": "distance", "visit_order": "settled_order"})


def shortest_path_length(vertices: DataFrame, edges: DataFrame, source: int, target: int) -> DataFrame:
    """distance along outgoing edges; -1 if there is no way."""
    spark = vertices.sparkSession
    answer = lambda d: spark.createDataFrame([(d,)], "distance bigint")
    if vertices.where(F.col("id").isin(source, target)).select("id").distinct().count() < len({source, target}):
        return answer(-1)
    if source == target:
        return answer(0)
    links = durable(edges.select("s", "t").distinct(), "links")
    level = spark.createDataFrame([(source,)], "v bigint")
    levels, depth = [level], 0
    while True:
        depth += 1
        seen = reduce(DataFrame.unionByName, levels)
        level = durable(level.join(links, F.col("v") == F.col("s")).select(F.col("t").alias("v")).distinct().join(seen, "v", "left_anti"), "level")
        if level.where(F.col("v") == target).count():
            return answer(depth)
        if not level.count():
            return answer(-1)
        levels.append(level)


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """vertex_id, rank, iterations, converged; parallel edges count, dangling mass is spread evenly."""
    if not 0 < damping < 1:
        raise GqlError("damping must be between 0 and 1")
    if max_iterations < 1 or tolerance <= 0:
        raise GqlError("max_iterations and tolerance must be positive")
    n = vertices.count()
    out = edges.groupBy("s").agg(F.count("*").alias("n"))
    links = durable(edges.groupBy("s", "t").agg(F.count("*").alias("k")).join(out, "s").select("s", "t", (F.col("k") / F.col("n")).alias("w")), "links")
    start = vertices.join(out.select(F.col("s").alias("id"), "n"), "id", "left").select("id", F.col("n").isNull().alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank"))
    ranks = durable(start, "ranks")
    loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    done, turn = n == 0, 0
    while turn < max_iterations and not done:
        turn += 1
        got = ranks.select(F.col("id").alias("s"), "rank").join(links, "s").groupBy("t").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        base = (1 - damping) / n + damping * loose / n
        new = ranks.withColumnRenamed("rank", "old").join(got.withColumnRenamed("t", "id"), "id", "left").select("id", "dangling", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "old")
        new = durable(new, "ranks")
        moved, loose = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        ranks, done = new.drop("old"), moved <= tolerance
    return ranks.select(F.col("id").alias("vertex_id"), "rank", F.lit(turn).cast("long").alias("iterations"), F.lit(done).alias("converged"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the smallest id connected with each vertex, by alternating large and small stars."""
    links = durable(edges.select(F.greatest("s", "t").alias("u"), F.least("s", "t").alias("v")).where("u <> v").distinct(), "links")
    last = None
    while True:
        two = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        links = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    root = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    return vertices.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def sized(members: DataFrame) -> DataFrame:
    """vertex_id, component_id, component_size of (id, root)."""
    size = members.groupBy("root").agg(F.count("*").alias("component_size"))
    return members.join(size, "root").select(F.col("id").alias("vertex_id"), F.col("root").alias("component_id"), "component_size")


def wcc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return sized(components(vertices, edges))


def scc(vertices: DataFrame, edges: DataFrame, kernel_edges: int = SCC_KERNEL_EDGES) -> DataFrame:
    """vertex_id, component_id (smallest member), component_size.

    Up to *kernel_edges* one task does all. Beyond, vertices without incoming or
    without outgoing edges are components of their own and leave the graph, until
    there are none; then every vertex is coloured with the smallest id that
    reaches it; what reaches a colour's own vertex within the colour is a
    component and leaves the graph, and so on.
    """
    edges = durable(edges.select("s", "t").where("s <> t").distinct().withColumn("id", F.lit(0).cast("long")), "edges")
    if edges.count() <= kernel_edges:
        return single_task(vertices, edges, scc_kernel, "vertex_id bigint, component_id bigint, component_size bigint")
    rest, found = durable(vertices, "rest"), []
    while True:
        rest, edges, lone = _trimmed(rest, edges)
        found += lone
        if not rest.count():
            break
        colour = rest.select("id", F.col("id").alias("c"))
        while True:
            better = colour.join(edges, colour["id"] == edges["s"]).groupBy("t").agg(F.min("c").alias("m")).withColumnRenamed("t", "id")
            new = durable(colour.join(better, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("changed")), "colour")
            colour = new.select("id", "c")
            if not new.where("changed").count():
                break
        ends = edges.join(colour.select(F.col("id").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("id").alias("t"), F.col("c").alias("ct")), "t")
        own = durable(ends.where("cs = ct").select("s", "t"), "own")
        level = colour.where("id = c")
        levels = [level]
        while True:
            seen = reduce(DataFrame.unionByName, levels).select("id")
            level = durable(level.join(own, level["id"] == own["t"]).select(F.col("s").alias("id"), "c").distinct().join(seen, "id", "left_anti"), "level")
            if not level.count():
                break
            levels.append(level)
        done = durable(reduce(DataFrame.unionByName, levels).select("id", F.col("c").alias("root")), "done")
        found.append(done)
        rest = durable(rest.join(done, "id", "left_anti"), "rest")
        alive = rest.select("id")
        edges = durable(edges.join(alive.withColumnRenamed("id", "s"), "s", "left_semi").join(alive.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t"), "edges")
    return sized(reduce(DataFrame.unionByName, found)) if found else sized(vertices.select("id", F.col("id").alias("root")))


def _trimmed(rest: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Vertices that have incoming and outgoing edges among themselves, those edges, and (id, root) of the others."""
    gone = []
    while True:
        both = rest.join(edges.select(F.col("s").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("t").alias("id")).distinct(), "id", "left_semi")
        both = durable(both, "rest")
        lone = durable(rest.join(both, "id", "left_anti").select("id", F.col("id").alias("root")), "lone")
        if lone.isEmpty():
            return both, edges, gone
        gone.append(lone)
        edges = durable(edges.join(both.withColumnRenamed("id", "s"), "s", "left_semi").join(both.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t"), "edges")
        rest = both


def _triangles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Simple undirected pairs (u < v, arcs: how many of the two directions exist) and triangles a, b, c with the arcs opposite to each."""
    arcs = edges.select("s", "t").where("s <> t").distinct()
    pairs = durable(arcs.select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).groupBy("u", "v").agg(F.count("*").alias("arcs")), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(ends.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(ends.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    swap = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") > F.col("v")))
    # from the end of smaller degree: no vertex has many such pairs
    up = durable(ranked.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("x"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("y"), "arcs"), "up")
    wedge = up.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("arcs").alias("arcs_c")).join(up.select(F.col("x").alias("a"), F.col("y").alias("c"), F.col("arcs").alias("arcs_b")), "a").where("b < c")
    closed = wedge.join(pairs.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("arcs").alias("arcs_a")), ["b", "c"])
    return ends, closed


def triangle_count(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends, closed = _triangles(edges)
    closed = durable(closed.select("a", "b", "c"), "triangles")
    whole = closed.count()
    own = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    d, n = F.coalesce("d", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0)).cast("long")
    return vertices.join(ends, "id", "left").join(own, "id", "left").select(F.col("id").alias("vertex_id"), n.alias("triangle_count"), d.alias("degree"), F.when(d < 2, F.lit(0.0)).otherwise(2.0 * n / (d * (d - 1))).alias("local_clustering_coefficient"), F.lit(whole).cast("long").alias("global_triangle_count"))


def lcc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends, closed = _triangles(edges)
    own = closed.select(F.explode(F.array(*[F.struct(F.col(x).alias("id"), F.col(f"arcs_{x}").alias("n")) for x in "abc"])).alias("z")).groupBy("z.id").agg(F.sum("z.n").alias("n"))
    d, n = F.coalesce("d", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0)).cast("long")
    return vertices.join(ends, "id", "left").join(own, "id", "left").select(F.col("id").alias("vertex_id"), d.alias("degree"), n.alias("directed_neighbor_edge_count"), F.when(d < 2, F.lit(0.0)).otherwise(n / (d * (d - 1))).alias("local_clustering_coefficient"))


def louvain(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0, max_iterations: int = 32, max_levels: int = 32, tolerance: float = 1e-12) -> DataFrame:
    """vertex_id, community_id, community_size, modularity, levels, iterations, converged.

    Moves depend on the vertices of one component alone, and on the number of all
    links, so groups of components are done apart. All go on until no component
    merges anything: a level takes as many turns as in the group that needs most.
    """
    ends = edges.where("s <> t").select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v"), "id")
    pairs = durable(ends.groupBy("u", "v").agg(F.min("id").alias("e")), "pairs")
    n = pairs.count()
    place = durable(components(vertices, pairs.select(F.col("u").alias("s"), F.col("v").alias("t"))), "components")
    groups = max(1, -(-n // LOUVAIN_PAIRS))
    apart = pairs.join(place.select(F.col("id").alias("u"), F.pmod(F.xxhash64("root"), F.lit(groups)).alias("part")), "u")
    done = durable(louvain_groups(apart, 2.0 * n, resolution, max_iterations, max_levels, tolerance), "communities")
    turns = [r["turns"] for r in done.where("turns IS NOT NULL").select("turns").collect()]
    levels = max([len(t) for t in turns], default=1)
    iterations = sum(max([t[i] for t in turns if len(t) > i], default=1) for i in range(levels))
    inside, around = done.where("vertex_id = community_id").agg(F.sum("inside"), F.sum(F.col("around").cast("decimal(19,0)") * F.col("around").cast("decimal(19,0)"))).first()
    q = inside / (2.0 * n) - resolution * float(around) / (2.0 * n) ** 2 if n else 0.0
    converged = done.where("NOT settled").isEmpty()
    lone = vertices.join(done.select(F.col("vertex_id").alias("id")), "id", "left_anti").select(F.col("id").alias("vertex_id"), F.col("id").alias("community_id"), F.lit(1).cast("long").alias("community_size"))
    whole = done.select("vertex_id", "community_id", "community_size").unionByName(lone)
    return whole.select("*", F.lit(float(q)).alias("modularity"), F.lit(levels).cast("long").alias("levels"), F.lit(iterations).cast("long").alias("iterations"), F.lit(converged).alias("converged"))


def degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("s").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    own = ends.groupBy("x.id").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i"))
    o, i = F.coalesce("o", F.lit(0)).cast("long"), F.coalesce("i", F.lit(0)).cast("long")
    return vertices.join(own, "id", "left").select(F.col("id").alias("vertex_id"), o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("total_degree"))


def closeness(vertices: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """vertex_id, reachable_count, distance_sum, closeness_centrality: reached^2 / ((n - 1) * distance sum)."""
    n = vertices.count()
    step = durable(hops(edges, direction).select("f", "t").where("f <> t").distinct(), "hops")
    # the first level is the hops themselves; zones of ids leave out what can't go on, or hasn't been seen
    turns = zone_pairs(step, "f", "t")
    level, depth, parts, ahead = step.select(F.col("f").alias("src"), F.col("t").alias("v")), 1, [], turns
    levels = []
    while ahead != set() and level.count():
        levels.append(level)
        parts.append(level.select("src", F.lit(depth).cast("long").alias("d")))
        depth += 1
        known = ahead is not None and turns is not None
        middle = {y for _, y in ahead} & {x for x, _ in turns} if known else None
        after = {(x, z) for x, y in ahead for w, z in turns if y == w} if known else None
        more = within(level, "v", middle).join(within(step, "f", middle), F.col("v") == F.col("f")).where("src <> t").select("src", F.col("t").alias("v")).distinct()
        seen = within_pairs(reduce(DataFrame.unionByName, levels), "src", "v", after)
        if after == set():
            break
        level = durable(more.join(seen, ["src", "v"], "left_anti"), "level")
        ahead = zone_pairs(level, "src", "v")
    if parts:
        own = reduce(DataFrame.unionByName, parts).groupBy("src").agg(F.count("*").alias("r"), F.sum("d").alias("d"))
    else:
        own = vertices.select(F.col("id").alias("src"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("d")).limit(0)
    r, d = F.coalesce("r", F.lit(0)).cast("long"), F.coalesce("d", F.lit(0)).cast("long")
    return vertices.join(own, vertices["id"] == own["src"], "left").select(F.col("id").alias("vertex_id"), r.alias("reachable_count"), d.alias("distance_sum"), F.when(r == 0, F.lit(0.0)).otherwise(r * r / (F.lit(n - 1) * d)).alias("closeness_centrality"))
