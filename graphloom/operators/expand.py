"""Variable-length expansion: all trails of *least* to *most* hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.durable import durable
from graphloom.operators.zones import within, zone_pairs

#: Levels up to this one stay one lazy plan.
LAZY_HOPS = 3


def trails(starts: DataFrame, hops: DataFrame, least: int, most: int | None, max_paths: int | None = None) -> DataFrame:
    """s, e, trail for each walk from each of *starts* (s) along *hops* (f, t, id) that repeats no edge.

    A bag: one row for each trail. Without *most*, levels are built until one is
    empty. *max_paths* raises rather than truncates when the trails of a level
    exceed it. Hops from zones of ids in which no trail ends are left out.
    """
    eager = most is None or most > LAZY_HOPS
    if eager:
        starts = durable(starts, "starts")
    level = starts.select("s", F.col("s").alias("e"), F.array().cast("array<bigint>").alias("trail"))
    out, depth = [level] if least == 0 else [], 0
    while most is None or depth < most:
        depth += 1
        ends = zone_pairs(level, "e", "e") if eager else None
        step = level.join(within(hops, "f", ends and {z for z, _ in ends}), F.col("e") == F.col("f"))
        if depth > 1:
            step = step.where(~F.array_contains("trail", F.col("id")))
        level = step.select("s", F.col("t").alias("e"), F.array_append("trail", F.col("id")).alias("trail"))
        if eager:
            level = durable(level, "trails")
            n = level.count()
            if max_paths is not None and n > max_paths:
                raise ValueError(f"more than {max_paths} paths of {depth} hops")
            if not n:
                break
        if depth >= least:
            out.append(level)
    if not out:
        return level.limit(0)
    return reduce(DataFrame.unionByName, out)
