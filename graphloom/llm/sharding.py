"""Sharding by extendible hashing.

A document's bucket is a prefix of the bits of its id's hash. The directory
starts with one bucket; a bucket over the byte limit, and no other, splits on
the next bit, until each fits. So a document's shard is its shortest prefix
whose documents fit together. Each round sums the documents of the open buckets
by ``STEP`` further bits; the driver only holds the directory.

Defined results: NULL text counts 0 bytes; a NULL id hashes as the empty
string; rows that repeat an id share its hash and shard. Documents with one
and the same hash can't be told apart by more bits: such a bucket stays as it
is even over the limit (``oversized``), as does a single document above the
limit. An empty table has no shards. Other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._frames import materialise

LIMIT = 16 << 20
BITS = 60
STEP = 6


def hash_bits(id_col):
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int, bits: int = BITS, step: int = STEP) -> list[tuple[int, int, int, bool]]:
    """Leaves (depth, prefix, bytes, oversized) in hash order. *sized* has h and n_bytes."""
    leaves: list[tuple[int, int, int, bool]] = []
    depth, rest = 0, sized
    while True:
        deep = min(depth + step, bits)
        rows = rest.groupBy(F.shiftright("h", bits - deep).alias("p")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        level = {r.p: (r.b, r.lo, r.hi) for r in rows}
        levels = {deep: level}
        for d in range(deep - 1, depth - 1, -1):
            up: dict[int, tuple[int, int, int]] = {}
            for p, (b, lo, hi) in level.items():
                o = up.get(p >> 1)
                up[p >> 1] = (b, lo, hi) if o is None else (o[0] + b, min(o[1], lo), max(o[2], hi))
            levels[d] = level = up
        todo, opened = [(depth, p) for p in level], []
        while todo:
            d, p = todo.pop()
            b, lo, hi = levels[d][p]
            if b <= limit or lo == hi or d == bits:
                leaves.append((d, p, b, b > limit))
            elif d == deep:
                opened.append((p,))
            else:
                todo += [(d + 1, q) for q in (2 * p, 2 * p + 1) if q in levels[d + 1]]
        if not opened:
            break
        spark = sized.sparkSession
        rest = sized.join(spark.createDataFrame(opened, "p bigint"), F.shiftright("h", bits - deep) == F.col("p"), "left_semi")
        depth = deep
    return sorted(leaves, key=lambda x: x[1] << (bits - x[0]))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, oversized."""
    sized = docs.select(docs[f"`{id_col}`"].alias("doc_id"), hash_bits(docs[f"`{id_col}`"]).alias("h"), F.coalesce(F.octet_length(docs[f"`{text_col}`"].cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    sized = materialise(sized, "sizes")
    leaves = directory(sized, limit)
    table = docs.sparkSession.createDataFrame([(n, d, p, b, o) for n, (d, p, b, o) in enumerate(leaves)], "shard int, depth int, p bigint, shard_bytes bigint, oversized boolean")
    # a document looks its prefix up at each depth that some leaf has; exactly one is there
    depths = sorted({d for d, *_ in leaves}) or [0]
    keyed = sized.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("p", F.expr(f"shiftright(h, {BITS} - depth)"))
    return keyed.join(table, ["depth", "p"]).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversized")


def sql(limit: int = LIMIT) -> str:
    """DuckDB SQL for the same rows: every prefix of every document, and the shortest that fits."""
    return f"""
WITH sized AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS n_bytes FROM documents),
prefixes AS (SELECT s.*, d.depth, s.h >> ({BITS} - d.depth) AS p FROM sized s, (SELECT CAST(unnest(range({BITS} + 1)) AS INTEGER) AS depth) d),
buckets AS (SELECT depth, p, CAST(sum(n_bytes) AS BIGINT) AS b, min(h) AS lo, max(h) AS hi FROM prefixes GROUP BY depth, p),
fit AS (SELECT x.doc_id, x.h, x.n_bytes, min(x.depth) AS depth FROM prefixes x JOIN buckets y ON x.depth = y.depth AND x.p = y.p WHERE y.b <= {limit} OR y.lo = y.hi GROUP BY x.doc_id, x.h, x.n_bytes)
SELECT f.doc_id, f.n_bytes, CAST(dense_rank() OVER (ORDER BY (f.h >> ({BITS} - f.depth)) << ({BITS} - f.depth)) - 1 AS INTEGER) AS shard, f.depth, y.b AS shard_bytes, y.b > {limit} AS oversized
FROM fit f JOIN buckets y ON f.depth = y.depth AND (f.h >> ({BITS} - f.depth)) = y.p"""
