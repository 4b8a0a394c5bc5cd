"""Helpers for DataFrames with arbitrary extra columns, and for durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def fresh(df: DataFrame, base: str) -> str:
    """A column name that *df* doesn't have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def materialise(df: DataFrame, what: str) -> DataFrame:
    """*df* written as a table to the shared folder and read back: lineage ends and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _values(column: pa.Array) -> np.ndarray:
    """A column as an array; lists of one length as its rows."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by its first *keys* columns, cut only between groups."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [_values(c) for c in batch.columns]
        new = np.zeros(len(cols[0]), bool)
        new[0] = bool(parts) and any(c[0] != p[-1] for c, p in zip(cols[:keys], parts[-1]))
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            parts.append([c[: cuts[-1]] for c in cols])
            out = [np.concatenate(x) for x in zip(*parts)]
            if len(out[0]):
                yield out
            parts = [[c[cuts[-1] :] for c in cols]]
        else:
            parts.append(cols)
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]
