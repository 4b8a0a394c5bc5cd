"""A training-corpus pipeline: each stage reads what its predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents,
whatever they are called: columns other than doc_id, text and lang are set
aside under other names while a stage runs.

Defined results, over all stages: NULL and empty texts, and those without
letters, go in the first; an empty table gives an empty result; texts are read
whole; rows that repeat an id are one document and stay or go alike; a row with
a NULL id has its lines deduplicated and is packed, and no other stage drops it.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, linededup, minhash, packing
from graphloom.llm._frames import shared_dir


def _aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """*stage* over *docs*, with the columns and values of *docs* even where a stage's own are called alike."""
    short = {c: c if c in ("doc_id", "text", "lang") else f"__column{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.toDF(*short.values()))
    return out.select(*[F.col(n).alias(c) for c, n in short.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is clear; NULL, empty and letterless texts go. Ties go by name, so a tie is not clear."""
    return _aside(docs, lambda d: langid.identify(d, langid.train(d)).where("accepted"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated runs of lines, all but the first of each; documents of which nothing is left go. Repeated rows are cut alike."""
    return _aside(docs, lambda d: linededup.remove_repeated_runs(d).where("chunks_removed = 0 OR trim(text) <> ''"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of near copies. Rows with a NULL id or no word stay."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item. Rows with a NULL id or no word stay, and all do where the benchmark is empty."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every piece of every document to a training sequence; texts without a word get a row without one."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Naive Bayes scoring, min-hashing and the packing loop have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of *sf_dir*; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs_out = stage(spark, docs, sf_dir)
        docs_out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
