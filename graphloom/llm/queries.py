"""The corpus operators as registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, chaining, decontaminate, langid, linededup, minhash, packing, pseudonyms, sharding, token_count

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PII_KEY = b"replace this key in production"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeated_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).drop("text")


def op5_token_count(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), asked=F.col("id") % 20 == 0)


def op7_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passage_clusters(_table(spark, sf_dir, "documents")).select("doc_id", "passage_id", "start_word", "end_word")


def op8_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes = PII_KEY) -> DataFrame:
    return pseudonyms.pseudonymise_documents(_table(spark, sf_dir, "documents"), key)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_line_dedup, op2_line_runs, op3_minhash, op4_language_id, op5_token_count, op6_neighbours, op7_fuzzy_passages, op8_pseudonyms, op9_packing, op10_sharding)
}

ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.sql(), "op2_line_dedup": linededup.sql(), "op10_sharding": sharding.sql()}
