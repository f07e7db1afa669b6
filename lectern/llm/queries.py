"""The queries of the ten operators over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, fingerprints, jaccard, licenses, mixing, sharding, substrings, token_store, toxicity, vectors
from lectern.plans.shared import shared_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write_tokens(_docs(spark, sf_dir), path)
    return token_store.digests(token_store.read_tokens(spark, path))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_docs(spark, sf_dir))


def op3_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_docs(spark, sf_dir))


def op4_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_docs(spark, sf_dir), audited=True)


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir)).drop("source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(_docs(spark, sf_dir))


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix(_docs(spark, sf_dir))).drop("source")


_OPERATORS = (
    op1_token_store,
    op2_syncmer_fingerprints,
    op3_forced_boundary_bpe,
    op4_rare_token_licenses,
    op5_chosen_path_join,
    op6_stratified_shards,
    op7_toxicity,
    op8_flat_graph,
    op9_seed_extend,
    op10_source_schedule,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op4_rare_token_licenses": licenses.scan_sql(),
    "op5_chosen_path_join": jaccard.join_sql(),
    "op6_stratified_shards": sharding.shard_sql(),
    "op8_flat_graph": vectors.pairs_sql(),
    "op9_seed_extend": substrings.repeats_sql(),
    "op10_source_schedule": mixing.mix_sql(),
}
