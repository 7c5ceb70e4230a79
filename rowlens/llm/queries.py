"""The thin queries opN_<name> over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowlens.llm import bm25, codes, collocations, cosine, exact, html, language, license, minhash, packing, pii, shards, tokens
from rowlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_result(table(spark, sf_dir, "documents"))


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.every_twentieth(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_bpe_round_trip, op2_pii, op3_token_shards, op4_language_id, op5_site_style_tree,
            op6_license_scan, op7_best_fit_packing, op8_minhash_near_dedup, op9_exact_dedup, op10_top_k_search,
            op11_vector_codes, op12_collocations, op13_embedding_near_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": exact.ORACLE_SQL, "op10_top_k_search": bm25.ORACLE_SQL,
        "op11_vector_codes": codes.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_embedding_near_dedup": cosine.ORACLE_SQL,
    }
