"""The corpus queries and, where SQL can express them, their DuckDB counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import chat, collocations, extraction, fingerprints, mixing, near_join, packing, pii, quality, scan, sharding, substrings, turn_trie
from emberlog.llm.frames import document_table


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture_plan(document_table(spark, sf_dir, "doc_id", "source", "text"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op3_context_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_report(document_table(spark, sf_dir, "doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.secret_report(document_table(spark, sf_dir, "doc_id", "text"))


def op5_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(document_table(spark, sf_dir, "doc_id", "text"))


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(document_table(spark, sf_dir, "doc_id", "text"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(document_table(spark, sf_dir, "doc_id", "text"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(document_table(spark, sf_dir, "doc_id", "text"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join.near_classes(document_table(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(document_table(spark, sf_dir, "doc_id", "text"))


def op11_pair_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(document_table(spark, sf_dir, "lang", "text"))


def op12_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_turn_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_snapshots, op2_source_mixture, op3_context_patterns, op4_secret_scan, op5_differencing_pack, op6_quality_votes,
        op7_bottom_k, op8_feistel_shards, op9_parity_join, op10_bucket_pointers,
        op11_pair_tiles, op12_dom_marginals, op13_turn_bitmaps,
    )
}
SQL: dict[str, str] = {
    "op1_chat_snapshots": chat.CHAT_SQL, "op11_pair_tiles": collocations.PHRASE_SQL, "op13_turn_bitmaps": turn_trie.TRIE_SQL,
}
