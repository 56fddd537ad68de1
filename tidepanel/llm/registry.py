"""The queries of the corpus operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat_format, decontaminate, html_paths, line_dedup, packing, quality_knn, sharding, simhash_dedup, token_store, topk_nra, turn_repair, url_filter
from .common import table


def op1_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every embedding whose id is divisible by 20, against all: ``query_id, rank, vec_id, score``."""
    return topk_nra.search_report(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap: ``doc_id, item_id, matches``."""
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back: digests and lengths per conversation."""
    return chat_format.chat_report(table(spark, sf_dir, "conversations"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``."""
    return html_paths.extract_report(table(spark, sf_dir, "pages"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a new store and read back by key: ``doc_id, start, n_tokens, ids_crc32``."""
    return token_store.store_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by its labelled neighbours: ``doc_id, held_out, score, predicted``."""
    return quality_knn.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged: ``page_id, host, path, rule, verdict`` and the trees' ``p_block``."""
    return url_filter.url_report(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines: ``doc_id, text, n_lines, n_dropped``."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component: ``doc_id, fingerprint, component_id``."""
    return simhash_dedup.report(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document: counts, corpus-wide link counts and a digest of the groups."""
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired: faults, ``cost``, ``audit`` and ``repaired_sha256``."""
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``fraction``."""
    return sharding.shard_report(table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_topk_nra,
    op2_decontamination,
    op3_chat_format,
    op4_html_extraction,
    op5_token_store,
    op6_quality,
    op7_best_fit_packing,
    op8_url_filter,
    op9_line_dedup,
    op10_simhash,
    op11_token_alignment,
    op12_turn_repair,
    op13_interleaved_shards,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_nra": topk_nra.SQL, "op9_line_dedup": line_dedup.SQL, "op12_turn_repair": turn_repair.SQL, "op13_interleaved_shards": sharding.SQL}
