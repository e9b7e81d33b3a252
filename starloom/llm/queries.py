"""The corpus operators as queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import conversation_repair, embedding_dedup, fingerprint, licenses, line_dedup, merkle, mixing, near_dedup, packing, quality, sharding, substring_dedup, url_filter
from starloom.llm.common import read_table, shared_dir, text_of, written

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
TOKENIZER = "word_bpe_49k.json"


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "n_docs", "keep")


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    kept = sharding.shard_by_arrival(docs, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return kept.select("doc_id", F.length(text_of()).cast("long").alias("n_chars"), F.sha2(text_of(), 256).alias("text_sha256"), "shard", "tier", "version")


def op3_weighted_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, rules=URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("strict_terms", ",").alias("strict_terms"), F.array_join("soft_terms", ",").alias("soft_terms"))


def op4_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    table = written(mixing.sized(docs).drop("text"), "mixing-sized")
    return mixing.mix_sized(table).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged = written(quality.judged(quality.measured(docs).drop("text")), "quality")
    verdicts = quality.with_verdicts(judged, quality.host_rates(judged))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bad_host")


def op8_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.compared_to_next(docs)


def op11_min_plus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(read_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_dart_minhash,
        op2_size_tiered_shards,
        op3_weighted_url_vocabulary,
        op4_fm_index_repeats,
        op5_hash_threshold_mix,
        op6_line_runs,
        op7_host_quality,
        op8_license_blocks,
        op9_sum_of_squares_packing,
        op10_closed_syncmers,
        op11_min_plus_repair,
        op12_merkle_manifest,
        op13_e8_lattice,
    )
}
