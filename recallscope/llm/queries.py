"""Registered queries of the operators, with their DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallscope.llm import oracle
from recallscope.llm.hard_negatives import hard_negatives
from recallscope.llm.host_trust import host_trust
from recallscope.llm.jaccard_join import jaccard_join
from recallscope.llm.katz import katz_scores
from recallscope.llm.language_id import language_id, page_evidence
from recallscope.llm.order_minhash import edited_neighbours
from recallscope.llm.outlier_rules import BASE, outlier_rules
from recallscope.llm.pfair_mix import pfair_mix, tempered_targets
from recallscope.llm.phrases import phrase_collocations
from recallscope.llm.ring_shards import ring_shards
from recallscope.llm.substring_dedup import substring_dedup
from recallscope.llm.token_counts import token_counts
from recallscope.llm.vector_packing import vector_pack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id(docs, declared=F.col("lang"), host=F.col("source"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence: markup, address, host and domain."""
    pages = page_evidence(table(spark, sf_dir, "pages")).drop("html")
    found = language_id(pages, text_col="__page_text", declared=F.col("__markup"), host=F.col("__page_host"),
                        domain=F.col("__page_domain"), suffix=F.col("__address"))
    return found.select("page_id", "url", "predicted", "posterior", "kept")


def op3_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outlier_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "distance")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "n_copies", "keep")


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    scored = katz_scores(docs, train=fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("length"))
    length = F.col("length")
    mixed = pfair_mix(docs, tempered_targets(docs, length=length), length=length)
    return mixed.select("doc_id", "source", "block", "release", "deadline", "slot", "block_offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, _vocabulary("word_bpe_49k.json"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = host_trust(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = ring_shards(docs, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "hops")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0, label=label)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_language_id": op2_language_id,
        "language_id_pages": language_id_pages,
        "op3_outlier_rules": op3_outlier_rules,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_katz_backoff": op5_katz_backoff,
        "op6_vector_packing": op6_vector_packing,
        "op7_pfair_mix": op7_pfair_mix,
        "op8_token_counts": op8_token_counts,
        "op9_host_trust": op9_host_trust,
        "op10_order_minhash": op10_order_minhash,
        "op11_ring_shards": op11_ring_shards,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
        "op4_jaccard_join": oracle.JACCARD_JOIN,
        "op7_pfair_mix": oracle.PFAIR_MIX,
        "op11_ring_shards": oracle.RING_SHARDS,
        "op12_hard_negatives": oracle.HARD_NEGATIVES,
        "op13_phrase_collocations": oracle.PHRASE_COLLOCATIONS,
    }
