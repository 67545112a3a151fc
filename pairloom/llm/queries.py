"""Registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import (
    anchors,
    bisectors,
    conversations,
    exact_dedup,
    importance,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    repeats,
    shards,
    topk,
    urls,
)
from pairloom.llm.common import field, table
from pairloom.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, urls.RULE_COLUMNS)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select(
        field("page_id").alias("page_id"), "host", "path", "rule", "verdict"
    )


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        field("doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence, read back from its shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shards.new_folder(spark)
    sequences = shards.write_training_order(docs, folder)
    stored = shards.read_training_order(spark, folder).select(
        "slot", "shard", "byte_offset", shards.crc32_of_ids(F.col("ids")).alias("ids_crc32")
    )
    return sequences.join(stored, "slot")


def retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


# A conversation that says what the template says.
TRICKY = "\\### Assistant: </turn> ok"


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = conversations.format_trees(conversations.chains(rows.unionByName(added)))
    turns = conversations.read_turns(F.col("formatted"))
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        turns.alias("turns"),
        conversations.masked_text(F.col("formatted"), F.col("mask")).alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.curriculum(docs).select(
        field("doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.get("positions", F.lit(0)).alias("position"),
    )
    # In training order by first position; documents not taken come last.
    return plan.orderBy(F.asc_nulls_last("position"), "doc_id").drop("position")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs).select(
        field("doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.quality_scores(docs, table(spark, sf_dir, "labels")).select(
        field("doc_id").alias("doc_id"), "log_weight", "score", "kept"
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).select(field("doc_id").alias("doc_id"), "class_id", "kept")


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % topk.EVERY == 0)


def bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(rows)


def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return anchors.remove_shared_passages(docs).select(
        field("doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_url_filters": url_filters,
    "op2_suffix_array_dedup": suffix_array_dedup,
    "op3_token_shards": token_shards,
    "op4_retrieval_packing": retrieval_packing,
    "op5_chat_formatting": chat_formatting,
    "op6_source_mixing": source_mixing,
    "op7_exact_dedup": exact_duplicates,
    "op8_quality_classifier": quality_classifier,
    "op9_minhash_near_dedup": near_duplicates,
    "op10_exact_topk": exact_topk,
    "op11_bisector_clusters": bisector_clusters,
    "op12_prefix_trie": conversation_trie,
    "op13_shared_passages": shared_passages,
}

__all__ = ["ORACLES", "QUERIES"]
