"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat_format, decontaminate, hard_negatives, html_extract, oracle, packing, periodic_runs, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, token_counts, toxicity
from riskloom.llm.common import table


def op7_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.control_case(spark))
    return chat_format.digests(chat_format.format_conversations(chat_format.events_of(rows)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit.places").cast("long")
    return found.select(
        "row.doc_id", "hit.n_words", n_hit.alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"shard-{i}" for i in range(sharding.SHARDS)]
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), names)


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse(periodic_runs.with_echoes(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_suffix_array_dedup, op3_simhash, op4_decontaminate, op5_shard_lookup, op6_power_of_two_packing, op7_chat_events, op8_toxicity, op9_wrapper_induction, op10_quality_rules,
                              op11_token_counts, op12_periodic_runs, op13_hard_negatives)
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRINGS, "op2_suffix_array_dedup": oracle.STRINGS, "op7_chat_events": oracle.CHATS,
    "op4_decontaminate": oracle.DECONTAMINATE, "op5_shard_lookup": oracle.SHARDS, "op10_quality_rules": oracle.QUALITY,
    "op12_periodic_runs": oracle.RUNS, "op13_hard_negatives": oracle.NEGATIVES,
}
