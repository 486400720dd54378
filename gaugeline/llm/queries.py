"""The contract queries of the thirteen operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, editprint, hardneg, minhash, mixing, oracles, quality, rules, suffix, toxicity, trie, warc, wordbpe
from .common import staged

RANKS, WORDS = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
PREDICTED = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.similar_classes(editprint.fingerprint(table(spark, sf_dir, "documents")))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs, least=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


def scored(module, label: str, folds: int, out: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
    model = module.fit(docs.where(~held), labels.where(~held).select("doc_id", F.col(label).alias("label")))
    return module.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted")
    )


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(toxicity, "toxic", 3, 1, spark, sf_dir)


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(quality, "quality", 4, 2, spark, sf_dir)


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = staged(rules.ledger(table(spark, sf_dir, "documents")), "rule-ledger")  # policies read it, not the texts
    return rules.apply_policy(led).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy")


def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    out = chat.staged(chat.format_conversations(rows.unionByName(own)), "chat-out")
    turns = chat.parse(F.col("formatted"))
    loss = F.array_join(chat.masked(F.col("formatted"), F.col("mask")), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op12_peeled_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    own = (
        op1_minmax_near_duplicates, op2_entropy_mixing, op3_edit_fingerprints, op3_similar_classes, op4_suffix_repeats, op5_weak_toxicity,
        op6_subword_quality, op7_bpe_transducer, op8_rule_ledger, op9_warc_chunks, op10_reply_tree_chat,
        op11_rank_array_bpe, op12_peeled_prefix_trie, op13_bit_sliced_negatives,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
