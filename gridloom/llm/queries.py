"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, fingerprints, line_dedup, maximal_repeats, mixing, near_dup, prefix_trie, quality, substring, token_store, topk
from .common import new_path, table, text_or_empty

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    return bpe.bpe_encode(docs, tokenizer_path(), decoded="decoded").select(
        "doc_id", bpe.token_counts().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    read = chat.read_chat(chat.format_chat(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256").drop("n_factors")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "tokens")
    token_store.write_texts(docs, path, tokenizer_path(), end_id=2)
    return token_store.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("a", "b")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat": op4_chat,
    "op5_topk": op5_topk,
    "op6_substring": op6_substring,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_store": op8_token_store,
    "op9_mixing": op9_mixing,
    "op10_minhash": op10_minhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_divergence": op12_divergence,
    "op13_maximal_repeats": op13_maximal_repeats,
}

SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_chat": chat.SQL,
    "op5_topk": topk.SQL,
    "op6_substring": substring.SQL,
    "op9_mixing": mixing.SQL,
    "op10_minhash": near_dup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_divergence": divergence.SQL,
    "op13_maximal_repeats": maximal_repeats.SQL,
}
