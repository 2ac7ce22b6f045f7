"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import plan_mix

    plan = plan_mix(table(spark, sf_dir, "documents"))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", "positions")
    # in the order of training; documents left out come last
    return plan.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "good", "kept"
    )


def op3_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import scan, spelled

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("found")).alias("spans"),
    )


def op4_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.epsilon_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents"), words=4)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.bytebpe import encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    encoded = encode(docs, ranks, public_tokenizers.PATTERN, with_digests=True, passed=["doc_id"])
    return encoded.drop("ids")


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.wordpiece import count_tokens, read_ranks

    vocabulary = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op9_write_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.tokenfiles import read_token_files, write_token_files

    manifest = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added=True
    )
    return read_token_files(manifest)


def op10_score_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixer import score

    return score(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm import oracles

    return {k: v for k, v in vars(oracles).items() if k.startswith("op") and isinstance(v, str)}
