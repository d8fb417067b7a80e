"""The registered queries of this subpackage, over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    fingerprints,
    katz,
    language_id,
    mixing,
    ngram_join,
    sharding,
    spelling,
    suffix_dedup,
    token_counts,
    token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pieces_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@_query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op2_exact_dedup", exact_dedup.ORACLE)
def op2(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_query("op3_token_files")
def op3(spark, sf_dir):
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op4_mix_sources")
def op4(spark, sf_dir):
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("row.doc_id", "size", "source_size", "target", "taken", "shards")


@_query("op5_shard")
def op5(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@_query("op6_decontaminate")
def op6(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op7_language_id")
def op7(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs), pieces_path())
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@_query("op8_ngram_join")
def op8(spark, sf_dir):
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


@_query("op9_katz_scores")
def op9(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    return katz.katz_scores(docs, training).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


@_query("op11_fingerprints")
def op11(spark, sf_dir):
    return fingerprints.with_next(_table(spark, sf_dir, "documents"))


@_query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.variants(spelling.corpus_words(_table(spark, sf_dir, "documents")))


@_query("op13_repair_conversations")
def op13(spark, sf_dir):
    damaged = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(damaged))


@_query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
