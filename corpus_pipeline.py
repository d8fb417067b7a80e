"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; its result is written as Parquet to the shared folder and read back as the
next one's docs.  All but the last return the columns of documents.

1. language_id: rows whose language cannot be told (no letter, or a posterior below 0.5) go.
2. ngram_join: of documents linked by 5-gram Jaccard similarity >= 0.75, one stays.
3. decontaminate: rows with a benchmark passage go.
4. mix: rows are taken, once or twice or not, towards the target words of their source.
5. token_files: the mix is encoded, written as token files and read back.

Defined cases: rows with a null or empty text, or one without a letter, go in stage 1; a
null lang is no label, a null source a source of its own; null, repeated and tied ids are
ordinary (rows equal in id and text count as copies, of which one stays); very long texts
are whole in every stage; an empty table gives an empty result; all columns, also those
whose names the stages use inside, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptloom.llm import decontaminate, language_id, mixing, ngram_join, token_files
from promptloom.llm.common import stored
from promptloom.llm.queries import pieces_path, tokenizer_path


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(language_id.training_rows(docs), pieces_path())
    return language_id.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, shard_col=None)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs, tokenizer_path())


STAGES = [
    ("language_id", tell_language),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]

#: Language ID and token files cannot be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
