"""Scoring that survives a stop (q60, q61).  A stand-in model reverses texts; for fixed
ids it fails always, only at first, or answers with nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.calls import outcome, score_durably
from promptloom.plans.registry import register
from promptloom.plans.scoring import PREDICT_BATCH, make_stub_model
from promptloom.sources.tables import table
from promptloom.streaming.jobs import scratch
from promptloom.streaming.scoring import score_stream

WAVES = 4
STOP_AFTER = 2
CALLS = 20
ATTEMPTS = 3


def flaky_call(attempt: int):
    """The calls of one attempt: ids divisible by 13 always fail, by 7 at the first
    attempt; ids divisible by 11 get an empty answer."""
    def make():
        def call(prompt: str) -> str:
            head, _, text = prompt.partition("\t")
            i = int(head)
            if i % 13 == 0 or (i % 7 == 0 and attempt == 0):
                raise RuntimeError("call failure")
            return "" if i % 11 == 0 else text[::-1]
        return call
    return make


def prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("prompt"))


def q60(spark, sf_dir):
    """Every document's prompt by concurrent calls; the run stops after STOP_AFTER
    waves and a second one resumes; rows without an answer are tried up to ATTEMPTS
    times.  One row a document: its answer, its error and how often it was tried."""
    base = scratch(spark, "calls")
    docs = prompts(spark, sf_dir)
    for most in (STOP_AFTER, None):
        answers = score_durably(docs, "doc_id", "prompt", flaky_call, base, WAVES, CALLS, ATTEMPTS, max_waves=most)
    # digests take the answers' place before rows are gathered by key
    short = answers.withColumn("prediction", F.when(F.col("prediction") != "", F.md5("prediction")).otherwise(""))
    open_ = F.col("prediction") == ""
    return outcome(short, "doc_id").select(
        "doc_id", F.when(open_, F.md5(F.lit(""))).otherwise(F.col("prediction")).alias("pred_md5"), "error", "attempts",
        "distinct_attempts", open_.alias("open"))


register("q60_durable_calls", oracle=f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 13 = 0 AS fails, doc_id % 11 = 0 OR coalesce(text, '') = '' AS nothing FROM documents),
a AS (SELECT doc_id, text, fails, nothing, CASE WHEN fails OR nothing THEN {ATTEMPTS} WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM d)
SELECT doc_id, md5(CASE WHEN fails OR nothing THEN '' ELSE reverse(text) END) AS pred_md5,
       CASE WHEN fails THEN 'RuntimeError' ELSE '' END AS error, CAST(attempts AS BIGINT) AS attempts,
       CAST(attempts AS BIGINT) AS distinct_attempts, fails OR nothing AS open FROM a""")(q60)


def q61(spark, sf_dir):
    """R2: prompts scored as they arrive: the even ids, a stop, then the odd ids together
    with a second copy of every tenth document.  One row a document, scored once."""
    base, source = scratch(spark, "score-stream"), scratch(spark, "prompts")
    docs = prompts(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = F.col("doc_id") % 2 == 0
    for rows in (docs.filter(even), docs.filter(~even).unionByName(docs.filter(F.col("doc_id") % 10 == 0))):
        rows.repartition(n, "doc_id").write.mode("append").json(source)
        scored = score_stream(spark, source, "doc_id long, prompt string", "doc_id", "prompt", make_stub_model, base,
                              max_files=max(1, n // 2), batch_size=PREDICT_BATCH)
    return scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_scored"), F.min(F.md5("prediction")).alias("pred_md5"),
                                        F.max("error").alias("error"))


register("q61_stream_scoring", oracle="""
SELECT doc_id, CAST(1 AS BIGINT) AS n_scored,
       md5(CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN '' ELSE reverse(coalesce(text, '')) END) AS pred_md5,
       CASE WHEN doc_id % 13 = 0 THEN 'RuntimeError' ELSE '' END AS error
FROM documents""")(q61)
