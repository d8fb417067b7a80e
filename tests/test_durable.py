"""Scoring that is stopped and resumed: every row once, nothing lost."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from promptloom.operators.calls import call_concurrently, outcome, score_durably
from promptloom.plans.durable import flaky_call
from promptloom.sources.ledger import Ledger
from promptloom.streaming.jobs import scratch
from promptloom.streaming.scoring import score_stream


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws("\t", F.col("id").cast("string"), F.lit("ab")).alias("prompt"))


def test_calls_run_side_by_side_and_fail_alone(spark):
    def make():
        lock, now, most = threading.Lock(), [0], [0]

        def call(prompt):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            if prompt.startswith("3\t"):
                raise ValueError("no")
            return None if prompt.startswith("4\t") else str(most[0])
        return call

    rows = {r["doc_id"]: r for r in call_concurrently(numbers(spark, 60).coalesce(1), "prompt", make, n_calls=7).collect()}
    assert len(rows) == 60 and (rows[3]["prediction"], rows[3]["error"]) == ("", "ValueError")
    assert (rows[4]["prediction"], rows[4]["error"]) == ("", "")
    assert max(int(r["prediction"]) for i, r in rows.items() if i not in (3, 4)) == 7


def test_resume_after_every_wave(spark):
    base, docs = scratch(spark, "t-calls"), numbers(spark, 200)
    seen = [score_durably(docs, "doc_id", "prompt", flaky_call, base, waves=4, attempts=3, max_waves=1).count() for _ in range(12)]
    assert seen == sorted(seen)
    answers = score_durably(docs, "doc_id", "prompt", flaky_call, base, waves=4, attempts=3)
    assert answers.count() == seen[-1]  # twelve waves are all; nothing is called again
    got = {r["doc_id"]: (r["prediction"], r["error"], r["attempts"], r["distinct_attempts"]) for r in outcome(answers, "doc_id").collect()}
    for i in range(200):
        n = 3 if i % 13 == 0 or i % 11 == 0 else 2 if i % 7 == 0 else 1
        assert got[i] == ("" if n == 3 else "ba", "RuntimeError" if i % 13 == 0 else "", n, n)


def test_a_part_without_its_record_is_written_anew(spark):
    ledger = Ledger(spark, scratch(spark, "t-ledger"))
    spark.range(5).write.parquet(f"{ledger.base}/parts/a")  # a writer that was stopped before its record
    assert ledger.read("id long").count() == 0
    assert ledger.write("a", spark.range(3)) and not ledger.write("a", spark.range(9))
    assert Ledger(spark, ledger.base).read("id long").count() == 3 and ledger.read("id long", "b").count() == 0


def test_empty_inputs(spark):
    base = scratch(spark, "t-none")
    assert outcome(score_durably(numbers(spark, 0), "doc_id", "prompt", flaky_call, base, waves=2), "doc_id").collect() == []


def test_stream_scores_once_though_it_crashes(spark):
    """The stop falls between a batch's results and the stream's own checkpoint."""
    source, base = scratch(spark, "t-prompts"), scratch(spark, "t-stream")
    numbers(spark, 120).repartition(6).write.json(source)
    numbers(spark, 30).repartition(2).write.mode("append").json(source)  # arrive again
    schema = "doc_id long, prompt string"

    def model():
        return lambda prompts: [p[::-1] for p in prompts]

    def crash(batch_id):
        if batch_id == 2:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        score_stream(spark, source, schema, "doc_id", "prompt", model, base, after_batch=crash)
    replayed = []
    rows = score_stream(spark, source, schema, "doc_id", "prompt", model, base, after_batch=replayed.append).collect()
    assert replayed[0] == 2 and sorted(r["doc_id"] for r in rows) == list(range(120))
    assert all(r["prediction"] == r["prompt"][::-1] and r["error"] == "" for r in rows)
    numbers(spark, 125).repartition(2).write.mode("append").json(source)
    assert score_stream(spark, source, schema, "doc_id", "prompt", model, base).count() == 125
