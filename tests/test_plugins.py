"""Caller-supplied tokenizer and model paths, and the salted fallback join."""

from pyspark.sql import functions as F

from promptloom.operators.joins import join_small
from promptloom.operators.scoring import batch_predict
from promptloom.operators.tokens import encode_with


def test_plugin_tokenizer(spark):
    def make_encoder():
        vocab = {}

        def enc(texts):
            return [[vocab.setdefault(w, len(vocab) + 4) for w in t.split()] for t in texts]
        return enc

    df = spark.createDataFrame([(0, "a b a"), (1, "")], "id long, text string")
    out = {r.id: r.ids for r in encode_with(df, "text", "ids", make_encoder, batch_rows=1).collect()}
    assert out[1] == [] and len(out[0]) == 3 and out[0][0] == out[0][2]


def test_batch_predict_failures_isolated(spark):
    def make():
        def predict(prompts):
            if isinstance(prompts, str):
                if prompts == "bad":
                    raise ValueError("x")
                return prompts.upper()
            if "bad" in prompts:
                raise ValueError("batch")
            return [p.upper() for p in prompts]
        return predict
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(10)], "id long, prompt string")
    out = {r.id: (r.prediction, r.error) for r in batch_predict(df, "prompt", make, batch_size=4).collect()}
    assert out[3] == ("", "ValueError") and out[2] == ("P2", "") and len(out) == 10


def test_join_small_salted_path(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, s string")
    a = sorted(tuple(r) for r in join_small(big, small, ["k"], max_bytes=1).collect())
    b = sorted(tuple(r) for r in big.join(small, ["k"]).collect())
    assert a == b


def test_join_small_never_broadcasts_the_replicated_side(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, s string")
    df = join_small(big, small, ["k"], max_bytes=1)  # its file is far below the planner's own broadcast bound
    assert len(df.collect()) == 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
