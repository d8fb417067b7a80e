"""Entity counts of whole texts: texts are dealt by sample, words never move."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from promptloom.operators.match import key_counts, multiset_outcome, nested_outcome, sum_counts

KEYS = {"strict": ["e_type", "e_name"], "boundaries": ["e_name"]}


@pytest.mark.parametrize("name", ["q01_ner_micro_hard", "q02_ner_per_type", "q03_ner_undefined_invalid", "q48_multi_seed", "q51_chosen_f1"])
def test_only_texts_are_shuffled_by_sample(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any("doc_id" in x and "REPARTITION_BY_NUM" in x for x in moved)
    assert not any("e_name" in x or ("doc_id" in x and "ENSURE_REQUIREMENTS" in x) for x in moved)


def _entities(spark):
    rows = [(1, "gold", "a", "x"), (1, "pred", "b", "x"), (1, "pred", "a", "x"), (1, "gold", "a", "y"), (1, "pred", "a", "x"),
            (None, "gold", "a", "x"), (None, "gold", "a", "x"), (None, "pred", "a", "x"), (None, "pred", "b", "x")]
    return spark.createDataFrame(rows, "doc long, side string, e_type string, e_name string")


def test_nested_outcome_equals_grouping_sets(spark):
    e = _entities(spark)
    want = multiset_outcome(key_counts(e, "doc", KEYS)).groupBy("match").agg(*[F.sum(c) for c in ("tp", "fp", "fn")])
    assert sorted(map(tuple, nested_outcome(e, "doc", KEYS).collect())) == sorted(map(tuple, want.collect()))
    counted = e.groupBy("doc", "side", "e_type", "e_name").agg(
        F.count_if(F.col("side") == "gold").alias("n_gold"), F.count_if(F.col("side") == "pred").alias("n_pred"))
    want = multiset_outcome(sum_counts(counted, "doc", KEYS)).groupBy("match").agg(*[F.sum(c) for c in ("tp", "fp", "fn")])
    got = nested_outcome(counted, "doc", KEYS, F.sum("n_gold"), F.sum("n_pred"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nested_outcome_without_rows(spark):
    assert nested_outcome(_entities(spark).limit(0), "doc", KEYS).collect() == []


def test_events_are_dealt_before_they_are_parsed(spark):
    from promptloom.plans.events_eval import _tuples
    assert _tuples(spark, SF001).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_batch_predict_hands_on_a_few_calls_at_a_time(spark):
    from promptloom.operators.scoring import CALLS_OUT, batch_predict
    n = 2 * CALLS_OUT * 2 + 1
    df = spark.range(n, numPartitions=1).select("id", F.col("id").cast("string").alias("prompt"))
    from promptloom.operators import scoring
    sizes = []

    class Frame:  # the function that runs on Arrow batches, taken as it is
        schema = df.schema
        sparkSession = spark

        def mapInPandas(self, run, schema):
            sizes.extend(len(x) for x in run([df.toPandas()]))

    scoring.batch_predict(Frame(), "prompt", lambda: lambda p: p if isinstance(p, str) else list(p), batch_size=2)
    assert sizes == [2 * CALLS_OUT, 2 * CALLS_OUT, 1]
    assert batch_predict(df, "prompt", lambda: lambda p: p if isinstance(p, str) else list(p), batch_size=2).filter("prediction = prompt").count() == n


@pytest.mark.parametrize("name", ["q18_span_text_stats", "q20_mrc_regroup"])
def test_spans_move_once_by_sentence(spark, name, monkeypatch):
    from promptloom.plans import ner_corpus
    stored = []
    monkeypatch.setattr(ner_corpus, "materialize", lambda df, *a: stored.append(df) or df)
    out = E.queries()[name](spark, SF001)
    plan = (stored[0] if stored else out)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


def test_flagged_rows_equal_nested_spans(spark):
    from promptloom.operators.ner import flag_nested, nested_spans
    rows = [(d, (d * 7 + i * i * 5) % 23, (d * 7 + i * i * 5) % 23 + 1 + (d + i * 3) % 4) for d in range(60) for i in range(d % 12)]
    rows += [(99, 1, 2), (99, 1, 2), (98, 1, 2), (None, 1, 2), (None, 1, 2)]
    e = spark.createDataFrame(rows, "doc long, start int, end int")
    want = e.join(nested_spans(e, "doc", width=4), ["doc", "start", "end"])
    assert sorted(map(tuple, flag_nested(e, "doc").select("doc", "start", "end", "nested").collect())) == sorted(map(tuple, want.collect()))
