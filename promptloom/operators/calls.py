"""Calls to an external model with bounded concurrency and durable progress.

``call_concurrently`` keeps at most ``n_calls`` calls of a task in flight and yields
results as they come back; a failing call gives '' and the error's name, a row of its
own.  ``score_durably`` deals the rows into waves and records each wave's results when
it is done (see :class:`~promptloom.sources.ledger.Ledger`): a run that is stopped has
lost one wave at most, and the next run goes on with what is not recorded.  When all
waves of an attempt are recorded, the rows without a result (an anti join with those
that have one) are the input of the next attempt."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.scoring import retry_set
from promptloom.sources.ledger import Ledger


def call_concurrently(df: DataFrame, prompt_col: str, make_call: Callable[[], Callable[[str], str]], n_calls: int = 20,
                      out_col: str = "prediction", error_col: str = "error") -> DataFrame:
    """I4: ``df`` with the answer to every prompt and the name of the call's error, or ''.

    ``make_call()`` runs once a task and returns a function of one prompt.  All calls
    of a cluster in flight are at most ``n_calls`` times its running tasks; rows come
    out in the order of their answers."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType()), T.StructField(error_col, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        call = make_call()

        def one(prompt):
            try:
                answer = call(prompt)
                return ("" if answer is None else answer), ""
            except Exception as e:  # noqa: BLE001 - the row says what failed
                return "", type(e).__name__

        with ThreadPoolExecutor(n_calls) as pool:
            for b in batches:
                prompts = b.column(b.schema.get_field_index(prompt_col))
                waiting, flying, back = deque(range(b.num_rows)), {}, []
                while waiting or flying:
                    while waiting and len(flying) < n_calls:
                        i = waiting.popleft()
                        flying[pool.submit(one, prompts[i].as_py())] = i
                    done, _ = wait(flying, return_when=FIRST_COMPLETED)
                    back += [(flying.pop(f), *f.result()) for f in done]
                    if len(back) >= n_calls or not flying and not waiting:
                        at, answers, errors = zip(*back)
                        rows, back = b.take(pa.array(at)), []
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                                                         names=[*b.schema.names, out_col, error_col])

    return df.mapInArrow(run, schema)


def score_durably(inputs: DataFrame, key: str, prompt_col: str, make_call: Callable[[int], Callable[[], Callable[[str], str]]],
                  base: str, waves: int = 8, n_calls: int = 20, attempts: int = 3, max_waves: int | None = None) -> DataFrame:
    """I4 + I5: every answer so far, rows (key, attempt, prediction, error), one for each
    row and attempt.  ``key`` is unique and not null; ``make_call(attempt)`` gives the
    factory of an attempt's calls.

    Run it again with the same ``base`` to go on where a run has stopped.  ``max_waves``
    ends a run after that many waves."""
    spark = inputs.sparkSession
    ledger = Ledger(spark, f"{base}/answers")
    todo = Ledger(spark, f"{base}/todo")
    answer = T.StructType([inputs.schema[key], T.StructField("attempt", T.IntegerType()), T.StructField("prediction", T.StringType()),
                           T.StructField("error", T.StringType())])
    left = max_waves
    for attempt in range(attempts):
        name = f"attempt-{attempt:04d}"
        if name not in todo.recorded():  # dealt once: a wave then reads its own folder only
            open_ = inputs if attempt == 0 else retry_set(inputs, ledger.read(answer), key)
            dealt = open_.withColumn("_wave", F.pmod(F.xxhash64(key), F.lit(waves)).cast("int"))
            (dealt.repartition("_wave", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(_spread(spark, waves))))
             .write.mode("overwrite").partitionBy("_wave").parquet(f"{base}/todo/parts/{name}"))
            todo.record(name)
        rows = spark.read.schema(T.StructType([*inputs.schema.fields, T.StructField("_wave", T.IntegerType())])).parquet(
            f"{base}/todo/parts/{name}")
        done = ledger.recorded()
        for w in range(waves):
            part = f"{name}-wave-{w:04d}"
            if part in done:
                continue
            if left == 0:
                return ledger.read(answer)
            mine = rows.filter(F.col("_wave") == w).drop("_wave")
            said = call_concurrently(mine, prompt_col, make_call(attempt), n_calls)
            ledger.write(part, said.select(key, F.lit(attempt).alias("attempt"), "prediction", "error"))
            left = None if left is None else left - 1
    return ledger.read(answer)


def _spread(spark: SparkSession, waves: int) -> int:
    """Tasks that share a wave, so that all waves together fill a shuffle."""
    return max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // waves))


def outcome(answers: DataFrame, key: str) -> DataFrame:
    """One row a key: the first answer that is not empty, or else the last attempt's,
    and the number of attempts."""
    good = F.col("prediction") != ""
    rank = F.struct(good.cast("int"), F.when(good, -F.col("attempt")).otherwise(F.col("attempt")))
    best = answers.groupBy(key).agg(F.max_by(F.struct("prediction", "error"), rank).alias("best"),
                                    F.count(F.lit(1)).alias("attempts"), F.count_distinct("attempt").alias("distinct_attempts"))
    return best.select(key, "best.prediction", "best.error", "attempts", "distinct_attempts")
