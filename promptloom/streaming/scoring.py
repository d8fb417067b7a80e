"""Incremental scoring of arriving prompts (R2).

The model runs inside the stream: every micro-batch scores the prompts that have just
arrived.  Samples are told apart by key in the stream's state, so one that arrives
again, in whatever file, is not scored again.  A micro-batch's results are one part
of a ledger, named by the batch id: where a run stopped after the part was recorded
and before the stream's own checkpoint, the batch is replayed with the same id and
rows, and its results are not written twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from promptloom.operators.scoring import batch_predict
from promptloom.sources.ledger import Ledger


def score_stream(spark: SparkSession, source_dir: str, schema: str, key: str, prompt_col: str,
                 make_predict: Callable[[], Callable], base: str, max_files: int = 1, batch_size: int = 16,
                 after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """Score all JSON files under ``source_dir`` that earlier runs with the same ``base``
    have not seen: rows (all columns of ``schema``, prediction, error, batch_id), one a
    key, from all runs so far.  ``after_batch`` is called with the id of each micro-batch
    whose results are recorded."""
    ledger = Ledger(spark, f"{base}/scored")

    def sink(batch: DataFrame, batch_id: int) -> None:
        if not ledger.write(f"batch-{batch_id:08d}", batch_predict(batch, prompt_col, make_predict, batch_size)):
            batch.write.format("noop").mode("overwrite").save()  # replayed: the state must see its rows, the model must not
        if after_batch is not None:
            after_batch(batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source_dir).dropDuplicates([key])
    query = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
             .foreachBatch(sink).trigger(availableNow=True).start())
    query.awaitTermination()
    fields = T.StructType.fromDDL(schema).add("prediction", T.StringType()).add("error", T.StringType())
    return ledger.read(fields)
