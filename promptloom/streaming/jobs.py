"""Streaming jobs over arriving files.

Both jobs use a file source with an explicit schema, a checkpoint location
(restartable after executor or driver loss), ``availableNow`` triggers and a
``foreachBatch`` sink that appends each micro-batch's updated rows tagged with
the batch id to a table in the shared folder.  The final state is the latest
row per key, so a re-run micro-batch (same batch id) cannot double count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.session import scratch_path as scratch

PREDICTION_SCHEMA = "doc_id long, target string, prediction string, error string"


def utc_text(ts: Column) -> Column:
    """A timestamp as 'yyyy-MM-dd HH:mm:ss' in UTC, whatever the session's time zone."""
    sec = F.unix_seconds(ts)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(sec / 86400).cast("int"))
    in_day = F.pmod(sec, F.lit(86400)).cast("int")
    return F.concat(day.cast("string"), F.format_string(" %02d:%02d:%02d", F.floor(in_day / 3600).cast("int"),
                                                        F.floor(in_day % 3600 / 60).cast("int"), in_day % 60))


def utc_timestamp(wall_clock: Column) -> Column:
    """A wall-clock (timestamp_ntz) value read as UTC, whatever the session's time zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), wall_clock))


def _append_batches(df: DataFrame, out: str):
    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    return sink


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    t = spark.read.parquet(out)
    rest = [c for c in t.columns if c not in (*keys, "batch_id")]
    last = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last"))
    return last.select(*keys, "_last.*")


def format_error_counts(spark: SparkSession, source_dir: str, max_files: int = 1,
                        base: str | None = None) -> DataFrame:
    """R1 + R2: running counts of rows, empty outputs and failed calls per
    target over prediction files as they arrive.  Re-running with the same
    ``base`` resumes from its checkpoint and only reads files not seen yet."""
    base = base or scratch(spark, "fmt-stream")
    stream = (spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", max_files).json(source_dir))
    agg = stream.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_if(F.col("prediction") == "").alias("n_empty"),
                                       F.count_if(F.col("error") != "").alias("n_error"))
    q = (agg.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(_append_batches(agg, f"{base}/out")).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_per_key(spark, f"{base}/out", ["target"])


def windowed_monitor(spark: SparkSession, source_dir: str, schema: str, ts: str, group: str, value: str,
                     response: str, window: str = "1 day", watermark: str = "1 hour",
                     max_files: int = 1, base: str | None = None, slide: str | None = None,
                     key: str | None = None) -> DataFrame:
    """Per event-time window and group: count, mean value and mean response
    length, with an event-time watermark of ``watermark``.  Windows tumble, or
    begin every ``slide``.

    With ``key`` a row that arrives again counts once: keys are kept in the stream's
    state until the watermark has passed their time by its own delay, and what comes
    later than that is behind the watermark itself.

    A micro-batch drops rows behind the watermark that the batches before its
    predecessor reached: a row that arrives directly after a jump in event time is
    still taken, one that arrives a batch later is late.  Window starts are UTC
    wall-clock strings, whatever the session's time zone.  Re-running with the
    same ``base`` resumes from its checkpoint, watermark included."""
    base = base or scratch(spark, "win-stream")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    stream = stream.withWatermark(ts, watermark)
    if key is not None:
        stream = stream.dropDuplicatesWithinWatermark([key])
    agg = (stream.groupBy(F.window(ts, window, slide).alias("w"), group)
           .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
                F.avg(F.length(response)).alias("mean_len")))
    agg = agg.select(utc_text(F.col("w.start")).alias("window_start"), group, "n",
                     "mean_value", "mean_len")
    q = (agg.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(_append_batches(agg, f"{base}/out")).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_per_key(spark, f"{base}/out", ["window_start", group])
