"""Streaming queries (q44, q45): the provided tables are first laid out as a
sequence of arriving files in the shared folder (a batch job), then consumed
by the streaming jobs; the returned frames hold the final streamed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.scoring import batch_predict
from promptloom.plans.registry import register
from promptloom.plans.scoring import PREDICT_BATCH, make_stub_model
from promptloom.sources.tables import table
from promptloom.streaming.jobs import format_error_counts, scratch, utc_timestamp, windowed_monitor

TRIGGERS = 6  # micro-batches of q44; the files of each follow from the parallelism


def _files(spark) -> int:
    """Arriving files: as many as the session's shuffles have tasks, one a trigger at least."""
    return max(TRIGGERS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def q44(spark, sf_dir):
    """Predictions of every document written as arriving JSON files;
    streaming counts of rows, empty outputs and errors per target."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.col("text")).alias("prompt"),
        F.col("source").alias("target"))
    out = batch_predict(docs, "prompt", make_stub_model, PREDICT_BATCH).drop("prompt")
    src = scratch(spark, "predictions")
    n = _files(spark)
    out.repartitionByRange(n, "doc_id").write.json(src)
    res = format_error_counts(spark, src, max_files=-(-n // TRIGGERS))
    return res.select("target", F.col("n_rows").cast("long").alias("n_rows"),
                      F.col("n_empty").cast("long").alias("n_empty"), F.col("n_error").cast("long").alias("n_error"))


register("q44_stream_format_errors", oracle="""
SELECT source AS target, count(*) AS n_rows,
       count(*) FILTER (WHERE doc_id % 13 = 0 OR doc_id % 11 = 0) AS n_empty,
       count(*) FILTER (WHERE doc_id % 13 = 0) AS n_error
FROM documents GROUP BY source""")(q44)


WINDOW_HOURS, SLIDE_HOURS = 24, 6


def q45(spark, sf_dir):
    """Events stream in event-time order through 1-day windows that begin every 6
    hours, with a 1-hour watermark: all but the last day; then the last day, and again
    the rows of the half hour before it (inside the watermark: told by their key); then
    copies of older rows, which the watermark drops.  The job is stopped and resumed
    from its checkpoint between the arrivals.  Event times are wall-clock
    (timestamp_ntz) values read as UTC."""
    ev = table(spark, sf_dir, "events").select(utc_timestamp(F.col("ts")).alias("ts"), "event_id", "event_type", "value", "props")
    last_day = F.timestamp_seconds(F.floor(F.unix_seconds(ev.agg(F.max("ts").alias("m")).select("m").scalar()) / 86400) * 86400)
    src, base, n = scratch(spark, "events"), scratch(spark, "win-stream"), _files(spark)
    before = F.col("ts") < last_day
    again = before & (F.col("ts") >= last_day - F.expr("INTERVAL 30 MINUTES"))
    arrivals = [ev.filter(before), ev.filter(~before).unionByName(ev.filter(again)),
                ev.filter((F.col("ts") < last_day - F.expr("INTERVAL 1 DAY")) & (F.col("event_id") % 50 == 0))]
    for rows in arrivals:
        rows.repartitionByRange(n, "ts").write.mode("append").parquet(src)
        res = windowed_monitor(spark, src, "ts timestamp, event_id long, event_type string, value double, props string",
                               "ts", "event_type", "value", "props", f"{WINDOW_HOURS} hours", max_files=n, base=base,
                               slide=f"{SLIDE_HOURS} hours", key="event_id")
    return res.select("window_start", "event_type",
                      F.col("n").cast("long").alias("n"), F.round("mean_value", 9).alias("mean_value"),
                      F.round("mean_len", 9).alias("mean_len"))


register("q45_stream_window", oracle=f"""
WITH w AS (SELECT *, unnest(range({WINDOW_HOURS // SLIDE_HOURS})) AS back FROM events)
SELECT strftime(time_bucket(INTERVAL {SLIDE_HOURS} HOUR, ts, TIMESTAMP '1970-01-01') - back * INTERVAL {SLIDE_HOURS} HOUR, '%Y-%m-%d %H:%M:%S') AS window_start,
       event_type, count(*) AS n, round(avg(value), 9) AS mean_value, round(avg(length(props)), 9) AS mean_len
FROM w GROUP BY ALL""")(q45)
