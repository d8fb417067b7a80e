"""A restarted stream resumes from its checkpoint without double counting."""

import json

import os
import tempfile

from promptloom.streaming.jobs import format_error_counts


def _write(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_restart_resumes(spark):
    src = tempfile.mkdtemp(prefix="pl-src-")
    base = tempfile.mkdtemp(prefix="pl-stream-")
    row = lambda i, pred, err: {"doc_id": i, "target": "t", "prediction": pred, "error": err}
    _write(src, "a.json", [row(0, "x", ""), row(1, "", "")])
    _write(src, "b.json", [row(2, "", "E")])
    r1 = format_error_counts(spark, src, base=base).collect()[0]
    assert (r1.n_rows, r1.n_empty, r1.n_error) == (3, 2, 1)
    _write(src, "c.json", [row(3, "y", "")])
    r2 = format_error_counts(spark, src, base=base).collect()[0]
    assert (r2.n_rows, r2.n_empty, r2.n_error) == (4, 2, 1)


def test_window_drops_late_rows(spark):
    import time
    from promptloom.streaming.jobs import windowed_monitor
    src = tempfile.mkdtemp(prefix="pl-ev-")
    schema = "ts timestamp, event_type string, value double, props string"

    def put(rows):
        df = spark.createDataFrame(rows, "ts string, event_type string, value double, props string")
        df.selectExpr("to_timestamp(ts) AS ts", "event_type", "value", "props").coalesce(1) \
            .write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct modification times: files arrive in this order

    put([("2024-01-01 10:00:00", "a", 1.0, "x"), ("2024-01-01 11:00:00", "a", 3.0, "x")])
    put([("2024-01-05 10:00:00", "a", 5.0, "x")])
    put([("2024-01-05 11:00:00", "a", 7.0, "x")])  # the batch after the jump moves the watermark
    put([("2024-01-01 12:00:00", "a", 100.0, "x")])  # behind the watermark: dropped
    res = {r.window_start: (r.n, r.mean_value) for r in
           windowed_monitor(spark, src, schema, "ts", "event_type", "value", "props").collect()}
    assert res["2024-01-01 00:00:00"] == (2, 2.0)
    assert res["2024-01-05 00:00:00"] == (2, 6.0)


def test_repeated_rows_count_once_in_sliding_windows(spark):
    import time
    from promptloom.streaming.jobs import windowed_monitor
    src = tempfile.mkdtemp(prefix="pl-ev-")
    schema = "ts timestamp, k long, event_type string, value double, props string"

    def put(rows):
        df = spark.createDataFrame([(t, k, "a", v, "x") for t, k, v in rows], "ts string, k long, event_type string, value double, props string")
        df.withColumn("ts", df.ts.cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)

    put([("2024-01-01 10:00:00", 1, 1.0), ("2024-01-01 10:50:00", 2, 3.0), ("2024-01-01 10:50:00", 2, 3.0)])
    put([("2024-01-01 11:10:00", 3, 5.0), ("2024-01-01 10:50:00", 2, 3.0)])  # again, inside the watermark
    put([("2024-01-03 10:00:00", 4, 7.0)])
    put([("2024-01-03 10:10:00", 5, 9.0)])
    put([("2024-01-01 10:00:00", 1, 1.0), ("2024-01-01 10:05:00", 6, 50.0)])  # behind it: the copy and a new row
    res = windowed_monitor(spark, src, schema, "ts", "event_type", "value", "props", "2 hours", slide="1 hour", key="k")
    got = {r.window_start: (r.n, r.mean_value) for r in res.collect()}
    assert got == {"2024-01-01 09:00:00": (2, 2.0), "2024-01-01 10:00:00": (3, 3.0), "2024-01-01 11:00:00": (1, 5.0),
                   "2024-01-03 09:00:00": (2, 8.0), "2024-01-03 10:00:00": (2, 8.0)}
