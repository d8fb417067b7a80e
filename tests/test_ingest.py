"""Line numbers where lines are read, bad lines, metric records, first rows, quotas."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from promptloom.operators import order, quota
from promptloom.operators.tokens import encode_fields, length_batches, padding, words
from promptloom.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="pl-in-")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of some hundred bytes, several to a task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _files(d, sizes):
    lines, n = [], 0
    for k, size in enumerate(sizes):
        with open(os.path.join(d, f"f{k}.jsonl"), "w", encoding="utf8") as f:
            for _ in range(size):
                f.write(json.dumps({"prompt": f"é{n}" * (n % 7), "target": str(n)}, ensure_ascii=False) + "\n")
                lines.append(n)
                n += 1
    return n


def test_line_numbers_of_split_files(spark, small_parts):
    d = _tmp()
    n = _files(d, [130, 1, 0, 77, 40])
    df = io.read_jsonl(spark, d)
    assert df.rdd.getNumPartitions() > 8
    assert sorted((r.line_no, int(r.target)) for r in df.collect()) == [(i, i) for i in range(n)]
    assert sorted(r.line_no for r in io.read_jsonl(spark, d, first_n=9).collect()) == list(range(9))


def test_lines_are_not_shuffled(spark):
    d = _tmp()
    _files(d, [50, 20])
    text = plan(io.read_jsonl(spark, d))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text and "Sort " not in text


def test_quarantine(spark, small_parts):
    d, side = _tmp(), os.path.join(_tmp(), "bad")
    lines = [json.dumps({"prompt": f"p{i}", "target": f"t{i}"}) for i in range(200)]
    lines[7], lines[90], lines[151], lines[152] = '{"prompt": "cut', '{"prompt": "only"}', "[1, 2]", ""
    for k in (0, 1):
        with open(os.path.join(d, f"f{k}"), "w") as f:
            f.write("\n".join(lines[k * 100:k * 100 + 100]) + "\n")
    good = io.read_jsonl_quarantined(spark, d, side, max_bad_share=0.05)
    assert sorted((r.line_no, r.prompt, r.target) for r in good.collect()) == [
        (i, f"p{i}", f"t{i}") for i in range(200) if i not in (7, 90, 151, 152)]
    bad = {r.line_no: r for r in spark.read.parquet(side).collect()}
    assert {i: (r.reason, r.file_line, r.line) for i, r in bad.items()} == {
        7: ("malformed", 7, lines[7]), 90: ("missing key", 90, lines[90]), 151: ("malformed", 51, "[1, 2]"), 152: ("malformed", 52, "")}
    assert all(r.file.endswith(f"f{i // 100}") for i, r in bad.items())
    with pytest.raises(ValueError, match="4 of 200"):
        io.read_jsonl_quarantined(spark, d, side, max_bad_share=0.01)
    assert spark.read.parquet(side).count() == 4


def test_metric_records_once(spark):
    d = os.path.join(_tmp(), "m")
    rows = spark.createDataFrame([("a", "strict", 0.5), ("a", "soft", None), ("b/c", "soft", 0.25)], "file string, match string, f1 double")
    schema = "file string, match string, f1 double"
    for df in (rows, rows, rows.filter("match = 'soft'").withColumn("f1", F.lit(0.75))):
        io.append_metrics(df, d, ["file", "match"])
    got = sorted((r.file, r.match, r.f1) for r in io.read_metrics(spark, d, schema).collect())
    assert got == [("a", "soft", 0.75), ("a", "strict", 0.5), ("b/c", "soft", 0.75)]


def test_first_n_small_and_large(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    small = order.first_n(df, ["k"], 20)
    assert "TakeOrderedAndProject" in plan(small) and "rangepartitioning" not in plan(small)
    monkeypatch.setattr(order, "TOP_ROWS", 5)
    large = order.first_n(df, ["k"], 20)
    assert sorted(r.k for r in small.collect()) == sorted(r.k for r in large.collect()) == list(range(20))
    assert order.first_n(df, ["k"], -1).count() == 1000


@pytest.mark.parametrize("ranked", [3, 10 ** 6])
def test_least_of_strata(spark, ranked):
    rows = spark.range(600).select(F.concat(F.lit("s"), (F.col("id") % 5 * (F.col("id") % 3) % 4).cast("string")).alias("stratum"),
                                   F.md5((F.col("id") % 211).cast("string")).alias("digest"), "id")
    by = {}
    for r in rows.collect():
        by.setdefault(r.stratum, []).append((r.digest, r.id))
    want = {s: q for s, q in zip(sorted(by), (0, 7, len(by[sorted(by)[2]]), 31))}
    quotas = spark.createDataFrame(list(want.items()), "stratum string, quota long")
    got = quota.least_of_strata(rows, quotas, "digest", "id", ranked).collect()
    assert sorted((r.stratum, r.id) for r in got) == sorted((s, i) for s, q in want.items() for _, i in sorted(by[s])[:q])


def test_quotas_add_up(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000), ("d", 3)], "stratum string, n long")
    got = {r.stratum: r.quota for r in quota.quotas(sizes, 100, {"a": 3.0, "b": 1.0}, default=1.0).collect()}
    assert got == {"a": 50, "b": 17, "c": 17, "d": 3} or sum(got.values()) == 100


def test_encoding_looked_up_and_joined(spark):
    rows = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None), (4, "zz b")], "id long, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "word string, id int")
    fields = {"x": words(F.col("text")), "y": F.slice(words(F.col("text")), 1, 2)}
    out = {}
    for most in (1 << 20, 0):
        enc = encode_fields(rows, ["id"], fields, vocab, bos={"x": True}, max_bytes=most)
        out[most] = {r.id: (r.x, r.y) for r in enc.collect()}
        assert ("Exchange" not in plan(enc)) == (most > 0)
    assert out[1 << 20] == out[0] == {1: ([1, 4, 5, 3, 4], [4, 5]), 2: ([1], []), 3: ([1], []), 4: ([1, 3, 5], [3, 5])}


def test_length_batches_pad_less(spark):
    df = spark.range(500).select("id", (F.col("id") * 31 % 97).cast("int").alias("n"))
    lengths = {r.id: r.n for r in df.collect()}
    for kind, ids in (("given", sorted(lengths)), ("length", sorted(lengths, key=lambda i: (-lengths[i], i)))):
        rows = length_batches(df, F.col("n"), ["id"], 16, kind)
        got = {r.id: (r.batch_id, r.longest) for r in rows.collect()}
        for b in range(0, 500, 16):
            part = ids[b:b + 16]
            assert {got[i] for i in part} == {(b // 16, max(lengths[i] for i in part))}
        pad = {r.batch_id: r.padding for r in padding(rows, F.col("n")).collect()}
        assert sum(pad.values()) == sum(got[i][1] - lengths[i] for i in ids)
