import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from promptloom.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="pl-io-")


def test_jsonl_roundtrip_line_numbers(spark):
    d = _tmp()
    p = os.path.join(d, "in.jsonl")
    rows = [{"q": f"问题{i}", "a": f"答{i}"} for i in range(25)]
    with open(p, "w", encoding="utf8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
    df = io.read_jsonl(spark, p, "q", "a")
    got = sorted((r.line_no, r.q, r.a) for r in df.collect())
    assert got == [(i, f"问题{i}", f"答{i}") for i in range(25)]
    assert io.read_jsonl(spark, p, "q", "a", first_n=5).count() == 5
    out = os.path.join(d, "out")
    io.write_jsonl(df.withColumn("n", F.lit(None).cast("string")), out)
    back = spark.read.json(out)
    assert "n" in back.columns and back.count() == 25


def test_jsonl_missing_key_fails(spark):
    d = _tmp()
    p = os.path.join(d, "bad.jsonl")
    with open(p, "w") as f:
        f.write('{"q": "x", "a": "y"}\n{"q": "z"}\n')
    with pytest.raises(Exception):
        io.read_jsonl(spark, p, "q", "a").collect()
    assert io.read_jsonl(spark, p, "q", "a", strict=False).filter("a IS NULL").count() == 1


def test_json_arrays_hold_a_bounded_range_of_keys(spark):
    p = os.path.join(_tmp(), "arrays")
    rows = [(k, f"名{k}\n\"") for k in range(1, 36)]
    io.write_json_arrays(spark.createDataFrame(rows, "k long, name string").repartition(4), "k", p, keys_per_array=10)
    files = [os.path.join(d, f) for d, _, fs in os.walk(p) for f in fs if f.endswith(".txt")]
    arrays = [json.load(open(f, encoding="utf8")) for f in files]
    assert sorted(map(len, arrays)) == [6, 9, 10, 10]
    back = io.read_json_array(spark, p, "k long, name string")
    assert sorted((r.k, r.name) for r in back.collect()) == rows
    none = os.path.join(_tmp(), "none")
    io.write_json_arrays(spark.createDataFrame([], "k long, name string"), "k", none)
    assert io.read_json_array(spark, none, "k long, name string").count() == 0


def test_json_array_type_dictionary_csv(spark):
    d = _tmp()
    arr = os.path.join(d, "corpus.json")
    with open(arr, "w") as f:
        json.dump([{"tokens": ["a", "b"], "entities": [{"start": 0, "end": 1, "type": "DNA"}]},
                   {"tokens": ["c"], "entities": []}], f, indent=4)
    c = io.read_json_array(spark, arr, "tokens array<string>, entities array<struct<start:int,end:int,type:string>>")
    assert sorted(r.line_no for r in c.collect()) == [0, 1]
    types = os.path.join(d, "types.json")
    with open(types, "w") as f:
        json.dump({"entities": {"DNA": {"verbose": "DNA", "short": "DNA"}, "RNA": {"verbose": "RNA", "short": "R"}},
                   "relations": {}}, f)
    t = {r.code: (r.verbose, r.short) for r in io.read_type_dictionary(spark, types).collect()}
    assert t == {"DNA": ("DNA", "DNA"), "RNA": ("RNA", "R")}
    csv = os.path.join(d, "qa.csv")
    with open(csv, "w") as f:
        f.write('question,answer\n"q1","a1"\n"q2","a, 2"\n')
    qa = sorted(tuple(r) for r in io.read_qa_csv(spark, csv).collect())
    assert qa == [("q1", "a1"), ("q2", "a, 2")]


def test_sinks(spark):
    d = _tmp()
    df = spark.createDataFrame([("m1", "d1", 0.123456, ""), ("m1", "d2", 1.0, "split_error")],
                               "model string, dataset string, kappa double, error_type string")
    io.write_result_csv(df, os.path.join(d, "grid"), ["kappa"])
    txt = "".join(open(os.path.join(d, "grid", f)).read() for f in os.listdir(os.path.join(d, "grid"))
                  if f.endswith(".csv"))
    assert "0.1235" in txt and "1.0000" in txt
    assert io.write_wrong_format(df, os.path.join(d, "wf")) is True
    assert spark.read.json(os.path.join(d, "wf")).count() == 1
    assert io.write_wrong_format(df.filter("error_type = ''"), os.path.join(d, "wf2")) is False
    io.append_metrics(df, os.path.join(d, "m"))
    io.append_metrics(df, os.path.join(d, "m"))
    assert spark.read.json(os.path.join(d, "m")).count() == 4
    io.write_partitioned(df, os.path.join(d, "p"), ["model", "dataset"])
    assert os.path.isdir(os.path.join(d, "p", "model=m1", "dataset=d2"))
    tok = spark.createDataFrame([([1, 2], 1, "train"), ([3], 1, "test")], "input_ids array<int>, seq_len int, split string")
    io.write_tokenized(tok, os.path.join(d, "tok"))
    assert io.read_tokenized(spark, os.path.join(d, "tok"), "test").count() == 1
