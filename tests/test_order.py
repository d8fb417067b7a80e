"""Positional operators stay distributed and dense."""

from pyspark.sql import functions as F

from promptloom.operators.order import batch_ids, first_last_split, with_global_index


def test_global_index_dense_and_distributed(spark):
    df = spark.range(0, 20000, 1, 8).select((F.col("id") % 7).alias("k"), F.col("id"))
    idx = with_global_index(df, ["k", "id"], num_partitions=8)
    assert idx.rdd.getNumPartitions() > 1
    rows = idx.select("k", "id", "idx").collect()
    assert sorted(r.idx for r in rows) == list(range(20000))
    order = [r.idx for r in sorted(rows, key=lambda r: (r.k, r.id))]
    assert order == list(range(20000))


def test_first_last_overlap_and_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "doc")
    s = first_last_split(df, ["doc"], 7, 5)
    got = sorted((r.split, r.doc) for r in s.collect())
    assert [d for sp, d in got if sp == "train"] == list(range(7))
    assert [d for sp, d in got if sp == "test"] == list(range(5, 10))
    b = {r.doc: (r.batch_id, r.slot) for r in batch_ids(df, ["doc"], 4).collect()}
    assert b[0] == (0, 0) and b[5] == (1, 1) and b[9] == (2, 1)


def test_first_n(spark):
    from promptloom.operators.order import first_n
    df = spark.range(10).withColumnRenamed("id", "doc")
    assert sorted(r.doc for r in first_n(df, ["doc"], 3).collect()) == [0, 1, 2]
    assert first_n(df, ["doc"], -1).count() == 10


def test_positions_with_payload_above_the_sampling_size(spark):
    """Range bounds come from a sample; positions stay dense when it is a part of the rows."""
    payload = F.repeat(F.lit("x"), 50)
    df = spark.range(0, 300000, 1, 12).select(F.md5(F.col("id").cast("string")).alias("k"), "id", payload.alias("p"))
    idx = with_global_index(df, ["k", "id"], num_partitions=16)
    low, high, n, distinct = idx.agg(F.min("idx"), F.max("idx"), F.count("*"), F.count_distinct("idx")).first()
    assert (low, high, n, distinct) == (0, 299999, 300000, 300000)


def test_line_numbers_of_a_large_file(spark, tmp_path):
    from promptloom.sources.io import read_jsonl
    path = str(tmp_path / "lines")
    spark.range(0, 150000, 1, 3).select(F.to_json(F.struct(F.col("id").cast("string").alias("prompt"),
                                                           F.lit("t").alias("target"))).alias("value")).write.text(path)
    n = read_jsonl(spark, path).agg(F.count_distinct("line_no"), F.max("line_no")).first()
    assert tuple(n) == (150000, 149999)
