"""Sharding with exact sizes: a hypergeometric communication matrix.

Every input partition permutes its rows locally.  How many of them go to each
shard is drawn exactly: a binary tree over the partitions splits the vector of
shard sizes by multivariate hypergeometric draws, so every row of the matrix
sums to its partition's rows and every column to its shard's size, as in a
uniform permutation of all rows.  Rows are exchanged by that matrix and permuted
again inside their shard.  Law ``rows``: shard sizes differ by at most one, so
equal texts are not kept together (a group may exceed a shard).

Built-in functions only.  Shard positions come from buckets inside the shard
(about the square root of its rows each), so no task holds a whole shard.

Defined cases: null text has crc32 0 and no bytes; null ids, ties and repeated
rows are ordinary rows; fewer rows than shards leave shards empty; an empty
table gives an empty result; all columns of the input are carried along; a very long
text is one row like any other (the law is ``rows``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import stored, text_or_empty
from promptloom.llm.hypergeometric import minus, split

LOCAL = (1 << 33) - 1  # monotonically_increasing_id: position inside the partition
SPREAD_LEVEL = 6  # from 64 nodes on the tree's draws are spread over tasks


def communication_matrix(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(part, n) -> (part, cum): cum[j] rows of the partition go to shards below j+1."""
    spark = counts.sparkSession
    top, total = counts.agg(F.max("part"), F.sum("n")).first()
    n_parts, total = (top or 0) + 1, total or 0
    depth = math.ceil(math.log2(n_parts)) if n_parts > 1 else 0
    base, extra = divmod(total, n_shards)
    caps = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)),
                       lambda j: F.lit(base) + F.when(j < extra, 1).otherwise(0).cast("long"))
    # row counts by partition number, zeros for the numbers without rows
    dense = spark.range(1 << depth).select(F.col("id").alias("part")).join(counts, "part", "left")
    row_counts = F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).cast("long").alias("n")))),
                             lambda x: x["n"])
    node = dense.agg(row_counts.alias("rows")).select(F.lit(0).cast("long").alias("node"), "rows", caps.alias("caps"))
    for level in range(depth):
        half = 1 << (depth - level - 1)
        left_rows = F.slice("rows", 1, half)
        drawn = node.withColumn("left", split(
            F.col("caps"), F.aggregate(left_rows, F.lit(0).cast("long"), lambda s, x: s + x),
            F.lit(seed), F.lit(level), F.col("node")))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), left_rows.alias("rows"), F.col("left").alias("caps")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("rows", half + 1, half).alias("rows"),
                     minus(F.col("caps"), F.col("left")).alias("caps")))
        node = drawn.select(F.explode(children).alias("x")).select("x.*")
        if level == SPREAD_LEVEL:
            node = stored(node.repartition(1 << level, "node"), "matrix")
    running = F.transform(F.sequence(F.lit(1), F.lit(n_shards)),
                          lambda j: F.aggregate(F.slice("caps", 1, j), F.lit(0).cast("long"), lambda s, x: s + x))
    return node.select(F.col("node").alias("part"), running.alias("cum"))


def shard_rows(rows: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """All columns of ``rows`` plus ``shard`` (int) and ``slot`` (long, gapless from 0)."""
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    permuted = stored(packed.sortWithinPartitions(F.rand(seed)).select("row", F.monotonically_increasing_id().alias("at")), "permuted")
    permuted = permuted.withColumn("part", F.shiftright("at", 33))
    counts = stored(permuted.groupBy("part").agg(F.count("*").alias("n")), "counts")
    matrix = stored(communication_matrix(counts, n_shards, seed), "matrix")
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.isqrt(total // n_shards))
    sent = (permuted.join(matrix, "part").select(
        "row", "at",
        F.size(F.filter("cum", lambda c: c <= F.col("at").bitwiseAND(F.lit(LOCAL)))).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "at"), F.lit(buckets)).alias("bucket")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.lit(seed + 2), "at"), "at")
    return sent.join(offsets, ["shard", "bucket"]).select(
        "row.*", "shard", (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """The digest of every document with its place: doc_id, size, text_crc32,
    law, shard, slot, grown_shard."""
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text_or_empty()).cast("long") + 16).alias("size"),
        F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"))
    return shard_rows(rows, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
