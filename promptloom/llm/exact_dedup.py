"""Exact dedup: tree-merge of sorted digest runs.

Each input partition makes one run: its documents sorted and combined by the
SHA-256 digest of the normalised text, each digest with its best document and
its number of rows.  Runs then meet in rounds: in round k the runs of ``fan_in``
neighbouring nodes are merged by digest (a sort-merge aggregation with map-side
combining) into one run of the parent node, and every level keeps the smallest
identifier verified on the full 256-bit digest.  The winners walk the same tree
back down.  A digest that holds a third of all rows therefore never meets in
one task: a node gets at most ``fan_in`` rows per digest.

Defined cases: null text is empty; equal texts tie by code points (more wins),
then doc_id (a null doc_id last), then input position; an empty table gives an
empty result; extra columns are ignored; a very long text is hashed whole where it
lies, only its digest moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import SPACE, stored, text_or_empty

NODE_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def _merge(runs: DataFrame) -> DataFrame:
    return runs.groupBy("digest", "node").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256."""
    norm = F.regexp_replace(text_or_empty(), SPACE, "")
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text_or_empty()).cast("long").alias("n_cp"),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
    ), "dedup-rows").withColumn("node", F.shiftright("row_id", NODE_BITS))
    best = F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    level = stored(_merge(rows.select("digest", "node", best.alias("best"), F.lit(1).cast("long").alias("n"))), "run")
    levels = [level]
    top = rows.agg(F.max("node")).first()[0] or 0
    while top > 0:
        top //= fan_in
        level = stored(_merge(level.withColumn("node", F.floor(F.col("node") / fan_in))), "run")
        levels.append(level)
    # down: winners of digests with more than one row reach the leaf runs
    down = levels[-1].filter("n > 1")
    for child in reversed(levels[:-1]):
        up = down.select(F.col("digest"), F.col("node").alias("parent"), "best", "n")
        down = (child.select("digest", "node", F.floor(F.col("node") / fan_in).alias("parent"))
                .join(up, ["digest", "parent"]).select("digest", "node", "best", "n"))
    many = down.select("digest", "node", F.col("best.doc_id").alias("w_doc"),
                       F.col("best.row_id").alias("w_row"), "n")
    single = F.col("w_row").isNull()
    return (rows.join(many, ["digest", "node"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("w_doc")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("w_row") == F.col("row_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256")))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
