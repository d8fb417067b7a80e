"""Order-dependent operators without a single-partition global window.

Spark tables are unordered, so every positional operator of the reference
(first-N/last-N splits, split rebalancing, fixed-size batches, line numbers)
takes an explicit order.  Positions are computed the way ``zipWithIndex`` does
it, but on DataFrames: range-partition on the order, count rows per partition
(one row per partition), turn the counts into offsets, and add each row's rank
inside its partition.  No step puts all rows into one task.

The range bounds come from a sample, and a second evaluation of the same plan may
draw another one.  The tagged rows are therefore written once (a checkpoint in
the shared folder), and counts and positions are both read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def tagged_in_order(df: DataFrame, order_cols: list[str | Column], n: int) -> DataFrame:
    """Rows range-partitioned and sorted, with partition and rank inside it."""
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    return ordered.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))


def with_global_index(df: DataFrame, order_cols: list[str | Column], index_col: str = "idx",
                      num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """Add a 0-based dense position of every row in the order ``order_cols``.

    The order must be total (end it with a unique column) for a deterministic
    result.  The offsets table has one row per partition, so broadcasting it is
    bounded by the partition count, not by the data.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = materialize(tagged_in_order(df, order_cols, n))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("_all"))
    out = (tagged.join(F.broadcast(offsets), "_pid")
           .withColumn(index_col, (F.col("_off") + F.col("_row")).cast("long")))
    if total_col:
        out = out.withColumn(total_col, F.col("_all").cast("long"))
    return out.drop("_pid", "_row", "_off", "_all")


def first_last_split(df: DataFrame, order_cols: list[str], n_first: Column | int, n_last: Column | int,
                     index_col: str = "idx") -> DataFrame:
    """Rows [0, n_first) are 'train', the last n_last rows are 'test'.

    Like the reference's ``data[:N]`` / ``data[-M:]``, the two may overlap; a row
    in both is emitted once per split.  ``n_first``/``n_last`` may be columns
    (e.g. derived from the row count) or ints.
    """
    j = with_global_index(df, order_cols, index_col, total_col="_total")  # total from the partition counts
    nf = n_first if isinstance(n_first, Column) else F.lit(n_first)
    nl = n_last if isinstance(n_last, Column) else F.lit(n_last)
    first = j.filter(F.col(index_col) < nf).withColumn("split", F.lit("train"))
    last = j.filter(F.col(index_col) >= F.col("_total") - nl).withColumn("split", F.lit("test"))
    return first.unionByName(last).drop("_total")


def batch_ids(df: DataFrame, order_cols: list[str], batch_size: int,
              index_col: str = "idx") -> DataFrame:
    """Consecutive chunks of ``batch_size`` rows in order (last may be short)."""
    idx = with_global_index(df, order_cols, index_col)
    return (idx.withColumn("batch_id", F.floor(F.col(index_col) / batch_size).cast("long"))
            .withColumn("slot", (F.col(index_col) % batch_size).cast("int")))


#: First rows that one task may keep and sort.
TOP_ROWS = 100_000


def first_n(df: DataFrame, order_cols: list[str], n: int, index_col: str = "idx") -> DataFrame:
    """The first ``n`` rows in order; ``n < 0`` keeps every row.

    A small ``n`` is a top-n: every task keeps its own first rows and one merges
    them.  A larger one counts the rows of the ordered ranges instead."""
    if n < 0:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(*order_cols).limit(n)
    return with_global_index(df, order_cols, index_col).filter(F.col(index_col) < n).drop(index_col)
