"""Exact stratified samples without a global sort (P20, P19 at any size).

A weighted mix takes a fixed number of rows from every stratum: those of least digest,
so that a sample is the same wherever it is drawn.  The place where a stratum's quota
ends is found by counting: rows by the first hexadecimal digits of their digest, then,
within the one prefix where the quota ends, by the next digits, until few rows share
it.  Only counts are shuffled; the rows themselves are compared with one threshold of
their stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.operators.joins import join_small
from promptloom.session import materialize

DIGITS = 3
#: Rows of one stratum that may be ranked in one task.
RANKED = 100_000
MAX_DIGITS = 30


def quotas(sizes: DataFrame, total: int, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """(stratum, n) -> (stratum, n, quota): ``total`` rows in proportion to the weights,
    whole numbers by largest remainder (ties: the lesser stratum), no more than there are.
    There is a row for every stratum, so this is as small as their number."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]).cast("map<string,double>")[F.col("stratum")],
                        F.lit(float(default))) if weights else F.lit(float(default))
    every = Window.partitionBy()
    share = sizes.withColumn("_w", weight).withColumn("_x", F.lit(float(total)) * F.col("_w") / F.sum("_w").over(every))
    floor = F.floor("_x")
    left = F.lit(total) - F.sum(floor).over(every)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_x") - floor), "stratum"))
    quota = floor + F.when(rank <= left, 1).otherwise(0)
    return share.select("stratum", "n", F.least(quota, F.col("n")).cast("long").alias("quota"))


def least_of_strata(rows: DataFrame, quota: DataFrame, digest: str, id_col: str, ranked: int = RANKED) -> DataFrame:
    """The ``quota`` (stratum, quota) rows of least (``digest``, ``id_col``) of every stratum
    of ``rows``; ``digest`` is a hexadecimal string of more than MAX_DIGITS digits."""
    # open strata: rows below the prefix are taken, of the rows at it ``need`` more
    at = materialize(quota.select("stratum", F.lit("").alias("prefix"), F.col("quota").alias("need"), F.lit(True).alias("wide")))
    length = 0
    while length < MAX_DIGITS and not at.filter("wide").isEmpty():
        length += DIGITS
        inside = join_small(rows.select("stratum", F.substring(digest, 1, length).alias("cut")), at.filter("wide"), ["stratum"])
        inside = inside.filter(F.startswith("cut", "prefix"))
        counts = inside.groupBy("stratum", "need", "cut").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("stratum").orderBy("cut"))
        counts = counts.withColumn("before", upto - F.col("c"))
        # the prefix where the quota ends: the last one that begins below it
        last = counts.filter(F.col("before") < F.col("need")).groupBy("stratum").agg(
            F.max_by(F.struct(F.col("cut").alias("prefix"), (F.col("need") - F.col("before")).alias("need"),
                              (F.col("c") > ranked).alias("wide")), "cut").alias("x")).select("stratum", "x.*")
        at = materialize(at.filter(~F.col("wide")).unionByName(last))
    own = F.substring(F.col(digest), F.lit(1), F.length("prefix"))
    marked = join_small(rows, at.drop("wide"), ["stratum"])
    below = marked.filter(own < F.col("prefix")).select(*rows.columns)
    edge = marked.filter((own == F.col("prefix")) & (F.col("need") > 0))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(digest, id_col))
    return below.unionByName(edge.withColumn("_r", rank).filter(F.col("_r") <= F.col("need")).select(*rows.columns))
