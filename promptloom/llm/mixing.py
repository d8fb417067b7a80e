"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Targets.  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` of all words; a target stops at ``max_passes`` times its source
and the excess goes to the others by weight (a water level: target =
min(cap, level * weight)).

Blocks.  The documents of a source fall by hash into about the square root of
their number of blocks, and the blocks are permuted by hash.  The mix takes each
block once per full pass over the source and, for the rest of the target, the
blocks at the front of the permutation; in the block where the rest ends, it
takes documents in hash order while that brings the total nearer to the target.
The error is at most half of one document a source.

Shards.  The numbers of taken block copies per source are split over the output
shards by a binary tree of exact multivariate hypergeometric draws; each source's
copies, permuted again, are dealt to the shards by these quotas, so they are
disjoint.  ``mix`` shuffles the documents inside their shard.

Built-in functions only; hashes of the content decide everything, so reruns
agree whatever the partitioning.  No window holds more than about the square
root of a source's rows.

Defined cases: null text has no words and is taken as an empty document; a null
source is a source of its own; repeated rows are separate documents (which of
two identical rows is taken is not told apart); an empty table gives an empty
result; extra columns are ignored by ``plan_mix`` and kept by ``mix``; a very long text
is one row of a large size, taken whole.  All sources meet in one row of totals, so
their number must fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import WORD, stored
from promptloom.llm.hypergeometric import minus, split

WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """(src, words) -> (src, words, weight, target)."""
    w_array = F.array(*[F.lit(float(w)) for w in weights])
    order = F.row_number().over(Window.orderBy("src")) - 1
    s = sources.withColumn("weight", F.element_at(w_array, (F.pmod(order, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("words") * F.lit(float(max_passes)))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    rest = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("words").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    # the water level is where the first source, by cap per weight, stays below its cap
    s = s.withColumn("level", level).withColumn("fits", F.col("cap") >= F.col("level") * F.col("weight") * (1 - 1e-12))
    at = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("src"), F.col("level"))))
    s = s.withColumn("water", at.over(Window.partitionBy())["level"])
    return s.select("src", "words", "weight", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def shard_quotas(copies: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(src, n) block copies -> (src, shard, first, n): the copies first..first+n-1 go to the shard.
    ``n_shards`` is a power of two."""
    node = copies.agg(F.array_sort(F.collect_list(F.struct("src", "n"))).alias("s")).select(
        F.lit(0).cast("long").alias("node"), F.transform("s", lambda x: x["src"]).alias("srcs"),
        F.transform("s", lambda x: x["n"]).alias("counts"))
    for level in range(n_shards.bit_length() - 1):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        # an odd copy goes left or right by the node's own coin
        half = F.floor((total + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2)
        left = split(F.col("counts"), half, F.lit(seed), F.lit(level), F.col("node"))
        node = (node.withColumn("left", left).select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), "srcs", F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), "srcs", minus(F.col("counts"), F.col("left")).alias("counts")),
        )).alias("x")).select("x.*"))
    flat = node.select(F.col("node").cast("int").alias("shard"),
                       F.explode(F.arrays_zip("srcs", "counts")).alias("z")).select(
        "shard", F.col("z.srcs").alias("src"), F.col("z.counts").alias("n"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def plan_mix(docs: DataFrame, n_shards: int = 16, seed: int = 11, weights=WEIGHTS, share: float = 1.5,
             max_passes: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``row`` (a struct of the columns ``keep``), size, source_size, target,
    taken and ``shards`` (one entry per copy that the mix takes)."""
    src = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit("")))
    text = F.col("text")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), src.alias("src"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("h"))
    if "text" in keep:  # texts are read again rather than stored
        stats = stored(rows.select("src", "size", "h"), "mix-rows")
    else:
        rows = stats = stored(rows, "mix-rows")
    per_source = stats.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    n_blocks = F.ceil(F.sqrt("n")).cast("long")
    targets = stored(source_targets(per_source, weights, share, max_passes)
                     .join(per_source.select("src", n_blocks.alias("n_blocks")), "src"), "mix-targets")
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int")
    block_counts = targets.select("src", "n_blocks")
    if _small(targets):
        block_counts = F.broadcast(block_counts)
    block = F.pmod(F.col("h"), F.col("n_blocks")).alias("block")
    placed = rows.join(block_counts, "src").select("row", "src", "size", "h", block)
    blocks = stats.join(block_counts, "src").select("src", "size", block).groupBy("src", "block").agg(F.sum("size").alias("block_words"))
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block"), "block")
    start = F.coalesce(F.sum("block_words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = (blocks.join(targets.select("src", "words", "target", passes.alias("passes")), "src")
              .withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
              .withColumn("left", F.col("rest") - start)  # words still wanted when the block's turn comes
              .withColumn("copies", F.col("passes") + F.when((F.col("left") > 0) & (F.col("block_words") > 0), 1).otherwise(0)))
    blocks = stored(blocks, "mix-blocks")
    copy_rows = blocks.filter("copies > 0").select("src", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "src", "block", "copy"), "block", "copy")
    numbered = copy_rows.withColumn("at", F.row_number().over(dealt) - 1)
    quotas = shard_quotas(copy_rows.groupBy("src").agg(F.count("*").alias("n")), n_shards, seed)
    slots = quotas.filter("n > 0").select("src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    shards = (numbered.join(slots.withColumn("at", F.col("at").cast("int")), ["src", "at"])
              .groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("c"))
              .select("src", "block", F.transform("c", lambda x: x["shard"]).alias("block_shards")))
    plan = blocks.drop("block_words", "copies").join(shards, ["src", "block"], "left")
    inside = Window.partitionBy("src", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (placed.join(plan, ["src", "block"])
           .withColumn("reached", F.sum("size").over(inside))
           .withColumn("n_copies", F.col("passes") + F.when(
               (F.col("left") > 0) & (F.col("reached") - F.col("size") / 2 <= F.col("left")), 1).otherwise(0)))
    taken_shards = F.when(F.col("block_shards").isNull(), F.array().cast("array<int>")).otherwise(
        F.slice("block_shards", F.lit(1), F.least(F.col("n_copies"), F.size("block_shards"))))
    return out.select("row", "size", F.col("words").alias("source_size"), "target", "h", taken_shards.alias("shards"),
                      (F.col("size") * F.size(taken_shards)).alias("taken"))


def _small(table: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether a table of short rows stays below the broadcast limit, by its bytes."""
    return (table.agg(F.sum(F.octet_length("src") + 64)).first()[0] or 0) <= limit


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 11, shard_col: str | None = "mix_shard", **params) -> DataFrame:
    """The mixed documents themselves, one row per copy: all columns of ``docs``
    and, unless it is None, ``shard_col``; in hash order inside each shard (the
    local shuffle)."""
    plan = plan_mix(docs, n_shards, seed, keep=tuple(docs.columns), **params)
    copies = plan.select("row", "h", F.posexplode("shards").alias("copy", "shard"))
    place = F.xxhash64(F.lit(seed + 3), "h", "copy")
    shuffled = copies.repartitionByRange("shard", place).sortWithinPartitions("shard", place)
    cols = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != shard_col]
    return shuffled.select(*cols, *([F.col("shard").alias(shard_col)] if shard_col else []))
