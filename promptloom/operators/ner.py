"""NER corpus operators.

Nested-entity detection (N4) is a containment test between spans of the same
sentence.  Instead of comparing all pairs, distinct spans are swept in start
order: a span is contained by another iff the running maximum of earlier ends
reaches its end, and contains another iff the running minimum of later ends
is within its end.  The sweep is split into fixed-width start buckets whose
carries come from a small per-bucket aggregate, so a very long sentence is
spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 1024


def span_text(tokens: Column, start: Column, end: Column, sep: str = " ") -> Column:
    """Sep.join(tokens[start:end]) for a half-open span."""
    return F.array_join(F.slice(tokens, start + 1, end - start), sep)


def lookup_types(ents: DataFrame, types: DataFrame, code_col: str = "e_type") -> DataFrame:
    """Code -> verbose through the (fixed, broadcast) type dictionary; an
    unknown code fails the job, as the reference's dictionary lookup does."""
    t = types.select(F.col("code").alias(code_col), F.col("verbose").alias("_verbose"))
    j = ents.join(F.broadcast(t), code_col, "left")
    return j.withColumn("e_type_verbose", F.coalesce(
        F.col("_verbose"), F.raise_error(F.concat(F.lit("unknown entity type: "), F.col(code_col))))).drop("_verbose")


def sort_entities(entities: Column) -> Column:
    """Entities ordered by start, ties kept in list order (stable); each
    element gains ``idx``, its position in the original list."""
    n = F.size(entities)
    z = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("idx"), entities.alias("e"))
    keyed = F.transform(z, lambda x: F.struct(x["e"]["start"].alias("start"), x["idx"].alias("idx"), x["e"].alias("e")))
    return F.when(n > 0, F.array_sort(keyed)).otherwise(F.array().cast(
        "array<struct<start:int,idx:int,e:struct<start:int,end:int,type:string>>>"))


def nested_spans(ents: DataFrame, doc: str, start: str = "start", end: str = "end",
                 width: int = BUCKET_WIDTH) -> DataFrame:
    """(doc, start, end, nested) per distinct span.  A span is nested when
    another entity of the sentence contains it or lies inside it (an identical
    span of a second entity counts)."""
    spans = ents.groupBy(doc, start, end).agg(F.count(F.lit(1)).alias("_c"))
    spans = spans.withColumn("_b", F.floor(F.col(start) / width))
    buckets = spans.groupBy(doc, "_b").agg(F.max(end).alias("_bmax"), F.min(end).alias("_bmin"))
    wb = Window.partitionBy(doc).orderBy("_b")
    buckets = buckets.select(
        doc, "_b",
        F.max("_bmax").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_max"),
        F.min("_bmin").over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_min"))
    s = spans.join(buckets, [doc, "_b"])
    w_up = Window.partitionBy(doc, "_b").orderBy(F.asc(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    w_dn = Window.partitionBy(doc, "_b").orderBy(F.desc(start), F.asc(end)).rowsBetween(Window.unboundedPreceding, -1)
    e = F.col(end)
    inside = (F.coalesce(F.max(end).over(w_up) >= e, F.lit(False))
              | F.coalesce(F.col("_carry_max") >= e, F.lit(False)))
    around = (F.coalesce(F.min(end).over(w_dn) <= e, F.lit(False))
              | F.coalesce(F.col("_carry_min") <= e, F.lit(False)))
    return s.select(doc, start, end, (inside | around | (F.col("_c") >= 2)).alias("nested"))


def flag_nested(ents: DataFrame, doc: str, start: str = "start", end: str = "end") -> DataFrame:
    """N4 on the entity rows themselves: each row of a sentence with ``nested``, as
    :func:`nested_spans` tells it of the row's span.

    Rows that are dealt by sentence stay where they are, and nothing is joined.  A
    sentence's rows are sorted in one task, which spills what it cannot hold."""
    at = Window.partitionBy(doc).orderBy(F.asc(start), F.desc(end))
    before = Window.unboundedPreceding, -1
    up = at.rowsBetween(*before)
    dn = Window.partitionBy(doc).orderBy(F.desc(start), F.asc(end)).rowsBetween(*before)
    e = F.col(end)
    # of equal spans, each but the last sees the next one here, and the last sees the others' end
    twin = (F.lead(start).over(at) == F.col(start)) & (F.lead(end).over(at) == e)
    tests = [twin, F.max(end).over(up) >= e, F.min(end).over(dn) <= e]
    flags = [F.coalesce(t, F.lit(False)) for t in tests]
    return ents.filter(F.col(doc).isNotNull()).withColumn("nested", flags[0] | flags[1] | flags[2])


def sentence_summary(ents: DataFrame, sentences: DataFrame, doc: str) -> DataFrame:
    """N5 + per-sentence counts: (doc, n_tokens, n_entities, n_nested_entities, mode).

    ``ents`` needs (doc, e_type, start, end, nested); nested entities are
    counted once per distinct value, as the reference's list-membership test
    does.  ``sentences`` needs (doc, n_tokens).  Rows that are dealt by sentence do not move.
    """
    values = ents.groupBy(doc, "e_type", "start", "end", "nested").agg(F.count(F.lit(1)).alias("_c"))
    per = values.groupBy(doc).agg(F.sum("_c").alias("n_entities"), F.count_if("nested").alias("n_nested_entities"))
    s = sentences.join(per, doc, "left").fillna(0, ["n_entities", "n_nested_entities"])
    return s.withColumn("mode", F.when(F.col("n_nested_entities") > 0, "nested").otherwise("flat"))


def corpus_stats(summary: DataFrame) -> DataFrame:
    """Sentences, entities, avg tokens, max/avg entities per sentence,
    nested sentences and entities, nesting ratio (ratios rounded to 6 dp)."""
    return summary.agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum("n_entities").cast("long").alias("n_entities"),
        F.round(F.avg("n_tokens"), 6).alias("avg_tokens"),
        F.max("n_entities").cast("long").alias("max_entities"),
        F.round(F.avg("n_entities"), 6).alias("avg_entities"),
        F.count_if(F.col("mode") == "nested").alias("n_nested_sentences"),
        F.sum("n_nested_entities").cast("long").alias("n_nested_entities"),
        F.round(F.try_divide(F.sum("n_nested_entities").cast("double"), F.sum("n_entities")), 6).alias("nesting_ratio"))
