"""NER evaluation queries over GP (q01-q03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.match import casefold, flag_undefined, key_counts, multiset_outcome, nested_outcome
from promptloom.operators.metrics import micro_prf
from promptloom.plans.derive import ENTITY_TYPES, gp_entities, gp_sql
from promptloom.plans.registry import register
from promptloom.sources.tables import table

STRICT_BOUNDARIES = {"strict": ["e_type", "e_name"], "boundaries": ["e_name"]}

# Frequent ("head") vs rare ("tail") type buckets used by the head/tail report.
TYPE_BUCKETS = [("head", "protein"), ("head", "DNA"), ("head", "cell_type"),
                ("tail", "RNA"), ("tail", "cell_line")]


def _prf_sql(scale: int = 5) -> str:
    return f"""tp, fp, fn,
  round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END, {scale}) AS precision,
  round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END, {scale}) AS recall,
  round(CASE WHEN tp + fp <> 0 AND tp + fn <> 0 AND tp > 0
        THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
        ELSE 0 END, {scale}) AS f1"""


def q01(spark, sf_dir):
    """M1 M2 M3 A1 A2 (hard): micro P/R/F1 under strict and boundaries keys."""
    ents = casefold(gp_entities(spark, sf_dir))
    return micro_prf(nested_outcome(ents, "doc_id", STRICT_BOUNDARIES), ["match"])


register("q01_ner_micro_hard", oracle="WITH " + gp_sql() + """,
c AS (
  SELECT 'strict' AS match, doc_id, lower(e_type) t, e_name,
         count(*) FILTER (WHERE side = 'gold') AS g, count(*) FILTER (WHERE side = 'pred') AS p
  FROM ents GROUP BY doc_id, lower(e_type), e_name
  UNION ALL
  SELECT 'boundaries', doc_id, NULL, e_name,
         count(*) FILTER (WHERE side = 'gold'), count(*) FILTER (WHERE side = 'pred')
  FROM ents GROUP BY doc_id, e_name),
s AS (SELECT match, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp,
             CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM c GROUP BY match)
SELECT match, """ + _prf_sql() + " FROM s")(q01)


def q02(spark, sf_dir):
    """A4 + M12: strict hard counts per type, per head/tail bucket and overall
    (GROUPING SETS on the per-key outcomes; the bucket table is 5 fixed rows)."""
    ents = casefold(gp_entities(spark, sf_dir))
    out = multiset_outcome(key_counts(ents, "doc_id", {"strict": ["e_type", "e_name"]}))
    buckets = spark.createDataFrame([(b, t.lower()) for b, t in TYPE_BUCKETS], "bucket string, e_type string")
    out = out.groupBy("e_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).join(F.broadcast(buckets), "e_type", "left")
    s = (out.groupingSets([[], ["bucket"], ["bucket", "e_type"]], "bucket", "e_type")
         .agg(F.sum("tp").cast("long").alias("tp"), F.sum("fp").cast("long").alias("fp"),
              F.sum("fn").cast("long").alias("fn")))
    return micro_prf(s, ["bucket", "e_type"])


register("q02_ner_per_type", oracle="WITH " + gp_sql() + """,
buckets(bucket, t) AS (VALUES ('head','protein'),('head','dna'),('head','cell_type'),('tail','rna'),('tail','cell_line')),
c AS (
  SELECT doc_id, lower(e_type) t, e_name,
         count(*) FILTER (WHERE side = 'gold') AS g, count(*) FILTER (WHERE side = 'pred') AS p
  FROM ents GROUP BY doc_id, lower(e_type), e_name),
s AS (SELECT b.bucket, c.t AS e_type, CAST(sum(least(g, p)) AS BIGINT) AS tp,
             CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn
      FROM c LEFT JOIN buckets b ON c.t = b.t
      GROUP BY GROUPING SETS ((), (b.bucket), (b.bucket, c.t)))
SELECT bucket, e_type, """ + _prf_sql() + " FROM s")(q02)


def q03(spark, sf_dir):
    """M11 + A5: entity counts, undefined predicted types, invalid samples,
    and strict hard P/R/F1 with the undefined predictions kept as false positives."""
    ents = casefold(gp_entities(spark, sf_dir, foreign_every=7))
    types = spark.createDataFrame([(t,) for t in ENTITY_TYPES], "verbose string")
    flagged = flag_undefined(ents, types)
    per_doc = (flagged.groupBy("doc_id")
               .agg(F.count_if(F.col("side") == "gold").alias("n_gold"),
                    F.count_if(F.col("side") == "pred").alias("n_pred"),
                    F.count_if((F.col("side") == "pred") & F.col("undefined")).alias("n_undef")))
    counts = per_doc.agg(F.sum("n_gold").cast("long").alias("n_entities"),
                         F.sum("n_pred").cast("long").alias("n_predicted"),
                         F.sum("n_undef").cast("long").alias("n_undefined"),
                         F.count_if(F.col("n_undef") > 0).cast("long").alias("n_invalid"))
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_samples"))
    m = micro_prf(multiset_outcome(key_counts(ents, "doc_id", {"strict": ["e_type", "e_name"]})), [])
    return counts.crossJoin(n_docs).crossJoin(m)  # three single-row frames


register("q03_ner_undefined_invalid", oracle="WITH " + gp_sql(7) + """,
d AS (SELECT doc_id, count(*) FILTER (WHERE side='gold') g, count(*) FILTER (WHERE side='pred') p,
             count(*) FILTER (WHERE side='pred' AND lower(e_type) NOT IN ('dna','rna','protein','cell_type','cell_line')) u
      FROM ents GROUP BY doc_id),
c AS (SELECT doc_id, lower(e_type) t, e_name,
             count(*) FILTER (WHERE side = 'gold') AS g, count(*) FILTER (WHERE side = 'pred') AS p
      FROM ents GROUP BY doc_id, lower(e_type), e_name),
s AS (SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp,
             CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM c)
SELECT (SELECT CAST(sum(g) AS BIGINT) FROM d) AS n_entities, (SELECT CAST(sum(p) AS BIGINT) FROM d) AS n_predicted,
       (SELECT CAST(sum(u) AS BIGINT) FROM d) AS n_undefined, (SELECT count(*) FILTER (WHERE u > 0) FROM d) AS n_invalid,
       (SELECT count(*) FROM documents) AS n_samples, """ + _prf_sql() + " FROM s")(q03)
