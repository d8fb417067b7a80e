"""NER corpus queries (q18-q20) on a span corpus derived from ``documents``.

Each document is one sentence: tokens are its whitespace-separated pieces
(whole text).  Entities come from two per-token rules evaluated with array
higher-order functions on the row itself (no shuffle): a capitalised token
starts a span of 1 + len % 3 tokens (type = TYPES[len % 5]); a token ending
with ',' is a one-token span (type = TYPES[(len + 1) % 5]).  Spans of the two
rules overlap, so flat and nested sentences and identical spans all occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.ner import (
    corpus_stats, flag_nested, lookup_types, sentence_summary, sort_entities, span_text)
from promptloom.plans.derive import ENTITY_TYPES, by_sample, text_tasks
from promptloom.functions.columns import expand_rows
from promptloom.plans.registry import register
from promptloom.session import materialize
from promptloom.sources.tables import table

NUM_TYPE = len(ENTITY_TYPES)


def _types_df(spark):
    return spark.createDataFrame([(t, t, t) for t in ENTITY_TYPES], "code string, verbose string, short string")


def span_corpus(docs):
    """F6 rows: (doc_id, tokens, n, entities array<struct<start,end,type>>).

    The lambdas only touch their own element (token, its index and the count
    of tokens after it, zipped together): an outer column used inside a
    lambda may be inlined by the optimizer and recomputed per element."""
    toks = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = docs.select("doc_id", toks.alias("tokens")).withColumn("n", F.size("tokens"))
    idx = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    z = F.arrays_zip(idx.alias("i"), F.col("tokens").alias("tok"), F.reverse(idx).alias("rest"))
    types = F.array(*[F.lit(t) for t in ENTITY_TYPES])

    def ent(x, end, type_shift):
        tlen = F.length(x["tok"])
        return F.struct(x["i"].alias("start"), end(x, tlen).alias("end"),
                        F.element_at(types, ((tlen + type_shift) % 5 + 1).cast("int")).alias("type"))

    a = F.transform(F.filter(z, lambda x: x["tok"].rlike(r"^\p{Lu}")),
                    lambda x: ent(x, lambda x, tl: x["i"] + 1 + F.least(tl % 3, x["rest"]), 0))
    b = F.transform(F.filter(z, lambda x: x["tok"].endswith(",")),
                    lambda x: ent(x, lambda x, tl: x["i"] + 1, 1))
    return d.select("doc_id", "tokens", "n", F.concat(a, b).alias("entities"))


def _entity_rows(spark, sf_dir):
    c = span_corpus(by_sample(table(spark, sf_dir, "documents")))
    e = c.select("doc_id", "tokens", F.posexplode(sort_entities(F.col("entities"))).alias("rank", "s"))
    e = e.select("doc_id", F.col("s.idx").cast("long").alias("idx"), F.col("rank").cast("long").alias("rank"),
                 F.col("s.e").alias("ent"), "tokens")
    e = e.select("doc_id", "idx", "rank", F.col("ent.start").alias("start"),
                 F.col("ent.end").alias("end"), F.col("ent.type").alias("e_type"),
                 span_text(F.col("tokens"), F.col("ent.start"), F.col("ent.end")).alias("e_name"))
    return c, flag_nested(lookup_types(e, _types_df(spark)), "doc_id")


def q18(spark, sf_dir):
    """Entity rows with span text, verbose type, nested flag and
    rank = position after the stable sort by start (computed on the row's own
    entity array, no window)."""
    _, e = _entity_rows(spark, sf_dir)
    return e.select("doc_id", "idx", "rank", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                    "e_type", "e_type_verbose", "e_name", "nested")


_CORPUS_SQL = r"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tokens FROM documents),
r AS (SELECT doc_id, tokens, unnest(range(0, len(tokens))) AS i FROM d),
e0 AS (
  SELECT doc_id, tokens, i AS start, least(i + 1 + length(tokens[i + 1]) % 3, len(tokens)) AS "end",
         (['DNA','RNA','protein','cell_type','cell_line'])[length(tokens[i + 1]) % 5 + 1] AS e_type, 0 AS rule
  FROM r WHERE regexp_matches(tokens[i + 1], '^\p{Lu}')
  UNION ALL
  SELECT doc_id, tokens, i, i + 1, (['DNA','RNA','protein','cell_type','cell_line'])[(length(tokens[i + 1]) + 1) % 5 + 1], 1
  FROM r WHERE suffix(tokens[i + 1], ',')),
e AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rule, start) - 1 AS BIGINT) AS idx, start, "end",
         e_type, e_type AS e_type_verbose, array_to_string(tokens[start + 1:"end"], ' ') AS e_name FROM e0),
nst AS (
  SELECT DISTINCT a.doc_id, a.start, a."end" FROM e a JOIN e b
    ON a.doc_id = b.doc_id AND a.idx <> b.idx
   AND ((a.start >= b.start AND a."end" <= b."end") OR (a.start <= b.start AND a."end" >= b."end"))),
en AS (SELECT e.*, (n.doc_id IS NOT NULL) AS nested FROM e LEFT JOIN nst n USING (doc_id, start, "end"))"""

register("q18_span_text_stats", oracle=f"""WITH {_CORPUS_SQL}
SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, idx) - 1 AS BIGINT) AS rank,
       start, "end", e_type, e_type_verbose, e_name, nested FROM en""")(q18)


def q19(spark, sf_dir):
    """Sentence modes and corpus statistics of the span corpus."""
    c, e = _entity_rows(spark, sf_dir)
    summary = sentence_summary(e, c.select("doc_id", F.col("n").alias("n_tokens")), "doc_id")
    return corpus_stats(summary)


_STATS_SQL = """
SELECT count(*) AS n_sentences, CAST(sum(n_entities) AS BIGINT) AS n_entities, round(avg(n_tokens), 6) AS avg_tokens,
       CAST(max(n_entities) AS BIGINT) AS max_entities, round(avg(n_entities), 6) AS avg_entities,
       count(*) FILTER (WHERE n_nested > 0) AS n_nested_sentences, CAST(sum(n_nested) AS BIGINT) AS n_nested_entities,
       round(sum(n_nested) / sum(n_entities), 6) AS nesting_ratio"""

register("q19_nested_spans", oracle=f"""WITH {_CORPUS_SQL},
s AS (
  SELECT d.doc_id, len(d.tokens) AS n_tokens,
         (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS n_entities,
         (SELECT count(*) FROM (SELECT DISTINCT e_type, start, "end" FROM en WHERE en.doc_id = d.doc_id AND nested)) AS n_nested
  FROM d)
{_STATS_SQL} FROM s""")(q19)


def q20(spark, sf_dir):
    """The corpus in MRC form (NUM_TYPE consecutive rows per sentence,
    one per type, spans as 's;e' with inclusive end) regrouped into sentences,
    with statistics without and with duplicate-sentence removal.

    Regrouping is a key computation (line div NUM_TYPE): lines go to their sentence's
    task as span lists, and nothing moves again until a sentence is one row of counts.
    Duplicate removal keeps the first sentence per context via an aggregation
    that combines duplicates map-side."""
    docs = table(spark, sf_dir, "documents")
    c, tasks = span_corpus(docs), text_tasks(docs)
    mrc = expand_rows(c, list(enumerate(ENTITY_TYPES)), ["t", "entity_label"]).select(
        (F.col("doc_id") * NUM_TYPE + F.col("t")).alias("line"),
        F.array_join("tokens", " ").alias("context"), "entity_label",
        F.transform(F.filter("entities", lambda x: x["type"] == F.col("entity_label")),
                    lambda x: F.concat(x["start"].cast("string"), F.lit(";"), (x["end"] - 1).cast("string")))
        .alias("span_position"))
    mrc = mrc.withColumn("sent_id", F.floor(F.col("line") / NUM_TYPE))
    # whole sentences are told apart by a wide digest
    sents = (mrc.filter(F.col("line") % NUM_TYPE == 0)
             .select("sent_id", F.sha2("context", 256).alias("digest"), F.size(F.split("context", " ")).alias("n_tokens"))
             .repartition(tasks, "sent_id"))
    sp = (mrc.filter(F.size("span_position") > 0).select("sent_id", "entity_label", "span_position").repartition(tasks, "sent_id")
          .select("sent_id", "entity_label", F.explode("span_position").alias("span")))
    parts = F.split("span", ";")
    ents = sp.select("sent_id", F.col("entity_label").alias("e_type"),
                     F.get(parts, 0).cast("int").alias("start"), (F.get(parts, 1).cast("int") + 1).alias("end"))
    # one row a sentence is stored, and read for both results
    summary = materialize(sentence_summary(flag_nested(ents, "sent_id"), sents, "sent_id"))
    first = summary.groupBy("digest").agg(F.min("sent_id").alias("sent_id"))
    out = None
    for dedup in (False, True):
        keep = summary.join(first, ["digest", "sent_id"], "left_semi") if dedup else summary
        st = corpus_stats(keep)
        st = st.select(F.lit(dedup).alias("dedup"), *st.columns)
        out = st if out is None else out.unionByName(st)
    return out


register("q20_mrc_regroup", oracle=f"""WITH {_CORPUS_SQL},
s0 AS (SELECT d.doc_id, array_to_string(d.tokens, ' ') AS context, len(d.tokens) AS n_tokens,
              (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS n_entities,
              (SELECT count(*) FROM (SELECT DISTINCT e_type, start, "end" FROM en WHERE en.doc_id = d.doc_id AND nested)) AS n_nested
       FROM d),
s1 AS (SELECT * FROM s0 WHERE doc_id IN (SELECT min(doc_id) FROM s0 GROUP BY context))
{_STATS_SQL}, false AS dedup FROM s0
UNION ALL
{_STATS_SQL}, true AS dedup FROM s1""")(q20)
