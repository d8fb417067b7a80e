"""Derivations from the provided tables shared by several queries.

GP (gold / prediction entities from ``documents``): every whitespace-separated
word of every whole text, lower-cased with non-letters removed, keeping all that
are not empty then.  Deterministic positional rules turn the words into a gold
list and a predicted list with exact hits, misses, spurious items, near-misses
(one letter dropped, where more than one is there) and repeated names, so every matching path is exercised.
Each rule has a one-to-one SQL form used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.columns import pick
from promptloom.operators.designs import TYPE_ORDER
from promptloom.sources.tables import table

ENTITY_TYPES = TYPE_ORDER
FOREIGN_TYPE = "gene"


#: Text that one task of :func:`by_sample` gets, about.
TASK_BYTES = 4 << 20


def by_sample(docs: DataFrame, task_bytes: int = TASK_BYTES, tasks: int | None = None) -> DataFrame:
    """(doc_id, text) dealt to tasks by doc_id, as many as the text needs (or ``tasks``).  Texts move
    before they become words, so whatever is grouped by doc_id and more later moves no word."""
    docs = docs.select("doc_id", "text")
    return docs.repartition(text_tasks(docs, task_bytes) if tasks is None else tasks, "doc_id")


def text_tasks(docs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for work on the texts of ``docs``: one for every ``task_bytes``, the session's at least."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // task_bytes + 1)


def clean_lines(text: str) -> Column:
    """The lower-case letters of each word on a line of its own: each run of whitespace is one
    line end, and what is no letter goes."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\s+", "\n"), r"[^\p{L}\n]+", "")
    return F.lower(lines)


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, name, n_letters) for every word with a letter (whole texts).  A text is
    cleaned as a whole (:func:`clean_lines`), which takes half the time of its words one by one; the
    outer explosion keeps Spark from cleaning it twice (before an inner one it counts the words)."""
    w = docs.select("doc_id", F.posexplode_outer(F.split(clean_lines("text"), "\n")).alias("pos", "name"))
    return w.withColumn("n_letters", F.length("name")).filter(F.col("n_letters") >= 1)


def gp_entities(spark: SparkSession, sf_dir: str, foreign_every: int = 0, docs: DataFrame | None = None,
                tasks: int | None = None) -> DataFrame:
    """Long entity table (doc_id, side, pos, e_type, e_name) of all documents, or of ``docs``.

    gold: words with pos % 3 <> 0; pred: words with pos % 4 <> 0, last letter
    dropped when pos % 5 = 0.  Type = ENTITY_TYPES[n_letters % 5]; with
    ``foreign_every`` > 0 the predicted type is the undefined FOREIGN_TYPE when
    pos % foreign_every = 0.  A word gives both its rows in place, and all rows of a
    doc_id stay in one task (:func:`by_sample`, which deals them to ``tasks`` if given).
    """
    w = document_words(by_sample(table(spark, sf_dir, "documents") if docs is None else docs, tasks=tasks))
    etype = pick(ENTITY_TYPES, F.col("n_letters") % 5)
    ptype = etype
    if foreign_every:
        ptype = F.when(F.col("pos") % foreign_every == 0, F.lit(FOREIGN_TYPE)).otherwise(etype)
    pname = F.when((F.col("pos") % 5 == 0) & (F.col("n_letters") > 1), F.expr("substring(name, 1, n_letters - 1)")).otherwise(F.col("name"))

    def row(side, e_type, e_name):
        return F.struct(F.lit(side).alias("side"), e_type.alias("e_type"), e_name.alias("e_name"))

    gold, pred = row("gold", etype, F.col("name")), row("pred", ptype, pname)
    is_gold, is_pred = F.col("pos") % 3 != 0, F.col("pos") % 4 != 0
    rows = F.when(is_gold & is_pred, F.array(gold, pred)).when(is_gold, F.array(gold)).when(is_pred, F.array(pred))
    x = w.filter(is_gold | is_pred).select("doc_id", "pos", F.explode(rows).alias("x"))
    return x.select("doc_id", "x.side", "pos", "x.e_type", "x.e_name")


# --- DuckDB forms of the same derivations -------------------------------------------------

WORDS_SQL = r"""
words AS (
  SELECT doc_id, pos, name, length(name) AS n_letters FROM (
    SELECT doc_id, generate_subscripts(arr, 1) - 1 AS pos,
           lower(regexp_replace(unnest(arr), '[^\p{L}]', '', 'g')) AS name
    FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS arr FROM documents))
  WHERE length(name) >= 1)"""

_TYPE_SQL = "(['DNA','RNA','protein','cell_type','cell_line'])[n_letters % 5 + 1]"


def gp_sql(foreign_every: int = 0) -> str:
    ptype = _TYPE_SQL
    if foreign_every:
        ptype = f"CASE WHEN pos % {foreign_every} = 0 THEN 'gene' ELSE {_TYPE_SQL} END"
    return WORDS_SQL + f""",
ents AS (
  SELECT doc_id, 'gold' AS side, pos, {_TYPE_SQL} AS e_type, name AS e_name FROM words WHERE pos % 3 <> 0
  UNION ALL
  SELECT doc_id, 'pred' AS side, pos, {ptype} AS e_type,
         CASE WHEN pos % 5 = 0 AND n_letters > 1 THEN substring(name, 1, n_letters - 1) ELSE name END AS e_name
  FROM words WHERE pos % 4 <> 0)"""


def gp_arrays(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """GP as per-document arrays (doc_id, seq, gold, pred), computed on each row of
    ``documents``, or of ``docs``, with array functions (no shuffle).  Each entity is
    struct<e_type, e_name>; order is word position.  Same rules as ``gp_entities``; a text
    is cleaned as a whole, each run of whitespace being one line end until it is split."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    d = docs.select("doc_id", F.col("text").alias("seq"), F.split(clean_lines("text"), "\n").alias("_w"))
    kept = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("pos"), w.alias("name"))), lambda x: F.length(x["name"]) >= 1)
    d = d.select("doc_id", "seq", kept.alias("_k"))
    types = F.array(*[F.lit(t) for t in ENTITY_TYPES])

    def etype(x):
        return F.element_at(types, (F.length(x["name"]) % 5 + 1).cast("int"))

    gold = F.transform(F.filter("_k", lambda x: x["pos"] % 3 != 0),
                       lambda x: F.struct(etype(x).alias("e_type"), x["name"].alias("e_name")))
    pred = F.transform(F.filter("_k", lambda x: x["pos"] % 4 != 0),
                       lambda x: F.struct(etype(x).alias("e_type"),
                                          F.when((x["pos"] % 5 == 0) & (F.length(x["name"]) > 1), F.substring(x["name"], F.lit(1), F.length(x["name"]) - 1))
                                          .otherwise(x["name"]).alias("e_name")))
    return d.select("doc_id", "seq", gold.alias("gold"), pred.alias("pred"))


def gp_arrays_sql() -> str:
    """DuckDB: CTE ``ga`` (doc_id, seq, gold, pred) on top of ``gp_sql()``."""
    empty = "[]::STRUCT(e_type VARCHAR, e_name VARCHAR)[]"
    return gp_sql() + f""",
ga AS (
  SELECT d.doc_id, d.text AS seq, coalesce(a.gold, {empty}) AS gold, coalesce(a.pred, {empty}) AS pred
  FROM documents d LEFT JOIN (
    SELECT doc_id,
           list(struct_pack(e_type := e_type, e_name := e_name) ORDER BY pos) FILTER (WHERE side = 'gold') AS gold,
           list(struct_pack(e_type := e_type, e_name := e_name) ORDER BY pos) FILTER (WHERE side = 'pred') AS pred
    FROM ents GROUP BY doc_id) a ON a.doc_id = d.doc_id)"""
