"""q26: bracket-list scanning of free-form model responses.

Responses are rendered from the GP gold lists in four styles (by doc_id % 4):
single-quoted lists (their items padded where doc_id % 8 = 0, behind a bracket
that spans two lines), parenthesised lists, lists after a chain-of-thought
'answer:' marker, and double-quoted lists inside a JSON object."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.designs import group_by_type
from promptloom.operators.parse_ner import entities_from_lists, unparsable
from promptloom.operators.prep import after_last_marker
from promptloom.plans.designs import _GROUPS
from promptloom.plans.derive import gp_arrays, gp_arrays_sql
from promptloom.plans.registry import ORACLES, register

COT_PREFIX = "Reasoning [draft] answer: [x] then answer: "


def responses(spark, sf_dir):
    ga = gp_arrays(spark, sf_dir)
    groups = F.filter(group_by_type(F.col("gold")), lambda g: F.size(g["names"]) > 0)
    single = F.array_join(F.transform(groups, lambda g: F.concat(
        F.lit("['"), g["type"], F.lit("', '"), F.array_join(g["names"], "', '"), F.lit("']"))), ", ")
    double = F.array_join(F.transform(groups, lambda g: F.concat(
        F.lit('["'), g["type"], F.lit('", "'), F.array_join(g["names"], '", "'), F.lit('"]'))), ", ")
    style = F.col("doc_id") % 4
    padded = F.concat(F.lit("[broken\n'x', 'y'] "), F.replace(F.replace(single, F.lit("['"), F.lit("[' ")), F.lit("']"), F.lit(" ']")))
    resp = (F.when(F.col("doc_id") % 8 == 0, padded).when(style == 0, single)
            .when(style == 1, F.translate(single, "[]", "()"))
            .when(style == 2, F.concat(F.lit(COT_PREFIX), single))
            .otherwise(F.to_json(F.struct(double.alias("answer")))))
    return ga.select("doc_id", resp.alias("response"))


def _answer():
    return after_last_marker(F.coalesce(F.get_json_object("response", "$.answer"), F.col("response")))


def q26(spark, sf_dir):
    r = responses(spark, sf_dir)
    text = _answer()
    ents = entities_from_lists(r.select("doc_id", text.alias("answer")), ["doc_id"], "answer")
    return ents.select("doc_id", F.col("span_pos").cast("long").alias("span_pos"),
                       F.col("name_pos").cast("long").alias("name_pos"), "e_type", "e_name")


_QUOTED = r"""(regexp_matches(it, '^''.*''$') OR regexp_matches(it, '^".*"$'))"""

register("q26_bracket_scan", oracle=f"""WITH {gp_arrays_sql()},
g AS (SELECT doc_id, list_filter({_GROUPS}, lambda x: len(x.names) > 0) AS groups FROM ga),
s AS (SELECT doc_id,
        array_to_string(list_transform(groups, lambda x: '[''' || x.type || ''', ''' || array_to_string(x.names, ''', ''') || ''']'), ', ') AS single,
        array_to_string(list_transform(groups, lambda x: '["' || x.type || '", "' || array_to_string(x.names, '", "') || '"]'), ', ') AS dbl
      FROM g),
r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN '[broken' || chr(10) || '''x'', ''y''] '
                      || replace(replace(single, '[''', '['' '), ''']', ' '']') ELSE single END WHEN 1 THEN translate(single, '[]', '()')
                      WHEN 2 THEN '{COT_PREFIX}' || single ELSE to_json(struct_pack(answer := dbl))::VARCHAR END AS response FROM s),
a AS (SELECT doc_id, CASE WHEN json_valid(response) AND json_extract_string(response, '$.answer') IS NOT NULL
                          THEN json_extract_string(response, '$.answer') ELSE response END AS t FROM r),
b AS (SELECT doc_id, translate(regexp_replace(string_split(t, 'answer:')[-1], '^\\s+|\\s+$', '', 'g'), '()', '[]') AS t FROM a),
sp AS (SELECT doc_id, generate_subscripts(spans, 1) - 1 AS span_pos, unnest(spans) AS span
       FROM (SELECT doc_id, regexp_extract_all(t, '\\[[^\\[\\]\\n]*\\]') AS spans FROM b)),
it AS (SELECT doc_id, span_pos, string_split(span[2:-2], ', ') AS items FROM sp),
ok AS (SELECT * FROM it WHERE len(items) >= 2 AND len(list_filter(items, lambda it: NOT {_QUOTED})) = 0)
SELECT doc_id, CAST(span_pos AS BIGINT) AS span_pos, CAST(generate_subscripts(names, 1) - 1 AS BIGINT) AS name_pos,
       e_type, unnest(names) AS e_name
FROM (SELECT doc_id, span_pos, trim(items[1][2:-2]) AS e_type, list_transform(items[2:], lambda it: trim(it[2:-2])) AS names FROM ok)""")(q26)


def q58(spark, sf_dir):
    """Responses that are not '[]' but hold no entity; every tenth document
    answers '[]' and every tenth has no list at all."""
    kind = F.col("doc_id") % 10
    text = F.when(kind == 0, F.lit(' "[]" ')).when(kind == 1, F.lit("there is no entity (none)")).otherwise(_answer())
    return responses(spark, sf_dir).select("doc_id", unparsable(text).alias("unparsable"))


register("q58_unparsable", oracle=f"""WITH e AS ({ORACLES['q26_bracket_scan']})
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN false WHEN 1 THEN true ELSE doc_id NOT IN (SELECT doc_id FROM e) END AS unparsable
FROM documents""")(q58)
