"""Sample-design renderers (G1-G7): one annotated row -> prompt/output text.

All renderers are row-level array expressions over the row's entity array, so
rendering a corpus is a map-only stage.  Name lists are single-quoted verbatim
(the reference builds them from Python list reprs; identical for names
without quotes or brackets).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types in output order, the three task descriptions, the
# dictionary example of the JSON design, and the prompt parts of every design (PROMPT_PARTS).
TYPE_ORDER = ["DNA", "RNA", "protein", "cell_type", "cell_line"]
DESCRIPTIONS = [
    "Read the given sentence carefully, identify all named entities of type \"DNA\", \"RNA\", \"protein\", "
    "\"cell_type\" or \"cell_line\".",
    "Carefully review the provided statement and detect any specific named entities that belong to the categories "
    "of \"DNA\", \"RNA\", \"protein\", \"cell_type\" or \"cell_line\"",
    "This is a nested entity recognition problem, with these entity types: \"DNA\", \"RNA\", \"protein\", "
    "\"cell_type\" or \"cell_line\". Please thoroughly examine the provided sentence and accurately identify all "
    "instances of named entities.",
]
JSON_EXAMPLE = '{"entity_type": "DNA","entity_names": ["name1", "name2"]}'
PROMPT_PARTS = {
    "default": ("[INST]{desc} Answer in the format [\"entity_type\", \"entity_name\"]. If no entity exists, then just "
                "answer \"[]\".\nGiven sentence: \"{sent}\"[/INST]"),
    "weak1": ("[INST]Given sentence: \"{sent}\"\n{desc} For each entity type, answer in the format like "
              "\"'entity_type': 'entity_name_1', 'entity_name_2'...\", then concat answer for each type with ';'. "
              "Only output entity types that contain entities.[/INST]"),
    "good1": ("[INST]{desc} For each entity type, answer in a line in the format like \"'entity_type': "
              "'entity_name_1', 'entity_name_2'...\" (when no entities exist, answer  \"'entity_type': ''\")."
              "\nGiven sentence: \"{sent}\"[/INST]"),
    "good2": ("[INST]Read the given sentence carefully, identify all named entities of type \"DNA\", \"RNA\", "
              "\"protein\", \"cell_type\" or \"cell_line\". For each entity type, answer in a line with a dictionary "
              "where the key is the entity type and value a list of entity names: '" + JSON_EXAMPLE + "' (output "
              "empty list if no entities for a certain type).\nGiven sentence: \"{sent}\"[/INST]"),
}
MODES = list(PROMPT_PARTS)


def render_prompt(mode: str, desc: Column, sent: Column) -> Column:
    """The mode's instruction template filled with description and sentence."""
    tpl = PROMPT_PARTS[mode]
    pieces: list[Column] = []
    rest = tpl
    while rest:
        i_d, i_s = rest.find("{desc}"), rest.find("{sent}")
        cands = [i for i in (i_d, i_s) if i >= 0]
        if not cands:
            pieces.append(F.lit(rest))
            break
        i = min(cands)
        if i:
            pieces.append(F.lit(rest[:i]))
        pieces.append(desc if i == i_d else sent)
        rest = rest[i + 6:]
    return F.concat(*pieces)


def group_by_type(entities: Column, type_field: str = "e_type", name_field: str = "e_name") -> Column:
    """G1: array<struct<type, names>> in TYPE_ORDER, names in entity order."""
    return F.transform(F.array(*[F.lit(t) for t in TYPE_ORDER]),
                       lambda t: F.struct(t.alias("type"),
                                          F.transform(F.filter(entities, lambda e: e[type_field] == t),
                                                      lambda e: e[name_field]).alias("names")))


def _quoted(names: Column) -> Column:
    """Names in single quotes, joined at once; null names are left out, no list gives null."""
    return F.when(F.exists(names, lambda n: n.isNotNull()),
                  F.concat(F.lit("'"), F.array_join(names, "', '"), F.lit("'"))).when(names.isNotNull(), F.lit(""))


def json_string(s: Column) -> Column:
    """A JSON string literal for s (quotes, backslashes and control characters escaped)."""
    listed = F.to_json(F.array(s))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_strings(names: Column) -> Column:
    """The JSON list of ``names`` with ', ' between them.  ``","`` in the list's text is the end
    of a name and the begin of the next, but for a name that is a comma: then each is written alone."""
    alone = F.concat(F.lit("["), F.array_join(F.transform(names, json_string), ", "), F.lit("]"))
    return F.when(F.array_contains(names, F.lit(",")) == F.lit(False),
                  F.replace(F.to_json(names), F.lit('","'), F.lit('", "'))).otherwise(alone)


def render_default(entities: Column) -> Column:
    """One ["type","name"] line per entity; '' without entities."""
    return F.array_join(F.transform(entities, lambda e: F.concat(F.lit('["'), e["e_type"], F.lit('","'),
                                                                 e["e_name"], F.lit('"]'))), "\n")


def render_weak1(groups: Column) -> Column:
    """G3: "'type': 'n1', 'n2'" for mentioned types only, joined by '; '."""
    return F.array_join(F.transform(F.filter(groups, lambda g: F.size(g["names"]) > 0),
                                    lambda g: F.concat(F.lit("'"), g["type"], F.lit("': "), _quoted(g["names"]))), "; ")


def render_good1(groups: Column) -> Column:
    """One line per type always; a type without names renders "''"."""
    return F.array_join(F.transform(groups, lambda g: F.concat(
        F.lit("'"), g["type"], F.lit("': "),
        F.when(F.size(g["names"]) == 0, F.lit("''")).otherwise(_quoted(g["names"])))), "\n")


def render_good2(groups: Column) -> Column:
    """One JSON object per type per line (json.dumps separators, UTF-8 kept)."""
    return F.array_join(F.transform(groups, lambda g: F.concat(
        F.lit('{"entity_type": '), json_string(g["type"]), F.lit(', "entity_names": '),
        json_strings(g["names"]), F.lit("}"))), "\n")


def render_output(mode: str, entities: Column, groups: Column | None = None) -> Column:
    """``groups``: :func:`group_by_type` of ``entities``, where it is a column already."""
    if mode == "default":
        return render_default(entities)
    return {"weak1": render_weak1, "good1": render_good1, "good2": render_good2}[mode](group_by_type(entities) if groups is None else groups)
