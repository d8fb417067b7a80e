"""Event-extraction output parsers (X9-X15) and event matching.

Each parser turns one output text into rows (key..., pos, e_type, trigger)
with a per-row explode; format-error and empty flags are computed on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.columns import py_strip

# The ten event types, numbered in this order by the numerical design.
EVENT_TYPES = ["Catastrophe", "Attack", "Hostile_encounter", "Causation", "Process_start", "Competition",
               "Motion", "Social_event", "Killing", "Conquering"]
FORMATS = ["ou", "heuristic", "numerical", "lines", "json"]

_ROW = "struct<ok:boolean,items:array<struct<e_type:string,trigger:string>>>"


def _norm(c: Column) -> Column:
    return F.lower(py_strip(c))


def _pair(t: Column, g: Column) -> Column:
    return F.struct(t.alias("e_type"), g.alias("trigger"))


def _units(text: Column, sep: str) -> Column:
    return F.split(text, sep)


def parse_ou(text: Column) -> Column:
    """X9 'type:t1,t2;type:…'; a piece without ':' is (piece, '')."""
    def one(p):
        items = F.split(p, ":")
        t = F.get(items, 0)
        trig = F.split(F.coalesce(F.get(items, 1), F.lit("")), ",")
        return F.when(F.size(items) == 1, F.array(_pair(_norm(t), F.lit("")))).otherwise(
            F.transform(trig, lambda g: _pair(_norm(t), _norm(g))))
    return F.flatten(F.transform(_units(text, ";"), one))


def _literal_list(line: Column) -> Column:
    s = py_strip(line)
    s = F.regexp_replace(s, r"^\((.*)\)$", "[$1]")
    return F.from_json(s, "array<string>", {"allowSingleQuotes": "true"})


#: Between the items of a list that is no (type, trigger) pair; no text holds it.
ITEM_MARK = "\x1f"


def parse_heuristic(text: Column, strip_items: bool = True) -> Column:
    """One literal list per line; an unparsable or empty line is ignored.
    A list of other than two items keeps them all (marked in the trigger), so it
    equals no pair.  Each line is parsed once (first transform), then reshaped."""
    empty = F.array().cast("array<struct<e_type:string,trigger:string>>")

    def one(arr):
        items = F.transform(arr, lambda x: _norm(x) if strip_items else F.lower(x))
        rest = F.concat(F.lit(ITEM_MARK), F.array_join(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1))), ITEM_MARK))
        trigger = F.when(F.size(items) == 2, F.get(items, 1)).otherwise(rest)
        return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array(_pair(F.get(items, 0), trigger))).otherwise(empty)
    return F.flatten(F.transform(F.transform(_units(text, "\n"), _literal_list), one))


def parse_numerical(text: Column) -> tuple[Column, Column]:
    """X11 'id:t1,t2;…' with id -> type; 'NONE' triggers dropped; an unknown id
    or a piece without ':' is a format error and adds nothing."""
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])

    def one(p):
        items = F.split(p, ":")
        idx = F.get(items, 0).try_cast("int")
        t = F.when((idx >= 0) & (idx < len(EVENT_TYPES)), F.element_at(types, idx + 1))
        ok = t.isNotNull() & (F.size(items) >= 2)
        trig = F.filter(F.split(F.coalesce(F.get(items, 1), F.lit("")), ","), lambda g: py_strip(g) != "NONE")
        return F.struct(ok.alias("ok"), F.when(ok, F.transform(trig, lambda g: _pair(_norm(t), _norm(g))))
                        .otherwise(F.array().cast("array<struct<e_type:string,trigger:string>>")).alias("items"))
    rows = F.transform(_units(text, ";"), one)
    return F.flatten(F.transform(rows, lambda r: r["items"])), F.exists(rows, lambda r: ~r["ok"])


def parse_lines(text: Column) -> Column:
    """X12 'type: t1,t2' per line; 'NONE' line skipped; no ':' -> (line, '')."""
    def one(p):
        items = F.split(p, ":")
        t = py_strip(F.get(items, 0))
        trig = py_strip(F.coalesce(F.get(items, 1), F.lit("")))
        return (F.when(F.size(items) == 1, F.array(_pair(_norm(F.get(items, 0)), F.lit(""))))
                .when(trig == "NONE", F.array().cast("array<struct<e_type:string,trigger:string>>"))
                .otherwise(F.transform(F.split(trig, ","), lambda g: _pair(_norm(t), _norm(g)))))
    return F.flatten(F.transform(_units(text, "\n"), one))


_JSON_EV = "struct<event_type:string,`trigger word`:string>"


def parse_json(text: Column) -> tuple[Column, Column]:
    """X13 one {"event_type", "trigger word"} object per line; a string trigger
    is split on ',' and a list taken as it is; [] adds nothing.  A line that is not
    one such object from its first to its last character is a format error, and so is
    a trigger that is neither string nor list.  A string that only begins like a
    list is split on ',' like any other; items are never null.  Each line is
    parsed once (first transform), as the only item of an array: what follows
    the object breaks the array."""
    empty = F.array().cast("array<struct<e_type:string,trigger:string>>")

    def parse_line(line):
        s = py_strip(line)
        objects = F.from_json(F.concat(F.lit("["), s, F.lit("]")), f"array<{_JSON_EV}>", {"allowSingleQuotes": "true"})
        kind = F.regexp_extract(s, r"""['"]trigger word['"]\s*:\s*(.)""", 1)
        return F.struct((s.startswith("{") & (F.size(objects) == 1)).alias("single"), F.get(objects, 0).alias("j"), kind.alias("kind"))

    def one(x):
        j = x["j"]
        listed = x["kind"] == "["
        ok = F.coalesce(x["single"] & (listed | x["kind"].isin("'", '"')) & j["event_type"].isNotNull()
                        & j["trigger word"].isNotNull(), F.lit(False))
        raw = j["trigger word"]
        items = F.when(listed, F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})).otherwise(F.split(py_strip(raw), ","))
        trig = F.transform(items, lambda g: F.coalesce(g, F.lit("")))
        t = _norm(j["event_type"])
        return F.struct(ok.alias("ok"), F.when(ok, F.transform(trig, lambda g: _pair(t, _norm(g))))
                        .otherwise(empty).alias("items"))
    rows = F.transform(F.transform(_units(text, "\n"), parse_line), one)
    return F.flatten(F.transform(rows, lambda r: r["items"])), F.exists(rows, lambda r: ~r["ok"])


def parse_events(text: Column, fmt: str) -> Column:
    """struct<items, format_error int, empty int> for one output format."""
    bad = F.lit(False)
    if fmt == "ou":
        items = parse_ou(text)
    elif fmt == "heuristic":
        items = parse_heuristic(text)
    elif fmt == "numerical":
        items, bad = parse_numerical(text)
    elif fmt == "lines":
        items = parse_lines(text)
    elif fmt == "json":
        items, bad = parse_json(text)
    else:
        raise ValueError(fmt)
    empty = text == ""
    return F.struct(F.when(empty, F.array().cast("array<struct<e_type:string,trigger:string>>"))
                    .otherwise(items).alias("items"),
                    (empty | bad).cast("int").alias("format_error"), empty.cast("int").alias("empty"))


def event_outcomes(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """M6 + A6 (reference semantics): per sample, tp = distinct predicted tuples
    found in the gold list, fp = raw #pred - tp, fn = #gold - tp."""
    p = pred.select(*keys, "e_type", "trigger", F.lit(1).alias("_p"), F.lit(0).alias("_g"))
    g = gold.select(*keys, "e_type", "trigger", F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    c = p.unionByName(g).groupBy(*keys, "e_type", "trigger").agg(F.sum("_p").alias("n_pred"), F.sum("_g").alias("n_gold"))
    c = c.withColumn("tp", ((F.col("n_pred") > 0) & (F.col("n_gold") > 0)).cast("long"))
    return c.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
