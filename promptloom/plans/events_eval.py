"""Event-extraction evaluation over ``events`` (q34, q35).

Every event row is one sample.  Its gold tuples are (TYPES[k % 10], event_type)
and (TYPES[(k + user_id) % 10], 'u' + user_id), k = props.k, rendered as the
heuristic list-per-line output.  The prediction follows event_id % 6: 0 exact,
1 a repeated tuple, 2 a near-miss trigger (+'s'; in the json design it begins
with '['), 3 empty output, 4 a missing tuple (in the heuristic design the other
one has a third item), 5 an extra tuple (malformed in the json design, an unknown id in the
numerical design).  In the json design kind 4 has a further line that is a format
error or a list of triggers.  Predictions are rendered in five designs and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.parse_events import EVENT_TYPES, FORMATS, event_outcomes, parse_events, parse_heuristic
from promptloom.plans.registry import register
from promptloom.session import materialize
from promptloom.plans.sqlutil import lit
from promptloom.sources.tables import table


def _tuples(spark, sf_dir):
    # parsing costs far more than reading, and the files of a narrow table are read by few
    # tasks: events are dealt over the session's
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    ev = ev.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    at = lambda i: F.element_at(types, (i % 10 + 1).cast("int"))

    def tup(t, g, tidx, broken=False):
        return F.struct(t.alias("t"), g.alias("g"), tidx.cast("int").alias("tidx"), F.lit(broken).alias("broken"))

    k, u = F.col("k"), F.col("user_id")
    t1 = tup(at(k), F.col("event_type"), k % 10)
    t2 = tup(at(k + u), F.concat(F.lit("u"), u.cast("string")), (k + u) % 10)
    near = tup(at(k), F.concat(F.col("event_type"), F.lit("s")), k % 10)
    extra = tup(at(k + 3), F.concat(F.lit("x"), F.col("event_id").cast("string")), F.lit(99), True)
    r = F.col("event_id") % 6
    pred = (F.when(r == 0, F.array(t1, t2)).when(r == 1, F.array(t1, t1, t2)).when(r == 2, F.array(near, t2))
            .when(r == 3, F.array().cast("array<struct<t:string,g:string,tidx:int,broken:boolean>>"))
            .when(r == 4, F.array(t1)).otherwise(F.array(t1, t2, extra)))
    return ev.select("event_id", F.array(t1, t2).alias("gold_t"), pred.alias("pred_t"))


#: Further lines of the json design: nothing, triggers that are no text, more after the object, a list.
ODD_LINES = ["", '5}', 'true}', '"b"} tail}', '["p", "q"]}']


def _render(arr, fmt, kind=None, odd=None):
    """``kind`` (event_id % 6) adds the faults that only one design shows, ``odd`` the
    json design's further line."""
    kind = F.lit(0) if kind is None else kind
    if fmt == "ou":
        return F.array_join(F.transform(arr, lambda x: F.concat(x["t"], F.lit(":"), x["g"])), ";")
    if fmt == "heuristic":
        third = F.when(kind == 4, F.lit("', 'raid")).otherwise(F.lit(""))
        return F.array_join(F.transform(arr, lambda x: F.concat(F.lit("['"), x["t"], F.lit("', '"), x["g"], third, F.lit("']"))), "\n")
    if fmt == "numerical":
        return F.array_join(F.transform(arr, lambda x: F.concat(x["tidx"].cast("string"), F.lit(":"), x["g"])), ";")
    if fmt == "lines":
        return F.array_join(F.transform(arr, lambda x: F.concat(x["t"], F.lit(": "), x["g"])), "\n")
    if fmt == "json":
        line = F.lit("")
        for i, x in enumerate(ODD_LINES[1:], 1):
            line = F.when((kind == 4) & (odd == i), F.concat(F.lit('\n{"event_type": "Attack", "trigger word": '), F.lit(x))).otherwise(line)
        return F.concat(F.array_join(F.transform(arr, lambda x: F.concat(
            F.lit('{"event_type": "'), x["t"], F.lit('", "trigger word": "'),
            F.when((kind == 2) & x["g"].endswith("s"), F.lit("[")).otherwise(F.lit("")), x["g"],
            F.when(x["broken"], F.lit('"')).otherwise(F.lit('"}')))), "\n"), line)
    raise ValueError(fmt)


def parsed_events(spark, sf_dir):
    """(format, event_id, gold, parsed struct) for all designs.  Each design is
    rendered and parsed in its own branch (small generated code per branch)."""
    t = _tuples(spark, sf_dir)
    out = None
    for f in FORMATS:
        x = t.select(F.lit(f).alias("format"), "event_id",
                     _render(F.col("gold_t"), "heuristic").alias("output"),
                     _render(F.col("pred_t"), f, F.col("event_id") % 6, F.floor(F.col("event_id") / 6) % len(ODD_LINES)).alias("prediction"))
        x = x.select("format", "event_id", parse_heuristic(F.col("output"), strip_items=False).alias("gold"),
                     parse_events(F.col("prediction"), f).alias("p"))
        out = x if out is None else out.unionByName(x)
    return materialize(out)


def q34(spark, sf_dir):
    """Parsed predictions per design with format-error / empty flags."""
    p = parsed_events(spark, sf_dir)
    return p.select("format", "event_id",
                    F.array_join(F.transform("p.items", lambda x: F.concat(x["e_type"], F.lit("|"), x["trigger"])), ";")
                    .alias("parsed"), F.size("p.items").cast("long").alias("n_items"),
                    F.col("p.format_error").alias("format_error"), F.col("p.empty").alias("empty"))


def q35(spark, sf_dir):
    """Per design, tp / fp / fn with the reference's event
    semantics (distinct predictions against the gold list; fp from the raw
    count), P/R/F1, format-error and empty counts and the error rate."""
    p = parsed_events(spark, sf_dir)
    keys = ["format", "event_id"]
    pred = p.select(*keys, F.explode("p.items").alias("x")).select(*keys, "x.e_type", "x.trigger")
    gold = p.select(*keys, F.explode("gold").alias("x")).select(*keys, "x.e_type", "x.trigger")
    out = event_outcomes(pred, gold, keys).groupBy("format").agg(
        F.sum("tp").cast("long").alias("tp"), F.sum("fp").cast("long").alias("fp"), F.sum("fn").cast("long").alias("fn"))
    flags = p.groupBy("format").agg(F.count(F.lit(1)).alias("n_samples"),
                                    F.sum("p.format_error").cast("long").alias("n_format_error"),
                                    F.sum("p.empty").cast("long").alias("n_empty"))
    j = flags.join(out, "format", "left").fillna(0, ["tp", "fp", "fn"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("format", "n_samples", "n_format_error", "n_empty",
                    F.round(F.col("n_format_error") / F.col("n_samples"), 4).alias("error_rate"),
                    "tp", "fp", "fn", F.round(prec, 7).alias("precision"), F.round(rec, 7).alias("recall"),
                    F.round(f1, 7).alias("f1"))


_TY = "[" + ", ".join(lit(t) for t in EVENT_TYPES) + "]"
EVENTS_SQL = f"""
ev AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
tt AS (SELECT event_id,
  {{'t': lower({_TY}[k % 10 + 1]), 'g': lower(event_type)}} AS t1,
  {{'t': lower({_TY}[(k + user_id) % 10 + 1]), 'g': 'u' || user_id}} AS t2,
  {{'t': lower({_TY}[k % 10 + 1]), 'g': lower(event_type) || 's'}} AS nr,
  {{'t': lower({_TY}[(k + 3) % 10 + 1]), 'g': 'x' || event_id}} AS ex FROM ev),
fm AS (SELECT * FROM (VALUES {", ".join(f"('{f}')" for f in FORMATS)}) f(format)),
pe AS (
  SELECT fm.format, tt.event_id, [t1, t2] AS gold,
    CASE event_id % 6 WHEN 0 THEN [t1, t2] WHEN 1 THEN [t1, t1, t2] WHEN 2 THEN CASE WHEN format = 'json' THEN [{{'t': nr.t, 'g': '[' || nr.g}}, t2] ELSE [nr, t2] END WHEN 3 THEN []
         WHEN 4 THEN CASE WHEN format = 'heuristic' THEN [{{'t': t1.t, 'g': chr(31) || t1.g || chr(31) || 'raid'}}]
              WHEN format = 'json' AND (event_id // 6) % 5 = 4 THEN [t1, {{'t': 'attack', 'g': 'p'}}, {{'t': 'attack', 'g': 'q'}}] ELSE [t1] END ELSE CASE WHEN format IN ('json', 'numerical') THEN [t1, t2] ELSE [t1, t2, ex] END END AS pred,
    CASE WHEN event_id % 6 = 3 THEN 1 WHEN event_id % 6 = 5 AND format IN ('json', 'numerical') THEN 1
         WHEN event_id % 6 = 4 AND format = 'json' AND (event_id // 6) % 5 IN (1, 2, 3) THEN 1 ELSE 0 END AS format_error,
    CASE WHEN event_id % 6 = 3 THEN 1 ELSE 0 END AS empty
  FROM tt, fm)"""

register("q34_event_parse", oracle=f"""WITH {EVENTS_SQL}
SELECT format, event_id, array_to_string(list_transform(pred, lambda x: x.t || '|' || x.g), ';') AS parsed,
       len(pred) AS n_items, format_error, empty FROM pe""")(q34)

register("q35_event_match", oracle=f"""WITH {EVENTS_SQL},
o AS (SELECT format, event_id, format_error, empty,
             len(list_filter(list_distinct(pred), lambda x: list_contains(gold, x))) AS tp, len(pred) AS np, len(gold) AS ng FROM pe),
s AS (SELECT format, count(*) AS n_samples, CAST(sum(format_error) AS BIGINT) AS n_format_error, CAST(sum(empty) AS BIGINT) AS n_empty,
             CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(ng - tp) AS BIGINT) AS fn FROM o GROUP BY format)
SELECT format, n_samples, n_format_error, n_empty, round(n_format_error / n_samples, 4) AS error_rate, tp, fp, fn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 7) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 7) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0 END, 7) AS f1
FROM s""")(q35)
