"""Soft-match queries (q36 NER, q37 events).  The similarity is Python's
difflib ratio.  The oracles compute it in SQL by recursion on the longest
common block: q37's for all pairs of a sample, q36's for the distinct pairs whose
lengths and character counts leave a chance to beat a containing name."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions.columns import pick
from promptloom.functions.similarity import soften_triggers_udf
from promptloom.operators.match import casefold, multiset_outcome, nested_outcome
from promptloom.operators.metrics import micro_prf
from promptloom.operators.soft_match import changed_names, soften_codes
from promptloom.plans.derive import gp_entities, gp_sql, text_tasks
from promptloom.plans.events_eval import EVENTS_SQL, parsed_events
from promptloom.plans.ner_eval import STRICT_BOUNDARIES, _prf_sql
from promptloom.plans.registry import register
from promptloom.session import materialize
from promptloom.sources.tables import table


#: Bytes of text up to which a sample is matched in its own task.
LONG_TEXT = 1 << 18


def entity_counts(ents):
    """(doc_id, e_type, e_name) with the multiplicities of both sides and the
    name's first place among the gold entities."""
    gold = F.col("side") == "gold"
    return casefold(ents).groupBy("doc_id", "e_type", "e_name").agg(
        F.count_if(gold).alias("n_gold"), F.count_if(~gold).alias("n_pred"), F.min(F.when(gold, F.col("pos"))).alias("gidx"))


def soft_counts(counts):
    """``counts`` with predicted names softened (M4)."""
    pred, gold = counts.filter("n_pred > 0"), counts.filter("n_gold > 0")
    changed = changed_names(gold.select("doc_id", "gidx", F.col("e_name").alias("name")),
                            pred.select("doc_id", F.col("e_name").alias("name")), "doc_id")
    p = pred.join(changed.withColumnRenamed("name", "e_name"), ["doc_id", "e_name"], "left")
    return gold.select("doc_id", "e_type", "e_name", "n_gold", F.lit(0).cast("long").alias("n_pred")).unionByName(
        p.select("doc_id", "e_type", F.coalesce("soft_name", "e_name").alias("e_name"), F.lit(0).cast("long").alias("n_gold"), "n_pred"))


def outcomes(spark, sf_dir, modes=("hard", "soft")):
    """Strict and boundaries totals (mode, match, tp, fp, fn) of GP, hard and soft, or of one of these ``modes``.

    Samples of up to LONG_TEXT bytes are counted and softened where their texts were dealt
    to; longer ones, if there are any, are stored as counts and softened over many tasks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.sum(F.octet_length("text").cast("long"))
    long = materialize(docs.groupBy("doc_id").agg(size.alias("n")).filter(F.col("n") > LONG_TEXT).select("doc_id"), "long-samples")
    some, tasks = not long.isEmpty(), text_tasks(docs)
    short = entity_counts(gp_entities(spark, sf_dir, docs=docs.join(long, "doc_id", "left_anti") if some else docs, tasks=tasks))
    # Spark does not know that rows still lie by sample when they come back: dealt again, once, as numbers
    rows = soften_codes(short, "doc_id").select("doc_id", "e_type", "n_gold", "n_pred", *modes).repartition(tasks, "doc_id")
    rows = rows.select("doc_id", "e_type", "n_gold", "n_pred", F.posexplode(F.array(*modes)).alias("mode", "e_name"))
    out = _outcome(rows).withColumn("mode", pick(modes, F.col("mode")))
    if some:
        counts = materialize(entity_counts(gp_entities(spark, sf_dir, docs=docs.join(long, "doc_id", "left_semi"))))
        for mode in modes:
            c = counts.drop("gidx") if mode == "hard" else soft_counts(counts)
            out = out.unionByName(_outcome(c.withColumn("mode", F.lit(mode))))
    return out


def _outcome(rows):
    return nested_outcome(rows, "doc_id", STRICT_BOUNDARIES, F.sum("n_gold"), F.sum("n_pred"), by=("mode",))


def q36(spark, sf_dir):
    """M4 + A2 (soft half): strict and boundaries micro P/R/F1 after soft
    replacement of predicted names."""
    return micro_prf(outcomes(spark, sf_dir, ("soft",)), ["match"])


def q37(spark, sf_dir):
    """M5 + M6 + A6 (soft, reference semantics): predictions deduplicated, then
    each trigger replaced by the most similar gold trigger of its own sample
    (ratio > 0.5), then counted if present in the gold list."""
    p = parsed_events(spark, sf_dir)
    items = F.col("p.items")
    uniq = F.array_distinct(items)
    soft_trig = soften_triggers_udf(F.transform(uniq, lambda x: x["trigger"]),
                                    F.transform(F.col("gold"), lambda x: x["trigger"]))
    x = p.select("format", "gold", F.size(items).alias("n_pred"), uniq.alias("u"), soft_trig.alias("st"))
    soft = F.transform(F.arrays_zip(F.col("u").alias("u"), F.col("st").alias("t")),
                       lambda z: F.struct(z["u"]["e_type"].alias("e_type"), z["t"].alias("trigger")))
    tp = F.size(F.filter(soft, lambda s: F.array_contains(F.col("gold"), s)))
    per = x.select("format", tp.alias("tp"), (F.col("n_pred") - tp).alias("fp"), (F.size("gold") - tp).alias("fn"))
    return micro_prf(per, ["format"], scale=7)


# The longest common block of p[alo:ahi] and g[blo:bhi], the first in p and then in g of equals.
_BLOCK = """list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: struct_pack(
  k := coalesce(list_max(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: substr(p, i, k) = substr(g, j, k))), 0),
  ni := -i, nj := -j)))))"""

RATIO_SQL = f"""
blocks AS (
  SELECT p, g, alo, ahi, blo, bhi, {_BLOCK} AS m
  FROM (SELECT p, g, CAST(1 AS BIGINT) AS alo, length(p) + 1 AS ahi, CAST(1 AS BIGINT) AS blo, length(g) + 1 AS bhi FROM pr)
  WHERE ahi > alo AND bhi > blo
  UNION ALL  -- the same to the left and to the right of the block
  SELECT p, g, alo, ahi, blo, bhi, {_BLOCK} AS m
  FROM (SELECT p, g, c.alo AS alo, c.ahi AS ahi, c.blo AS blo, c.bhi AS bhi
        FROM (SELECT p, g, unnest([struct_pack(alo := alo, ahi := -m.ni, blo := blo, bhi := -m.nj),
                                   struct_pack(alo := m.k - m.ni, ahi := ahi, blo := m.k - m.nj, bhi := bhi)]) AS c
              FROM blocks WHERE m.k > 0))
  WHERE ahi > alo AND bhi > blo),
ratios AS (SELECT pr.p, pr.g, CASE WHEN pr.p = pr.g THEN 1.0 ELSE 2.0 * coalesce(sum(b.m.k), 0) / (length(pr.p) + length(pr.g)) END AS r
           FROM pr LEFT JOIN blocks b ON b.p = pr.p AND b.g = pr.g GROUP BY pr.p, pr.g)"""

_SOFT_SQL = "WITH RECURSIVE " + gp_sql() + f""",
e AS (SELECT doc_id, side, pos, lower(e_type) AS t, e_name AS n FROM ents),
g AS (SELECT doc_id, n AS g, min(pos) AS gi FROM e WHERE side = 'gold' GROUP BY ALL),
rest AS (SELECT DISTINCT doc_id, n AS p FROM e WHERE side = 'pred' AND (doc_id, n) NOT IN (SELECT doc_id, g FROM g)),
best AS (  -- the best containing name and its ratio
  SELECT doc_id, p, arg_max(struct_pack(g := g, gi := gi, rc := rc), struct_pack(rc := rc, n := -gi)) AS b
  FROM (SELECT doc_id, p, g, gi, 2::DOUBLE * least(length(p), length(g)) / (length(p) + length(g)) AS rc FROM rest JOIN g USING (doc_id)
        WHERE 3 * least(length(p), length(g)) > greatest(length(p), length(g)) AND (contains(p, g) OR contains(g, p))) GROUP BY doc_id, p),
nm AS (SELECT p AS n FROM rest UNION SELECT g FROM g),
tk AS (  -- characters numbered by occurrence
  SELECT n, list_transform(range(1, length(n) + 1), lambda i: substr(n, i, 1) || (i - length(replace(substr(n, 1, i), substr(n, i, 1), '')))::VARCHAR) AS k FROM nm),
near AS (
  SELECT best.doc_id, best.p, g.g, g.gi, best.b.rc AS rc, best.b.gi AS bgi FROM best JOIN g USING (doc_id)
  WHERE 2::DOUBLE * least(length(p), length(g.g)) / (length(p) + length(g.g)) >= best.b.rc AND NOT contains(p, g.g) AND NOT contains(g.g, p)),
rival AS (
  SELECT * FROM (SELECT near.*, 2::DOUBLE * len(list_intersect(x.k, y.k)) / (length(p) + length(g)) AS q FROM near JOIN tk x ON x.n = p JOIN tk y ON y.n = g)
  WHERE q > rc OR (q = rc AND gi < bgi)),
pr AS (SELECT DISTINCT p, g FROM rival),{RATIO_SQL},
beaten AS (SELECT DISTINCT doc_id, p FROM rival JOIN ratios USING (p, g) WHERE r > rc OR (r = rc AND gi < bgi)),
soft AS (SELECT doc_id, p, b.g AS s FROM best WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM beaten)),
hard_pairs AS (SELECT doc_id, t, n, side = 'gold' AS is_gold FROM e),
soft_pairs AS (SELECT e.doc_id, t, CASE WHEN side = 'pred' THEN coalesce(s, n) ELSE n END AS n, side = 'gold' AS is_gold
               FROM e LEFT JOIN soft ON soft.doc_id = e.doc_id AND soft.p = e.n),"""


def _scores_sql(pairs: str) -> str:
    return f"""SELECT match, {_prf_sql()} FROM (
  SELECT match, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn
  FROM (SELECT 'strict' AS match, count(*) FILTER (WHERE is_gold) AS g, count(*) FILTER (WHERE NOT is_gold) AS p FROM {pairs} GROUP BY doc_id, t, n
        UNION ALL SELECT 'boundaries', count(*) FILTER (WHERE is_gold), count(*) FILTER (WHERE NOT is_gold) FROM {pairs} GROUP BY doc_id, n)
  GROUP BY match)"""


register("q36_soft_match_ner", oracle=_SOFT_SQL + f" q AS ({_scores_sql('soft_pairs')}) SELECT * FROM q")(q36)

SCORE_TABLE_SQL = _SOFT_SQL + f""" q AS (SELECT 'hard' AS mode, * FROM ({_scores_sql('hard_pairs')})
  UNION ALL SELECT 'soft', * FROM ({_scores_sql('soft_pairs')})) SELECT * FROM q"""

register("q37_soft_match_event", oracle=f"""WITH RECURSIVE {EVENTS_SQL},
u AS (SELECT format, event_id, gold, unnest(list_distinct(pred)) AS x FROM pe),
ug AS (SELECT *, generate_subscripts(gold, 1) AS at, unnest(gold) AS t FROM u),
pr AS (SELECT DISTINCT x.g AS p, t.g AS g FROM ug),{RATIO_SQL},
best AS (SELECT ug.format, ug.event_id, ug.x, any_value(ug.gold) AS gold,
                arg_max(struct_pack(r := q.r, g := ug.t.g), struct_pack(r := q.r, n := -ug.at)) AS b
         FROM ug JOIN ratios q ON q.p = ug.x.g AND q.g = ug.t.g GROUP BY ug.format, ug.event_id, ug.x),
hit AS (SELECT format, event_id, count(*) AS tp FROM best
        WHERE list_contains(gold, struct_pack(t := x.t, g := CASE WHEN b.r > 0.5 THEN b.g ELSE x.g END)) GROUP BY format, event_id),
s AS (SELECT format, CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp, CAST(sum(len(pred) - coalesce(tp, 0)) AS BIGINT) AS fp,
             CAST(sum(len(gold) - coalesce(tp, 0)) AS BIGINT) AS fn FROM pe LEFT JOIN hit USING (format, event_id) GROUP BY format)
SELECT format, {_prf_sql(7)} FROM s""")(q37)


def q59(spark, sf_dir):
    """M5 counted as multisets: every prediction is softened (repeats included),
    and a (type, trigger) pair counts min(#pred, #gold) times per sample."""
    p = parsed_events(spark, sf_dir)
    items = F.col("p.items")
    soft = soften_triggers_udf(F.transform(items, lambda x: x["trigger"]), F.transform(F.col("gold"), lambda x: x["trigger"]))
    p = p.select("format", "event_id", "gold", items.alias("items"), soft.alias("soft"))
    pairs = F.transform(F.arrays_zip(F.col("items").alias("i"), F.col("soft").alias("t")),
                        lambda z: F.struct(z["i"]["e_type"].alias("e_type"), z["t"].alias("trigger")))
    sides = [p.select("format", "event_id", F.explode(arr).alias("x"), F.lit(side).alias("side"))
             for side, arr in (("pred", pairs), ("gold", F.col("gold")))]
    rows = sides[0].unionByName(sides[1]).groupBy("format", "event_id", "x.e_type", "x.trigger").agg(
        F.count_if(F.col("side") == "gold").alias("n_gold"), F.count_if(F.col("side") == "pred").alias("n_pred"))
    return micro_prf(multiset_outcome(rows), ["format"], scale=7)


register("q59_soft_match_event_multiset", oracle=f"""WITH RECURSIVE {EVENTS_SQL},
u AS (SELECT format, event_id, gold, unnest(list_distinct(pred)) AS x FROM pe),
ug AS (SELECT *, generate_subscripts(gold, 1) AS at, unnest(gold) AS t FROM u),
pr AS (SELECT DISTINCT x.g AS p, t.g AS g FROM ug),{RATIO_SQL},
best AS (SELECT ug.format, ug.event_id, ug.x, arg_max(struct_pack(r := q.r, g := ug.t.g), struct_pack(r := q.r, n := -ug.at)) AS b
         FROM ug JOIN ratios q ON q.p = ug.x.g AND q.g = ug.t.g GROUP BY ug.format, ug.event_id, ug.x),
one AS (SELECT format, event_id, unnest(pred) AS x FROM pe),
side AS (SELECT o.format, o.event_id, o.x.t AS t, CASE WHEN b.b.r > 0.5 THEN b.b.g ELSE o.x.g END AS g, 1 AS np, 0 AS ng
         FROM one o JOIN best b ON b.format = o.format AND b.event_id = o.event_id AND b.x = o.x
         UNION ALL SELECT format, event_id, y.t, y.g, 0, 1 FROM (SELECT format, event_id, unnest(gold) AS y FROM pe)),
c AS (SELECT format, sum(np) AS np, sum(ng) AS ng FROM side GROUP BY format, event_id, t, g),
s AS (SELECT format, CAST(sum(least(np, ng)) AS BIGINT) AS tp, CAST(sum(np - least(np, ng)) AS BIGINT) AS fp,
             CAST(sum(ng - least(np, ng)) AS BIGINT) AS fn FROM c GROUP BY format)
SELECT format, {_prf_sql(7)} FROM s""")(q59)
