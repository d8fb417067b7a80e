"""Reshaping and protocol queries (q46-q48): the result grid in long form,
the hard-mode format check, and a multi-seed evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from promptloom.operators.absa import format_check
from promptloom.operators.metrics import micro_prf
from promptloom.plans import absa as A
from promptloom.plans.derive import ENTITY_TYPES, by_sample, document_words, gp_sql
from promptloom.plans.ner_eval import _prf_sql
from promptloom.plans.registry import ORACLES, register
from promptloom.functions.columns import pick
from promptloom.sources.tables import table

SEEDS = 5


def q46(spark, sf_dir):
    """The design × domain grid unpivoted to (mode, cell, value)."""
    g = A.q33(spark, sf_dir)
    cells = [c for c in g.columns if c != "mode"]
    g = g.select("mode", *[F.col(c).cast("double").alias(c) for c in cells])
    return g.unpivot("mode", cells, "cell", "value")


def _q46_sql():
    base = ORACLES["q33_result_grid"]
    cells = [f"{d}_{m}" for _, d in A.LANG_PAIRS for m in ("k", "wf", "a")]
    body = " UNION ALL ".join(f"SELECT mode, '{c}' AS cell, CAST({c} AS DOUBLE) AS value FROM g" for c in cells)
    return base.replace("\nSELECT mode, max(kappa)", ",\ng AS (SELECT mode, max(kappa)", 1) \
        .replace(" FROM c2 GROUP BY mode", " FROM c2 GROUP BY mode)\n" + body)


def q47(spark, sf_dir):
    """M10 + A7 (hard mode): per design, samples failing the format check
    (key set must equal the aspects, values must be legal) and all samples
    with any error once check failures are included."""
    entries, errors = A.parsed(spark, sf_dir)
    keys = ["doc_id", "lang", "mode"]
    pred_e = entries.filter(F.col("side") == "pred").select(*keys, "key", "value")
    err = errors.filter(F.col("side") == "pred").select(*keys, "error_type")
    chk = format_check(pred_e, err, keys, A.DOMAIN).join(err, keys)
    final = F.when(~F.col("passed"), F.lit("check_error")).otherwise(F.col("error_type"))
    return chk.groupBy("mode").agg(F.count(F.lit(1)).alias("n_samples"),
                                   F.count_if(~F.col("passed")).alias("n_check_error"),
                                   F.count_if(final != "").alias("n_error"))


def _q47_sql():
    asp = "(" + ", ".join(f"'{a}'" for a in A.ASPECTS[A.DOMAIN]) + ")"
    return f"""WITH {A.ABSA_SQL},
chk AS (SELECT e.doc_id, e.mode, e.error_type,
               CASE WHEN e.mode IN ('omit-unmentioned', 'EW-SDE') THEN coalesce(c.known = c.n AND c.bad = 0, true)
                    ELSE coalesce(c.known = {len(A.ASPECTS[A.DOMAIN])} AND c.n = {len(A.ASPECTS[A.DOMAIN])} AND c.bad = 0, false)
               END AS passed
        FROM errs e LEFT JOIN (
          SELECT doc_id, mode, count(*) FILTER (WHERE key IN {asp}) AS known, count(*) AS n,
                 count(*) FILTER (WHERE value NOT IN ('正面', '中性', '负面', '未提及')) AS bad
          FROM ent WHERE side = 'pred' GROUP BY doc_id, mode) c ON c.doc_id = e.doc_id AND c.mode = e.mode
        WHERE e.side = 'pred')
SELECT mode, count(*) AS n_samples, count(*) FILTER (WHERE NOT passed) AS n_check_error,
       count(*) FILTER (WHERE NOT passed OR error_type <> '') AS n_error FROM chk GROUP BY mode"""


def q48(spark, sf_dir):
    """Five seeded prediction runs against the same gold (the prediction
    rules shift with the seed); per match key the mean and sample standard
    deviation of F1 over seeds.  A word gives two names at most, itself and the one
    without its last letter, each with a count for every seed: seeds are columns
    until the last aggregation."""
    w = document_words(by_sample(table(spark, sf_dir, "documents")))
    seeds = range(SEEDS)
    kept = [(F.col("pos") + s) % 4 != 0 for s in seeds]
    cut = [((F.col("pos") + s) % 5 == 0) & (F.col("n_letters") > 1) for s in seeds]

    def named(name, gold, pred):
        return F.struct(name.alias("e_name"), gold.cast("long").alias("gold"), *[x.cast("long").alias(f"p{s}") for s, x in zip(seeds, pred)])

    whole = named(F.col("name"), F.col("pos") % 3 != 0, [k & ~c for k, c in zip(kept, cut)])
    short = named(F.expr("substring(name, 1, n_letters - 1)"), F.lit(False), [k & c for k, c in zip(kept, cut)])
    some_cut = reduce(lambda a, b: a | b, [k & c for k, c in zip(kept, cut)])
    x = w.select("doc_id", F.lower(pick(ENTITY_TYPES, F.col("n_letters") % 5)).alias("e_type"),
                 F.explode(F.when(some_cut, F.array(whole, short)).otherwise(F.array(whole))).alias("x"))
    counts = ["gold", *[f"p{s}" for s in seeds]]
    x = x.select("doc_id", "e_type", F.lower("x.e_name").alias("e_name"), *[F.col(f"x.{c}").alias(c) for c in counts])
    sums = [F.sum(c).alias(c) for c in counts]
    hits = [F.least("gold", f"p{s}") for s in seeds]
    strict = x.groupBy("doc_id", "e_type", "e_name").agg(*sums)
    # texts are dealt by doc_id before they become words: neither grouping moves a row
    names = strict.groupBy("doc_id", "e_name").agg(*sums, *[F.sum(h).alias(f"h{s}") for s, h in zip(seeds, hits)])
    totals = names.agg(*sums, *[F.sum(f"h{s}").alias(f"h{s}") for s in seeds], *[F.sum(h).alias(f"b{s}") for s, h in zip(seeds, hits)])
    cells = [F.struct(F.lit(match).alias("match"), F.lit(s).alias("seed"), F.coalesce(f"{c}{s}", F.lit(0)).alias("tp"),
                      F.coalesce(F.col(f"p{s}") - F.col(f"{c}{s}"), F.lit(0)).alias("fp"), F.coalesce(F.col("gold") - F.col(f"{c}{s}"), F.lit(0)).alias("fn"))
             for match, c in (("strict", "h"), ("boundaries", "b")) for s in seeds]
    out = totals.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    per_seed = micro_prf(out, ["match", "seed"])
    return per_seed.groupBy("match").agg(F.count(F.lit(1)).alias("n_seeds"),
                                         F.round(F.avg("f1"), 6).alias("mean_f1"),
                                         F.round(F.stddev("f1"), 6).alias("std_f1"))


def _q48_sql():
    words = gp_sql().split(",\nents AS")[0]
    t = "(['DNA','RNA','protein','cell_type','cell_line'])[n_letters % 5 + 1]"
    return "WITH " + words + f""",
seeds AS (SELECT CAST(range AS INTEGER) AS seed FROM range({SEEDS})),
ents AS (
  SELECT s.seed, doc_id, 'gold' AS side, lower({t}) AS e_type, name AS e_name FROM words, seeds s WHERE pos % 3 <> 0
  UNION ALL
  SELECT s.seed, doc_id, 'pred', lower({t}),
         CASE WHEN (pos + s.seed) % 5 = 0 AND n_letters > 1 THEN substring(name, 1, n_letters - 1) ELSE name END
  FROM words, seeds s WHERE (pos + s.seed) % 4 <> 0),
c AS (
  SELECT 'strict' AS match, seed, doc_id, e_type, e_name, count(*) FILTER (WHERE side = 'gold') g, count(*) FILTER (WHERE side = 'pred') p
  FROM ents GROUP BY seed, doc_id, e_type, e_name
  UNION ALL
  SELECT 'boundaries', seed, doc_id, NULL, e_name, count(*) FILTER (WHERE side = 'gold'), count(*) FILTER (WHERE side = 'pred')
  FROM ents GROUP BY seed, doc_id, e_name),
s AS (SELECT match, seed, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp,
             CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM c GROUP BY match, seed),
f AS (SELECT match, seed, {_prf_sql()} FROM s)
SELECT match, count(*) AS n_seeds, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1 FROM f GROUP BY match"""


register("q46_grid_unpivot", oracle=_q46_sql())(q46)
register("q47_absa_hard_check", oracle=_q47_sql())(q47)
register("q48_multi_seed", oracle=_q48_sql())(q48)
