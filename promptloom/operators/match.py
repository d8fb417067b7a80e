"""Normalisation and matching.

Entity tables are long: one row per (sample, side, pos) with the matched key
columns.  Matching never builds per-sample lists: the multiset intersection of
gold and predicted keys is a single aggregation on (sample, key) with partial
(map-side) combining, so a hot sample or a hot name is collapsed before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLD, PRED = "gold", "pred"


def casefold(ents: DataFrame, cols=("e_type", "e_name")) -> DataFrame:
    """M3: lower-case the compared fields (types and names)."""
    for c in cols:
        ents = ents.withColumn(c, F.lower(F.col(c)))
    return ents


def key_counts(ents: DataFrame, sample_col: str, key_sets: dict[str, list[str]],
               side_col: str = "side") -> DataFrame:
    """Per (match variant, sample, key): gold and predicted multiplicities.

    ``key_sets`` maps a variant name (e.g. strict / boundaries, M2) to its key
    columns.  All variants are computed by one GROUPING SETS aggregation, i.e.
    one shuffle for any number of variants.
    """
    return _by_key_sets(ents, sample_col, key_sets, F.count_if(F.col(side_col) == GOLD), F.count_if(F.col(side_col) == PRED))


def sum_counts(counts: DataFrame, sample_col: str, key_sets: dict[str, list[str]]) -> DataFrame:
    """:func:`key_counts` of rows that carry multiplicities (n_gold, n_pred) already."""
    return _by_key_sets(counts, sample_col, key_sets, F.sum("n_gold"), F.sum("n_pred"))


def _by_key_sets(rows: DataFrame, sample_col: str, key_sets: dict[str, list[str]], n_gold: Column, n_pred: Column) -> DataFrame:
    if len(key_sets) == 1:  # no grouping sets, so rows that are dealt by sample stay where they are
        (name, keys), = key_sets.items()
        return rows.groupBy(sample_col, *keys).agg(n_gold.alias("n_gold"), n_pred.alias("n_pred")).withColumn("match", F.lit(name))
    names = list(key_sets)
    all_keys: list[str] = []
    for ks in key_sets.values():
        for k in ks:
            if k not in all_keys:
                all_keys.append(k)
    sets = [[F.col(sample_col)] + [F.col(k) for k in key_sets[n]] for n in names]
    agg = (rows.groupingSets(sets, sample_col, *all_keys)
           .agg(n_gold.alias("n_gold"), n_pred.alias("n_pred"), F.grouping_id().alias("_gid")))
    # map grouping id -> variant name (bit set when a key is *not* grouped; the
    # sample column comes first and is always grouped)
    n = len(all_keys)
    gid_expr = None
    for name in names:
        gid = sum(1 << (n - 1 - i) for i, k in enumerate(all_keys) if k not in key_sets[name])
        cond = F.col("_gid") == gid
        gid_expr = F.when(cond, F.lit(name)) if gid_expr is None else gid_expr.when(cond, F.lit(name))
    return agg.withColumn("match", gid_expr).drop("_gid")


def nested_outcome(rows: DataFrame, sample_col: str, key_sets: dict[str, list[str]],
                   n_gold: Column | None = None, n_pred: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """M1 + M2: tp / fp / fn totals (match, tp, fp, fn) of two variants, the keys of the
    second being some of the first's; without rows, none.  Totals are per value of ``by``.

    The counts of the first variant are summed up to the second's keys beside its hits,
    so rows that are dealt by sample already (e.g. whole texts, before they became
    entities) are counted for both variants without moving.  ``n_gold`` and ``n_pred`` are
    the aggregates of a key (rows by ``side`` unless given)."""
    (fine, keys), (coarse, some) = key_sets.items()
    if not set(some) <= set(keys):
        raise ValueError(key_sets)
    n_gold = F.count_if(F.col("side") == GOLD) if n_gold is None else n_gold
    n_pred = F.count_if(F.col("side") == PRED) if n_pred is None else n_pred
    both = F.least(F.col("n_gold"), F.col("n_pred"))
    per = rows.groupBy(sample_col, *by, *keys).agg(n_gold.alias("n_gold"), n_pred.alias("n_pred"))
    per = per.groupBy(sample_col, *by, *some).agg(F.sum(both).alias("hits"), F.sum("n_gold").alias("n_gold"), F.sum("n_pred").alias("n_pred"))
    total = per.groupBy(*by).agg(F.sum("hits").alias(fine), F.sum(both).alias(coarse), F.sum("n_gold").alias("g"), F.sum("n_pred").alias("p"))
    out = total.filter(F.col(fine).isNotNull()).unpivot([*by, "g", "p"], [fine, coarse], "match", "tp")
    return out.select(*by, "match", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def design_counts(ents: DataFrame, sample_col: str, keys: list[str], designs: list[str], design_col: str = "design",
                  side_col: str = "side") -> DataFrame:
    """Gold and predicted multiplicities (sample, key, design, n_gold, n_pred) of rows of several designs.

    All designs of a key are counted in one group, so a name that is in each of them is one
    group instead of one for each design, and rows that are dealt by sample do not move."""
    def count(design, side):
        return F.count_if((F.col(design_col) == design) & (F.col(side_col) == side))

    per = ents.groupBy(sample_col, *keys).agg(*[count(d, s).alias(f"{s}{i}") for i, d in enumerate(designs) for s in (GOLD, PRED)])
    rows = F.array(*[F.struct(F.lit(d).alias(design_col), F.col(f"{GOLD}{i}").alias("n_gold"), F.col(f"{PRED}{i}").alias("n_pred"))
                     for i, d in enumerate(designs)])
    return per.select(sample_col, *keys, F.explode(rows).alias("x")).select(sample_col, *keys, "x.*").filter(F.col("n_gold") + F.col("n_pred") > 0)


def multiset_outcome(counts: DataFrame) -> DataFrame:
    """M1: per key, tp = min(#pred, #gold); fp and fn are the remainders."""
    tp = F.least(F.col("n_gold"), F.col("n_pred"))
    return (counts.withColumn("tp", tp)
            .withColumn("fp", F.col("n_pred") - tp)
            .withColumn("fn", F.col("n_gold") - tp))


def flag_undefined(ents: DataFrame, types: DataFrame, type_col: str = "e_type",
                   type_key: str = "verbose") -> DataFrame:
    """Add ``undefined`` (bool) = the row's type is not a known type.

    The type dictionary is a fixed handful of rows, so it is broadcast.
    """
    t = types.select(F.lower(F.col(type_key)).alias("_known")).distinct()
    return (ents.join(F.broadcast(t), F.lower(F.col(type_col)) == F.col("_known"), "left")
            .withColumn("undefined", F.col("_known").isNull()).drop("_known"))
