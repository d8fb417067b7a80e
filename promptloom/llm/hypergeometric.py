"""Exact hypergeometric draws as Spark SQL expressions (no Python on the rows).

A draw inverts the distribution: starting at the mode it adds the point
weights, first upwards, then downwards, until they reach ``u`` times their
total.  Weights follow from each other by the exact ratio.  The walk covers 13
standard deviations and 20 steps on either side; what lies beyond has less
weight than a double can hold against the total.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def _steps(a: Column, b: Column) -> Column:
    """a, a+1, ..., b-1 (empty unless a < b)."""
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def draw(total: Column, good: Column, n: Column, u: Column) -> Column:
    """Good items among ``n`` drawn without replacement from ``total`` items, ``good`` of them good."""
    args = F.struct(total.cast("long").alias("t"), good.cast("long").alias("g"), n.cast("long").alias("n"),
                    u.alias("u"))
    # transform over a one-element array binds the arguments once
    return F.transform(F.array(args), _draw_bound)[0]


def _draw_bound(a: Column) -> Column:
    t, g, n = a["t"], a["g"], a["n"]
    low = F.greatest(F.lit(0).cast("long"), n - (t - g))
    high = F.least(n, g)
    mode = F.least(high, F.greatest(low, F.floor((n + 1) * (g + 1).cast("double") / (t + 2)).cast("long")))
    share = g.cast("double") / F.greatest(t, F.lit(1))
    sd = F.sqrt(n * share * (1 - share) * F.greatest(t - n, F.lit(0)) / F.greatest(t - 1, F.lit(1)))
    reach = F.ceil(13 * sd).cast("long") + 20
    bound = F.struct(t.alias("t"), g.alias("g"), n.alias("n"), a["u"].alias("u"), mode.alias("m"),
                     F.greatest(low, mode - reach).alias("lo"), F.least(high, mode + reach).alias("hi"))
    return F.transform(F.array(bound), _walk)[0]


def _walk(a: Column) -> Column:
    t, g, n, m = a["t"], a["g"], a["n"], a["m"]
    rest = t - g - n

    def up(k):
        return (g - k).cast("double") * (n - k) / ((k + 1).cast("double") * (rest + k + 1))

    def down(k):
        return k.cast("double") * (rest + k) / ((g - k + 1).cast("double") * (n - k + 1))

    ups = _steps(m, a["hi"])
    downs = F.transform(_steps(a["lo"], m), lambda k: a["lo"] + m - k)  # m, m-1, ..., lo+1

    def weights(ks, ratio):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        return F.aggregate(ks, start, lambda s, k: F.struct(
            (s["w"] * ratio(k)).alias("w"), (s["s"] + s["w"] * ratio(k)).alias("s")))["s"]

    goal = a["u"] * (1.0 + weights(ups, up) + weights(downs, down))

    def search(ks, ratio, step, state):
        start = F.struct(F.lit(1.0).alias("w"), state["s"].alias("s"), state["k"].alias("k"),
                         state["goal"].alias("goal"))
        return F.aggregate(ks, start, lambda s, k: F.when(s["k"].isNotNull(), s).otherwise(F.struct(
            (s["w"] * ratio(k)).alias("w"), (s["s"] + s["w"] * ratio(k)).alias("s"),
            F.when(s["s"] + s["w"] * ratio(k) >= s["goal"], k + step).alias("k"), s["goal"].alias("goal"))))

    state = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"),
                     F.when(goal <= 1.0, m).alias("k"), goal.alias("goal"))
    found = F.transform(F.array(state), lambda s: search(downs, down, -1, search(ups, up, 1, s)))[0]
    # rounding at the very end of the walk leaves the last step
    return F.coalesce(found["k"], a["lo"])


def split(counts: Column, n: Column, *keys) -> Column:
    """Multivariate draw: of ``n`` items taken without replacement from groups
    with ``counts`` (array<bigint>), how many come from each group.  Group after
    group, each draw is conditional on those before it."""
    start = F.struct(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
                     n.cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))
    indexed = F.transform(counts, lambda x, i: F.struct(x.alias("c"), i.alias("i")))

    def step(s, x):
        got = F.transform(F.array(F.struct(s.alias("s"), draw(s["total"], x["c"], s["n"], uniform(*keys, x["i"])).alias("k"))),
                          lambda y: F.struct((y["s"]["total"] - x["c"]).alias("total"),
                                             (y["s"]["n"] - y["k"]).alias("n"),
                                             F.concat(y["s"]["out"], F.array(y["k"])).alias("out")))
        return got[0]

    return F.aggregate(indexed, start, step)["out"]


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)
