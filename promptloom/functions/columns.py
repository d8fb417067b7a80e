"""Reusable Column expressions.  Everything here compiles to built-in Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace character; Spark trim() only spaces.
_UNICODE_EDGE_WS = r"(?U)^\s+|\s+$"


def py_strip(c: Column | str) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _UNICODE_EDGE_WS, "")


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` when b is zero (ANSI-safe)."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def prf(tp: Column, fp: Column, fn: Column, scale: int = 5) -> dict[str, Column]:
    """Micro precision / recall / F1; 0 on zero denominators; each rounded."""
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    f1 = safe_div(2.0 * p * r, p + r)
    return {"precision": F.round(p, scale), "recall": F.round(r, scale), "f1": F.round(f1, scale)}


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def neg_log_sigmoid(d: Column) -> Column:
    """-log(sigmoid(d)) computed without overflow: max(-d, 0) + log1p(exp(-|d|))."""
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def pick(values: list[str], index: Column) -> Column:
    """values[index] for a 0-based integer column (fixed small list)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def md5_rank_key(id_col: Column, seed: int | str) -> Column:
    """Deterministic, engine-independent shuffle key: md5(id || '-' || seed)."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"-{seed}")))


def ints_to_long(df, cols):
    """Widen the named int columns to bigint (array sizes are int in Spark)."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])


def expand_rows(df, rows: list[tuple], names: list[str]):
    """Each row of ``df`` once per fixed row of ``rows`` (a literal array
    exploded in place: no join, no shuffle; the factor is len(rows))."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    return df.select("*", F.explode(arr).alias("_fixed")).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_fixed.`{n}`").alias(n) for n in names])
