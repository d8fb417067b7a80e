"""Ratcliff-Obershelp similarity (Python's difflib ratio) as Arrow UDFs.

The ratio is asymmetric for some inputs, so argument order is (prediction,
gold) as in the reference.  These run on Arrow batches; callers only send the
candidate pairs that survive the exact filters in ``operators.soft_match``.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


SHORT = 64  # up to this length blocks are looked for as substrings


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks: the longest common block, the first in ``a`` and
    then in ``b`` of equals, and the same to its left and its right."""
    n = len(a)
    for k in range(min(n, len(b)), 0, -1):
        for i in range(n - k + 1):
            j = b.find(a[i:i + k])
            if j >= 0:
                return k + _matched(a[:i], b[:j]) + _matched(a[i + k:], b[j + k:])
    return 0


def ratio(a: str, b: str) -> float:
    """``SequenceMatcher(a=a, b=b).ratio()``; names of usual length need no matcher."""
    if 0 < len(a) <= SHORT and 0 < len(b) <= SHORT:
        return 2.0 * _matched(a, b) / (len(a) + len(b))
    return SequenceMatcher(a=a, b=b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def soften(pred: list[str], gold: list[str], threshold: float = 0.5) -> list[str]:
    """For each predicted string the gold string of highest ratio, lower-cased and
    stripped, where that ratio is above ``threshold``; the first of equals.

    A prediction that stands among the gold strings is its own best match.  For
    the others the matcher indexes each gold string once, and the exact ratio is
    computed only where both upper bounds (lengths, character counts) can still
    beat the best so far."""
    hits = set(gold)
    best: dict[str, tuple[float, str | None]] = {p: (1.0, p) if p in hits else (threshold, None) for p in pred}
    matcher = SequenceMatcher()
    for g in gold:
        matcher.set_seq2(g)
        for p, (reached, _) in best.items():
            if 2 * min(len(p), len(g)) <= reached * (len(p) + len(g)):
                continue
            matcher.set_seq1(p)
            if matcher.quick_ratio() > reached and (r := matcher.ratio()) > reached:
                best[p] = (r, g)
    return [p if best[p][1] is None else best[p][1].lower().strip() for p in pred]


@F.pandas_udf(T.ArrayType(T.StringType()))
def soften_triggers_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """M5 on one sample's own arrays."""
    return pd.Series([soften(list(p), list(g)) for p, g in zip(pred, gold)])
