"""Aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.columns import prf


def micro_prf(outcomes: DataFrame, group_cols: list[str], scale: int = 5) -> DataFrame:
    """A1: sum tp/fp/fn per group, then precision / recall / F1 (0 on zero
    denominators), each rounded to ``scale`` digits."""
    s = outcomes.groupBy(*group_cols).agg(F.sum("tp").cast("long").alias("tp"),
                                         F.sum("fp").cast("long").alias("fp"),
                                         F.sum("fn").cast("long").alias("fn"))
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"), scale)
    return s.select(*group_cols, "tp", "fp", "fn", *[v.alias(k) for k, v in m.items()])


def metric_report(scores: DataFrame, task: str, run_col: str, block_col: str, metrics: list[str]) -> DataFrame:
    """K7: a run's scores as tidy rows (task, run, block, metric, value)."""
    wide = scores.select(F.lit(task).alias("task"), F.col(run_col).alias("run"), F.col(block_col).alias("block"),
                         *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(["task", "run", "block"], metrics, "metric", "value")
