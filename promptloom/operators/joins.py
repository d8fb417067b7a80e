"""Join helpers that keep broadcasts bounded and hot keys spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.session import materialize

MAX_BROADCAST_BYTES = 32 << 20
ROW_BYTES = 32  # a row's own cost beside its values


def n_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df`` (as JSON text, which is not smaller) and its rows."""
    size = F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_bytes: int = MAX_BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """Join a dimension-like side onto a large table.

    The small side is evaluated once (a checkpoint) and its bytes are summed; at
    or under ``max_bytes`` it is broadcast (no shuffle of ``big``, no hot-key
    task).  Above the bound it is not broadcast: the small side is replicated
    ``salts`` times and the big side is spread over the salts by a hash of the
    whole row, so a key that holds a large share of ``big`` is split across
    ``salts`` tasks instead of one.  That join is a sort-merge join by hint: the
    planner knows the small side by its compressed file, not by its replicated rows,
    and would else send those through the driver.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    small = materialize(small)
    if n_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    salted_small = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("_salt"))
    # deterministic salt (a re-run task after an executor loss salts identically)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)))
    return salted_big.join(salted_small.hint("merge"), on + ["_salt"], how).drop("_salt")
