"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing the plan modules fills the registry
    from promptloom.plans import (  # noqa: F401
        absa,
        brackets,
        conversations,
        corpus,
        designs,
        durable,
        events_eval,
        extras,
        files,
        ner_corpus,
        ner_eval,
        scoring,
        softmatch,
        streams,
        tokenized,
    )
