"""Helpers to write oracle SQL from the same fixed values the Spark plans use."""

from __future__ import annotations


def lit(s: str) -> str:
    """DuckDB string literal (newlines may stay literal inside quotes)."""
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str]) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return lit(v)
        return repr(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"


NL = "chr(10)"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)
