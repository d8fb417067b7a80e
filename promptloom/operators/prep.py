"""Instruction-data preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.columns import py_strip


def rename_qa(df: DataFrame, q_col: str, a_col: str, q: str = "q", a: str = "a") -> DataFrame:
    """Project two named fields as q / a."""
    return df.select(F.col(q_col).alias(q), F.col(a_col).alias(a))


def speaker_template(q: Column, a: Column | None = None, user: str = "问：", bot: str = "答：",
                     sep: str = "\n\n") -> Column:
    """``user + q`` (+ ``sep + bot + a``)."""
    if a is None:
        return F.concat(F.lit(user), q)
    return F.concat(F.lit(user), q, F.lit(sep), F.lit(bot), a)


def append_instruction(text: Column, suffix: str) -> Column:
    """Text followed by a fixed instruction."""
    return F.concat(text, F.lit(suffix))


def fill_template(template: Column, text: Column, placeholder: str = "{}") -> Column:
    """P5: ``template.format(text)`` for a single positional placeholder."""
    return F.replace(template, F.lit(placeholder), text)


def drop_empty_answers(df: DataFrame, col: str, empties=("无", "")) -> DataFrame:
    """P11."""
    return df.filter(~F.col(col).isin(*empties))


def human_count(text: Column) -> Column:
    """Occurrences of 'Human:' (P13's single-round test counts them)."""
    return F.regexp_count(text, F.lit("Human:"))


def strip_role(text: Column, role: str) -> Column:
    """Remove ' Role: ' then 'Role: ', then strip all edge whitespace."""
    return py_strip(F.replace(F.replace(text, F.lit(f" {role}: "), F.lit("")), F.lit(f"{role}: "), F.lit("")))


def qa_explode(df: DataFrame, question: str, answers: str, keep: list[str] | None = None) -> DataFrame:
    """One row per (question, answer); an empty answer list yields no row.
    P23: the answer's position in its list is kept (arrays_zip + explode)."""
    keep = keep or []
    z = F.arrays_zip(F.sequence(F.lit(0), F.size(answers) - 1).alias("pos"), F.col(answers).alias("answer"))
    return (df.filter(F.size(answers) > 0)
            .select(*keep, F.col(question).alias("question"), F.explode(z).alias("_z"))
            .select(*keep, "question", F.col("_z.pos").alias("pos"), F.col("_z.answer").alias("answer")))


def after_last_marker(text: Column, marker: str = "answer:") -> Column:
    """Text after the last ``marker`` (whole text when absent), stripped."""
    return py_strip(F.substring_index(text, marker, -1))
