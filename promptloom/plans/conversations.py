"""Queries over ``conversations`` (q04, q05, q10, q11).

Turn adjacency is an equi-join on (conv_id, turn + 1): the composite key is
unique, so a conversation with a huge share of rows does not land in one task
the way a window partitioned by conv_id would.  Turns are dense 0..n-1 within
a conversation in this data model (checked on the provided tables).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.prep import human_count, qa_explode, speaker_template, strip_role
from promptloom.plans.registry import register
from promptloom.plans.sqlutil import NL, strip
from promptloom.sources.tables import table

HISTORY_CAP, HISTORY_KEEP = 6, 3  # the chat UI keeps the last 20 of > 40 entries; scaled to 8-turn chats


def _next_turn(conv, role_a: str, role_b: str):
    a = conv.filter(F.col("role") == role_a).select("conv_id", "turn", F.col("text").alias("a_text"))
    b = conv.filter(F.col("role") == role_b).select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                    F.col("text").alias("b_text"))
    return a.join(b, ["conv_id", "turn"])


def q04(spark, sf_dir):
    """lead-by-join user->assistant pairs, P1 rename to q/a, P3 speaker template."""
    pairs = _next_turn(table(spark, sf_dir, "conversations"), "user", "assistant")
    qa = pairs.select("conv_id", "turn", F.col("a_text").alias("q"), F.col("b_text").alias("a"))
    return qa.withColumn("text", speaker_template(F.col("q"), F.col("a")))


register("q04_sft_pairs", oracle=f"""
SELECT u.conv_id, u.turn, u.text AS q, a.text AS a, '问：' || u.text || {NL} || {NL} || '答：' || a.text AS text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")(q04)


def q05(spark, sf_dir):
    """P13 single-round filter + P14 role-tag cleanup.

    The rendered prompt of a conversation is its user turns, each as
    'Human: <text>'; its 'Human:' count is additive, so it is a partial
    aggregate per conversation (no per-conversation list is built).  Kept
    conversations (count <= 1) yield prompt = cleaned user turn and chosen =
    cleaned following assistant turn.
    """
    conv = table(spark, sf_dir, "conversations")
    n_human = (conv.groupBy("conv_id")
               .agg(F.sum(F.when(F.col("role") == "user", 1 + human_count(F.col("text")))
                          .otherwise(0)).alias("n_human"),
                    F.count_if(F.col("role") == "user").alias("n_user")))
    single = n_human.filter((F.col("n_human") <= 1) & (F.col("n_user") == 1)).select("conv_id")
    user = conv.filter(F.col("role") == "user").join(single, "conv_id", "left_semi")
    reply = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    out = user.join(reply, ["conv_id", "turn"], "left")
    return out.select("conv_id",
                      strip_role(F.concat(F.lit("Human: "), F.col("text")), "Human").alias("prompt"),
                      strip_role(F.concat(F.lit(" Assistant: "), F.col("reply")), "Assistant").alias("chosen"))


def _sql_strip_role(x: str, role: str) -> str:
    return strip(f"replace(replace({x}, ' {role}: ', ''), '{role}: ', '')")


register("q05_single_round", oracle=f"""
WITH h AS (
  SELECT conv_id,
         sum(CASE WHEN role = 'user' THEN 1 + (length(text) - length(replace(text, 'Human:', ''))) // 6 ELSE 0 END) AS n_human,
         count(*) FILTER (WHERE role = 'user') AS n_user
  FROM conversations GROUP BY conv_id),
u AS (SELECT c.* FROM conversations c JOIN h USING (conv_id) WHERE c.role = 'user' AND h.n_human <= 1 AND h.n_user = 1)
SELECT u.conv_id,
       {_sql_strip_role("'Human: ' || u.text", "Human")} AS prompt,
       {_sql_strip_role("' Assistant: ' || a.text", "Assistant")} AS chosen
FROM u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'""")(q05)


def q10(spark, sf_dir):
    """P2/P23 QA explode: each assistant reply's non-empty lines are the answer
    list of the preceding user question (HC3 shape); P3 prefixes; P22 pruning."""
    pairs = _next_turn(table(spark, sf_dir, "conversations"), "user", "assistant")
    hc3 = pairs.select("conv_id", "turn", F.col("a_text").alias("question"),
                       F.filter(F.split("b_text", "\n"), lambda x: x != "").alias("chatgpt_answers"))
    ex = qa_explode(hc3, "question", "chatgpt_answers", keep=["conv_id", "turn"])
    return ex.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"),
                     speaker_template(F.col("question")).alias("q"),
                     F.concat(F.lit("答："), F.col("answer")).alias("a"))


register("q10_qa_explode", oracle=f"""
WITH p AS (
  SELECT u.conv_id, u.turn, u.text AS question,
         list_filter(string_split(a.text, {NL}), lambda x: x <> '') AS answers
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, CAST(generate_subscripts(answers, 1) - 1 AS BIGINT) AS pos,
       '问：' || question AS q, '答：' || unnest(answers) AS a
FROM p WHERE len(answers) > 0""")(q10)


def q11(spark, sf_dir):
    """P25 history truncation: a conversation longer than HISTORY_CAP keeps
    only its last HISTORY_KEEP turns.  Length and last turn are partial
    aggregates per conversation, joined back."""
    conv = table(spark, sf_dir, "conversations")
    stats = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.max("turn").alias("_last"))
    j = conv.join(stats, "conv_id")
    keep = (F.col("_n") <= HISTORY_CAP) | (F.col("_last") - F.col("turn") < HISTORY_KEEP)
    return j.filter(keep).select("conv_id", "turn", "role", "text")


register("q11_history_truncate", oracle=f"""
WITH s AS (SELECT conv_id, count(*) n, max(turn) last FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN s USING (conv_id)
WHERE s.n <= {HISTORY_CAP} OR s.last - c.turn < {HISTORY_KEEP}""")(q11)
