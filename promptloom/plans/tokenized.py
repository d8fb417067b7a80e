"""Tokenisation and batch-building queries over ``conversations`` (q14-q17).

The vocabulary holds every word of every conversation text.
Results carry lengths, counts and md5 fingerprints of the id arrays so that
the DuckDB oracle can check every id.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptloom.operators.order import batch_ids
from promptloom.operators.tokens import (
    attention_mask, build_vocab, causal_lm_features, encode_fields, ids_md5, last_non_pad, left_pad,
    length_batches, padding, plain_labels, prompt_masked_labels, right_pad, words)
from promptloom.functions.columns import ints_to_long
from promptloom.plans.registry import register
from promptloom.plans.sqlutil import NL
from promptloom.sources.tables import table

MAX_SEQ_LEN = 256
BATCH = 8
GEN_MAX = 128
PAIR_MAX = 400
QUERY_MAX = 96
PAIR_BATCH = 4


def _vocab(spark, sf_dir):
    return build_vocab(table(spark, sf_dir, "conversations"), "text")


def _pairs(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = conv.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                         F.col("text").alias("a"))
    return u.join(a, ["conv_id", "turn"])


def tokenized_pairs(spark, sf_dir, skip_overlength: bool = False):
    pairs = _pairs(spark, sf_dir)
    # cut before the words are exploded; the word count rides along in the key
    pairs = pairs.select("conv_id", "turn", words(F.col("q")).alias("q"), words(F.col("a")).alias("a"))
    keyed = pairs.select("conv_id", "turn", F.size("q").alias("n_prompt_words"), F.slice("q", 1, MAX_SEQ_LEN).alias("q"),
                         F.slice("a", 1, MAX_SEQ_LEN).alias("a"))
    enc = encode_fields(keyed, ["conv_id", "turn", "n_prompt_words"], {"prompt_ids": F.col("q"), "target_ids": F.col("a")},
                        _vocab(spark, sf_dir), bos={"prompt_ids": True})
    feats = causal_lm_features(F.col("prompt_ids"), F.col("target_ids"), MAX_SEQ_LEN, skip_overlength)
    return (enc.select("conv_id", "turn", "n_prompt_words", F.slice("prompt_ids", 1, MAX_SEQ_LEN).alias("prompt_ids"),
                       F.slice("target_ids", 1, MAX_SEQ_LEN).alias("target_ids"),
                       *[v.alias(k) for k, v in feats.items()])
            .filter("keep").drop("keep"))


def q14(spark, sf_dir):
    """Encode q/a pairs, causal-LM concat, overlength handling."""
    t = tokenized_pairs(spark, sf_dir)
    return ints_to_long(t.select("conv_id", "turn", F.size("input_ids").alias("n_ids"), "seq_len", "overlength",
                                 ids_md5(F.col("input_ids")).alias("ids_md5"), "n_prompt_words"),
                        ["n_ids", "seq_len", "n_prompt_words"])


_WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"

TOKENIZED_SQL = f"""
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS q, a.text AS a
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
vocab AS (
  SELECT word, CAST(rn + 3 AS INTEGER) AS id FROM (
    SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rn FROM (
      SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format(x='text')}) AS word FROM conversations) GROUP BY word))
  ),
toks AS (
  SELECT conv_id, turn, f, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (
    SELECT conv_id, turn, 'p' AS f, {_WORDS.format(x='q')} AS ws FROM pairs
    UNION ALL SELECT conv_id, turn, 't', {_WORDS.format(x='a')} FROM pairs)),
enc AS (
  SELECT t.conv_id, t.turn,
         coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.f = 'p'), []) AS p,
         coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.f = 't'), []) AS tg
  FROM toks t LEFT JOIN vocab v ON t.word = v.word GROUP BY t.conv_id, t.turn),
feat AS (
  SELECT conv_id, turn, p2 AS prompt_ids, t2 AS target_ids, list_concat(p2, t2, [2]) AS full_ids, len(p2) AS seq_len
  FROM (SELECT conv_id, turn, list_concat([1], p)[1:{MAX_SEQ_LEN}] AS p2, tg[1:{MAX_SEQ_LEN}] AS t2 FROM enc)),
tok AS (
  SELECT f.conv_id, f.turn, f.prompt_ids, f.target_ids, f.full_ids[1:{MAX_SEQ_LEN}] AS input_ids, f.seq_len,
         len(f.full_ids) > {MAX_SEQ_LEN} AS overlength, len({_WORDS.format(x='pr.q')}) AS n_prompt_words
  FROM feat f JOIN pairs pr ON pr.conv_id = f.conv_id AND pr.turn = f.turn)"""

register("q14_tokenize_concat", oracle=f"""WITH {TOKENIZED_SQL}
SELECT conv_id, turn, len(input_ids) AS n_ids, seq_len, overlength,
       md5(array_to_string(input_ids, ',')) AS ids_md5, n_prompt_words FROM tok""")(q14)


def q15(spark, sf_dir):
    """Fixed-size batches in (conv_id, turn) order; prompt-masked
    and plain labels; right padding to the batch's longest; in-batch order by
    length desc (stable).  Batches hold BATCH rows, so the per-batch window is
    bounded whatever the data size."""
    t = batch_ids(tokenized_pairs(spark, sf_dir), ["conv_id", "turn"], BATCH)
    w = Window.partitionBy("batch_id")
    t = t.withColumn("longest", F.max(F.size("input_ids")).over(w))
    t = t.withColumn("slot", F.row_number().over(w.orderBy(F.desc(F.size("input_ids")), "idx")))
    labels = prompt_masked_labels(F.col("input_ids"), F.col("seq_len"), F.col("longest"))
    return ints_to_long(t.select("batch_id", F.col("slot").cast("int").alias("slot"), "conv_id", "turn", "longest",
                    F.size(F.filter(labels, lambda x: x == -100)).alias("n_ignored"),
                    ids_md5(right_pad(F.col("input_ids"), F.col("longest"))).alias("ids_md5"),
                    ids_md5(labels).alias("labels_md5"),
                    ids_md5(plain_labels(F.col("input_ids"), F.col("longest"))).alias("plain_labels_md5")),
                        ["longest", "n_ignored"])


register("q15_masked_padded_batch", oracle=f"""WITH {TOKENIZED_SQL},
b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) AS idx FROM tok),
b2 AS (SELECT *, CAST(idx // {BATCH} AS BIGINT) AS batch_id FROM b),
b3 AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS longest,
              row_number() OVER (PARTITION BY batch_id ORDER BY len(input_ids) DESC, idx) AS slot FROM b2),
l AS (SELECT *, list_concat(repeat([-100], greatest(seq_len, 1) - 1), input_ids[greatest(seq_len, 1):],
                            repeat([-100], longest - len(input_ids))) AS labels FROM b3)
SELECT batch_id, CAST(slot AS INTEGER) AS slot, conv_id, turn, longest,
       len(list_filter(labels, lambda x: x = -100)) AS n_ignored,
       md5(array_to_string(list_concat(input_ids, repeat([0], longest - len(input_ids))), ',')) AS ids_md5,
       md5(array_to_string(labels, ',')) AS labels_md5,
       md5(array_to_string(list_concat(input_ids, repeat([-100], longest - len(input_ids))), ',')) AS plain_labels_md5
FROM l""")(q15)


def q16(spark, sf_dir):
    """Prompts cut to GEN_MAX and left-padded per batch for generation;
    the continuation after the padded prompt is sliced off a stand-in output
    (padded prompt + target + eos); last non-pad index of the right-padded input."""
    t = batch_ids(tokenized_pairs(spark, sf_dir), ["conv_id", "turn"], BATCH)
    t = t.withColumn("p", F.slice("prompt_ids", 1, GEN_MAX))
    w = Window.partitionBy("batch_id")
    t = t.withColumn("plen", F.max(F.size("p")).over(w)).withColumn("longest", F.max(F.size("input_ids")).over(w))
    padded = left_pad(F.col("p"), F.col("plen"))
    generated = F.concat(padded, F.col("target_ids"), F.array(F.lit(2)))
    cont = F.slice(generated, F.col("plen") + 1, F.size(generated))
    return ints_to_long(t.select("batch_id", "conv_id", "turn", "plen", (F.col("plen") - F.size("p")).alias("n_pad"),
                    ids_md5(padded).alias("padded_md5"), ids_md5(cont).alias("continuation_md5"),
                    last_non_pad(right_pad(F.col("input_ids"), F.col("longest"))).alias("last_non_pad")),
                        ["plen", "n_pad", "last_non_pad"])


register("q16_left_pad", oracle=f"""WITH {TOKENIZED_SQL},
b AS (SELECT *, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH} AS BIGINT) AS batch_id,
             prompt_ids[1:{GEN_MAX}] AS p FROM tok),
b2 AS (SELECT *, max(len(p)) OVER (PARTITION BY batch_id) AS plen,
              max(len(input_ids)) OVER (PARTITION BY batch_id) AS longest FROM b),
g AS (SELECT *, list_concat(repeat([0], plen - len(p)), p) AS padded FROM b2)
SELECT batch_id, conv_id, turn, plen, plen - len(p) AS n_pad, md5(array_to_string(padded, ',')) AS padded_md5,
       md5(array_to_string(list_concat(target_ids, [2]), ',')) AS continuation_md5,
       len(list_filter(list_concat(input_ids, repeat([0], longest - len(input_ids))), lambda x: x <> 0)) - 1 AS last_non_pad
FROM g""")(q16)


def q17(spark, sf_dir):
    """chosen = first and rejected = last assistant reply to a
    conversation's first user turn; both rendered with the speaker template and
    encoded with masks; pair filter (both <= PAIR_MAX) and strict query filter
    (< QUERY_MAX); pairs padded per batch, each side to its own longest."""
    conv = table(spark, sf_dir, "conversations")
    ends = (conv.groupBy("conv_id")
            .agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("t_user"),
                 F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("t_first"),
                 F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("t_last")))
    txt = conv.select("conv_id", "turn", "text")
    pick = lambda tcol, name: ends.join(txt.withColumnRenamed("turn", tcol).withColumnRenamed("text", name),
                                        ["conv_id", tcol])
    pr = pick("t_user", "prompt").join(pick("t_first", "chosen").select("conv_id", "chosen"), "conv_id") \
        .join(pick("t_last", "rejected").select("conv_id", "rejected"), "conv_id")
    head = F.concat(F.lit("问："), F.col("prompt"), F.lit("\n\n答："))
    pr = pr.select("conv_id", words(F.concat(head, F.col("chosen"))).alias("ids_j"),
                   words(F.concat(head, F.col("rejected"))).alias("ids_k"), words(head).alias("query"))
    # an encoded text is bos and one id per word, so the length filters need no encoding
    short = pr.filter((F.size("ids_j") < PAIR_MAX) & (F.size("ids_k") < PAIR_MAX) & (F.size("query") + 1 < QUERY_MAX))
    kept = encode_fields(short, ["conv_id"], {c: F.col(c) for c in ("ids_j", "ids_k", "query")},
                         _vocab(spark, sf_dir), bos={"ids_j": True, "ids_k": True, "query": True})
    b = batch_ids(kept, ["conv_id"], PAIR_BATCH)
    w = Window.partitionBy("batch_id")
    b = b.withColumn("max_j", F.max(F.size("ids_j")).over(w)).withColumn("max_k", F.max(F.size("ids_k")).over(w))
    return ints_to_long(b.select("conv_id", "batch_id", F.size("ids_j").alias("len_j"), F.size("ids_k").alias("len_k"),
                    F.size("query").alias("q_len"),
                    ids_md5(right_pad(F.col("ids_j"), F.col("max_j"))).alias("ids_j_md5"),
                    ids_md5(right_pad(F.col("ids_k"), F.col("max_k"))).alias("ids_k_md5"),
                    F.aggregate(attention_mask(F.col("ids_j")), F.lit(0), lambda a, x: a + x).alias("mask_j")),
                        ["len_j", "len_k", "q_len", "mask_j"])


register("q17_pair_encode_filter", oracle=f"""
WITH e AS (
  SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS t_user, min(turn) FILTER (WHERE role = 'assistant') AS t_first,
         max(turn) FILTER (WHERE role = 'assistant') AS t_last FROM conversations GROUP BY conv_id),
pr AS (
  SELECT e.conv_id, u.text AS prompt, c.text AS chosen, r.text AS rejected FROM e
  JOIN conversations u ON u.conv_id = e.conv_id AND u.turn = e.t_user
  JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.t_first
  JOIN conversations r ON r.conv_id = e.conv_id AND r.turn = e.t_last),
vocab AS (
  SELECT word, CAST(rn + 3 AS INTEGER) AS id FROM (
    SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rn FROM (
      SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format(x='text')}) AS word FROM conversations) GROUP BY word))
  ),
x AS (SELECT conv_id, '问：' || prompt || {NL} || {NL} || '答：' AS head, chosen, rejected FROM pr),
toks AS (
  SELECT conv_id, f, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (
    SELECT conv_id, 'j' AS f, {_WORDS.format(x='head || chosen')} AS ws FROM x
    UNION ALL SELECT conv_id, 'k', {_WORDS.format(x='head || rejected')} FROM x
    UNION ALL SELECT conv_id, 'q', {_WORDS.format(x='head')} FROM x)),
enc AS (
  SELECT t.conv_id,
         list_concat([1], coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.f = 'j'), [])) AS ids_j,
         list_concat([1], coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.f = 'k'), [])) AS ids_k,
         list_concat([1], coalesce(list(coalesce(v.id, 3) ORDER BY t.pos) FILTER (WHERE t.f = 'q'), [])) AS query
  FROM toks t LEFT JOIN vocab v ON t.word = v.word GROUP BY t.conv_id),
k AS (SELECT *, CAST((row_number() OVER (ORDER BY conv_id) - 1) // {PAIR_BATCH} AS BIGINT) AS batch_id FROM enc
      WHERE len(ids_j) <= {PAIR_MAX} AND len(ids_k) <= {PAIR_MAX} AND len(query) < {QUERY_MAX}),
m AS (SELECT *, max(len(ids_j)) OVER (PARTITION BY batch_id) AS max_j, max(len(ids_k)) OVER (PARTITION BY batch_id) AS max_k FROM k)
SELECT conv_id, batch_id, len(ids_j) AS len_j, len(ids_k) AS len_k, len(query) AS q_len,
       md5(array_to_string(list_concat(ids_j, repeat([0], max_j - len(ids_j))), ',')) AS ids_j_md5,
       md5(array_to_string(list_concat(ids_k, repeat([0], max_k - len(ids_k))), ',')) AS ids_k_md5,
       len(ids_j) AS mask_j
FROM m""")(q17)


WIDE_BATCH = 32


def q63(spark, sf_dir):
    """T8 T9 over the corpus: padding of every batch of documents (length in words), as the
    documents come by id and sorted by length, with each order's share of padding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).alias("n"))
    docs = docs.withColumn("n", F.greatest("n", F.lit(0)))
    out = None
    for order in ("given", "length"):
        per = padding(length_batches(docs, F.col("n"), ["doc_id"], WIDE_BATCH, order), F.col("n"))
        cells = per.agg((F.sum("padding") / F.sum(F.col("width") * F.col("n_rows"))).alias("x"))
        per = per.crossJoin(F.broadcast(cells)).select(F.lit(order).alias("order"), "batch_id", "n_rows", "width", "padding",
                                                       F.round("x", 6).alias("padding_share"))  # one-row frame
        out = per if out is None else out.unionByName(per)
    return out


register("q63_length_batches", oracle=f"""
WITH d AS (SELECT doc_id, len({_WORDS.format(x="coalesce(text, '')")}) AS n FROM documents),
o AS (SELECT 'given' AS ord, doc_id, n, (row_number() OVER (ORDER BY doc_id) - 1) // {WIDE_BATCH} AS batch_id FROM d
      UNION ALL SELECT 'length', doc_id, n, (row_number() OVER (ORDER BY n DESC, doc_id) - 1) // {WIDE_BATCH} FROM d),
b AS (SELECT ord, batch_id, count(*) AS n_rows, max(n) AS width, CAST(max(n) * count(*) - sum(n) AS BIGINT) AS padding FROM o GROUP BY ord, batch_id),
t AS (SELECT ord, sum(padding) / sum(width * n_rows) AS x FROM b GROUP BY ord)
SELECT ord AS "order", batch_id, n_rows, CAST(width AS BIGINT) AS width, padding, round(x, 6) AS padding_share FROM b JOIN t USING (ord)""")(q63)
