"""Scoring queries (q38-q43)."""

from __future__ import annotations


from pyspark.sql import functions as F

from promptloom.operators.scoring import batch_predict, needs_retry, pairwise_loss, reward, reward_accuracy, run_monitor
from promptloom.operators.joins import join_small
from promptloom.plans.registry import register
from promptloom.session import materialize
from promptloom.plans.sqlutil import lit
from promptloom.sources.tables import table

PREDICT_BATCH = 16


def make_stub_model():
    """Deterministic stand-in for a generation model: the reversed prompt; ''
    for prompts whose id is a multiple of 11; raises for multiples of 13."""
    def predict(prompts):
        single = isinstance(prompts, str)
        items = [prompts] if single else prompts
        out = []
        for p in items:
            doc_id, _, text = p.partition("\t")
            i = int(doc_id)
            if i % 13 == 0:
                raise RuntimeError("model failure")
            out.append("" if i % 11 == 0 else text[::-1])
        return out[0] if single else out
    return predict


def q38(spark, sf_dir):
    """Batched prediction over every document with prompt and target
    carried, empty / failed outputs flagged and the retry set marked.  The model
    runs once: its output is stored, and a row that must be retried says so itself."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.col("text")).alias("prompt"),
        F.col("source").alias("target"))
    out = materialize(batch_predict(docs, "prompt", make_stub_model, PREDICT_BATCH).drop("prompt"))
    return out.select("doc_id", "target", F.length("prediction").cast("long").alias("pred_chars"),
                      F.md5("prediction").alias("pred_md5"), (F.col("prediction") == "").alias("empty"),
                      "error", needs_retry(F.col("prediction")).alias("retry"))


register("q38_batch_predict", oracle="""
SELECT doc_id, source AS target,
       CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 0 ELSE length(text) END AS pred_chars,
       md5(CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN '' ELSE reverse(text) END) AS pred_md5,
       (doc_id % 13 = 0 OR doc_id % 11 = 0) AS empty,
       CASE WHEN doc_id % 13 = 0 THEN 'RuntimeError' ELSE '' END AS error,
       (doc_id % 13 = 0 OR doc_id % 11 = 0) AS retry
FROM documents""")(q38)


def q39(spark, sf_dir):
    """Events paired (even id with the next id); the reward
    of each side is sigmoid of a logit derived from the event value, the text
    scored is query + response; reward accuracy, pairwise loss, mean reward and
    mean reward minus the batch baseline (the mean over both sides)."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    j = ev.filter(F.col("event_id") % 2 == 0).alias("a").join(
        ev.alias("b"), F.col("b.event_id") == F.col("a.event_id") + 1)
    logit = lambda c: (F.col(c) - 50.0) / 25.0
    p = j.select(F.concat(F.col("a.event_type"), F.col("a.props")).alias("text_j"),
                 reward(logit("a.value")).alias("rj"), reward(logit("b.value")).alias("rk"))
    s = p.agg(F.count(F.lit(1)).alias("n_pairs"), reward_accuracy(F.col("rj"), F.col("rk")).alias("acc"),
              pairwise_loss(F.col("rj"), F.col("rk")).alias("loss"), F.avg("rj").alias("mean_rj"),
              ((F.sum("rj") + F.sum("rk")) / (2 * F.count(F.lit(1)))).alias("baseline"),
              F.avg(F.length("text_j")).alias("mean_text_chars"))
    return s.select("n_pairs", F.round("acc", 6).alias("reward_accuracy"), F.round("loss", 6).alias("pairwise_loss"),
                    F.round("mean_rj", 6).alias("mean_reward"), F.round(F.col("mean_rj") - F.col("baseline"), 6)
                    .alias("mean_advantage"), F.round("mean_text_chars", 6).alias("mean_text_chars"))


register("q39_reward_eval", oracle="""
WITH p AS (
  SELECT a.event_type || a.props AS text_j, 1 / (1 + exp(-((a.value - 50.0) / 25.0))) AS rj,
         1 / (1 + exp(-((b.value - 50.0) / 25.0))) AS rk
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0),
s AS (SELECT count(*) AS n_pairs, avg(CASE WHEN rj >= rk THEN 1.0 ELSE 0.0 END) AS acc,
             avg(greatest(-(rj - rk), 0) + ln(1 + exp(-abs(rj - rk)))) AS loss, avg(rj) AS mean_rj,
             (sum(rj) + sum(rk)) / (2 * count(*)) AS baseline, avg(length(text_j)) AS mtc FROM p)
SELECT n_pairs, round(acc, 6) AS reward_accuracy, round(loss, 6) AS pairwise_loss, round(mean_rj, 6) AS mean_reward,
       round(mean_rj - baseline, 6) AS mean_advantage, round(mtc, 6) AS mean_text_chars FROM s""")(q39)


def q40(spark, sf_dir):
    """Per-day (step) monitor of event values as rewards and props as
    responses, with alerts and a 10-step moving average."""
    ev = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("step"), "value", "props")
    m = run_monitor(ev, "step", "value", "props", window=10, collapse_score=300.0)
    return m.select("step", "n", F.round("mean_score", 6).alias("mean_score"), F.round("mean_len", 6).alias("mean_len"),
                    "n_alert", F.round("ma_score", 6).alias("ma_score"))


register("q40_reward_monitor", oracle="""
WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS step, count(*) AS n, avg(value) AS mean_score,
                  avg(length(props)) AS mean_len, count(*) FILTER (WHERE length(props) = 0 AND value > 300.0) AS n_alert
           FROM events GROUP BY 1)
SELECT step, n, round(mean_score, 6) AS mean_score, round(mean_len, 6) AS mean_len, n_alert,
       round(avg(mean_score) OVER (ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ma_score FROM d""")(q40)

# Verbalizer words per class (one per document language) for the label-word score.
VERBALIZER = [(0, "not"), (0, "pas"), (0, "nicht"), (0, "no"), (1, "the"), (1, "le"), (1, "die"), (1, "el")]


def q41(spark, sf_dir):
    """I8: per document and class, mean probability of the class's label words
    (word frequency within the document as the probability) × 100, 2 dp.  The
    label words are counted on the row, so nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("ws"))

    def share(label):
        return F.size(F.filter("ws", lambda x: x == F.lit(label))) / F.size("ws")

    scores = []
    for c in sorted({c for c, _ in VERBALIZER}):
        probs = [share(w) for k, w in VERBALIZER if k == c]
        scores.append(F.struct(F.lit(c).alias("class"), F.round(sum(probs[1:], probs[0]) / len(probs) * 100, 2).alias("score")))
    return docs.select("doc_id", F.explode(F.array(*scores)).alias("x")).select("doc_id", "x.class", "x.score")


register("q41_label_word_score", oracle=f"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
v AS (SELECT * FROM (VALUES {", ".join(f"({c}, {lit(x)})" for c, x in VERBALIZER)}) v(class, word)),
h AS (SELECT doc_id, word, count(*) AS c FROM w WHERE word IN (SELECT word FROM v) GROUP BY ALL)
SELECT t.doc_id, CAST(v.class AS INTEGER) AS class, round(avg(coalesce(h.c, 0) / t.n) * 100, 2) AS score
FROM t CROSS JOIN v LEFT JOIN h ON h.doc_id = t.doc_id AND h.word = v.word GROUP BY t.doc_id, v.class""")(q41)


def q42(spark, sf_dir):
    """Unigram language model over the whole corpus; per document the mean
    token negative log-likelihood and its perplexity.  Counts per (document,
    word) are combined map-side before the join with corpus counts."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).filter(F.col("word") != "")
    dw = materialize(words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c")))  # read three times
    cw = dw.groupBy("word").agg(F.sum("c").alias("cw"))
    total = cw.agg(F.sum("cw").alias("N"))
    # a frequent word has one row a document at most: the join broadcasts or salts a little
    j = join_small(dw, cw, ["word"], salts=8).crossJoin(F.broadcast(total))  # one-row frame
    per = j.groupBy("doc_id").agg(F.sum("c").alias("n_tokens"),
                                  F.sum(F.col("c") * F.log(F.col("cw") / F.col("N"))).alias("ll"))
    nll = -F.col("ll") / F.col("n_tokens")
    return per.select("doc_id", "n_tokens", F.round(nll, 6).alias("nll"), F.round(F.exp(nll), 4).alias("ppl"))


register("q42_sequence_nll", oracle="""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents),
dw AS (SELECT doc_id, word, count(*) AS c FROM w WHERE word <> '' GROUP BY ALL),
cw AS (SELECT word, sum(c) AS cw FROM dw GROUP BY word),
n AS (SELECT sum(cw) AS N FROM cw),
per AS (SELECT doc_id, sum(c) AS n_tokens, sum(c * ln(cw / N)) AS ll FROM dw JOIN cw USING (word), n GROUP BY doc_id)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, round(-ll / n_tokens, 6) AS nll, round(exp(-ll / n_tokens), 4) AS ppl FROM per""")(q42)


def q43(spark, sf_dir):
    """Attention-style cells from lineitem (layer = line number, head =
    orderkey % 8, i = partkey % 16, j = suppkey % 16, weight = quantity): sum
    over heads, symmetrise (M + Mᵀ − diag) and take row sums per layer."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("layer"), (F.col("l_partkey") % 16).alias("i"),
        (F.col("l_suppkey") % 16).alias("j"), F.col("l_quantity").alias("w"))
    m = li.groupBy("layer", "i", "j").agg(F.sum("w").alias("m"))
    sym = m.unionByName(m.filter(F.col("i") != F.col("j")).select("layer", F.col("j").alias("i"), F.col("i").alias("j"), "m"))
    return sym.groupBy("layer", "i").agg(F.round(F.sum("m"), 6).alias("row_sum"))


register("q43_attention_rows", oracle="""
WITH m AS (SELECT l_linenumber AS layer, l_partkey % 16 AS i, l_suppkey % 16 AS j, sum(l_quantity) AS m
           FROM lineitem GROUP BY ALL),
s AS (SELECT layer, i, m FROM m UNION ALL SELECT layer, j, m FROM m WHERE i <> j)
SELECT layer, i, round(sum(m), 6) AS row_sum FROM s GROUP BY layer, i""")(q43)
