"""Sources, sinks and reports over the provided tables (q49-q57): a table is
written with a sink into the shared folder, read back with the matching source,
and compared with the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.metrics import metric_report, micro_prf
from promptloom.operators.order import first_n
from promptloom.operators.match import casefold, nested_outcome
from promptloom.plans import absa as A
from promptloom.plans.derive import gp_entities
from promptloom.plans.events_eval import q35
from promptloom.plans.ner_eval import STRICT_BOUNDARIES
from promptloom.plans.registry import ORACLES, register
from promptloom.plans.softmatch import SCORE_TABLE_SQL, outcomes
from promptloom.sources import io
from promptloom.sources.tables import table
from promptloom.streaming.jobs import scratch

FIRST_LINES = 50


def q49(spark, sf_dir):
    """K7: one tidy report of an evaluation run: the events designs (samples,
    format errors and rate, P/R/F1) and the aspect designs (accuracy and kappa
    per aspect), as (task, run, block, metric, value) rows."""
    events = q35(spark, sf_dir)
    pr, _, samples = A.evaluated(spark, sf_dir)
    acc = A.accuracy(pr, ["mode"], ["doc_id"], samples)
    kappa = (A.class_scores(A.confusion(pr, ["mode"], spark, A.ASPECTS[A.DOMAIN]), ["mode"])
             .select("mode", "aspect", "kappa").distinct())
    parts = [metric_report(events.withColumn("block", F.lit("ALL")), "events", "format", "block",
                           ["n_samples", "n_format_error", "error_rate", "precision", "recall", "f1"]),
             metric_report(acc, "aspects", "mode", "aspect", ["correct", "incorrect", "acc"]),
             metric_report(kappa, "aspects", "mode", "aspect", ["kappa"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _long(source: str, task: str, run: str, block: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{task}' AS task, {run} AS run, {block} AS block, '{m}' AS metric, "
                              f"CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics)


register("q49_metric_report", oracle=f"""WITH ev AS ({ORACLES['q35_event_match']}), ac AS ({ORACLES['q32_accuracy']}),
kp AS (SELECT DISTINCT mode, aspect, kappa FROM ({ORACLES['q31_kappa']}))
{_long('ev', 'events', 'format', "'ALL'", ['n_samples', 'n_format_error', 'error_rate', 'precision', 'recall', 'f1'])}
UNION ALL {_long('ac', 'aspects', 'mode', 'aspect', ['correct', 'incorrect', 'acc'])}
UNION ALL {_long('kp', 'aspects', 'mode', 'aspect', ['kappa'])}""")(q49)


def score_table(spark, sf_dir):
    """A2: tp / fp / fn and P/R/F1 for {strict, boundaries} x {hard, soft}."""
    scores = micro_prf(outcomes(spark, sf_dir), ["mode", "match"])
    return scores.select(*[c for c in scores.columns if c != "mode"], "mode")


def chosen_f1(scores, mode: str, match: str):
    """A3: the one F1 of a (mode, match) choice."""
    return scores.filter((F.col("mode") == mode) & (F.col("match") == match)).select("mode", "match", "f1")


def q50(spark, sf_dir):
    """A2 in one table."""
    return score_table(spark, sf_dir)


register("q50_ner_score_table", oracle=SCORE_TABLE_SQL)(q50)


def q51(spark, sf_dir):
    """A3: F1 of the strict, hard choice."""
    ents = casefold(gp_entities(spark, sf_dir))
    hard = micro_prf(nested_outcome(ents, "doc_id", STRICT_BOUNDARIES), ["match"])
    return chosen_f1(hard.withColumn("mode", F.lit("hard")), "hard", "strict")


register("q51_chosen_f1", oracle=f"""
SELECT 'hard' AS mode, match, f1 FROM ({ORACLES['q01_ner_micro_hard']}) WHERE match = 'strict'""")(q51)


def q52(spark, sf_dir):
    """Documents as JSON lines and back, with line numbers; the
    first FIRST_LINES lines by the reader's limit."""
    path = scratch(spark, "jsonl")
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("prompt"), F.col("doc_id").cast("string").alias("target"))
    io.write_jsonl(docs, path)
    back = io.read_jsonl(spark, path)
    head = io.first_lines(back, FIRST_LINES).agg(F.count("*").alias("n_head"))
    lines = back.agg(F.count("*").alias("n_lines"), F.count_distinct("line_no").alias("n_numbers"),
                     F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    return (back.select(F.col("target").cast("long").alias("doc_id"), F.md5("prompt").alias("text_md5"))
            .crossJoin(F.broadcast(lines)).crossJoin(F.broadcast(head)))  # one-row frames


register("q52_jsonl_lines", oracle=f"""
SELECT doc_id, md5(text) AS text_md5, n AS n_lines, n AS n_numbers, CAST(0 AS BIGINT) AS low, n - 1 AS high,
       least(n, {FIRST_LINES}) AS n_head
FROM documents, (SELECT count(*) AS n FROM documents)""")(q52)


def q53(spark, sf_dir):
    """Conversation texts as a header CSV (quotes and line ends inside) and back."""
    path = scratch(spark, "csv")
    conv = table(spark, sf_dir, "conversations")
    io.write_result_csv(conv.select(F.concat_ws("|", "conv_id", "turn").alias("question"), F.col("text").alias("answer")), path, [])
    return io.read_qa_csv(spark, path).select("q", F.md5("a").alias("a_md5"))


register("q53_csv_pairs", oracle="SELECT conv_id || '|' || turn AS q, md5(text) AS a_md5 FROM conversations")(q53)


def q54(spark, sf_dir):
    """Token-length rows by split, written and read back one split at a time."""
    path = scratch(spark, "tokenized")
    docs = table(spark, sf_dir, "documents")
    ids = F.transform(F.split("text", r"\s+"), F.length)
    io.write_tokenized(docs.select("doc_id", ids.alias("input_ids"), F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
                                   .alias("split")), path)
    out = None
    for split in ("train", "test"):
        part = io.read_tokenized(spark, path, split).select(
            "doc_id", "split", F.size("input_ids").cast("long").alias("n_ids"),
            F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))
        out = part if out is None else out.unionByName(part)
    return out


register("q54_tokenized_splits", oracle=r"""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, len(w) AS n_ids,
       CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS id_sum
FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents)""")(q54)


def q55(spark, sf_dir):
    """Wrong-format rows as a side file, metric records of two runs
    of which one is repeated, rows in folders by source, and a pair table; each is
    counted from what was read back."""
    base = scratch(spark, "sinks")
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 9 == 0, "split_error").otherwise("")
    io.write_wrong_format(docs.select("doc_id", kind.alias("error_type"), "text"), f"{base}/wrong")
    per = docs.groupBy("lang").agg(F.count("*").alias("n"))
    for run in ("a", "b", "a"):
        io.append_metrics(per.select(F.lit(run).alias("run"), "lang", "n"), f"{base}/metrics", ["run", "lang"])
    io.write_partitioned(docs.select("doc_id", "source", "lang"), f"{base}/folders", ["source"])
    docs.select(F.col("text").alias("content"), F.col("lang").alias("msg")).write.parquet(f"{base}/pairs")
    read = spark.read.json
    parts = [read(f"{base}/wrong").select(F.lit("wrong_format").alias("sink"), F.col("error_type").alias("key")),
             io.read_metrics(spark, f"{base}/metrics", "run string, lang string, n long").select(
                 F.lit("metrics"), F.concat_ws("|", "run", "lang", "n")),
             read(f"{base}/folders").select(F.lit("folders"), F.concat_ws("|", "source", "lang")),
             io.read_pairs(spark, f"{base}/pairs").select(F.lit("pairs"), F.concat_ws("|", "msg", F.md5("content")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("sink", "key").agg(F.count("*").alias("n_rows"))


register("q55_sinks", oracle="""
SELECT sink, key, count(*) AS n_rows FROM (
  SELECT 'wrong_format' AS sink, 'split_error' AS key FROM documents WHERE doc_id % 9 = 0
  UNION ALL SELECT 'metrics', r || '|' || lang || '|' || n
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang), (VALUES ('a'), ('b')) v(r)
  UNION ALL SELECT 'folders', source || '|' || lang FROM documents
  UNION ALL SELECT 'pairs', lang || '|' || md5(text) FROM documents) GROUP BY sink, key""")(q55)


def q56(spark, sf_dir):
    """Customers as JSON array files, one per range of keys, and back; part types as the
    type dictionary beside a corpus, and back."""
    base = scratch(spark, "arrays")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    io.write_json_arrays(cust, "c_custkey", f"{base}/array")
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("code")).distinct()
    entry = F.struct("code", F.struct(F.lower("code").alias("verbose"), F.substring("code", 1, 3).alias("short")).alias("v"))
    dictionary = parts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("entities"))))
    dictionary.coalesce(1).write.text(f"{base}/dictionary")
    types = io.read_type_dictionary(spark, f"{base}/dictionary")
    io.write_corpus(cust, types, f"{base}/corpus")
    copied = spark.read.json(f"{base}/corpus/types").select("code", "verbose", "short")
    array = io.read_json_array(spark, f"{base}/array", "c_custkey long, c_name string")
    return (array.select(F.lit("array").alias("kind"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
            .unionByName(copied.select(F.lit("type").alias("kind"), F.col("code").alias("key"),
                                       F.concat_ws("|", "verbose", "short").alias("value"))))


register("q56_json_arrays", oracle="""
SELECT 'array' AS kind, CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer
UNION ALL SELECT DISTINCT 'type', p_type, lower(p_type) || '|' || substr(p_type, 1, 3) FROM part""")(q56)


def q57(spark, sf_dir):
    """The first FIRST_LINES documents in id order (a top-n, no sort of the table)."""
    return first_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], FIRST_LINES)


register("q57_first_n", oracle=f"SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT {FIRST_LINES}")(q57)


#: Lines that q62 spoils, by doc_id: cut off, or without a target.
CUT_EVERY, KEYLESS_EVERY = 17, 19


def q62(spark, sf_dir):
    """Documents as JSON lines, some cut off and some without a target; the good
    ones are read, the bad ones found in the side table with their reason and place."""
    base = scratch(spark, "quarantine")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    head = F.concat(F.lit('{"prompt": "'), F.col("doc_id").cast("string"))
    line = (F.when(F.col("doc_id") % CUT_EVERY == 0, head).when(F.col("doc_id") % KEYLESS_EVERY == 0, F.concat(head, F.lit('"}')))
            .otherwise(F.concat(head, F.lit('", "target": "'), "h", F.lit('"}'))))
    docs.select(line.alias("value")).write.text(f"{base}/lines")
    good = io.read_jsonl_quarantined(spark, f"{base}/lines", f"{base}/bad", max_bad_share=0.5)
    bad = spark.read.parquet(f"{base}/bad")
    every = good.select("line_no").unionByName(bad.select("line_no")).agg(
        F.count_distinct("line_no").alias("n_numbers"), (F.max("line_no") + 1).alias("n_lines"))
    rows = good.select(F.col("prompt").cast("long").alias("doc_id"), F.col("target").alias("h"), F.lit("").alias("reason"))
    rows = rows.unionByName(bad.select(F.regexp_extract("line", "[0-9]+", 0).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("h"), "reason"))
    return rows.crossJoin(F.broadcast(every))  # one-row frame


register("q62_quarantine", oracle=f"""
WITH d AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % {CUT_EVERY} = 0 THEN 'malformed' WHEN doc_id % {KEYLESS_EVERY} = 0 THEN 'missing key'
                  ELSE '' END AS reason FROM documents)
SELECT doc_id, CASE WHEN reason = '' THEN h END AS h, reason, n AS n_numbers, n AS n_lines
FROM d, (SELECT count(*) AS n FROM documents)""")(q62)
