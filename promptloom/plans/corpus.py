"""Corpus splitting, sampling, mixing and prompt construction over
``documents`` and ``benchmark`` (q06-q09, q12, q13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptloom.functions.columns import md5_rank_key
from promptloom.functions.columns import expand_rows
from promptloom.operators.joins import join_small
from promptloom.operators.order import first_last_split, with_global_index
from promptloom.operators.quota import least_of_strata, quotas
from promptloom.operators.prep import append_instruction, drop_empty_answers, fill_template
from promptloom.plans.registry import register
from promptloom.plans.sqlutil import NL, lit, values
from promptloom.session import materialize
from promptloom.sources.tables import table

FIRST_FRACTION, LAST_FRACTION = 0.8, 0.3   # overlapping first-N / last-N split
KEEP_TRAIN_FRACTION = 0.8                  # rebalance: train keeps its first 80 %
SAMPLE_K, SAMPLE_SEED = 100, 42
SHOTS = 3

# Routing of (base model, tool) to a prompt template, as in the chat demo.
EXTRACT_TOOL_SUFFIX = ("\n---\n请从上文中抽取出所有公司，以及对应的在本文中的情感倾向（积极、消极、中性）以及原因。\n"
                       "请用这样的格式返回：\n{\"ORG\":..., \"sentiment\":..., \"reason\":...}")
TEMPLATES = [
    ("baichuan-7b", "聊天", "问：{}答："),
    ("baichuan-7b", "公司情感抽取", "{}" + EXTRACT_TOOL_SUFFIX),
    ("glm", "公司情感抽取", "{}" + EXTRACT_TOOL_SUFFIX),
]
# The instruction appended to every text sent to the external annotator.
ANNOTATION_SUFFIX = ("\n---\n请从上文中抽取出所有公司/机构、对应的在本文中的情感倾向（积极、消极、中性）以及原因。\n"
                     "并用这样的格式返回：\n{\"ORG\":..., \"sentiment\":..., \"reason\":...}")
# Which model/tool serves which document language (our routing for the provided data).
LANG_ROUTES = [("en", "baichuan-7b", "聊天"), ("fr", "baichuan-7b", "公司情感抽取"),
               ("de", "glm", "公司情感抽取"), ("es", "baichuan-7b", "聊天")]
# Any other language, or none.
DEFAULT_ROUTE = ("baichuan-7b", "聊天")
# Question rewrites used to augment each task seed (paraphrase table).
PARAPHRASES = [(1, "Could you explain: {}"), (2, "Question: {}"), (3, "Tell me about {}"),
               (4, "{} Please answer briefly.")]


def q06(spark, sf_dir):
    """First 80 % as train and last 30 % as test by doc_id (overlap kept)."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    total = F.col("_total")
    out = first_last_split(docs, ["doc_id"], F.floor(total * FIRST_FRACTION), F.floor(total * LAST_FRACTION))
    return out.select("doc_id", "split", "idx")


register("q06_first_last_split", oracle=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents)
SELECT doc_id, 'train' AS split, idx FROM r WHERE idx < floor(total * {FIRST_FRACTION})
UNION ALL
SELECT doc_id, 'test' AS split, idx FROM r WHERE idx >= total - floor(total * {LAST_FRACTION})""")(q06)


def q07(spark, sf_dir):
    """P15 split rebalance: the original split is test = Spanish documents,
    train = the rest; train keeps its first 80 % by doc_id and the remainder
    moves to test (test ∪ train[k:], train = train[:k])."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    test = docs.filter(F.col("lang") == "es").select("doc_id", F.lit("test").alias("split"))
    train = with_global_index(docs.filter(~F.col("lang").eqNullSafe("es")).select("doc_id"), ["doc_id"], total_col="_n")
    train = train.withColumn("_k", F.floor(F.col("_n") * KEEP_TRAIN_FRACTION))
    moved = train.filter(F.col("idx") >= F.col("_k")).select("doc_id", F.lit("test").alias("split"))
    kept = train.filter(F.col("idx") < F.col("_k")).select("doc_id", F.lit("train").alias("split"))
    return test.unionByName(moved).unionByName(kept)


register("q07_split_rebalance", oracle=f"""
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n
           FROM documents WHERE lang IS DISTINCT FROM 'es')
SELECT doc_id, 'test' AS split FROM documents WHERE lang = 'es'
UNION ALL SELECT doc_id, CASE WHEN idx < floor(n * {KEEP_TRAIN_FRACTION}) THEN 'train' ELSE 'test' END FROM t""")(q07)


def q08(spark, sf_dir):
    """P18 deterministic shuffle of the whole corpus (md5 of id and seed) and
    P19 exact-k sample = the first k rows of that shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    keyed = docs.withColumn("_key", md5_rank_key(F.col("doc_id"), SAMPLE_SEED))
    pos = with_global_index(keyed, ["_key", "doc_id"], "shuffle_pos")
    return pos.select("doc_id", "lang", "shuffle_pos", (F.col("shuffle_pos") < SAMPLE_K).alias("in_sample"))


register("q08_exact_k_sample", oracle=f"""
SELECT doc_id, lang, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-{SAMPLE_SEED}'), doc_id) - 1 AS shuffle_pos,
       (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-{SAMPLE_SEED}'), doc_id) - 1) < {SAMPLE_K} AS in_sample
FROM documents""")(q08)


def q09(spark, sf_dir):
    """P20 corpus mixing, P21 paraphrase augmentation, P11 empty-answer drop,
    then exact (q, a) dedup keeping the smallest (source, sample_id, variant).

    general corpus: documents, q = first line, a = the rest of the text.
    task corpus: benchmark items, q = first sentence, a = whole item; every task
    seed is also rendered through the paraphrase table (4 fixed rows, broadcast).
    """
    docs = table(spark, sf_dir, "documents")
    nl = F.instr("text", "\n")
    general = docs.select(F.lit("general").alias("source"), F.col("doc_id").alias("sample_id"),
                          F.lit(0).alias("variant"), F.substring_index("text", "\n", 1).alias("q"),
                          F.when(nl > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise(F.lit("")).alias("a"))
    bench = table(spark, sf_dir, "benchmark")
    task = bench.select(F.lit("task").alias("source"), F.col("item_id").alias("sample_id"),
                        F.lit(0).alias("variant"), F.substring_index("text", ".", 1).alias("q"),
                        F.col("text").alias("a"))
    aug = (expand_rows(task.drop("variant"), PARAPHRASES, ["variant", "template"])
           .select("source", "sample_id", "variant", fill_template(F.col("template"), F.col("q")).alias("q"), "a"))
    mixed = drop_empty_answers(general.unionByName(task).unionByName(aug), "a")
    # texts are told apart by a wide digest, so the shuffle key is 32 bytes; the texts
    # of a digest come along with its smallest row
    digest = F.sha2(F.concat(F.octet_length("q").cast("string"), F.lit(":"), "q", "a"), 256)
    best = mixed.groupBy(digest.alias("_d")).agg(F.min(F.struct("source", "sample_id", "variant", "q", "a")).alias("_m"))
    return best.select(F.col("_m.q").alias("q"), F.col("_m.a").alias("a"), F.col("_m.source").alias("source"), F.col("_m.sample_id").alias("sample_id"),
                       F.col("_m.variant").cast("int").alias("variant"))


register("q09_corpus_mix", oracle=f"""
WITH g AS (
  SELECT 'general' AS source, doc_id AS sample_id, 0 AS variant,
         CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, 1, strpos(text, {NL}) - 1) ELSE text END AS q,
         CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, strpos(text, {NL}) + 1) ELSE '' END AS a
  FROM documents),
t AS (
  SELECT 'task' AS source, item_id AS sample_id, 0 AS variant,
         CASE WHEN strpos(text, '.') > 0 THEN substr(text, 1, strpos(text, '.') - 1) ELSE text END AS q, text AS a
  FROM benchmark),
p AS (SELECT * FROM {values(PARAPHRASES, ["variant", "template"])}),
m AS (
  SELECT * FROM g UNION ALL SELECT * FROM t
  UNION ALL SELECT t.source, t.sample_id, p.variant, replace(p.template, '{{}}', t.q), t.a FROM t, p),
k AS (SELECT *, row_number() OVER (PARTITION BY q, a ORDER BY source, sample_id, variant) AS rn
      FROM m WHERE a NOT IN ('无', ''))
SELECT q, a, source, sample_id, CAST(variant AS INTEGER) AS variant FROM k WHERE rn = 1""")(q09)


def q12(spark, sf_dir):
    """P5 template routing (lang -> (model, tool) -> template, both fixed tables
    broadcast) and P4 annotation-instruction suffix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    routes = spark.createDataFrame(LANG_ROUTES, "lang string, model string, tool string")
    tpl = spark.createDataFrame(TEMPLATES, "model string, tool string, template string")
    r = docs.join(F.broadcast(routes), "lang", "left").withColumns(
        {c: F.coalesce(c, F.lit(d)) for c, d in zip(("model", "tool"), DEFAULT_ROUTE, strict=True)})
    r = r.join(F.broadcast(tpl), ["model", "tool"])
    return r.select("doc_id", "model", "tool", fill_template(F.col("template"), F.col("text")).alias("prompt"),
                    append_instruction(F.col("text"), ANNOTATION_SUFFIX).alias("api_content"))


register("q12_template_route", oracle=f"""
SELECT d.doc_id, tp.model, tp.tool, replace(t.template, '{{}}', d.text) AS prompt, d.text || {lit(ANNOTATION_SUFFIX)} AS api_content
FROM documents d LEFT JOIN {values(LANG_ROUTES, ["lang", "model", "tool"])} ON d.lang = r.lang
JOIN {values(TEMPLATES, ["model", "tool", "template"])}
  ON coalesce(r.model, {lit(DEFAULT_ROUTE[0])}) = tp.model AND coalesce(r.tool, {lit(DEFAULT_ROUTE[1])}) = tp.tool"""
         .replace("AS t(lang, model, tool)", "AS r(lang, model, tool)")
         .replace("AS t(model, tool, template)", "AS tp(model, tool, template)")
         .replace("t.template", "tp.template"))(q12)


def few_shot_examples(docs):
    """One row per language: its SHOTS lowest doc_ids as examples."""
    rn = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    shots = docs.withColumn("rn", rn).filter(F.col("rn") <= SHOTS)
    shot_text = F.concat(F.lit("Example "), F.col("rn").cast("string"), F.lit(":\n"), F.col("text"),
                         F.lit("\n输出："), F.col("source"))
    return (shots.groupBy("lang")
            .agg(F.sort_array(F.collect_list(F.struct("rn", shot_text.alias("s")))).alias("_shots"))
            .select("lang", F.array_join(F.transform("_shots", lambda x: x["s"]), "\n\n").alias("examples")))


def q13(spark, sf_dir):
    """P6 few-shot prompts: the SHOTS lowest doc_ids of each language are the
    examples ('Example k:' + text + '输出：' + source); every document gets its
    language's examples followed by itself as 'Example SHOTS+1'.

    The per-language top-k is a ranked window with ``rn <= k``, which Spark
    turns into a map-side group limit before the shuffle; the shot table then
    has at most SHOTS rows per language and is joined by ``join_small``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit("")))  # rows without a language share examples
    j = join_small(docs, few_shot_examples(docs), ["lang"])
    prompt = F.concat(F.col("examples"), F.lit(f"\n\nExample {SHOTS + 1}:\n"), F.col("text"), F.lit("\n输出："))
    return j.select("doc_id", prompt.alias("prompt"))


register("q13_few_shot", oracle=f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, text, source FROM documents),
s AS (SELECT lang, doc_id, text, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM d),
e AS (SELECT lang, string_agg('Example ' || rn || ':' || {NL} || text || {NL} || '输出：' || source, {NL} || {NL} ORDER BY rn) AS examples
      FROM s WHERE rn <= {SHOTS} GROUP BY lang)
SELECT d.doc_id, e.examples || {NL} || {NL} || 'Example {SHOTS + 1}:' || {NL} || d.text || {NL} || '输出：' AS prompt
FROM d JOIN e USING (lang)""")(q13)


# Weights of the mix by language; any other language, or none, weighs 1.
MIX_WEIGHTS = {"en": 5.0, "de": 2.5, "fr": 1.5}
MIX_FRACTION, MIX_SEED = 0.35, 7


def q64(spark, sf_dir):
    """P20 weighted mix: 35 % of the documents, by language in proportion to weights,
    exact quotas, the rows of least md5 of each language (no sort of the table)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"))
    rows = docs.withColumn("digest", md5_rank_key(F.col("doc_id"), MIX_SEED))
    sizes = materialize(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    total = int((sizes.agg(F.sum("n")).first()[0] or 0) * MIX_FRACTION)
    quota = materialize(quotas(sizes, total, MIX_WEIGHTS))
    picked = least_of_strata(rows, quota.select("stratum", "quota"), "digest", "doc_id")
    return join_small(picked, quota, ["stratum"]).select("doc_id", F.col("stratum").alias("lang"), "quota")


register("q64_weighted_mix", oracle=f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, md5(CAST(doc_id AS VARCHAR) || '-{MIX_SEED}') AS h FROM documents),
s AS (SELECT lang, count(*) AS n, CASE lang {" ".join(f"WHEN {lit(k)} THEN {w}" for k, w in MIX_WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY lang),
t AS (SELECT CAST(floor(count(*) * {MIX_FRACTION}::DOUBLE) AS BIGINT) AS total FROM d),
x AS (SELECT lang, n, total, total::DOUBLE * w / sum(w) OVER () AS x FROM s, t),
q AS (SELECT lang, n, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang) <= total - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS q FROM x),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM d)
SELECT doc_id, lang, CAST(least(q, n) AS BIGINT) AS quota FROM r JOIN q USING (lang) WHERE rn <= least(q, n)""")(q64)
