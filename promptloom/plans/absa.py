"""Aspect-sentiment evaluation queries (q27-q33).

q27 re-renders an aspect-annotated corpus (ABSA preparation).  q28-q33 build an
evaluation set from ``labels`` ⋈ ``documents``: each labelled document is a
review with a gold sentiment for each of the six domain-1 aspects, and a
model prediction derived from it with deterministic perturbations (shifted
sentiments, alias aspect names, sentiment synonyms) and injected format errors
(doc_id % 7: 1 missing separator, 2 empty output, 3 repeated aspect, 4 missing
aspect, 5 unknown numerical code, 6 single-quoted dicts; doc_id % 11 = 10: a
label with a missing separator, which counts as no label).  Gold and prediction are rendered in seven
output designs, parsed back, relaxed and scored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.absa import (
    ASPECTS, SENTIMENTS, SOFT_ASPECTS, accuracy, class_scores, confusion, parse_table, relax)
from promptloom.operators.prep import append_instruction
from promptloom.functions.columns import expand_rows
from promptloom.plans.registry import register
from promptloom.session import materialize
from promptloom.plans.sqlutil import lit
from promptloom.sources.tables import table

# The ABSA preparation's old instruction, code -> label table and 20 aspects.
OLD_INSTRUCTION = ("你现在是一个细粒度情感分析模型，请从评论中，抽取出关于以下所有方面的情感倾向"
                   "[\"正向：1\",\"中性:0\",\"负向:-1\",\"未提及:-2\"],评论：")
INT_TO_TEXT = [(-2, "未提及"), (-1, "负面"), (0, "中性"), (1, "正面")]
PREP_ASPECTS = ["交通是否便利", "距离商圈远近", "是否容易寻找", "排队等候时间", "服务人员态度", "是否容易停车",
                "点菜/上菜速度", "价格水平", "性价比", "折扣力度", "装修情况", "嘈杂情况", "就餐空间", "卫生情况",
                "分量", "口感", "外观", "推荐程度", "本次消费感受", "再次消费的意愿"]
NEW_INSTRUCTION = ("\n---\n请对上面这段文字，进行细粒度方面情感分析，具体包括以下这些方面：" + ",".join(PREP_ASPECTS)
                   + "，情感分为四类：正面、负面、中性、未提及。请用json的格式返回结果。")

EVAL_MODES = ["instruction-last", "no-instruction", "numerical-label", "lines-output", "json-output",
              "omit-unmentioned", "cot"]
DICT_MODES = ("json-output", "cot")
DOMAIN = "1"
DEFAULT_PAIR = "D11"  # of any other language, or none
LANG_PAIRS = [("en", "D11"), ("fr", "D22"), ("de", "D12"), ("es", "D21")]
CODES = {"正面": "1", "中性": "0", "负面": "-1", "未提及": "-2"}


def _prep_raw(spark, sf_dir):
    """F13 rows from labels ⋈ documents: quoted text behind the old instruction
    and a 'aspect:int,…' summary (three aspects coded from quality / toxic)."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q, t = F.col("quality"), F.col("toxic")
    summary = F.concat(F.lit("交通是否便利:"), (q - t).cast("string"),
                       F.lit(",价格水平:"), F.when(t == 1, F.lit(-2)).otherwise(q * 2 - 1).cast("string"),
                       F.lit(",卫生情况:"), (t - 2 * (1 - q)).cast("string"))
    return lab.join(docs, "doc_id").select(
        "doc_id", F.concat(F.lit(OLD_INSTRUCTION), F.lit('"'), F.col("text"), F.lit('"')).alias("content"),
        summary.alias("summary"))


def q27(spark, sf_dir):
    """Strip the old instruction and the quotes, append the
    new instruction (aspects comma-joined); summary -> map -> labels -> JSON
    (json.dumps separators, UTF-8 kept); a second target drops 未提及."""
    raw = _prep_raw(spark, sf_dir)
    stripped = F.replace(F.col("content"), F.lit(OLD_INSTRUCTION), F.lit(""))
    text = F.substring(stripped, F.lit(2), F.length(stripped) - 2)
    prompt = append_instruction(text, NEW_INSTRUCTION)
    labels = F.create_map(*[x for k, v in INT_TO_TEXT for x in (F.lit(str(k)), F.lit(v))])
    m = F.transform_values(F.str_to_map(F.col("summary"), F.lit(","), F.lit(":")), lambda k, v: F.element_at(labels, v))

    def to_json_text(mp):
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(mp), lambda e: F.concat(
            F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))), ", "), F.lit("}"))

    return raw.select("doc_id", F.md5(prompt).alias("prompt_md5"), to_json_text(m).alias("output"),
                      to_json_text(F.map_filter(m, lambda k, v: v != "未提及")).alias("output_mentioned"))


def _sql_label(code: str) -> str:
    return "CASE " + code + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INT_TO_TEXT) + " END"


register("q27_absa_prep", oracle=f"""
WITH raw AS (
  SELECT l.doc_id, {lit(OLD_INSTRUCTION)} || '"' || d.text || '"' AS content,
         '交通是否便利:' || (l.quality - l.toxic) || ',价格水平:' || (CASE WHEN l.toxic = 1 THEN -2 ELSE l.quality * 2 - 1 END)
         || ',卫生情况:' || (l.toxic - 2 * (1 - l.quality)) AS summary
  FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT doc_id, replace(content, {lit(OLD_INSTRUCTION)}, '') AS t, summary FROM raw),
e AS (SELECT doc_id, generate_subscripts(items, 1) AS i, string_split(unnest(items), ':') AS kv
      FROM (SELECT doc_id, string_split(summary, ',') AS items FROM p)),
j AS (SELECT doc_id,
             '{{' || string_agg('"' || kv[1] || '": "' || {_sql_label('kv[2]')} || '"', ', ' ORDER BY i) || '}}' AS output,
             '{{' || coalesce(string_agg('"' || kv[1] || '": "' || {_sql_label('kv[2]')} || '"', ', ' ORDER BY i)
                    FILTER (WHERE {_sql_label('kv[2]')} <> '未提及'), '') || '}}' AS output_mentioned
      FROM e GROUP BY doc_id)
SELECT p.doc_id, md5(substr(p.t, 2, length(p.t) - 2) || {lit(NEW_INSTRUCTION)}) AS prompt_md5, j.output, j.output_mentioned
FROM p JOIN j USING (doc_id)""")(q27)


# ---------------------------------------------------------------- evaluation set

def eval_samples(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return lab.join(docs, "doc_id").select("doc_id", "quality", "toxic", "lang")


def _units(s):
    aspects = F.array(*[F.lit(a) for a in ASPECTS[DOMAIN]])
    aliases = F.array(*[F.lit(a if isinstance(a, str) else a[0]) for a in SOFT_ASPECTS[DOMAIN]])
    senti = F.array(*[F.lit(x) for x in SENTIMENTS])
    doc, e = F.col("doc_id"), F.col("doc_id") % 7
    gidx = lambda k: (F.col("quality") + 2 * F.col("toxic") + k + doc) % 4
    pidx = lambda k: (gidx(k) + F.when((doc + k) % 5 == 0, 1).otherwise(0)) % 4
    at = lambda arr, i: F.element_at(arr, (i + 1).cast("int"))

    def unit(k, key, val, canon, nosep, badcode):
        return F.struct(k.cast("int").alias("k"), key.alias("key"), val.alias("val"), canon.alias("canon"),
                        nosep.alias("nosep"), badcode.alias("badcode"))

    ks = F.sequence(F.lit(0), F.lit(len(ASPECTS[DOMAIN]) - 1))
    gold = F.transform(ks, lambda k: unit(k, at(aspects, k), at(senti, gidx(k)), at(senti, gidx(k)),
                                          (doc % 11 == 10) & (k == 0), F.lit(False)))

    def pred_unit(k):
        canon = at(senti, pidx(k))
        key = F.when((doc + k) % 6 == 0, at(aliases, k)).otherwise(at(aspects, k))
        val = (F.when(((doc + k) % 9 == 0) & (canon == "正面"), F.lit("积极"))
               .when(((doc + k) % 9 == 0) & (canon == "负面"), F.lit("消极")).otherwise(canon))
        return unit(k, key, val, canon, (e == 1) & (k == 0), (e == 5) & (k == 0))

    base = F.transform(ks, pred_unit)
    dup_canon = at(senti, (pidx(F.lit(0)) + 1) % 4)
    dup = F.array(unit(F.lit(6), F.element_at(base, 1)["key"], dup_canon, dup_canon, F.lit(False), F.lit(False)))
    pred = (F.when(e == 4, F.slice(base, 1, len(ASPECTS[DOMAIN]) - 1))
            .when(e == 3, F.concat(base, dup)).otherwise(base))
    return gold, pred


def _render(units, mode):
    if mode == "omit-unmentioned":
        units = F.filter(units, lambda u: u["canon"] != "未提及")
    code_map = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])

    def kv(u, value):
        return F.concat(u["key"], F.when(u["nosep"], F.lit("")).otherwise(F.lit("：")), value)

    if mode in ("instruction-last", "no-instruction", "omit-unmentioned"):
        return F.concat(F.array_join(F.transform(units, lambda u: kv(u, u["val"])), "，"), F.lit("。"))
    if mode == "numerical-label":
        return F.concat(F.array_join(F.transform(units, lambda u: kv(u, F.when(u["badcode"], F.lit("7"))
                                                                      .otherwise(F.element_at(code_map, u["canon"])))),
                                     "，"), F.lit("。"))
    if mode == "lines-output":
        return F.array_join(F.transform(units, lambda u: kv(u, u["val"])), "\n")

    def obj(u, with_desc):
        desc = F.concat(F.lit('", "描述": "d'), u["k"].cast("string")) if with_desc else F.lit("")
        return F.concat(F.lit('{"方面": "'), u["key"], desc, F.lit('", "情感": "'), u["val"], F.lit('"'),
                        F.when(u["nosep"], F.lit("")).otherwise(F.lit("}")))

    if mode == "json-output":
        return F.array_join(F.transform(units, lambda u: obj(u, False)), "\n")
    if mode == "cot":
        return F.array_join(F.transform(units, lambda u: obj(u, True)), ", ")
    raise ValueError(mode)


def rendered(spark, sf_dir):
    """(doc_id, lang, mode, target, prediction) for every sample × design."""
    s = eval_samples(spark, sf_dir)
    gold, pred = _units(s)
    s = s.select("doc_id", "lang", gold.alias("gold_u"), pred.alias("pred_u"))
    x = expand_rows(s, [(m,) for m in EVAL_MODES], ["mode"])
    tgt = pr = None
    for m in EVAL_MODES:
        c = F.col("mode") == m
        tgt = F.when(c, _render(F.col("gold_u"), m)) if tgt is None else tgt.when(c, _render(F.col("gold_u"), m))
        pr = F.when(c, _render(F.col("pred_u"), m)) if pr is None else pr.when(c, _render(F.col("pred_u"), m))
    kind = F.col("doc_id") % 7
    pr = F.when((kind == 6) & F.col("mode").isin(*DICT_MODES), F.translate(pr, '"', "'")).otherwise(pr)
    return materialize(x.select("doc_id", "lang", "mode", tgt.alias("target"),
                                F.when(kind == 2, F.lit("")).otherwise(pr).alias("prediction")))


def parsed(spark, sf_dir, r=None):
    """(entries, errors) of labels and predictions; side 'raw' is the
    prediction parsed without punctuation repair (used for cot error counts)."""
    r = rendered(spark, sf_dir) if r is None else r
    keys = ["doc_id", "lang", "mode", "side"]
    texts = (r.select("doc_id", "lang", "mode", F.lit("label").alias("side"), F.col("target").alias("text"))
             .unionByName(r.select("doc_id", "lang", "mode", F.lit("pred").alias("side"),
                                   F.col("prediction").alias("text"))))
    entries, errors = parse_table(texts, keys, "text", "mode", EVAL_MODES, domain=DOMAIN)
    raw = r.filter(F.col("mode") == "cot").select("doc_id", "lang", "mode", F.lit("raw").alias("side"),
                                                  F.col("prediction").alias("text"))
    _, raw_err = parse_table(raw, keys, "text", "mode", ["cot"], punc_replace=False)
    return materialize(entries), errors.unionByName(raw_err)  # errors are read from the stored parse


def pick_by(key, table_, default):
    """The value of a small fixed (key, value) table, or the default."""
    out = F.lit(default)
    for k, v in reversed(table_):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def q28(spark, sf_dir):
    """Parsed prediction and label dicts (pos:key=value in output order),
    the prediction's error type, and its error type without punctuation repair."""
    entries, errors = parsed(spark, sf_dir)
    keys = ["doc_id", "mode"]
    txt = (entries.groupBy(*keys, "side")
           .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "value"))).alias("_e"))
           .select(*keys, "side", F.array_join(F.transform("_e", lambda e: F.concat(
               e["pos"].cast("string"), F.lit(":"), e["key"], F.lit("="), e["value"])), ";").alias("t")))
    wide_t = txt.groupBy(*keys).pivot("side", ["pred", "label"]).agg(F.first("t"))
    wide_e = errors.groupBy(*keys).pivot("side", ["pred", "raw"]).agg(F.first("error_type"))
    j = wide_e.join(wide_t.withColumnRenamed("pred", "t_pred").withColumnRenamed("label", "t_label"), keys, "left")
    return j.select(*keys, F.col("pred").alias("error_type"),
                    F.coalesce(F.col("t_pred"), F.lit("")).alias("parsed"),
                    F.coalesce(F.col("t_label"), F.lit("")).alias("label_parsed"),
                    F.coalesce(F.col("raw"), F.col("pred")).alias("error_norepair"))


SAMPLE = ["doc_id", "lang", "mode"]


def evaluated(spark, sf_dir):
    """(pairs, errors, samples), each built once: M7-M10 pairs (doc_id, lang,
    mode, aspect, label, pred) after soft relaxation, the parse errors, and the
    keys of all samples.  A label that does not parse without error counts as no
    label: its sample has no pairs."""
    r = rendered(spark, sf_dir)
    entries, errors = parsed(spark, sf_dir, r)
    pred_e = entries.filter(F.col("side") == "pred").select(*SAMPLE, "pos", "key", "value")
    rel = relax(pred_e, r.select(*SAMPLE), SAMPLE, spark, DOMAIN)
    told = errors.filter((F.col("side") == "label") & (F.col("error_type") == "")).select(*SAMPLE)
    lab = (entries.filter(F.col("side") == "label").select(*SAMPLE, F.col("key").alias("aspect"), F.col("value").alias("label"))
           .join(told, SAMPLE, "left_semi"))
    out = materialize(lab.join(rel, SAMPLE + ["aspect"]).select(*SAMPLE, "aspect", "label", "pred"))
    return out, errors, r.select(*SAMPLE)


def pairs(spark, sf_dir):
    return evaluated(spark, sf_dir)[0]


def q29(spark, sf_dir):
    return pairs(spark, sf_dir).drop("lang")


def q30(spark, sf_dir):
    """A10: dense 4×4 matrices per design, per aspect and ALL."""
    return confusion(pairs(spark, sf_dir), ["mode"], spark, ASPECTS[DOMAIN])


def q31(spark, sf_dir):
    """Per-class precision / recall and weighted kappa."""
    return class_scores(confusion(pairs(spark, sf_dir), ["mode"], spark, ASPECTS[DOMAIN]), ["mode"])


def q32(spark, sf_dir):
    """Sentence and aspect accuracy per design."""
    pr, _, samples = evaluated(spark, sf_dir)
    return accuracy(pr, ["mode"], ["doc_id"], samples)


def q33(spark, sf_dir):
    """Result grid, design rows × domain-pair columns of kappa (ALL),
    wrong-format count and accuracy (ALL).  Domain pairs are languages; the
    no-instruction design has no out-of-domain cells (null)."""
    pr, errors, _ = evaluated(spark, sf_dir)
    dpair = pick_by(F.col("lang"), LANG_PAIRS, DEFAULT_PAIR)
    pr = pr.withColumn("dpair", dpair)
    k = class_scores(confusion(pr, ["mode", "dpair"], spark, ASPECTS[DOMAIN]), ["mode", "dpair"])
    k = k.filter(F.col("aspect") == "ALL").select("mode", "dpair", "kappa").distinct()
    a = accuracy(pr, ["mode", "dpair"], ["doc_id"]).filter(F.col("aspect") == "ALL").select("mode", "dpair", "acc")
    e = errors.filter(((F.col("mode") == "cot") & (F.col("side") == "raw"))
                      | ((F.col("mode") != "cot") & (F.col("side") == "pred")))
    wf = (e.withColumn("dpair", dpair).groupBy("mode", "dpair")
          .agg(F.count_if(F.col("error_type") != "").cast("long").alias("wf")))
    cells = k.join(a, ["mode", "dpair"]).join(wf, ["mode", "dpair"])
    skip = (F.col("mode") == "no-instruction") & F.col("dpair").isin("D12", "D21")
    cells = cells.select("mode", "dpair", *[F.when(skip, F.lit(None)).otherwise(F.col(c)).alias(c)
                                            for c in ("kappa", "wf", "acc")])
    grid = cells.groupBy("mode").pivot("dpair", [d for _, d in LANG_PAIRS]).agg(
        F.first("kappa").alias("k"), F.first("wf").alias("wf"), F.first("acc").alias("a"))
    return grid


for _name, _fn in [("q28_absa_parse", q28), ("q29_absa_relax", q29), ("q30_confusion", q30),
                   ("q31_kappa", q31), ("q32_accuracy", q32), ("q33_result_grid", q33)]:
    register(_name)(_fn)


# ---------------------------------------------------------------- DuckDB oracle

def _arr(xs):
    return "[" + ", ".join(lit(x) for x in xs) + "]"


_ASP = _arr(ASPECTS[DOMAIN])
_ALI = _arr([a if isinstance(a, str) else a[0] for a in SOFT_ASPECTS[DOMAIN]])
_SEN = _arr(SENTIMENTS)
_CODE = "CASE canon " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " END"
_UNCODE = "CASE parts[2] " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in CODES.items()) + " END"
_ALIASES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS a_pos, {lit(a)} AS aspect, {lit(x)} AS alias"
    for i, (a, s) in enumerate(zip(ASPECTS[DOMAIN], SOFT_ASPECTS[DOMAIN])) for x in (s if isinstance(s, list) else [s]))
_SOFT_SQL = "CASE " + " ".join(f"WHEN contains(value, {lit(a)}) THEN {lit(b)}"
                               for a, b in __import__("promptloom.operators.absa", fromlist=["x"]).SOFT_SENTIMENT) \
    + " ELSE value END"
_REPAIR_SQL = "text"
for _a, _b in __import__("promptloom.operators.absa", fromlist=["x"]).PUNCT_REPAIRS:
    _REPAIR_SQL = f"replace({_REPAIR_SQL}, {lit(_a)}, {lit(_b)})"
_MODES_SQL = ", ".join(f"({lit(m)})" for m in EVAL_MODES)
_W_SQL = " UNION ALL ".join(
    f"SELECT {lit(SENTIMENTS[i])} AS label, {lit(SENTIMENTS[j])} AS pred, CAST({w} AS DOUBLE) AS w"
    for i, row in enumerate(__import__("promptloom.operators.absa", fromlist=["x"]).KAPPA_WEIGHTS)
    for j, w in enumerate(row))

ABSA_SQL = f"""
s AS (SELECT l.doc_id, l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id)),
u AS (SELECT s.*, k, (quality + 2 * toxic + k + doc_id) % 4 AS gidx FROM s, range(0, {len(ASPECTS[DOMAIN])}) r(k)),
u2 AS (SELECT *, (gidx + CASE WHEN (doc_id + k) % 5 = 0 THEN 1 ELSE 0 END) % 4 AS pidx FROM u),
units AS (
  SELECT doc_id, lang, 'label' AS side, k, {_ASP}[k + 1] AS key, {_SEN}[gidx + 1] AS val, {_SEN}[gidx + 1] AS canon,
         doc_id % 11 = 10 AND k = 0 AS nosep, false AS badcode FROM u2
  UNION ALL
  SELECT doc_id, lang, 'pred', k, CASE WHEN (doc_id + k) % 6 = 0 THEN {_ALI}[k + 1] ELSE {_ASP}[k + 1] END,
         CASE WHEN (doc_id + k) % 9 = 0 AND {_SEN}[pidx + 1] = '正面' THEN '积极'
              WHEN (doc_id + k) % 9 = 0 AND {_SEN}[pidx + 1] = '负面' THEN '消极' ELSE {_SEN}[pidx + 1] END,
         {_SEN}[pidx + 1], doc_id % 7 = 1 AND k = 0, doc_id % 7 = 5 AND k = 0
  FROM u2 WHERE NOT (doc_id % 7 = 4 AND k = {len(ASPECTS[DOMAIN]) - 1})
  UNION ALL
  SELECT doc_id, lang, 'pred', 6, CASE WHEN doc_id % 6 = 0 THEN {_ALI}[1] ELSE {_ASP}[1] END,
         {_SEN}[(pidx + 1) % 4 + 1], {_SEN}[(pidx + 1) % 4 + 1], false, false
  FROM u2 WHERE k = 0 AND doc_id % 7 = 3),
mu AS (SELECT units.*, m.mode FROM units, (VALUES {_MODES_SQL}) m(mode)),
ut AS (
  SELECT *, CASE
    WHEN mode = 'numerical-label' THEN key || CASE WHEN nosep THEN '' ELSE '：' END || CASE WHEN badcode THEN '7' ELSE {_CODE} END
    WHEN mode = 'json-output' THEN '{{"方面": "' || key || '", "情感": "' || val || '"' || CASE WHEN nosep THEN '' ELSE '}}' END
    WHEN mode = 'cot' THEN '{{"方面": "' || key || '", "描述": "d' || k || '", "情感": "' || val || '"' || CASE WHEN nosep THEN '' ELSE '}}' END
    ELSE key || CASE WHEN nosep THEN '' ELSE '：' END || val END AS ut
  FROM mu WHERE NOT (mode = 'omit-unmentioned' AND canon = '未提及')),
smp AS (SELECT s.doc_id, m.mode FROM s CROSS JOIN (VALUES {_MODES_SQL}) m(mode)),
texts AS (
  SELECT doc_id, lang, mode, side,
         CASE WHEN side = 'pred' AND doc_id % 7 = 6 AND mode IN ('json-output', 'cot') THEN replace(text, '"', '\'\'') ELSE text END AS text
  FROM (SELECT s.doc_id, s.lang, m.mode, sd.side,
    CASE WHEN sd.side = 'pred' AND s.doc_id % 7 = 2 THEN ''
         WHEN m.mode IN ('lines-output', 'json-output') THEN coalesce(string_agg(ut.ut, chr(10) ORDER BY ut.k), '')
         WHEN m.mode = 'cot' THEN coalesce(string_agg(ut.ut, ', ' ORDER BY ut.k), '')
         ELSE coalesce(string_agg(ut.ut, '，' ORDER BY ut.k), '') || '。' END AS text
  FROM s CROSS JOIN (VALUES {_MODES_SQL}) m(mode) CROSS JOIN (VALUES ('label'), ('pred')) sd(side)
  LEFT JOIN ut ON ut.doc_id = s.doc_id AND ut.mode = m.mode AND ut.side = sd.side
  GROUP BY s.doc_id, s.lang, m.mode, sd.side)),
t2 AS (
  SELECT doc_id, lang, mode, side, text, text AS ptext FROM texts
  UNION ALL
  SELECT doc_id, lang, mode, 'raw', text, text FROM texts WHERE side = 'pred' AND mode = 'cot'),
t3 AS (
  SELECT doc_id, lang, mode, side, text,
    CASE WHEN mode IN ('lines-output', 'json-output') OR (mode = 'cot' AND side = 'raw') THEN string_split(trim(text, chr(10)), chr(10))
         WHEN mode = 'cot' THEN string_split(trim({_REPAIR_SQL}, chr(10)), chr(10))
         ELSE string_split(trim(text, '。'), '，') END AS us
  FROM t2),
pu AS (
  SELECT doc_id, lang, mode, side, text, i, u, CASE WHEN mode IN ('json-output', 'cot') AND strpos(u, '"') = 0 THEN replace(u, '\'\'', '"') ELSE u END AS uq
  FROM (SELECT doc_id, lang, mode, side, text, generate_subscripts(us, 1) - 1 AS i, unnest(us) AS u FROM t3 WHERE text <> '')),
pk AS (
  SELECT *, string_split(u, '：') AS parts,
         list_transform(string_split(regexp_replace(u, '^["{{}}]+|["{{}}]+$', '', 'g'), '", "'), lambda p: string_split(p, '": "')) AS kv,
         regexp_matches(uq, '^\\s*\\{{[^{{}}]*\\}}\\s*$') AND json_valid(uq) AND (CASE WHEN json_valid(uq) THEN json_extract_string(uq, '$."方面"') END) IS NOT NULL
           AND (CASE WHEN json_valid(uq) THEN json_extract_string(uq, '$."情感"') END) IS NOT NULL AS strict
  FROM pu WHERE NOT (mode = 'omit-unmentioned' AND u = '')),
pv AS (
  SELECT doc_id, lang, mode, side, i,
    CASE WHEN mode IN ('json-output', 'cot') THEN CASE WHEN strict THEN (CASE WHEN json_valid(uq) THEN json_extract_string(uq, '$."方面"') END) ELSE list_filter(kv, lambda p: p[1] = '方面')[-1][2] END
         ELSE parts[1] END AS key,
    CASE WHEN mode IN ('json-output', 'cot') THEN CASE WHEN strict THEN (CASE WHEN json_valid(uq) THEN json_extract_string(uq, '$."情感"') END) ELSE list_filter(kv, lambda p: p[1] = '情感')[-1][2] END
         WHEN mode = 'numerical-label' THEN {_UNCODE}
         ELSE parts[2] END AS value,
    CASE WHEN mode IN ('json-output', 'cot') THEN CASE WHEN strict THEN ''
              WHEN list_filter(kv, lambda p: p[1] = '方面')[-1][2] IS NOT NULL AND list_filter(kv, lambda p: p[1] = '情感')[-1][2] IS NOT NULL THEN 'eval_error'
              ELSE 'split_error' END
         WHEN len(parts) >= 2 AND (mode <> 'numerical-label' OR {_UNCODE} IS NOT NULL) THEN ''
         ELSE 'split_error' END AS err
  FROM pk),
errs AS (
  SELECT t.doc_id, t.lang, t.mode, t.side,
         CASE WHEN t.text = '' THEN 'empty_output' ELSE coalesce(arg_max(pv.err, pv.i) FILTER (WHERE pv.err <> ''), '') END AS error_type
  FROM t2 t LEFT JOIN pv USING (doc_id, lang, mode, side) GROUP BY t.doc_id, t.lang, t.mode, t.side, t.text),
ali AS ({_ALIASES_SQL}),
asp AS (SELECT DISTINCT a_pos, aspect FROM ali),
ent AS (
  SELECT doc_id, lang, mode, side, key, min(i) AS pos, arg_max(value, ord) AS value FROM (
    SELECT doc_id, lang, mode, side, key, i, value, i AS ord FROM pv WHERE err = '' OR (err = 'eval_error')
    UNION ALL  -- the omit-unmentioned design says 未提及 by leaving an aspect out, in labels as in predictions
    SELECT t3.doc_id, t3.lang, t3.mode, t3.side, asp.aspect, len(list_filter(t3.us, lambda x: x <> '')) + asp.a_pos, '未提及', -1
    FROM t3, asp WHERE t3.mode = 'omit-unmentioned' AND t3.text <> '')
  GROUP BY doc_id, lang, mode, side, key),
rel0 AS (
  SELECT e.doc_id, e.lang, e.mode, a.aspect, arg_min(e.value, e.pos) AS value
  FROM ent e JOIN ali a ON contains(e.key, a.alias) WHERE e.side = 'pred' GROUP BY e.doc_id, e.lang, e.mode, a.aspect),
rel AS (
  SELECT s.doc_id, s.lang, m.mode, asp.aspect,
         CASE WHEN ({_SOFT_SQL.replace('value', 'r.value')}) IN ('正面', '中性', '负面', '未提及') THEN ({_SOFT_SQL.replace('value', 'r.value')}) ELSE '未提及' END AS pred
  FROM s CROSS JOIN (VALUES {_MODES_SQL}) m(mode) CROSS JOIN asp
  LEFT JOIN rel0 r ON r.doc_id = s.doc_id AND r.mode = m.mode AND r.aspect = asp.aspect),
pairs AS (
  SELECT l.doc_id, l.lang, l.mode, l.key AS aspect, l.value AS label, rel.pred
  FROM ent l JOIN rel ON rel.doc_id = l.doc_id AND rel.mode = l.mode AND rel.aspect = l.key
  JOIN errs el ON el.doc_id = l.doc_id AND el.mode = l.mode AND el.side = 'label' AND el.error_type = ''
  WHERE l.side = 'label')"""

_Q28 = f"""WITH {ABSA_SQL},
tx AS (SELECT doc_id, mode, side, string_agg(pos || ':' || key || '=' || value, ';' ORDER BY pos) AS t FROM ent GROUP BY doc_id, mode, side)
SELECT e.doc_id, e.mode, e.error_type, coalesce(tp.t, '') AS parsed, coalesce(tl.t, '') AS label_parsed,
       coalesce(er.error_type, e.error_type) AS error_norepair
FROM errs e
LEFT JOIN tx tp ON tp.doc_id = e.doc_id AND tp.mode = e.mode AND tp.side = 'pred'
LEFT JOIN tx tl ON tl.doc_id = e.doc_id AND tl.mode = e.mode AND tl.side = 'label'
LEFT JOIN errs er ON er.doc_id = e.doc_id AND er.mode = e.mode AND er.side = 'raw'
WHERE e.side = 'pred'"""

_Q29 = f"WITH {ABSA_SQL} SELECT doc_id, mode, aspect, label, pred FROM pairs"

_MATRIX_SQL = f""",
grid AS (SELECT a.aspect, l.x AS label, p.x AS pred FROM (SELECT aspect FROM asp UNION ALL SELECT 'ALL') a,
         (SELECT unnest({_SEN}) AS x) l, (SELECT unnest({_SEN}) AS x) p),
cnt AS (SELECT mode, aspect, label, pred, count(*) AS n FROM pairs GROUP BY mode, aspect, label, pred
        UNION ALL SELECT mode, 'ALL', label, pred, count(*) FROM pairs GROUP BY mode, label, pred),
mat AS (SELECT g.mode, grid.aspect, grid.label, grid.pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
        FROM (SELECT DISTINCT mode FROM pairs) g CROSS JOIN grid
        LEFT JOIN cnt c ON c.mode = g.mode AND c.aspect = grid.aspect AND c.label = grid.label AND c.pred = grid.pred)"""

_Q30 = f"WITH {ABSA_SQL}{_MATRIX_SQL} SELECT mode, aspect, label, pred, n FROM mat"

_SCORES_SQL = f""",
w AS ({_W_SQL}),
rs AS (SELECT mode, aspect, label, sum(n) AS la_num FROM mat GROUP BY ALL),
cs AS (SELECT mode, aspect, pred, sum(n) AS pre_num FROM mat GROUP BY ALL),
tot AS (SELECT m.mode, m.aspect, sum(m.n) AS nn, sum(m.n * w.w) AS po_num FROM mat m JOIN w USING (label, pred) GROUP BY ALL),
pe AS (SELECT m.mode, m.aspect, sum(rs.la_num * cs.pre_num * w.w) AS pe_num FROM mat m JOIN w USING (label, pred)
       JOIN rs ON rs.mode = m.mode AND rs.aspect = m.aspect AND rs.label = m.label
       JOIN cs ON cs.mode = m.mode AND cs.aspect = m.aspect AND cs.pred = m.pred GROUP BY ALL),
kp AS (SELECT tot.mode, tot.aspect,
              round(CASE WHEN nn = 0 THEN NULL WHEN pe_num / (nn * nn) = 1 THEN 0.0
                    ELSE (po_num / nn - pe_num / (nn * nn)) / (1 - pe_num / (nn * nn)) END, 4) AS kappa
       FROM tot JOIN pe USING (mode, aspect)),
sc AS (SELECT d.mode, d.aspect, d.label AS cls, CAST(cs.pre_num AS BIGINT) AS pre_num, CAST(rs.la_num AS BIGINT) AS la_num,
              CASE WHEN cs.pre_num = 0 THEN 'NaN'::DOUBLE ELSE round(d.n / cs.pre_num, 4) END AS precision,
              CASE WHEN rs.la_num = 0 THEN 'NaN'::DOUBLE ELSE round(d.n / rs.la_num, 4) END AS recall, kp.kappa
       FROM mat d JOIN rs ON rs.mode = d.mode AND rs.aspect = d.aspect AND rs.label = d.label
       JOIN cs ON cs.mode = d.mode AND cs.aspect = d.aspect AND cs.pred = d.label
       JOIN kp ON kp.mode = d.mode AND kp.aspect = d.aspect WHERE d.label = d.pred)"""

_Q31 = f"WITH {ABSA_SQL}{_MATRIX_SQL}{_SCORES_SQL} SELECT * FROM sc"

_ACC_SQL = """,
acc AS (
  SELECT mode, aspect, CAST(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS BIGINT) AS correct,
         CAST(sum(CASE WHEN label = pred THEN 0 ELSE 1 END) AS BIGINT) AS incorrect FROM pairs GROUP BY mode, aspect
  UNION ALL
  SELECT mode, 'ALL', CAST(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS BIGINT),
         CAST(sum(CASE WHEN label = pred THEN 0 ELSE 1 END) AS BIGINT) FROM pairs GROUP BY mode
  UNION ALL
  SELECT mode, 'sentence', CAST(sum(ok) AS BIGINT), CAST(count(*) - sum(ok) AS BIGINT)
  FROM (SELECT a.mode, a.doc_id, coalesce(b.ok, 0) AS ok FROM smp a LEFT JOIN (
          SELECT mode, doc_id, min(CASE WHEN label = pred THEN 1 ELSE 0 END) AS ok FROM pairs GROUP BY mode, doc_id) b
        ON a.mode = b.mode AND a.doc_id = b.doc_id) GROUP BY mode)"""

_Q32 = f"WITH {ABSA_SQL}{_ACC_SQL} SELECT mode, aspect, correct, incorrect, round(correct / (correct + incorrect), 4) AS acc FROM acc"

_DP = " UNION ALL ".join(f"SELECT {lit(a)} AS lang, {lit(b)} AS dpair" for a, b in LANG_PAIRS)
_Q33_CELLS = (_Q31.replace("pairs AS (\n  SELECT l.doc_id", "pairs0 AS (\n  SELECT l.doc_id"))


def _q33_sql():
    base = ABSA_SQL.replace("pairs AS (\n  SELECT l.doc_id", "pairs0 AS (\n  SELECT l.doc_id")
    mat = _MATRIX_SQL.replace("mode", "md")
    sql = f"""WITH {base},
dp AS (SELECT l.lang, coalesce(k.dpair, '{DEFAULT_PAIR}') AS dpair FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN ({_DP}) k USING (lang)),
pairs AS (SELECT p.doc_id, p.mode || '|' || dp.dpair AS md, p.aspect, p.label, p.pred FROM pairs0 p JOIN dp USING (lang)),
smp2 AS (SELECT DISTINCT doc_id, md FROM pairs){mat}
{_SCORES_SQL.replace('mode', 'md')}{_ACC_SQL.replace('mode', 'md').replace('FROM smp a', 'FROM smp2 a')},
wf AS (SELECT e.mode || '|' || dp.dpair AS md, count(*) FILTER (WHERE e.error_type <> '') AS wf
       FROM errs e JOIN dp USING (lang)
       WHERE (e.mode = 'cot' AND e.side = 'raw') OR (e.mode <> 'cot' AND e.side = 'pred') GROUP BY ALL),
cells AS (
  SELECT split_part(k.md, '|', 1) AS mode, split_part(k.md, '|', 2) AS dpair, k.kappa, CAST(wf.wf AS BIGINT) AS wf,
         round(a.correct / (a.correct + a.incorrect), 4) AS acc
  FROM (SELECT DISTINCT md, kappa FROM sc WHERE aspect = 'ALL') k JOIN wf USING (md)
  JOIN acc a ON a.md = k.md AND a.aspect = 'ALL'),
c2 AS (SELECT mode, dpair,
              CASE WHEN mode = 'no-instruction' AND dpair IN ('D12', 'D21') THEN NULL ELSE kappa END AS kappa,
              CASE WHEN mode = 'no-instruction' AND dpair IN ('D12', 'D21') THEN NULL ELSE wf END AS wf,
              CASE WHEN mode = 'no-instruction' AND dpair IN ('D12', 'D21') THEN NULL ELSE acc END AS acc FROM cells)
SELECT mode, """ + ", ".join(f"max(kappa) FILTER (WHERE dpair = '{d}') AS {d}_k, max(wf) FILTER (WHERE dpair = '{d}') AS {d}_wf, "
                             f"max(acc) FILTER (WHERE dpair = '{d}') AS {d}_a" for _, d in LANG_PAIRS) + " FROM c2 GROUP BY mode"
    return sql


for _name, _sql in [("q28_absa_parse", _Q28), ("q29_absa_relax", _Q29), ("q30_confusion", _Q30),
                    ("q31_kappa", _Q31), ("q32_accuracy", _Q32), ("q33_result_grid", _q33_sql())]:
    from promptloom.plans.registry import ORACLES as _O
    _O[_name] = _sql
