"""Aspect-sentiment output parsing, relaxation and scoring.

A parsed output is an array<struct<pos, key, value>> with dict semantics (a
repeated key keeps its last value at its first position) plus an error type;
parsing is per row (no shuffle).  Relaxation and scoring are joins against
fixed, broadcast dimension tables and ordinary aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.columns import expand_rows
from promptloom.session import materialize

# Sentiment classes (matrix order), numerical codes, aspect lists of the two
# restaurant-review domains with their relaxed aliases, sentiment synonyms (checked in this
# order), the weighted-kappa weight table, and the punctuation repairs applied before parsing
# chain-of-thought outputs.
SENTIMENTS = ["正面", "中性", "负面", "未提及"]
NUMERIC_LABELS = {"1": "正面", "0": "中性", "-1": "负面", "-2": "未提及"}
ASPECTS = {
    "1": ["食品评价", "饮品评价", "价格水平", "卫生情况", "服务人员态度", "停车方便程度"],
    "2": ["交通便利程度", "排队等候情况", "点菜上菜速度", "装修情况", "嘈杂情况"],
}
SOFT_ASPECTS = {
    "1": ["食品", "饮品", "价格", "卫生", "服务", "停车"],
    "2": ["交通", ["排队", "等候"], "点菜", "装修", "嘈杂"],
}
SOFT_SENTIMENT = [("积极", "正面"), ("正向", "正面"), ("正面", "正面"), ("中性", "中性"), ("消极", "负面"),
                  ("负向", "负面"), ("负面", "负面"), ("未提及", "未提及")]
KAPPA_WEIGHTS = [[1, 0.5, 0, 0.5], [0.67, 1, 0.67, 0.67], [0, 0.5, 1, 0.5], [0.5, 0.67, 0.5, 1]]
PUNCT_REPAIRS = [("}, {", "}\n{"), ("},\n{", "}\n{"), ("}, \n{", "}\n{"),
                 ("\"， \"", "\", \""), ("\"; \"", "\", \""), ("\" ; \"", "\", \""), ("\"}, \"", "\", \""),
                 ("\"},\"", "\", \"")]

INLINE_MODES = ("instruction-last", "instruction-first", "no-instruction", "input-modeling")
LINE_MODES = ("lines-output", "ES-SDE")
JSON_MODES = ("json-output", "cot", "rev-cot")
OMIT_MODES = ("omit-unmentioned", "EW-SDE")
NUMERIC_MODES = ("numerical-label",)


def _strip_chars(c: Column, chars: str) -> Column:
    cls = "".join("\\" + ch if ch in "[]\\^-" else ch for ch in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def repair_punctuation(text: Column) -> Column:
    """The literal replacements applied to cot / rev-cot outputs."""
    for a, b in PUNCT_REPAIRS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _kv_units(units: Column, numeric: bool, skip_empty: bool) -> Column:
    """Units 'key：value' -> array<struct<i, ok, key, value, err>>."""
    codes = F.create_map(*[x for k, v in NUMERIC_LABELS.items() for x in (F.lit(k), F.lit(v))])
    n = F.size(units)
    z = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), units.alias("u"))

    def one(x):
        parts = F.split(x["u"], "：")
        ok = F.size(parts) >= 2
        val = F.get(parts, 1)
        if numeric:
            val = F.try_element_at(codes, val)
            ok = ok & val.isNotNull()
        return F.struct(x["i"].alias("i"), ok.alias("ok"), F.get(parts, 0).alias("key"), val.alias("value"),
                        F.when(ok, F.lit("")).otherwise(F.lit("split_error")).alias("err"))

    arr = F.transform(z, one)
    if skip_empty:
        arr = F.filter(F.transform(z, lambda x: F.struct(x["u"].alias("u"), one(x).alias("r"))),
                       lambda y: y["u"] != "")
        arr = F.transform(arr, lambda y: y["r"])
    return arr


def _json_units(lines: Column) -> Column:
    """One dict per line; on failure the '"k": "v"' fallback scan.
    Each line is JSON-parsed once (first transform), then interpreted."""
    n = F.size(lines)
    z = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), lines.alias("u"))
    first = F.transform(z, lambda x: F.struct(
        x["i"].alias("i"), x["u"].alias("u"),
        F.from_json(x["u"], "`方面` string, `情感` string", {"allowSingleQuotes": "true"}).alias("j")))

    def one(x):
        j = x["j"]
        strict = x["u"].rlike(r"^\s*\{[^{}]*\}\s*$") & j["方面"].isNotNull() & j["情感"].isNotNull()
        kv = F.transform(F.split(_strip_chars(x["u"], '"{}'), '", "'), lambda p: F.split(p, '": "'))
        asp = F.try_element_at(F.filter(kv, lambda p: F.get(p, 0) == "方面"), F.lit(-1))
        sen = F.try_element_at(F.filter(kv, lambda p: F.get(p, 0) == "情感"), F.lit(-1))
        fb_ok = F.coalesce(F.get(asp, 1).isNotNull() & F.get(sen, 1).isNotNull(), F.lit(False))
        return F.struct(x["i"].alias("i"), (strict | fb_ok).alias("ok"),
                        F.when(strict, j["方面"]).otherwise(F.get(asp, 1)).alias("key"),
                        F.when(strict, j["情感"]).otherwise(F.get(sen, 1)).alias("value"),
                        F.when(strict, F.lit("")).when(fb_ok, F.lit("eval_error"))
                        .otherwise(F.lit("split_error")).alias("err"))

    return F.transform(first, one)


def parse_units(text: Column, mode: str, punc_replace: bool = True) -> Column:
    """array<struct<i, ok, key, value, err>>, one element per output unit
    (comma-separated pair, line, or JSON line) of ``mode``; [] for ''.
    Lambdas only see their own element, so each unit is parsed once."""
    if mode in INLINE_MODES or mode in OMIT_MODES or mode in NUMERIC_MODES:
        units = _kv_units(F.split(_strip_chars(text, "。"), "，"), mode in NUMERIC_MODES, mode in OMIT_MODES)
    elif mode in LINE_MODES:
        units = _kv_units(F.split(_strip_chars(text, "\n"), "\n"), False, False)
    elif mode in JSON_MODES:
        t = repair_punctuation(text) if (mode != "json-output" and punc_replace) else text
        units = _json_units(F.split(_strip_chars(t, "\n"), "\n"))
    else:
        raise ValueError(mode)
    return F.when(text == "", F.array().cast(
        "array<struct<i:int,ok:boolean,key:string,value:string,err:string>>")).otherwise(units)


def error_type(text: Column, units: Column) -> Column:
    """X8: '', empty_output, or the error of the last failing unit."""
    errs = F.filter(F.transform(units, lambda u: u["err"]), lambda e: e != "")
    return F.when(text == "", F.lit("empty_output")).otherwise(F.coalesce(F.try_element_at(errs, F.lit(-1)), F.lit("")))


def parse_table(df: DataFrame, keys: list[str], text_col: str, mode_col: str, modes: list[str],
                punc_replace: bool = True, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse a text column into (entries, errors).

    entries: keys + (pos, key, value) with dict semantics (a repeated key keeps
    its last value at its first position) -- an aggregation on (keys, key) with
    map-side combining; errors: keys + error_type, computed on the row.  Each
    mode is parsed in its own branch, so a row meets one parser only, and what was
    read is stored: entries and errors come from one parse of a text.

    X2: with a ``domain``, the omit-unmentioned designs are completed: every
    aspect of the domain that a non-empty text leaves out is 未提及, after the
    text's own entries."""
    u = None
    for m in modes:
        part = df.filter(F.col(mode_col) == m).select(*keys, F.col(text_col).alias("_text"),
                                                      parse_units(F.col(text_col), m, punc_replace).alias("_u"))
        u = part if u is None else u.unionByName(part)
    ok = F.transform(F.filter("_u", lambda x: x["ok"]), lambda x: F.struct(
        x["key"].alias("key"), x["value"].alias("value"), x["i"].alias("pos"), x["i"].alias("order")))
    if domain is not None and any(m in OMIT_MODES for m in modes):
        aspects = F.array(*[F.lit(a) for a in ASPECTS[domain]])
        n = F.size("_u")
        rest = F.transform(aspects, lambda a, i: F.struct(a.alias("key"), F.lit("未提及").alias("value"),
                                                          (n + i).alias("pos"), F.lit(-1).alias("order")))
        ok = F.when(F.col(mode_col).isin(*OMIT_MODES) & (F.col("_text") != ""), F.concat(ok, rest)).otherwise(ok)
    read = materialize(u.select(*keys, error_type(F.col("_text"), F.col("_u")).alias("error_type"), ok.alias("_ok")))
    errors = read.select(*keys, "error_type")
    ex = read.select(*keys, F.explode("_ok").alias("x"))
    entries = (ex.groupBy(*keys, F.col("x.key").alias("key"))
               .agg(F.min("x.pos").alias("pos"), F.max_by("x.value", "x.order").alias("value")))
    return entries, errors


def aspect_dims(spark: SparkSession, domain: str) -> tuple[DataFrame, DataFrame]:
    """(aspects: a_pos, aspect), (aliases: a_pos, aspect, alias) for a domain."""
    asp = [(i, a) for i, a in enumerate(ASPECTS[domain])]
    ali = []
    for i, (a, s) in enumerate(zip(ASPECTS[domain], SOFT_ASPECTS[domain])):
        for x in (s if isinstance(s, list) else [s]):
            ali.append((i, a, x))
    return (spark.createDataFrame(asp, "a_pos int, aspect string"),
            spark.createDataFrame(ali, "a_pos int, aspect string, alias string"))


def soft_sentiment(v: Column) -> Column:
    """M8: the first synonym (in table order) contained in the value names the class."""
    expr = None
    for syn, canon in SOFT_SENTIMENT:
        cond = v.contains(syn)
        expr = F.when(cond, F.lit(canon)) if expr is None else expr.when(cond, F.lit(canon))
    return expr.otherwise(v)


def relax(pred_entries: DataFrame, samples: DataFrame, keys: list[str], spark: SparkSession,
          domain: str) -> DataFrame:
    """M7 M8 M9: soft aspect match (key contains an alias; the first key in
    output order wins), soft sentiment, missing or illegal -> 未提及.

    ``pred_entries``: keys + (pos, key, value); ``samples``: the keys of every
    scored sample.  Returns keys + (aspect, pred)."""
    aspects, aliases = aspect_dims(spark, domain)
    m = pred_entries.join(F.broadcast(aliases), F.col("key").contains(F.col("alias")))
    first = m.groupBy(*keys, "aspect").agg(F.min_by("value", "pos").alias("value"))
    asp_rows = list(enumerate(ASPECTS[domain]))
    full = expand_rows(samples.select(*keys), asp_rows, ["a_pos", "aspect"]).join(first, keys + ["aspect"], "left")
    v = soft_sentiment(F.col("value"))
    pred = F.when(v.isin(*SENTIMENTS), v).otherwise(F.lit("未提及"))
    return full.select(*keys, "a_pos", "aspect", pred.alias("pred"))


def confusion(pairs: DataFrame, group_cols: list[str], spark: SparkSession, aspects: list[str]) -> DataFrame:
    """A10: dense counts per group × (each aspect and 'ALL') × label × pred.

    Counts are a rollup over the aspect; the 4×4 grid of every aspect comes
    from a fixed broadcast table, so empty cells are present as 0."""
    g = list(group_cols)
    counts = (pairs.groupingSets([g + ["aspect", "label", "pred"], g + ["label", "pred"]], *g, "aspect", "label", "pred")
              .agg(F.count(F.lit(1)).alias("n"), F.grouping("aspect").alias("_all")))
    counts = counts.withColumn("aspect", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("aspect"))).drop("_all")
    grid = [(a, la, p) for a in aspects + ["ALL"] for la in SENTIMENTS for p in SENTIMENTS]
    groups = pairs.select(*group_cols).distinct()
    dense = expand_rows(groups, grid, ["aspect", "label", "pred"]).join(counts, group_cols + ["aspect", "label", "pred"], "left")
    return dense.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _share(part: str, whole: str) -> Column:
    """part / whole to 4 decimals, NaN for a whole of 0."""
    return F.when(F.col(whole) == 0, F.lit(float("nan"))).otherwise(
        F.round(F.try_divide(F.col(part).cast("double"), F.col(whole)), 4))


def class_scores(matrix: DataFrame, group_cols: list[str]) -> DataFrame:
    """A11 + A12 per group and aspect: per-class precision/recall (4 dp, NaN
    on a zero denominator) and the weighted kappa (4 dp; 0 when pe = 1, null
    for an empty matrix)."""
    g = group_cols + ["aspect"]
    spark = matrix.sparkSession
    w = spark.createDataFrame([(SENTIMENTS[i], SENTIMENTS[j], float(KAPPA_WEIGHTS[i][j]))
                               for i in range(4) for j in range(4)], "label string, pred string, w double")
    m = matrix.join(F.broadcast(w), ["label", "pred"])
    row = m.groupBy(*g, "label").agg(F.sum("n").alias("la_num"))
    col = m.groupBy(*g, "pred").agg(F.sum("n").alias("pre_num"))
    tot = m.groupBy(*g).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("w")).alias("_po_num"))
    pe = (m.join(row, g + ["label"]).join(col, g + ["pred"])
          .groupBy(*g).agg(F.sum(F.col("la_num") * F.col("pre_num") * F.col("w")).alias("_pe_num")))
    k = tot.join(pe, g)
    po = F.try_divide(F.col("_po_num"), F.col("N"))
    pe_ = F.try_divide(F.col("_pe_num"), F.col("N") * F.col("N"))
    kappa = F.when(F.col("N") == 0, F.lit(None)).when(pe_ == 1, F.lit(0.0)).otherwise((po - pe_) / (1 - pe_))
    k = k.select(*g, F.round(kappa, 4).alias("kappa"))
    diag = m.filter(F.col("label") == F.col("pred")).select(*g, F.col("label").alias("cls"), F.col("n").alias("correct"))
    pr = (diag.join(row.withColumnRenamed("label", "cls"), g + ["cls"])
          .join(col.withColumnRenamed("pred", "cls"), g + ["cls"]))
    pr = pr.select(*g, "cls", "pre_num", "la_num",
                   _share("correct", "pre_num").alias("precision"), _share("correct", "la_num").alias("recall"))
    return pr.join(k, g)


def accuracy(pairs: DataFrame, group_cols: list[str], sample_cols: list[str],
             samples: DataFrame | None = None) -> DataFrame:
    """A8 + A9: per group: accuracy per aspect, over all aspects ('ALL') and of
    whole samples ('sentence'), each with correct / incorrect counts, 4 dp.
    ``samples`` (group and sample columns) also has the samples without a pair,
    whose label did not parse; they are incorrect sentences."""
    ok = (F.col("label") == F.col("pred")).cast("int")
    per = (pairs.withColumn("_ok", ok)
           .rollup(*group_cols, "aspect").agg(F.sum("_ok").alias("correct"), F.count(F.lit(1)).alias("total")))
    per = per.filter(F.col(group_cols[-1]).isNotNull() if group_cols else F.lit(True))
    per = per.withColumn("aspect", F.coalesce("aspect", F.lit("ALL")))
    sent = pairs.withColumn("_ok", ok).groupBy(*group_cols, *sample_cols).agg(F.min("_ok").alias("_ok"))
    if samples is not None:
        sent = (samples.select(*group_cols, *sample_cols).join(sent, [*group_cols, *sample_cols], "left")
                .withColumn("_ok", F.coalesce("_ok", F.lit(0))))
    sent = (sent.groupBy(*group_cols).agg(F.sum("_ok").alias("correct"), F.count(F.lit(1)).alias("total"))
            .withColumn("aspect", F.lit("sentence")))
    out = per.unionByName(sent)
    return out.select(*group_cols, "aspect", F.col("correct").cast("long").alias("correct"),
                      (F.col("total") - F.col("correct")).cast("long").alias("incorrect"),
                      F.round(F.col("correct") / F.col("total"), 4).alias("acc"))


def format_check(entries: DataFrame, samples: DataFrame, keys: list[str], domain: str,
                 mode_col: str = "mode") -> DataFrame:
    """M10 (hard mode): a prediction passes when its key set equals the
    domain's aspects and every value is a legal class; otherwise its dict is
    emptied and its error becomes check_error.  In the omit-unmentioned designs
    missing aspects are first filled with 未提及 (the design's intent), so only
    unknown keys or illegal values fail.  Returns keys + (passed bool)."""
    aspects = ASPECTS[domain]
    per = entries.groupBy(*keys).agg(
        F.count_if(F.col("key").isin(*aspects)).alias("_known"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.col("value").isin(*SENTIMENTS)).alias("_bad"))
    full = (F.col("_known") == len(aspects)) & (F.col("_n") == len(aspects)) & (F.col("_bad") == 0)
    filled = (F.col("_known") == F.col("_n")) & (F.col("_bad") == 0)
    omit = F.col(mode_col).isin(*OMIT_MODES)
    ok = F.when(omit, F.coalesce(filled, F.lit(True))).otherwise(F.coalesce(full, F.lit(False)))
    return samples.select(*keys).join(per, keys, "left").select(*keys, ok.alias("passed"))
