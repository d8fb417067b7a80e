"""Hand-built edge rows, one per reference quirk (FIXTURES §C)."""

import pytest
from pyspark.sql import functions as F

from promptloom.functions.similarity import ratio
from promptloom.operators import absa, designs, ner, parse_events, parse_ner, tokens
from promptloom.operators.match import key_counts, multiset_outcome
from promptloom.operators.soft_match import soft_names
from promptloom.operators.scoring import pairwise_loss, reward_accuracy


def one(spark, expr, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first().r


def test_overlength(spark):
    df = spark.createDataFrame([([1, 10, 11, 12, 13], [20, 21, 22, 23])], "p array<int>, t array<int>")
    for skip, expect in ((True, None), (False, ([1, 10, 11, 12, 13, 20, 21, 22], 5))):
        f = tokens.causal_lm_features(F.col("p"), F.col("t"), 8, skip)
        rows = df.select(f["input_ids"].alias("ids"), f["seq_len"].alias("s"), f["keep"].alias("k")).filter("k").collect()
        assert (rows[0].ids, rows[0].s) == expect if expect else rows == []


def test_label_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2, 6)], "ids array<int>, s int, l int")
    r = df.select(tokens.prompt_masked_labels(F.col("ids"), F.col("s"), F.col("l")).alias("x")).first().x
    assert r == [-100, 2, 3, 4, -100, -100]


def test_multiset(spark):
    rows = [(0, "gold", "t", n) for n in "aab"] + [(0, "pred", "t", n) for n in "aaabc"]
    e = spark.createDataFrame(rows, "doc long, side string, e_type string, e_name string")
    out = multiset_outcome(key_counts(e, "doc", {"b": ["e_name"]})).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    assert tuple(out) == (3, 2, 0)


def test_nested_and_equal_spans(spark):
    e = spark.createDataFrame([(0, 0, 3, "X"), (0, 1, 2, "X"), (0, 5, 6, "X"), (1, 0, 2, "X"), (1, 0, 2, "Y"),
                               (2, 0, 1, "X"), (2, 1, 2, "X")],
                              "doc long, start int, end int, e_type string")
    f = {(r.doc, r.start, r.end): r.nested for r in ner.nested_spans(e, "doc", width=2).collect()}
    assert f[(0, 0, 3)] and f[(0, 1, 2)] and not f[(0, 5, 6)]
    assert f[(1, 0, 2)]
    assert not f[(2, 0, 1)] and not f[(2, 1, 2)]


def test_ratio_asymmetric():
    assert ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5


def test_soft_ner(spark):
    gold = spark.createDataFrame([(0, 0, "il-2 gene"), (1, 0, "abcdy")], "doc long, gidx long, name string")
    pred = spark.createDataFrame([(0, "il-2 gene expression"), (1, "abcdx")], "doc long, name string")
    m = {r.name: r.soft_name for r in soft_names(gold, pred, "doc").collect()}
    assert m == {"il-2 gene expression": "il-2 gene", "abcdx": "abcdx"}


def test_soft_event(spark):
    from promptloom.functions.similarity import soften
    assert soften(["abcdx"], ["abcdy"], 0.5) == ["abcdy"]


def _absa(spark, text, mode, domain="1"):
    df = spark.createDataFrame([(0, mode, text)], "id long, mode string, text string")
    ent, err = absa.parse_table(df, ["id"], "text", "mode", [mode])
    return sorted((r.pos, r.key, r.value) for r in ent.collect()), err.first().error_type


def test_duplicate_aspect(spark):
    e, err = _absa(spark, "食品评价：正面，饮品评价：中性，食品评价：负面。", "instruction-last")
    assert e == [(0, "食品评价", "负面"), (1, "饮品评价", "中性")] and err == ""


def test_missing_colon(spark):
    e, err = _absa(spark, "食品评价正面，饮品评价：中性。", "instruction-last")
    assert e == [(1, "饮品评价", "中性")] and err == "split_error"


def test_unknown_code(spark):
    e, err = _absa(spark, "食品评价：7", "numerical-label")
    assert e == [] and err == "split_error"


def test_json_fallback(spark):
    e, err = _absa(spark, '{"方面": "食品评价", "情感": "正面"', "json-output")
    assert e == [(0, "食品评价", "正面")] and err == "eval_error"


def test_soft_alias(spark):
    ents = spark.createDataFrame([(0, 0, "排队情况", "积极")], "id long, pos int, key string, value string")
    out = {r.aspect: r.pred for r in absa.relax(ents, ents.select("id"), ["id"], spark, "2").collect()}
    assert out["排队等候情况"] == "正面"
    assert {v for k, v in out.items() if k != "排队等候情况"} == {"未提及"}


def _events(spark, text, fmt):
    r = one(spark, parse_events.parse_events(F.col("x"), fmt), row=(text,))
    return [(i.e_type, i.trigger) for i in r.items], r.format_error


def test_events_formats(spark):
    assert _events(spark, "Attack:bomb, raid;Motion", "ou")[0] == [("attack", "bomb"), ("attack", "raid"), ("motion", "")]
    assert _events(spark, "Attack: NONE", "lines") == ([], 0)
    assert _events(spark, '{"event_type": "Attack", "trigger word": []}', "json") == ([], 0)
    assert _events(spark, '{"event_type": "Attack", "trigger word": "a,b"}', "json")[0] == [("attack", "a"), ("attack", "b")]
    assert _events(spark, "not json", "json") == ([], 1)
    assert _events(spark, "", "ou") == ([], 1)


def test_ner_weak1_vs_good1(spark):
    df = spark.createDataFrame([(0, "'DNA': ''")], "id long, t string")
    w = [r.e_name for r in parse_ner.parse_weak1(df, ["id"], "t", "pred").collect()]
    g = [r.e_name for r in parse_ner.parse_good1(df, ["id"], "t", "pred").collect()]
    assert w == [""] and g == []


def test_bracket_scan(spark):
    spans = one(spark, parse_ner.bracket_lists(F.col("x")), row=("x ['a'], ['b','c'] [d [e]]",))
    assert spans == ["['a']", "['b','c']", "[e]"]


def test_reward_tie_and_logloss(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 800.0)], "rj double, rk double")
    r = df.agg(reward_accuracy(F.col("rj"), F.col("rk")).alias("a"), pairwise_loss(F.col("rj"), F.col("rk")).alias("l")).first()
    assert r.a == 0.5
    assert r.l == pytest.approx((0.6931471805599453 + 800.0) / 2)


def test_kappa_single_cell(spark):
    rows = [("m", "ALL", la, p, 10 if (la == p == "正面") else 0) for la in absa.SENTIMENTS for p in absa.SENTIMENTS]
    mat = spark.createDataFrame(rows, "mode string, aspect string, label string, pred string, n long")
    assert absa.class_scores(mat, ["mode"]).first().kappa == 0.0


def test_design_roundtrip_quotes(spark):
    ents = F.array(F.struct(F.lit("DNA").alias("e_type"), F.lit("a b").alias("e_name")))
    assert one(spark, designs.render_output("weak1", ents)) == "'DNA': 'a b'"
    assert one(spark, designs.render_output("default", ents)) == '["DNA","a b"]'


def test_single_quoted_dict_is_no_error(spark):
    from promptloom.operators.absa import error_type, parse_units
    df = spark.createDataFrame([("{'方面': '食品评价', '情感': '正面'}",)], "t string")
    u = df.select(parse_units(F.col("t"), "json-output").alias("u"), "t")
    r = u.select("u", error_type(F.col("t"), F.col("u")).alias("e")).first()
    assert r.e == "" and (r.u[0].key, r.u[0].value) == ("食品评价", "正面")


def test_omitted_aspects_are_unmentioned(spark):
    from promptloom.operators.absa import ASPECTS, parse_table
    df = spark.createDataFrame([(1, "omit-unmentioned", "食品评价：正面。"), (2, "omit-unmentioned", "")], "id long, mode string, t string")
    entries, _ = parse_table(df, ["id", "mode"], "t", "mode", ["omit-unmentioned"], domain="1")
    got = {(r.id, r.key): r.value for r in entries.collect()}
    assert got == {(1, a): "正面" if a == "食品评价" else "未提及" for a in ASPECTS["1"]}


def _items(spark, text, fmt):
    from promptloom.operators.parse_events import parse_events
    r = spark.createDataFrame([(text,)], "t string").select(parse_events(F.col("t"), fmt).alias("p")).first().p
    return [(x.e_type, x.trigger) for x in r["items"]], r.format_error


def test_event_lists_keep_all_items(spark):
    items, err = _items(spark, "['Attack','bomb','raid']\n['Motion', 'go']\n['Killing']", "heuristic")
    assert items[1] == ("motion", "go") and err == 0
    assert items[0] != ("attack", "bomb") and "raid" in items[0][1] and items[2] != ("killing", "")


def test_json_triggers_are_never_null(spark):
    assert _items(spark, '{"event_type": "Attack", "trigger word": "[abc"}', "json") == ([("attack", "[abc")], 0)
    assert _items(spark, '{"event_type": "Attack", "trigger word": "a{b}"}', "json") == ([("attack", "a{b}")], 0)
    assert _items(spark, '{"event_type": "Attack", "trigger word": {"a": 1}}', "json") == ([], 1)


def test_quoted_names_hold_commas(spark):
    from promptloom.operators.parse_ner import parse_default
    df = spark.createDataFrame([(1, '["DNA","a, b"]')], "id long, t string")
    assert [tuple(r) for r in parse_default(df, ["id"], "t").collect()] == [(1, "DNA", "a, b")]
    assert [tuple(r) for r in parse_default(df, ["id"], "t", legacy=True).collect()] == [(1, "DNA", "")]


def test_bracket_items_are_stripped_and_lines_separate(spark):
    from promptloom.operators.parse_ner import entities_from_lists
    df = spark.createDataFrame([(1, "[' DNA ', ' il-2 ']\n['x',\n'y'] ['RNA', 'z']")], "id long, t string")
    got = [(r.e_type, r.e_name) for r in entities_from_lists(df, ["id"], "t").orderBy("span_pos").collect()]
    assert got == [("DNA", "il-2"), ("RNA", "z")]


def test_json_names_escape_control_characters(spark):
    import json
    from promptloom.operators.designs import json_string
    text = 'a"b\\c\n\t\x01é'
    assert json.loads(spark.createDataFrame([(text,)], "t string").select(json_string(F.col("t")).alias("j")).first().j) == text


def test_json_event_lines(spark):
    """What is one object with a string or a list as trigger, and what is not."""
    t = '{"event_type": "A", "trigger word": %s}'
    cases = {
        t % '"b, C "': ([("a", "b"), ("a", "c")], 0), t % '["b", "c"]': ([("a", "b"), ("a", "c")], 0), t % "[]": ([], 0),
        t % "5": ([], 1), t % "true": ([], 1), t % '{"x": 1}': ([], 1), t % '"b"} tail}'[:-1]: ([], 1),
        t % '"b"' + " tail": ([], 1), t % '"b"' + ", " + t % '"c"': ([], 1), '{"event_type": "A"}': ([], 1),
        "{'event_type': 'A', 'trigger word': 'b'}": ([("a", "b")], 0), t % '"[b"': ([("a", "[b")], 0),
        "  " + t % '"b"' + " ": ([("a", "b")], 0), t % '"b"' + "\n" + t % "7" + "\n" + t % '"c"': ([("a", "b"), ("a", "c")], 1)}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", parse_events.parse_events(F.col("text"), "json").alias("p"))
    got = {r.text: ([(x.e_type, x.trigger) for x in r.p["items"]], r.p.format_error) for r in rows.collect()}
    assert got == cases
