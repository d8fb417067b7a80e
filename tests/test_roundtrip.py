"""The designs' round trip in one pass: texts move once, names never, and odd outputs read as before."""

from pyspark.sql import functions as F

from promptloom.operators import designs, parse_ner
from promptloom.plans.designs import q25


def test_no_name_is_stored_or_shuffled(spark, tmp_path):
    rows = [(i, f"Alpha beta{i} gamma, delta-x 12 beta{i} é Ünder " * 3, "en", "s", 1) for i in range(40)]
    rows += [(7, "one Two two", "fr", "s", 1), (None, "a b c", None, None, None), (None, "a b", None, None, None), (90, None, "en", "s", 0), (91, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = q25(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 2 and all("e_name" not in x for x in dealt), dealt  # texts by doc_id, totals by design
    assert "stage-" not in plan
    got = {r.design: (r.tp, r.fp, r.fn) for r in df.collect()}
    assert set(got) == set(designs.MODES) and len(set(got.values())) == 1 and got["default"][0] > 0


def test_one_pass_reads_what_each_parser_reads(spark):
    texts = ["", '["DNA","a b"]\n["RNA","c"]', '["DNA","a, b"]\nDNA,x\n["DNA", "y"]', '["DNA","q\\"r"]\n', "['DNA','s']", '["DNA","a"],["RNA","b"]',
             "'DNA': 'a' , 'b c',' d'; 'RNA': ''; x", "'DNA':  'a',　'b'\n'RNA': ''\n'protein': , ", "'DNA':'a'\nnone\n'cell_line': ' '",
             '{"entity_type": "DNA", "entity_names": ["a", ","]}\n{"entity_type": null, "entity_names": ["x"]}\nbad\n{"entity_type": "RNA", "entity_names": []}',
             '["DNA"," "]\n["DNA","t\tu"]', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for d in designs.MODES:
        for s in ("gold", "pred"):
            one = df.withColumns({"design": F.lit(d), "side": F.lit(s)})
            a = sorted(map(repr, parse_ner.parse_designs(one, ["id"], "text").select("id", "e_type", "e_name").collect()))
            assert a == sorted(map(repr, parse_ner.PARSERS[d](df, ["id"], "text", s).collect()))
    got = [(r.id, r.e_type, r.e_name) for r in parse_ner.parse_default(df.filter("id in (1, 2, 3, 5)"), ["id"], "text").collect()]
    assert got == [(1, "DNA", "a b"), (1, "RNA", "c"), (2, "DNA", "a, b"), (2, "N", ""), (2, "DNA", "y"), (3, "DNA", 'q"r'), (5, "DNA", "a")]


def test_json_names_with_commas_and_nulls(spark):
    df = spark.createDataFrame([(["a", ",", 'b","c'],), (["x", None],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(designs.json_strings(F.col("n"))).collect()] == ['["a", ",", "b\\",\\"c"]', '["x", null]', "[]"]


def test_no_entity_list_renders_as_before(spark):
    df = spark.createDataFrame([(None,), ([("DNA", None)],), ([],)], "e array<struct<e_type:string,e_name:string>>")
    empty = "\n".join(f"'{t}': ''" for t in designs.TYPE_ORDER)
    assert [r[0] for r in df.select(designs.render_output("good1", F.col("e"))).collect()] == ["", empty.replace("''", "", 1), empty]
    assert [r[0] for r in df.select(designs.render_output("weak1", F.col("e"))).collect()] == ["", "'DNA': ", ""]


def test_designs_counted_together_equal_grouping_sets(spark):
    from promptloom.operators.match import design_counts, key_counts
    rows = [(k % 3 if k % 7 else None, "ab"[k % 2], "gold" if k % 5 < 2 else "pred", "tu"[k % 4 // 2], f"n{k * k % 11}") for k in range(300)]
    rows += [(1, "c", "pred", "t", "x"), (1, "c", "pred", "t", "x")]
    e = spark.createDataFrame(rows, "doc_id long, design string, side string, e_type string, e_name string")
    want = key_counts(e, "doc_id", {"strict": ["design", "e_type", "e_name"]})
    got = design_counts(e, "doc_id", ["e_type", "e_name"], ["a", "b", "c", "d"])
    assert sorted(map(str, got.select(*want.drop("match").columns).collect())) == sorted(map(str, want.drop("match").collect()))
    assert got.select("design").distinct().count() == 3


def test_a_text_is_read_once(spark, tmp_path):
    """Spark asked whether anything is found before it gave the rows, and so cleaned and parsed each text twice."""
    from promptloom.plans.derive import document_words
    spark.createDataFrame([(1, "Alpha beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for df in (q25(spark, str(tmp_path)), document_words(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "size(" in x]


def test_words_are_cleaned_as_one_by_one(spark):
    from promptloom.plans.derive import document_words
    texts = ["", None, " lead and\ttrail \n", "a\r\nb\x0bc\x0cd", "ΟΔΟΣ ΣΑΣ-Σ Σ", "12 34", "İstanbul İx  nb sp ét", "x\u0085y", "\U0001d400b C"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    w = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "raw"))
    want = w.select("doc_id", "pos", F.lower(F.regexp_replace("raw", r"[^\p{L}]", "")).alias("name")).filter(F.length("name") >= 1)
    got = document_words(docs).select("doc_id", "pos", "name", "n_letters")
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, r.pos, r.name, len(r.name)) for r in want.collect())
