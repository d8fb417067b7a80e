"""Entries and errors come from one parse of a text."""

from promptloom.operators.absa import parse_table


def test_errors_are_read_from_the_stored_parse(spark):
    df = spark.createDataFrame([(1, "cot", '{"方面": "食品评价", "情感": "正面"}'), (2, "cot", "x"), (3, "cot", "")], "id int, mode string, t string")
    entries, errors = parse_table(df, ["id", "mode"], "t", "mode", ["cot"])
    for f in (entries, errors):
        assert "from_json" not in f._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.error_type for r in errors.collect()} == {1: "", 2: "split_error", 3: "empty_output"}
    assert [(r.id, r.key, r.value) for r in entries.collect()] == [(1, "食品评价", "正面")]
