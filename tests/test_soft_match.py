"""Soft matching against a direct Python evaluation of the reference rule."""

import random

import brute
from conftest import SF001
from promptloom.functions.similarity import soften
from promptloom.operators import soft_match
from promptloom.plans.events_eval import parsed_events
from promptloom.plans.softmatch import q36, q37


def test_soft_ner_equals_bruteforce(spark):
    exp = brute.soft_ner_scores(SF001)
    got = {r.match: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in q36(spark, SF001).collect()}
    assert got == exp


def test_one_sample_spreads_over_blocks(spark, monkeypatch):
    """Blocks of a long sample give what the rule gives, ties and long names included."""
    monkeypatch.setattr(soft_match, "PRED_BLOCK", 16)
    monkeypatch.setattr(soft_match, "GOLD_BLOCK", 12)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 7)))
    samples = {1: ([word() for _ in range(90)], [word() for _ in range(120)]), 2: ([word()], [word() for _ in range(3)]),
               3: ([], ["abc"]), 4: (["abc"], []), 5: (["x" * 150 + "yz" * 60, "x" * 150 + "yz" * 59], ["x" * 150 + "yz" * 55, "yz" * 60, "zy"])}
    gold = spark.createDataFrame([(d, k, n) for d, (g, _) in samples.items() for k, n in enumerate(g)], "doc long, gidx int, name string")
    pred = spark.createDataFrame([(d, n) for d, (_, p) in samples.items() for n in p], "doc long, name string")
    got = {(x.doc, x.name): x.soft_name for x in soft_match.soft_names(gold, pred, "doc").collect()}
    assert got == {(d, n): brute.soft_choice(n, g) for d, (g, p) in samples.items() for n in p}


def test_soften_equals_its_rule():
    r = random.Random(5)
    for _ in range(300):
        gold = ["".join(r.choice("abC ") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 5))]
        pred = ["".join(r.choice("abC ") for _ in range(r.randint(0, 6))) for _ in range(4)]
        assert soften(pred, gold) == [brute.soft_event_choice(p, gold) for p in pred]


def test_soft_events_equals_bruteforce(spark):
    rows = parsed_events(spark, SF001).select("format", "gold", "p.items").collect()
    tot = {}
    for r in rows:
        gold = [(g.e_type, g.trigger) for g in r.gold]
        pred = [(p.e_type, p.trigger) for p in r["items"]]
        uniq = list(dict.fromkeys(pred))
        soft = [brute.soft_event_choice(t, [g for _, g in gold]) for _, t in uniq]
        res = [x for x in zip([e for e, _ in uniq], soft) if x in gold]
        a = tot.setdefault(r.format, [0, 0, 0])
        a[0] += len(res)
        a[1] += len(pred) - len(res)
        a[2] += len(gold) - len(res)
    got = {r.format: [r.tp, r.fp, r.fn] for r in q37(spark, SF001).collect()}
    assert got == tot


def test_short_and_long_samples_give_the_same(spark, monkeypatch):
    """Samples that stay in their task and those that spread, with nothing stored for the first."""
    from promptloom.plans import softmatch
    stored = []
    monkeypatch.setattr(softmatch, "materialize", lambda df, *a: stored.append(a) or real(df, *a))
    real = soft_match.materialize
    exp = None  # of the first; test_soft_ner_equals_bruteforce compares it
    for most, n in ((softmatch.LONG_TEXT, 1), (4000, 2)):
        monkeypatch.setattr(softmatch, "LONG_TEXT", most)
        stored.clear()
        df = q36(spark, SF001)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, df.collect()))
        exp = exp or got
        assert len(got) == 2 and got == exp
        assert len(stored) == n
        if n == 1:
            moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x]
            assert len(moved) == 2 and all("REPARTITION_BY_NUM" in x for x in moved)  # texts, then softened names


def test_softened_rows_equal_the_rule(spark, monkeypatch):
    monkeypatch.setattr(soft_match, "PRED_BLOCK", 16)
    monkeypatch.setattr(soft_match, "GOLD_BLOCK", 12)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 7)))
    for n in (0, 1, 40, 90):
        gold = list(dict.fromkeys(word() for _ in range(n)))
        pred = sorted({word() for _ in range(90)} - set(gold))
        got = soft_match.choose(pred, gold, soft_match.np.arange(len(gold)))
        assert {p: got.get(p, p) for p in pred} == {p: brute.soft_choice(p, gold) for p in pred}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(1, "a", "walk", 1, 0, 4), (1, "a", "walks", 0, 2, None), (1, "b", "walks", 0, 1, None), (1, "b", "walked", 2, 0, 1),
                (1, "b", "x", 0, 1, None), (2, "a", "walks", 0, 1, None), (None, "a", "walk", 1, 0, 0), (None, "a", "walks", 0, 1, None)]
        df = spark.createDataFrame(rows, "doc_id long, e_type string, e_name string, n_gold long, n_pred long, gidx int").coalesce(1)
        got = [(x.doc_id, x.e_type, x.e_name, x.n_gold, x.n_pred, x.gidx, x.soft_name) for x in soft_match.soften_rows(df, "doc_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted([(*x, "walk" if x[0] == 1 and x[2] == "walks" else None) for x in rows], key=key)


def test_ratio_equals_difflib():
    from difflib import SequenceMatcher
    from promptloom.functions.similarity import ratio
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randint(0, r.choice((4, 9, 70))))) for _ in "ab")
        assert ratio(a, b) == SequenceMatcher(a=a, b=b).ratio()


def test_pairs_at_once_equal_difflib():
    """Blocks, subsequences and bounds of many pairs at once, names of 64 characters and odd letters included."""
    from difflib import SequenceMatcher
    np, r = soft_match.np, random.Random(4)
    word = lambda: "".join(r.choice("abcé\U0001f600") for _ in range(r.choice((1, 2, 5, 9, 12, 63, 64))))
    words = [word() for _ in range(300)] + ["a" * 64, "ab" * 32]
    names = soft_match.Names(words)
    p, g = np.array([r.randrange(len(words)) for _ in range(2000)]), np.array([r.randrange(len(words)) for _ in range(2000)])
    where = soft_match._positions(names, p, g)
    want = [sum(b.size for b in SequenceMatcher(a=words[x], b=words[y]).get_matching_blocks()) for x, y in zip(p, g)]
    assert soft_match._matched(where).tolist() == want
    assert (soft_match._subsequence(where) >= want).all()
    a, b = names.take(p[:100]), names.take(g[:100])
    shared, rows = soft_match.shared_marks(a, b), np.arange(100)
    for ratio in (0.4, 0.7):  # a pair that is no better than the bound allows is looked at
        at, j, most, _ = soft_match.rivals(a, b, np.zeros(100, np.int64), shared, rows, np.full(100, ratio), np.ones(100, np.int64))
        seen = dict(zip(zip(at.tolist(), j.tolist()), most.tolist()))
        for x in range(100):
            for y in range(100):
                true = SequenceMatcher(a=words[p[x]], b=words[g[y]]).ratio()
                assert true < ratio or seen[x, y] >= true - 1e-9


def test_samples_softened_at_once_equal_each_alone(monkeypatch):
    """Samples that share names, and pairs that are settled in several rounds."""
    np, r = soft_match.np, random.Random(6)
    pool = ["".join(r.choice("abc") for _ in range(r.choice((1, 3, 4, 6, 7, 70)))) for _ in range(250)]
    pool = list(dict.fromkeys(pool))
    samples = []
    for _ in range(30):
        gold = r.sample(range(len(pool)), r.randint(0, 60))
        pred = [x for x in r.sample(range(len(pool)), 60) if x not in gold]
        samples.append((np.array(pred), np.array(gold, np.int64), np.arange(len(gold))))
    monkeypatch.setattr(soft_match, "OPEN_PAIRS", 50)
    monkeypatch.setattr(soft_match, "PAIRS", 16)
    got = soft_match.choose_all(soft_match.Names(pool), samples)
    for (pred, gold, at), chosen in zip(samples, got):
        for x, y in zip(pred.tolist(), chosen.tolist()):
            assert (pool[y] if y >= 0 else pool[x]) == brute.soft_choice(pool[x], [pool[k] for k in gold])


def test_only_numbers_move_after_softening(spark):
    """A query that asks for one mode counts no other, and softened names are dealt again as numbers."""
    from promptloom.plans.softmatch import outcomes
    plan = outcomes(spark, SF001, ("soft",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
    moved = plan[:plan.index("MapInArrow")]  # above the softening
    assert "RepartitionByExpression" in moved and "e_name" not in moved.split("RepartitionByExpression")[1]
    rows = outcomes(spark, SF001).collect()
    assert {(r.mode, r.match) for r in rows} == {(m, x) for m in ("hard", "soft") for x in ("strict", "boundaries")}
    assert sorted(map(tuple, (r for r in rows if r.mode == "soft"))) == sorted(map(tuple, outcomes(spark, SF001, ("soft",)).collect()))


def test_softened_numbers_stand_for_names(spark):
    rows = [(1, "a", "walk", 1, 0, 4), (1, "a", "walks", 0, 2, None), (1, "b", "walks", 0, 1, None), (2, "a", "walks", 0, 1, None), (None, "a", "walk", 1, 0, 0), (None, "a", "walks", 0, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, e_type string, e_name string, n_gold long, n_pred long, gidx int").coalesce(1)
    got = sorted(soft_match.soften_codes(df, "doc_id").collect(), key=lambda x: (-x.n_gold, -x.n_pred))
    assert [(x.doc_id, x.n_gold, x.n_pred) for x in got if x.doc_id == 1] == [(1, 1, 0), (1, 0, 2), (1, 0, 1)]
    one = [x for x in got if x.doc_id == 1]
    assert len({x.soft for x in one}) == 1 and len({x.hard for x in one}) == 2 and [x.e_type == one[0].e_type for x in one] == [True, True, False]
    assert len({x.soft for x in got if x.doc_id is None}) == 2
