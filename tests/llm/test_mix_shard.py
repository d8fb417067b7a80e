"""Mixing and sharding: exact margins, targets, plans without Python, fair draws."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from llm.conftest import same
from promptloom.llm import hypergeometric, mixing, sharding


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """Excess over the caps is reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total = share * sum(sizes.values())
    out = dict.fromkeys(order, 0.0)
    free, left = set(order), total
    while free and left > 1e-9:
        whole = sum(w[s] for s in free)
        for s in free:
            out[s] += left * w[s] / whole
        left = sum(max(0.0, out[s] - 2 * sizes[s]) for s in free)
        full = {s for s in free if out[s] >= 2 * sizes[s]}
        for s in full:
            out[s] = 2.0 * sizes[s]
        free -= full
    return out


def check_mix(got, rows):
    sizes, largest = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
        largest[s] = max(largest[s], n_words(t))
    want, taken = targets(sizes), Counter()
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] == r["size"] * len(r["shards"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_mix_plan(docs, rows):
    got = mixing.plan_mix(docs, keep=("doc_id", "source", "text")).select("*", "row.*").collect()
    assert len(got) == len(rows)
    assert all(r["size"] == n_words(r["text"]) for r in got)
    check_mix(got, [(r[0], r[1], r[3]) for r in rows])


def test_mix_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    first = mixing.plan_mix(docs, keep=("doc_id", "source")).select("*", "row.*").collect()
    check_mix(first, rows)
    again = mixing.plan_mix(docs.repartition(7), keep=("doc_id", "source")).select("*", "row.*").collect()
    key = lambda r: (r["doc_id"], r["taken"], tuple(r["shards"]))
    assert sorted(map(key, first)) == sorted(map(key, again))
    # every shard's share of every source follows its quota: block copies are at most one apart in total
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: len(r["shards"]) for r in first if r["shards"]})


def test_quotas_are_exact(spark):
    copies = {"a": 40, "b": 7, "c": 1, "d": 0}
    q = mixing.shard_quotas(spark.createDataFrame(list(copies.items()), "src string, n long"), 8, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in q:
        by_source[r["src"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert all(by_source[s] == n for s, n in copies.items())
    assert max(by_shard.values()) - min(by_shard.values()) <= 3 and sum(by_shard.values()) == 48


def test_shards(docs, rows):
    got = sharding.shard_documents(docs, n_shards=8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_keep_all_columns(docs, rows):
    out = sharding.shard_rows(docs, 3)
    assert out.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"]
    same(out, [r[:2] for r in rows], ["doc_id", "text"])


def test_fewer_rows_than_shards(spark, no_docs):
    got = sharding.shard_rows(spark.range(3), 40).collect()
    assert len({r["shard"] for r in got}) == 3 and {r["slot"] for r in got} == {0}
    assert sharding.shard_documents(no_docs).count() == 0
    assert mixing.plan_mix(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_matrix_margins(spark):
    counts = {0: 50, 1: 0, 2: 13, 5: 200}
    df = spark.createDataFrame([(k, n) for k, n in counts.items() if n], "part long, n long")
    got = {r["part"]: r["cum"] for r in sharding.communication_matrix(df, 7, 1).collect()}
    rows = {p: [b - a for a, b in zip([0, *c], c, strict=False)] for p, c in got.items()}
    assert all(sum(r) == counts.get(p, 0) and min(r) >= 0 for p, r in rows.items())
    cols = [sum(r[j] for r in rows.values()) for j in range(7)]
    assert sorted(cols) == sorted([38] * 4 + [37] * 3) and sum(cols) == 263


def test_draws_follow_the_distribution(spark):
    from math import comb
    n = 20000
    k = hypergeometric.draw(F.lit(30), F.lit(12), F.lit(9), hypergeometric.uniform(F.col("id")))
    seen = {r["k"]: r["n"] for r in spark.range(n).select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    for x in range(10):
        p = comb(12, x) * comb(18, 9 - x) / comb(30, 9)
        assert abs(seen.get(x, 0) - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1


@pytest.mark.parametrize("args", [(10, 0, 5, 0), (10, 10, 5, 5), (10, 3, 0, 0), (10, 3, 10, 3), (0, 0, 0, 0), (1, 1, 1, 1)])
def test_draws_at_the_ends(spark, args):
    t, g, n, want = args
    for u in (0.0, 0.5, 1 - 2**-53):
        assert spark.range(1).select(hypergeometric.draw(F.lit(t), F.lit(g), F.lit(n), F.lit(u)).alias("k")).first()["k"] == want


def test_native_plans(docs, capsys):
    for df in (mixing.plan_mix(docs), sharding.shard_documents(docs)):
        df.explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
