"""Exact dedup, n-gram join and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import DOCS, same, sentence
from promptloom.llm import ngram_join, suffix_dedup
from promptloom.llm.components import components
from promptloom.llm.exact_dedup import exact_dedup


def test_exact_dedup(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for k, x in enumerate(norm):
        groups[x].append(k)
    best = {x: min(((-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0) for k in ks)) for x, ks in groups.items()}
    got = exact_dedup(docs, fan_in=2).collect()
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    for x, ks in groups.items():
        rs = by_sha[hashlib.sha256(x.encode()).hexdigest()]
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rs) == sorted((rows[k][0] is None, rows[k][0] or 0) for k in ks)
        keep = None if best[x][1] else best[x][2]
        assert {(r["keep_id"], r["group_size"]) for r in rs} == {(keep, len(ks))}
        assert [r["doc_id"] for r in rs if r["kept"]] == [keep]


def test_exact_dedup_hot_group(spark):
    same(exact_dedup(spark.range(300).selectExpr("id AS doc_id", "'same text' AS text").repartition(16), fan_in=2).filter("kept"),
         [(0, 0, 300)], ["doc_id", "keep_id", "group_size"])


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    low = defaultdict(list)
    for i in range(len(rows)):
        low[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_join(docs, rows, block):
    same(ngram_join.ngram_join(docs, block=block), brute_join([r[:2] for r in rows]), ["doc_id", "n_shingles", "component_id"])


def test_ngram_join_large_groups(spark):
    """A group of near copies, some of which only link through others, and a passage that unlike documents share."""
    r = random.Random(3)
    base = sentence(r, 120).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = f"w{k}"
        rows.append((k, " ".join(w)))
    passage = sentence(r, 40)
    rows += [(100 + k, sentence(r, 40) + " " + passage) for k in range(40)]
    rows += [(200 + k, " ".join(base[:k + 1])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_join(rows)
    for block in (256, 8):
        same(ngram_join.ngram_join(df, block=block), want, ["doc_id", "n_shingles", "component_id"])


def test_ngram_join_bounds_what_meets_in_a_task(spark, monkeypatch):
    """Unlike documents that share most of their n-grams, some linked, and ones made of few n-grams, most of them unlinked."""
    r = random.Random(8)
    passage = sentence(r, 40)
    rows = [(k, sentence(r, 20) + " " + passage) for k in range(400)]
    rows += [(500 + k, rows[k][1] + " " + sentence(r, 4)) for k in range(0, 400, 9)]  # a link each
    pieces = [sentence(r, 12) for _ in range(14)]
    rows += [(1000 + k, " ".join(r.sample(pieces, 7))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    for name in ("_verify", "_cross"):
        def look(members, num, f=getattr(ngram_join, name, None)):
            top = members.groupBy("c", "block").count().agg({"count": "max"}).first()[0]
            seen.append(top or 0)
            return f(members, num)
        monkeypatch.setattr(ngram_join, name, look, raising=False)
    same(ngram_join.ngram_join(df, block=16), brute_join(rows), ["doc_id", "n_shingles", "component_id"])
    assert max(seen) <= 4 * 16, seen


def test_ngram_join_small_sets_of_common_ngrams_share_a_signature():
    # linked pairs, the larger side crowded into few segments of a partition, every n-gram common
    r = np.random.default_rng(5)
    bands = ngram_join.Bands(75)
    pool = r.integers(1, 2**63, 20_000).astype(np.uint64)
    lost = []
    for size in range(2, 40):
        for small in range(-(-size * 75 // 100), size + 1):
            band = bands.of(small)[-1]
            m, _, families = bands.segments(band)
            for trial in range(12):
                salt, _ = bands.salt(band, trial % families, m)
                seg = (ngram_join.mix(pool ^ salt) >> np.uint64(24)) % np.uint64(m)
                alone = min(trial // families, size - 1, m - 1)  # segments that hold one n-gram
                a = np.concatenate([pool[seg == 0][:size - alone]] + [pool[seg == k + 1][:1] for k in range(alone)])
                assert len(a) == size
                b = np.sort(a[:small])  # without the n-grams that are alone
                a = np.sort(a)
                assert ngram_join.linked(a, b, 75)
                sa, fa, broad_a = ngram_join.signatures(a, bands, np.ones(size, bool))
                sb, fb, broad_b = ngram_join.signatures(b, bands, np.ones(small, bool))
                met = np.intersect1d(sa[fa & ngram_join.PROBE > 0], sb[fb & ngram_join.INDEX > 0])
                if not (len(met) or broad_a or broad_b):
                    lost.append((size, small, trial))
    assert not lost


def test_ngram_join_compares_with_all_where_units_lack(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.Bands, "segments", lambda self, band: (1, 0, 1))
    r = random.Random(4)
    base = [sentence(r, 60).split() for _ in range(5)]
    rows = [(10 * i + k, " ".join([*w[:k], "x", *w[k + 1:]])) for i, w in enumerate(base) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.ngram_join(df), brute_join(rows), ["doc_id", "n_shingles", "component_id"])


def test_one_of_each(docs, rows):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    groups = Counter(c for _, _, c in brute_join([(k, t) for k, (_, t, *_) in enumerate(rows)]))
    # every component has one row; textless rows are components of their own, and equal rows of them are one
    textless = [r for r in rows if not (r[1] or "").split()]
    assert len([r for r in got if (r["text"] or "").split()]) == len(groups) - len(textless)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    same(got, [(k, 0) for k in range(1, 31)] + [(k, 100) for k in range(101, 140)], ["node", "root"])


def brute_suffix(rows, width):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k:k + width] for b in data for k in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [200, 170, 40])
def test_suffix_dedup(docs, rows, width):
    same(suffix_dedup.suffix_dedup(docs, width), brute_suffix([r[:2] for r in rows], width),
         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_cover_has_every_difference():
    p, c = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_no_documents(no_docs):
    for f in (exact_dedup, ngram_join.ngram_join, suffix_dedup.suffix_dedup, ngram_join.one_of_each):
        assert f(no_docs).count() == 0


def test_schema_of_digest_queries(docs):
    assert dict(ngram_join.ngram_join(docs).dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert DOCS.fieldNames()[:2] == ["doc_id", "text"]
