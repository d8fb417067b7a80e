"""Fingerprints: the neighbour rule against brute force, sampling against the definition."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm.conftest import DOCS, sentence
from promptloom.llm import fingerprints
from promptloom.llm.fingerprints import Printer, Sampler, Terms, alike, fingerprint, likeness, shown, with_next


def bag(t):
    w = (t or "").encode().lower().split()
    return Counter(tuple(w[max(0, i - 4):i + 1]) for i in range(len(w)))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    r = random.Random(5)
    printer = Printer(1024, 5)
    errors = []
    for n, vocabulary in ((4, 3), (30, 2), (30, 500), (300, 3), (300, 9999), (2000, 9999)):
        t = " ".join(str(r.randrange(vocabulary)) for _ in range(n))
        u = t[:len(t) * 2 // 3] + " " + " ".join(str(r.randrange(vocabulary)) for _ in range(n // 3))
        (code,), (edit,) = printer.codes([t], [u])
        assert (code == printer.codes([t])[0][0]).all() and (edit == printer.codes([u])[0][0]).all()
        errors.append(alike(code, edit) - jaccard(t, u))
    assert max(map(abs, errors)) < 0.06 and abs(np.mean(errors)) < 0.02


def test_bounds_change_no_sample(monkeypatch):
    r = np.random.default_rng(1)
    term = np.unique(r.integers(0, 2 ** 63, 1500).astype(np.uint64))
    weight = r.integers(1, 6, len(term)).astype(np.float64)
    left, right = 400, 1100
    fast = Sampler(32).codes(term, weight, left, right)
    monkeypatch.setattr(Sampler, "_bound", staticmethod(lambda xu, xv, w: np.full(xu.shape, -1e9, np.float32)))
    for a, b in zip(fast, Sampler(32).codes(term, weight, left, right)):
        assert (a == b).all()


def test_weights_scale_the_winner():
    """A term of weight w wins about w times as often as one of weight 1."""
    s = Sampler(4000)
    both, _ = s.codes(np.array([11, 12], np.uint64), np.array([1.0, 3.0]), 2, 2)
    one, _ = s.codes(np.array([12], np.uint64), np.array([3.0]), 1, 1)
    assert abs(alike(both, one) - 0.75) < 0.03


def test_long_words_and_chunks(monkeypatch):
    text = ("x" * 3000 + " " + sentence(random.Random(2), 500)).encode()
    whole = Terms(5).of([text, b"", b"a  b\n", text])
    monkeypatch.setattr(fingerprints, "CHUNK", 64)
    parts = Terms(5).of([text, b"", b"a  b\n", text])
    for a, b in zip(whole, parts):
        assert (a == b).all()
    owner, term = whole
    assert (term[owner == 0] == term[owner == 3]).all() and not (owner == 1).any()
    assert (Terms(5).of([b"A b c"])[1] == Terms(5).of([b"a\tb\x0bc"])[1]).all()


def test_with_next(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BATCH_BYTES", 5000)
    key = lambda x: (x[0] is not None, x[0] or 0)
    got = with_next(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    alone = {i for i, n in Counter(x[0] for x in rows).items() if n == 1}
    order = sorted(rows, key=key)
    printer = Printer(fingerprints.SAMPLES, fingerprints.WORDS)
    code = lambda t: printer.codes([t])[0][0]
    by_id = {r["doc_id"]: r for r in got}
    checked = 0
    for a, b in zip(order, order[1:] + order[:1]):
        if a[0] not in alone or b[0] not in alone:
            continue
        t, u = a[1] or "", b[1] or ""
        edit = t[:len(t) - len(t) // 4] + u[:len(t) // 4]
        r = by_id[a[0]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert r["fingerprint"] == shown(code(t)) and r["edited_fingerprint"] == shown(code(edit))
        assert r["near_edited"] == alike(code(t), code(edit)) and r["near_next"] == alike(code(t), code(u))
        checked += 1
    assert checked > 40
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint(docs).collect()}
    assert all(prints[i] == by_id[i]["fingerprint"] for i in alone)
    for t in set(x[1] or "" for x in rows):  # equal texts, equal fingerprints
        assert len({by_id[x[0]]["fingerprint"] for x in rows if (x[1] or "") == t and x[0] in alone}) <= 1


@pytest.mark.parametrize("texts", [["one"], [None], ["a b", "a b"], ["same text"] * 40])
def test_few_documents(spark, texts):
    some = spark.createDataFrame([(i, t, None, None, 0, *["x"] * 12) for i, t in enumerate(texts)], DOCS)
    got = with_next(some).collect()
    assert len(got) == len(texts) and all(r["near_next"] == 1.0 for r in got)


def test_repeated_rows_and_no_rows(spark, no_docs):
    some = spark.createDataFrame([(7, "the same row")] * 50 + [(None, None)] * 30, "doc_id long, text string").repartition(7)
    assert Counter(r["doc_id"] for r in with_next(some).collect()) == {7: 50, None: 30}
    assert with_next(no_docs).collect() == [] and fingerprint(no_docs).collect() == []


def test_likeness_of_columns(spark):
    a, b = Printer(64, 5).codes(["a b c d e f g h i j", "", "x"], ["a b c d e f g x y z", "", ""])
    pairs = spark.createDataFrame([(shown(x), shown(y)) for x, y in zip(a, b)], "p string, q string")
    assert [r[0] for r in pairs.select(likeness("p", "q")).collect()] == [alike(x, y) for x, y in zip(a, b)]
