"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from llm.conftest import DOCS
from promptloom.llm import spelling
from promptloom.llm.spelling import corpus_words, near_pairs, variants


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_variants(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def columns(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def vocabulary(seed, size, letters, longest):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, longest))) for _ in range(size)}
    for w in list(words)[:size // 2]:
        k = r.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1:]}
    return {w: r.choice([1, 2, 3, 5, 8, 40, 300]) for w in words}


@pytest.mark.parametrize("cell", [8192, 40])
@pytest.mark.parametrize("letters, longest", [("abcde", 7), ("aé", 9), ("aeioutsrnlüßñÿz", 40)])
def test_variants(spark, cell, letters, longest):
    n = vocabulary(3, 250, letters, longest)
    rows = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert columns(variants(rows, cell)) == brute_variants(n)


def test_one_vector_overfills_cells(spark, monkeypatch):
    """Words of the same letters: no trie level parts them, the cells of one vector do."""
    r = random.Random(1)
    words = {"".join(r.sample("abcdefg", 7)) for _ in range(400)} | {"".join(r.sample("abcdefh", 7)) for _ in range(400)}
    n = {w: 3 + len(w) for w in words}
    monkeypatch.setattr(spelling, "SHARE", 4)
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(x["word"], x["near"]) for x in near_pairs(rows, 30).collect()}
    assert got == {(a, b) for a in words for b in words if is_near(a, b)} and got
    assert near_pairs(rows, 30).count() == len(got)


def test_very_long_words(spark):
    long = "abcde" * 4000
    n = {long: 9, long[:9000] + "x" + long[9000:]: 3, long[:-1]: 4, "z" + long[1:]: 3, long[:100] + "x" + long[101:200] + "x" + long[201:]: 3}
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    assert columns(variants(rows)) == brute_variants(n)


def test_chains_of_forms(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    n = {w: 3 * 2 ** k for k, w in enumerate(words)}
    got = columns(variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n) and {x[2] for x in got} == {"bbbbc"}


def test_corpus_words(spark, docs, rows, no_docs):
    r = random.Random(4)
    some = [(i, " ".join(r.choice(["Straße", "élève", "Maison", "houses", "house", "hause", "x1y", "ÉCOLE"]) for _ in range(60)), None, None, 0,
             *["x"] * 12) for i in range(40)] + rows
    n = brute_words([(x[0], x[1]) for x in some])
    table = spark.createDataFrame(some, DOCS).repartition(3)
    words = corpus_words(table)
    assert {(x["word"], x["n"]) for x in words.collect()} == set(n.items())
    assert columns(variants(words)) == brute_variants(n)
    assert variants(corpus_words(no_docs)).collect() == []
