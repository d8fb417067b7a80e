"""Token counts, token files, decontamination, language ID and LM scores against
the library, exact round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF001
from llm.conftest import same, sentence
from promptloom.llm import decontaminate, katz, language_id, ngram_join, suffix_dedup, token_counts, token_files
from promptloom.llm.common import pack, unpack
from promptloom.llm.queries import pieces_path, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(docs, rows, library):
    want = [(i, len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 100) for i, t, *_ in rows]
    same(token_counts.count_tokens(docs, tokenizer_path(), max_tokens=100), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_counts_of_every_character(library):
    counter = token_counts.WordCounter(tokenizer_path())
    chars = [chr(c) for c in [*range(0x3000), *range(0xAC00, 0xAC80), *range(0xFB00, 0xFB60), 0x1F600, 0x1D400, 0x2F800]]
    texts = [c + "a" + c.upper() + " x" + c for c in chars]
    assert counter.batch([t.encode() for t in texts]) == [len(ids_of(library, t)) for t in texts]


def test_merging_many_equal_symbols(library):
    counter = token_counts.WordCounter(tokenizer_path())
    texts = ["a" * k for k in range(1, 60)] + ["!" * k for k in range(1, 30)] + ["ab" * 500]
    assert counter.batch([t.encode() for t in texts]) == [len(ids_of(library, t)) for t in texts]


def test_a_full_word_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    counter = token_counts.WordCounter(tokenizer_path())
    r = random.Random(2)
    for _ in range(20):
        texts = [sentence(r, 8) for _ in range(3)]
        assert counter.batch([t.encode() for t in texts]) == [len(ids_of(library, t)) for t in texts]


def brute_files(rows, library):
    out, start = [], 0
    known = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = defaultdict(list)
    for i, t, *_ in known:
        by_id[i].append([*ids_of(library, t), 1])
    return by_id, sum(len(x) for v in by_id.values() for x in v), out, start


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files(docs, rows, library, mode):
    got = token_files.token_files(docs, tokenizer_path(), mode=mode).collect()
    by_id, total, *_ = brute_files(rows, library)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == total
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = Counter((i, len(x), crc(x)) for i, v in by_id.items() for x in v)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_files_are_cut_between_documents(spark, library, monkeypatch, docs, rows):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    monkeypatch.setattr(token_files, "BATCH_BYTES", 200)
    test_token_files(docs, rows, library, "byte")


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_file_round_trip(mode, n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 70000, n).astype(np.uint32)
    lengths = np.array([n // 3, n - n // 3], np.int64)
    docs, back, got = token_files.decode_file(token_files.encode_file([5, None], lengths, ids, mode, block_ids=64))
    assert docs == [5, None] and back.tolist() == lengths.tolist() and np.array_equal(got, ids)


def test_pack_round_trip():
    for v in ([], [0], [1, 2, 3], [2**64 - 1, 0], list(range(1000))):
        a = np.array(v, np.uint64)
        assert np.array_equal(unpack(pack(a)), a)


def words6(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words6(t)
        for x in [tuple(w[k:k + 10]) for k in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows[x].add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, ids = words6(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                x = tuple(w[k:k + n])
                if x in windows:
                    ids |= windows[x]
                    hit |= set(range(k, k + n))
        named = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


CONTAMINATION = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.fixture(scope="module")
def items(spark, rows):
    long = [t for _, t, *_ in rows if t and len(t) > 300]
    texts = [long[0][10:200], long[1], "one two three", "a", "", None, long[2][:60].upper() + "!!", "not in any document at all, I think so",
             long[0][10:200], "日本語"]
    r = [(k, t) for k, t in enumerate(texts)] + [(None, long[3][:100]), (2, "one two three")]
    return spark.createDataFrame(r, "item_id long, text string"), r


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(docs, rows, items, block_bytes):
    same(decontaminate.contamination(docs, items[0], block_bytes=block_bytes), brute_contamination(rows, items[1]), CONTAMINATION)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_without_contaminated(docs, rows, items, block_bytes):
    clean = decontaminate.without_contaminated(docs, items[0], block_bytes=block_bytes)
    assert clean.columns == docs.columns
    dirty = [r[5] for r in brute_contamination(rows, items[1])]
    same(clean, [r[:2] for r, d in zip(rows, dirty, strict=True) if not d], ["doc_id", "text"])


def test_contamination_without_items(docs, rows, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    same(decontaminate.contamination(docs, none), brute_contamination(rows, []), CONTAMINATION)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = language_id.train(language_id.training_rows(docs), pieces_path(), fit_docs=50)
    found = language_id.predict(docs, model).filter(language_id.held_out()).collect()
    assert len(found) > 30 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_edges(docs, rows):
    model = language_id.train(docs, pieces_path())
    assert model.languages == ["de", "en"]
    found = language_id.predict(docs, model)
    assert found.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    for r in found.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    untold = language_id.train(docs.filter("false"), pieces_path())
    assert {r["lang_pred"] for r in language_id.predict(docs, untold).collect()} == {"und"}
    kept = language_id.accepted(docs, model)
    assert "lang_pred" not in kept.columns


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", ""]
    logs = np.log(np.array([[.1, .3], [.2, .1], [.1, .1], [.2, .2], [.15, .1], [.15, .1], [.1, .1]]))
    at = {p: i for i, p in enumerate(pieces[:-1])}

    def brute(w, k):
        if not w:
            return 1.0
        total = sum(math.exp(logs[i, k]) * brute(w[len(p):], k) for p, i in at.items() if w.startswith(p))
        return total + (math.exp(logs[-1, k]) * brute(w[1:], k) if w[0] not in at else 0)

    words = ["▁abab", "▁", "▁xa", "▁" + "ab" * 6]
    lattice = language_id.Lattice(words, at, 2, len(pieces) - 1)
    forward = lattice.forward(logs[lattice.piece])[lattice.last]
    backward = lattice.backward(logs[lattice.piece])[lattice.first]
    want = np.log([[brute(w, k) for k in range(2)] for w in words])
    assert np.allclose(forward, want) and np.allclose(backward, want)


def test_long_words_score_as_others(monkeypatch):
    pieces = language_id.load_pieces(pieces_path())
    r = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], pieces, np.log(r.dirichlet(np.ones(len(pieces)), 2).T))
    text = ["the" * 40 + "é日x" * 30, "of " + "ing" * 90]
    want = language_id.Scorer(model).predict([t.encode() for t in text])
    monkeypatch.setattr(language_id, "LONG_WORD", 10)
    got = language_id.Scorer(model).predict([t.encode() for t in text])
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_very_long_texts(spark, library):
    r = random.Random(9)
    long = sentence(r, 150_000)
    rows = [(1, long), (2, long + " end"), (3, "y" * 20_000), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: len(ids_of(library, t)) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, tokenizer_path()).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.token_files(df, tokenizer_path()).collect()} == want
    model = language_id.train(df.selectExpr("*", "'en' AS lang"), pieces_path())
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
    assert {r["doc_id"]: r["n_tokens"] for r in katz.katz_scores(df, F.lit(True)).collect()} == {1: 150_001, 2: 150_002, 3: 2, 4: 1}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}
    assert got[1][1] == got[2][1] == 1 and got[2][0] == got[1][0] + 1 and got[3] == (1, 3) and got[4] == (0, 4)
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect()}
    n = len(long.encode())
    assert cut == {1: (n, n), 2: (n + 4, n), 3: (20_000, 20_000), 4: (0, 0)}


def brute_katz(rows, trained):
    tokens = [[*(t or "").encode().lower().split(), "</s>"] for _, t, *_ in rows]
    c1, c2 = Counter(), defaultdict(Counter)
    for ts, use in zip(tokens, trained, strict=True):
        h = "<s>"
        for w in ts if use else ():
            c1[w] += 1
            c2[h][w] += 1
            h = w
    n, v = sum(c1.values()), len(c1)

    def rates(counts):
        k = Counter(counts)
        a = 6 * k[6] / k[1] if k[1] else 1
        out = {}
        for r in range(1, 6):
            x = ((r + 1) * k[r + 1] / (r * k[r]) - a) / (1 - a) if k[r] and a < 1 else 0
            out[r] = x if 0 < x < 1 else (r - 0.5) / r
        return out

    d1, d2 = rates(c1.values()), rates([x for h in c2.values() for x in h.values()])
    p1 = {w: d1.get(c, 1) * c / n for w, c in c1.items()}
    rest = 1 - sum(p1.values())

    def p(h, w):
        low = p1.get(w, rest)
        if h not in c2:
            return low
        total = sum(c2[h].values())
        free = 1 - sum(d2.get(c, 1) * c / total for c in c2[h].values())
        if free * total < 1e-9:
            total += 1
            free = 1 / total
        c = c2[h][w]
        return d2.get(c, 1) * c / total if c else free / (1 - sum(p1[x] for x, k in c2[h].items() if k)) * low

    out = []
    for ts in tokens:
        score = sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ts], ts, strict=False))
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        out.append((len(ts), sum(c1[w] > 0 for w in ts), n, base, score))
    return out, p, c1


@pytest.mark.parametrize("split_at", [1_000_000, 5])
def test_katz(docs, rows, split_at, monkeypatch):
    monkeypatch.setattr(katz, "HISTORY_ROWS", split_at)
    trained = [i is not None and i % 4 != 1 for i, *_ in rows]
    got = katz.katz_scores(docs, F.col("doc_id") % 4 != 1).collect()
    want, p, c1 = brute_katz(rows, trained)
    order = lambda x: tuple((v is not None, v) for v in x)
    a = sorted([(r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
                for r in got], key=order)
    b = sorted([(r[0], t, *w[:3], round(w[3], 6), round(w[4], 6)) for r, t, w in zip(rows, trained, want, strict=True)], key=order)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5:] for x in a], [x[5:] for x in b], atol=2e-6)
    for h in ["<s>", *list(c1)[:20]]:
        assert abs(sum(p(h, w) for w in c1) + p(h, "unknown") - 1) < 1e-9


def test_katz_without_training(docs, rows):
    for r in katz.katz_scores(docs, F.lit(False)).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0


def test_no_documents(no_docs, items):
    assert token_counts.count_tokens(no_docs, tokenizer_path()).count() == 0
    assert token_files.token_files(no_docs, tokenizer_path()).count() == 0
    assert decontaminate.contamination(no_docs, items[0]).count() == 0
    assert language_id.predict(no_docs, language_id.train(no_docs, pieces_path())).count() == 0
    assert katz.katz_scores(no_docs, F.lit(True)).count() == 0
