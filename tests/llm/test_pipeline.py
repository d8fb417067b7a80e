"""The pipeline's stages against brute force, on odd documents and on the given ones."""

from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from conftest import SF001
from llm.conftest import DOCS
from llm.test_dedup import brute_join
from llm.test_mix_shard import n_words, targets
from llm.test_tokens import brute_contamination, ids_of
from promptloom.llm.common import stored
from promptloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def odd_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    texts = [t for _, t, *_ in rows if t and len(t) > 300]
    items = [(0, texts[0][:120]), (1, "one two three"), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def stages(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], d), "stage"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def check_stages(spark, d, out):
    docs, told, single, clean, mixed, files = out
    assert all(df.columns == docs.columns for df in (told, single, clean, mixed))
    # 1: only documents without a letter may go on these data
    letters = [(i, t) for i, t in pairs(docs) if any(c.isalpha() for c in t or "")]
    assert not Counter(pairs(told)) - Counter(letters)
    assert len(pairs(told)) >= 0.97 * len(letters)
    # 2: one document of each component
    before = pairs(told)
    parts = defaultdict(list)
    for k, (_, _, c) in enumerate(brute_join([(k, t) for k, (_, t) in enumerate(before)])):
        parts[c].append(before[k])
    left = Counter(pairs(single))
    # equal rows cannot be told apart, so a component is matched by any of its rows
    assert sum(left.values()) == len(parts)
    assert all(sum(left[x] for x in set(p)) >= 1 for p in parts.values())
    # 3: no benchmark window is left, and nothing else went
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    before = pairs(single)
    dirty = [r[5] for r in brute_contamination(before, items)]
    assert Counter(pairs(clean)) == Counter(x for x, bad in zip(before, dirty, strict=True) if not bad)
    # 4: sources near their targets, no document more than twice
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in clean.collect():
        n = n_words(r["text"])
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in mixed.collect():
        taken[r["source"]] += n_words(r["text"])
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= largest[s] / 2 + 1
    have = Counter(pairs(clean))
    assert all(n <= 2 * have[x] for x, n in Counter(pairs(mixed)).items())
    # 5: what the files hold is what the library makes of the mix
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, len(ids_of(library, t)) + 1) for i, t in pairs(mixed))
    got = files.collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_on_odd_documents(spark, odd_dir):
    check_stages(spark, odd_dir, stages(spark, odd_dir))


def test_stages_on_given_documents(spark):
    check_stages(spark, SF001, stages(spark, SF001))


def test_pipeline_without_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and [s for s, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_join", "decontaminate", "mix", "token_files"]
    oracles = __spark_entry__.oracle_sql()
    assert "op2_exact_dedup" in oracles and corpus_pipeline.ORACLE_SQL is None
