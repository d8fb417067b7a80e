import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()),
                   # names that the operators use inside
                   *[StructField(c, StringType()) for c in ("digest", "node", "row", "h", "src", "shard", "slot", "row_id", "chunk",
                                                            "score", "n", "part")]])


def word(r):
    return "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 5)))


def sentence(r, n):
    return " ".join(word(r) for _ in range(n))


def edge_rows(seed=1):
    """Documents with every odd case: nulls, empties, ties, repeated rows, long texts, copies, shared passages."""
    r = random.Random(seed)
    passage = sentence(r, 60)
    texts = [None, "", " \t\n", "a", "A  b", "one two three", "ONE two three", "a b c d e", "... 123 !!", "ИВАН и 日本語 テスト", "é é",
             "x<|endoftext|>y <|startoftext|>", "don't it's", "aaaaaaaa " * 40, "ab" * 300, sentence(r, 3000), "Ünï " * 5, "\x0b\x0c\r"]
    base = [sentence(r, r.randint(20, 200)) for _ in range(25)]
    texts += base
    texts += base[:4] + [base[0]] * 3 + [base[1].replace(" ", "\n"), base[1] + " ", " " + base[1]]
    for b in base[5:12]:  # near copies
        w = b.split()
        for k in range(3):
            v = list(w)
            v[r.randrange(len(v))] = f"new{k}"
            texts.append(" ".join(v))
    texts += [sentence(r, 30) + " " + passage + " " + sentence(r, 30) for _ in range(5)]
    texts += [sentence(r, 4) + "\t" + passage[:150].upper() + "." for _ in range(3)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, base[2]), (None, None), (rows[21][0], "another text of the same id")]
    r.shuffle(rows)
    langs, sources = ["en", "de", None], ["b", "a", None, "c", "Z"]
    return [(i, t, langs[k % 3], sources[k % 5], len(t or ""), *["x"] * 12) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def same(df, expected, cols):
    """Rows of ``cols`` agree, in any order."""
    got = [tuple(r) for r in df.select(*cols).collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == sorted(expected, key=key)
