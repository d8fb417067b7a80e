"""Token chunks: documents as packed word numbers, written once to the shared folder.

A chunk holds consecutive documents of one task (at most ``CHUNK_DOCS`` of them
and about ``CHUNK_BYTES`` of text): their ids, their lengths in words, the
distinct words' 64-bit hashes in falling frequency and, per word of the text,
its number in that list.  Later passes read chunks instead of texts; a document
is known by ``chunk * CHUNK_DOCS + place``, which holds for all of them.

Words are lower-cased (A-Z) runs without ``[\\x20\\x09-\\x0D]``.  Null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import WordIndex, lean, pack, text_or_empty, text_slices, unpack

CHUNK_DOCS = 1 << 12
CHUNK_BYTES = 5 << 20
CACHE_WORDS = 500_000
SCHEMA = "chunk long, doc_ids array<long>, marks binary, n_words long, lengths binary, lexicon binary, words binary, info binary"


def token_chunks(docs: DataFrame, hook: Callable | None = None, mark: Column | None = None) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text); ``mark``, a boolean, is kept for each document.  ``hook()`` makes, per task, an object
    with ``info(lengths, hashes) -> bytes`` (kept beside each chunk; ``hashes`` has
    every word) and ``finish() -> bytes`` (kept in one last row, chunk < 0)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        digest = xxhash.xxh3_64_intdigest
        hashes = np.zeros(0, np.uint64)

        def learn(words):
            nonlocal hashes
            hashes = np.concatenate([hashes, np.fromiter(map(digest, words), np.uint64, len(words))])

        def forget():
            nonlocal hashes
            hashes = np.zeros(0, np.uint64)

        index = WordIndex(CACHE_WORDS, learn, forget)
        extra = hook() if hook else None

        def row(chunk, doc_ids, marks, n_words, lengths, lexicon, words, info):
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([marks], pa.binary()),
                 pa.array([n_words], pa.int64()), pa.array([lengths], pa.binary()), pa.array([lexicon], pa.binary()), pa.array([words], pa.binary()),
                 pa.array([info], pa.binary())],
                names=["chunk", "doc_ids", "marks", "n_words", "lengths", "lexicon", "words", "info"])

        def chunk_row(doc_ids, marks, texts):
            nonlocal seq
            lengths, words = index.look([t.lower() for t in texts])
            every = hashes[words]
            used, counts = np.unique(words, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.zeros(len(hashes), np.uint32)
            place[used[order]] = np.arange(len(used), dtype=np.uint32)
            info = extra.info(lengths, every) if extra else b""
            out = row((part << 24) | seq, doc_ids, bytes(marks), len(words), pack(lengths), hashes[used[order]].tobytes(),
                      pack(place[words]), info)
            seq += 1
            return out

        held_ids: list = []
        held_marks: list = []
        held: list = []
        size = 0
        for b in batches:
            for rows, texts in text_slices(b, CHUNK_BYTES):
                ids, marks = (rows.column(c).to_pylist() for c in ("doc_id", "mark"))
                for k in range(0, len(texts), CHUNK_DOCS):
                    more = texts[k:k + CHUNK_DOCS]
                    if held and (size + sum(map(len, more)) > CHUNK_BYTES or len(held) + len(more) > CHUNK_DOCS):
                        yield chunk_row(held_ids, held_marks, held)
                        held_ids, held_marks, held, size = [], [], [], 0
                    held_ids += ids[k:k + len(more)]
                    held_marks += marks[k:k + len(more)]
                    held += more
                    size += sum(map(len, more))
        if held:
            yield chunk_row(held_ids, held_marks, held)
        if extra:
            yield row(-1 - part, [], b"", 0, b"", b"", b"", extra.finish())

    mark = F.lit(False) if mark is None else mark
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(mark, F.lit(False)).alias("mark"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)


def chunk_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, word list (hashes) and word numbers of a chunk row."""
    return (unpack(row["lengths"]).astype(np.int64), np.frombuffer(row["lexicon"], np.uint64),
            unpack(row["words"]).astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    m = np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * m
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(32))
