"""Suffix-array dedup with a difference cover, to the depth of the repeats wanted.

Every byte covered by a ``width``-byte string that also starts anywhere else is
removed.  That needs suffixes told apart only by their first ``width`` bytes, which
bounds the difference-cover method:

1. Sample.  Positions whose residue modulo ``period`` lies in a difference cover.
   For any two positions i, j there is a shift below ``period`` that takes both
   into the sample, so if their ``width``-byte prefixes agree, so do the
   ``width - period + 1`` byte prefixes of two sampled suffixes.  These prefixes
   are named by fingerprint over the whole corpus; a name is either
   single or repeated.  (The recursion of the unbounded method would extend names
   past ``width``, so one level suffices.)
2. Merge.  A suffix can only repeat to the full depth if a sampled suffix within
   its next ``period`` positions has a repeated name.  Only those remaining
   suffixes go into the merge: equal 64-bit fingerprints of their whole
   ``width``-byte prefixes are counted.  Fingerprints take the place of suffix
   order: no suffixes are sorted and no bytes compared.

Text is packed once into chunks in the shared folder.  A chunk sends, for each
range of fingerprints, its distinct ones, sorted and difference-coded, and gets
back one bit for each: whether another chunk has it, too.  Copies within a chunk
are counted there.  So a string that occurs a million times costs one entry per
chunk, and no task holds more than its range of fingerprints.

Equal 64-bit fingerprints of equal-length strings count as equal strings: n
merged suffixes hold about n^2 / 2^65 false matches in all.

Defined cases: null or empty text has 0 bytes and the digest of nothing; texts
below ``width`` bytes are kept whole; matches never cross documents; repeated
rows remove each other's bytes, the first one's too; ids may be null; an empty
table gives an empty result; extra columns are ignored.  A text is never split: its task holds some 40
bytes for each byte of a very long one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.chunks import mix
from promptloom.llm.common import each_row, lean, pack, parallelism, stored, stored_by, text_or_empty, text_slices, unpack

CHUNK_BYTES = 4 << 20
WIDTH = 200
#: A perfect difference set: every residue modulo 133 is a difference of two of these.
PERIOD, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
NAME_BITS = 40  # fingerprint of a sampled prefix; a false match only costs work
RANGE_ROWS = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for a width: the fixed set, or for short strings every position."""
    return (PERIOD, COVER) if width > PERIOD + 30 else (1, (0,))


def text_chunks(docs: DataFrame) -> DataFrame:
    """Consecutive documents of a task as (chunk, doc_ids, lengths, text), zstd-compressed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        z = zstandard.ZstdCompressor(level=3)
        ids: list = []
        held: list = []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([sum(map(len, held))], pa.int64()), pa.array([pack(np.array(list(map(len, held)), np.int64))], pa.binary()),
                 pa.array([z.compress(b"".join(held))], pa.binary())], names=["chunk", "doc_ids", "n_bytes", "lengths", "text"])

        for b in batches:
            for rows, texts in text_slices(b, CHUNK_BYTES):
                if held and sum(map(len, held)) + sum(map(len, texts)) > CHUNK_BYTES:
                    yield row()
                    ids, held, seq = [], [], seq + 1
                ids += rows.column("doc_id").to_pylist()
                held += texts
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "chunk long, doc_ids array<long>, n_bytes long, lengths binary, text binary")


class Text:
    """The bytes of a chunk with fingerprints of their substrings."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, row: dict):
        import zstandard
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, row["n_bytes"]))
        self.size = row["n_bytes"]
        data = np.frombuffer(self.raw, np.uint8)
        self._grow(self.size)
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.prefix = np.zeros(self.size + 1, np.uint64)
        np.cumsum(values[data] * Text.powers[:self.size], out=self.prefix[1:])
        self.ends = np.cumsum(self.lengths)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) < n + 1:
            steps = np.full(n, BASE, np.uint64)
            back = np.full(n, pow(BASE, -1, 2**64), np.uint64)
            one = np.ones(1, np.uint64)
            cls.powers = np.concatenate([one, np.cumprod(steps)])
            cls.inverse = np.concatenate([one, np.cumprod(back)])

    def room(self) -> np.ndarray:
        """Bytes from each position to the end of its document."""
        return np.repeat(self.ends, self.lengths) - np.arange(self.size)

    def prints(self, at: np.ndarray, width: int) -> np.ndarray:
        return mix((self.prefix[at + width] - self.prefix[at]) * Text.inverse[at])


class Sent:
    """Sorted distinct fingerprints of positions, cut into ranges, and what comes back for them."""

    def __init__(self, prints: np.ndarray, bits: int, n_ranges: int):
        self.known, self.at, self.counts = np.unique(prints, return_inverse=True, return_counts=True)
        top = (self.known >> np.uint64(max(0, bits - 32)))
        part = ((top * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int64)
        self.cuts = np.searchsorted(part, np.arange(n_ranges + 1))

    def rows(self, chunk: int):
        import pyarrow as pa
        full = np.flatnonzero(np.diff(self.cuts)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64()),
             pa.array([pack(np.diff(self.known[self.cuts[k]:self.cuts[k + 1]], prepend=np.uint64(0))) for k in full], pa.binary())],
            names=["part", "chunk", "prints"])

    def repeated(self, replies: list[dict] | None) -> np.ndarray:
        """Per position: whether its fingerprint occurs at another one, here or in another chunk."""
        elsewhere = np.zeros(len(self.known), bool)
        for r in replies or []:
            a, b = self.cuts[r["part"]:r["part"] + 2]
            elsewhere[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a)
        return ((self.counts > 1) | elsewhere)[self.at]


def _match(sent: DataFrame) -> DataFrame:
    """(part, chunk, prints) -> (chunk, part, bits): which fingerprints another chunk has."""

    def run(table):
        import pyarrow as pa
        prints = [np.cumsum(unpack(p), dtype=np.uint64) for p in table.column("prints").to_pylist()]
        _, at, counts = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        shared = np.split(counts[at] > 1, np.cumsum([len(p) for p in prints])[:-1])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"),
                         "bits": pa.array([np.packbits(s).tobytes() for s in shared], pa.binary())})

    back = sent.groupBy("part").applyInArrow(lean(run), "chunk long, part long, bits binary")
    return back.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("back"))


def _sample(text: Text, width: int) -> tuple[np.ndarray, int]:
    """Sampled positions with a whole name before the end of their document, and the name's width."""
    period, cover = cover_for(width)
    name = width - period + 1
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    at = np.flatnonzero(np.resize(inside, text.size)) if text.size else np.zeros(0, np.int64)
    return at[text.room()[at] >= name], name


def _names(text: Text, width: int, n_ranges: int) -> tuple[np.ndarray, Sent]:
    at, name = _sample(text, width)
    return at, Sent(text.prints(at, name) >> np.uint64(64 - NAME_BITS), NAME_BITS, n_ranges)


def _remaining(text: Text, at: np.ndarray, repeated: np.ndarray, width: int) -> np.ndarray:
    """Positions whose whole prefix must be merged: a repeated name follows within the period."""
    period, _ = cover_for(width)
    hit = at[repeated]
    marks = np.zeros(text.size + 1, np.int32)
    np.add.at(marks, np.maximum(0, hit - period + 1), 1)
    np.add.at(marks, hit + 1, -1)
    return np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (text.room() >= width))


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    chunks = stored_by(text_chunks(docs), "suffix_chunks", "chunk")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    period, cover = cover_for(width)
    name_ranges = max(parallelism(spark), total * len(cover) // period // RANGE_ROWS)
    merge_ranges = max(parallelism(spark), total // 4 // RANGE_ROWS)

    def send_names(batches: Iterator) -> Iterator:
        for b in batches:
            for row in each_row(b):
                yield _names(Text(row), width, name_ranges)[1].rows(row["chunk"])

    def send_rest(batches: Iterator) -> Iterator:
        for b in batches:
            for row in each_row(b):
                text = Text(row)
                at, names = _names(text, width, name_ranges)
                rest = _remaining(text, at, names.repeated(row["names_back"]), width)
                yield Sent(text.prints(rest, width), 64, merge_ranges).rows(row["chunk"])

    def report(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for row in each_row(b):
                text = Text(row)
                at, names = _names(text, width, name_ranges)
                rest = _remaining(text, at, names.repeated(row["names_back"]), width)
                starts = rest[Sent(text.prints(rest, width), 64, merge_ranges).repeated(row["rest_back"])]
                marks = np.zeros(text.size + 1, np.int32)
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + width, -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed, spans, digests = [], [], []
                data = np.frombuffer(text.raw, np.uint8)
                for end, n in zip(text.ends.tolist(), text.lengths.tolist(), strict=True):
                    g = gone[end - n:end]
                    removed.append(int(g.sum()))
                    spans.append(int(g[:1].sum() + np.count_nonzero(g[1:] & ~g[:-1])))
                    kept = data[end - n:end][~g] if removed[-1] else data[end - n:end]
                    digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(text.lengths), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    sent = "part long, chunk long, prints binary"
    names_back = stored(_match(chunks.select("chunk", "n_bytes", "lengths", "text").mapInArrow(lean(send_names), sent)), "names-back")
    with_names = chunks.join(names_back.withColumnRenamed("back", "names_back"), "chunk", "left")
    rest_back = _match(with_names.mapInArrow(lean(send_rest), sent)).withColumnRenamed("back", "rest_back")
    return with_names.join(rest_back, "chunk", "left").mapInArrow(
        lean(report), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
