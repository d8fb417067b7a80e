"""Helpers shared by the training-data operators: tables in the shared folder
and small array codecs for packed exchange between tasks."""

from __future__ import annotations

import functools
import gc
import inspect
import sys
import types
import uuid
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.session import scratch_path

#: ``[\x20\x09-\x0D]``: the white space that separates words in all operators.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so later steps survive lost executors and never recompute it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """:func:`stored`, in buckets of ``key``: joins on it need no exchange of this table."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("compression", "none").option("path", shared_path(spark, name))
     .bucketBy(parallelism(spark), key).saveAsTable(table))
    return spark.table(table)


def parallelism(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session is configured for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(sizes, limit: int):
    """(start, end) row ranges of at most ``limit`` bytes each, one row at least."""
    sizes = list(sizes)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def each_row(batch):
    """The rows of an Arrow batch as dicts, made one at a time (a chunk row is large)."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def text_slices(batch, limit: int, column: str = "text"):
    """(rows, texts) parts of an Arrow batch: slices of at most ``limit`` bytes of
    its binary column (one row at least), turned into Python objects one by one."""
    import pyarrow.compute as pc
    col = batch.column(column)
    for i, j in slices(pc.fill_null(pc.binary_length(col), 0).to_pylist(), limit):
        yield batch.slice(i, j - i), col.slice(i, j - i).to_pylist()


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Integers as zstd-compressed little-endian byte planes (only as many
    planes as the largest value needs); inverse of :func:`unpack`."""
    import zstandard
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = len(v).to_bytes(8, "little") + bytes([width])
    return head + zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    raw = zstandard.ZstdDecompressor().decompress(bytes(data[9:]), max_output_size=max(1, n * width))
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start+length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PerWorker:
    """One object that a Python worker keeps between tasks of the same kind and
    key, so that they share what they have learned; one of another kind or key
    takes its place.  Functions reach
    the workers by value and their classes live as long as a task; a module of
    its own, made on the worker, lives as long as the process."""

    MODULE = "_promptloom_worker_state"

    @classmethod
    def get(cls, kind: str, key, make):
        state = sys.modules.get(cls.MODULE)
        if state is None:
            state = sys.modules[cls.MODULE] = types.ModuleType(cls.MODULE)
            state.name = state.held = None
        if state.name != (kind, key):
            cls.drop()  # freed before the next is made
            state.held = make()
            state.name = (kind, key)
        return state.held

    @classmethod
    def drop(cls) -> None:
        state = sys.modules.get(cls.MODULE)
        if state is not None and state.name is not None:
            state.name = state.held = None
            give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, and
    what it holds counts against its executor."""
    import ctypes

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run):
    """A task function (batches -> batches, or table -> table) that needs no kept
    words: it frees what its worker holds, and a whole task gives its own memory back."""
    if inspect.isgeneratorfunction(run):
        @functools.wraps(run)
        def batches_to_batches(batches):
            PerWorker.drop()
            try:
                yield from run(batches)
            finally:
                give_back()
        return batches_to_batches

    @functools.wraps(run)
    def table_to_table(table):  # called for every group: only the cheap part
        PerWorker.drop()
        return run(table)
    return table_to_table


class _Numbers(dict):
    """Numbers keys in the order of their first lookup."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class WordIndex:
    """Numbers for the words (runs without ``[\\x20\\x09-\\x0D]``) a task has met.

    Holds about ``limit`` words (and those of one batch) at most and then starts
    anew (``on_reset``), which bounds a task's memory; what is looked up stays the
    same.  ``on_new`` gets the words numbered since the last call, in order."""

    def __init__(self, limit: int, on_new, on_reset):
        self.limit, self.on_new, self.on_reset = limit, on_new, on_reset
        self.at = _Numbers()

    def look(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words in each text, and the numbers of all words, one text after the other."""
        if len(self.at) > self.limit:
            self.at = _Numbers()
            self.on_reset()
        split = [t.split() for t in texts]  # bytes split exactly at these six characters
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        known = len(self.at)
        found = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        if len(self.at) > known:
            self.on_new(list(islice(self.at, known, None)))
        return n_words, found


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``lengths`` consecutive values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
