"""Benchmark decontamination: a prefix-filtered set join of text windows.

Words are the runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing
A-Z.  Every ``width`` consecutive words of a benchmark item are a window; a
shorter item is one window of all its words.  A window occurs in a document where
its words stand in a row.

The shingles of a window are its pairs of adjacent words (its word, if it has
only one).  A first pass counts, over all documents, the shingles that windows
use; windows order their shingles by that rarity.  Containment needs every
shingle, so a prefix of one, the rarest, is necessary: documents join with
windows on it.  A match at position i of the document and o of the window puts
the window at i - o: the positional bound wants that at or after the start, the
length bound wants its last word before the end.  Windows that share rarest
shingle, offset and length are one hash table, so a candidate place is verified
by one exact lookup of the item-sized run of words, however many windows share it.

The windows travel to the tasks by broadcast in blocks of at most
``BLOCK_BYTES`` of item text; a larger benchmark takes more blocks, each a pass
over the documents, and the hit ranges of the blocks meet per document.

Defined cases: null text has no words (0, 0, 0 items, not contaminated); null
item ids are not reported but their windows hit; items without words match
nothing; repeated items count once per distinct item_id; ties in rarity go by
place; empty tables give no items or no rows; extra columns are ignored.  A very long
text is whole, and so is held by its task.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import lean, stored, text_or_empty

WIDTH = 10
BLOCK_BYTES = 16 << 20
#: Runs of these are words (after lower-casing A-Z); the bytes of a non-ASCII
#: character are all at or above 0x80.
WORDS = re.compile(rb"[0-9a-z\x80-\xFF]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS.findall(text.lower()) if text else []  # bytes lower-case A-Z only


def windows_of(words: list[bytes], width: int = WIDTH) -> list[tuple]:
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def shingles_of(words) -> list:
    return list(zip(words, words[1:], strict=False)) if len(words) > 1 else list(words)


def build_index(items: list[tuple], counts: dict, width: int = WIDTH) -> dict:
    """Rarest shingle -> {(offset, length): {window: item ids}}."""
    by_window: dict[tuple, set] = {}
    for item_id, text in items:
        for w in windows_of(words_of(text), width):
            by_window.setdefault(w, set()).add(item_id)
    index: dict = {}
    for w, ids in by_window.items():
        rare = [(counts.get(s, 0), k, s) for k, s in enumerate(shingles_of(w))]
        _, offset, shingle = min(rare)
        index.setdefault(shingle, {}).setdefault((offset, len(w)), {})[w] = tuple(ids)
    return index


def find_hits(words: list[bytes], index: dict, single: bool) -> tuple[list[tuple[int, int]], set]:
    """Ranges of words covered by windows, and the items that these belong to.
    ``single``: some shingles of the index are single words."""
    ranges, found = [], set()
    known = index.keys()
    spots = []
    pairs = list(zip(words, words[1:], strict=False))
    if not known.isdisjoint(pairs):
        spots += [(i, s) for i, s in enumerate(pairs) if s in known]
    if single and not known.isdisjoint(words):
        spots += [(i, s) for i, s in enumerate(words) if s in known]
    for i, s in spots:
        for (offset, length), table in index[s].items():
            start = i - offset
            if start >= 0 and start + length <= len(words):
                ids = table.get(tuple(words[start:start + length]))
                if ids is not None:
                    ranges.append((start, start + length))
                    found.update(ids)
    return ranges, found


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, limit: int):
    """The items in blocks of about ``limit`` bytes at most, read one block at a time, and their number."""
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("at"), F.col("item_id").cast("string").alias("item_id"),
                                    text_or_empty().cast("binary").alias("text")), "bench-items")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 if total <= limit else -(-2 * total // limit)  # by hash, half full on average

    def read():
        for k in range(n):
            rows = items.filter(F.pmod(F.xxhash64("at"), F.lit(n)) == k) if n > 1 else items
            yield [(r["item_id"], bytes(r["text"])) for r in rows.select("item_id", "text").toLocalIterator()]

    return read(), n


def _shingle_counts(docs: DataFrame, wanted) -> dict:
    """How often each wanted shingle (a broadcast set) occurs in all documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        use = wanted.value
        total: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                words = words_of(t.as_py())
                pairs = list(zip(words, words[1:], strict=False))
                total.update(filter(use.__contains__, pairs))
                total.update(filter(use.__contains__, words))
        keys = [k if isinstance(k, bytes) else b" ".join(k) for k in total]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         names=["shingle", "n"])

    counted = (docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(lean(run), "shingle binary, n long")
               .groupBy("shingle").agg(F.sum("n").alias("n")))
    out = {}
    for r in counted.toLocalIterator():  # shingles of one block of items: bounded by the block
        parts = bytes(r["shingle"]).split(b" ")
        out[tuple(parts) if len(parts) > 1 else parts[0]] = r["n"]
    return out


def _hits(docs: DataFrame, index) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        table = index.value
        single = any(isinstance(s, bytes) for s in table)
        for b in batches:
            n, hits, items = [], [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                ranges, found = find_hits(words, table, single)
                n.append(len(words))
                hits.append([{"a": x, "b": y} for x, y in merged(ranges)])
                items.append(sorted(i for i in found if i is not None))
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))], names=["row_id", "doc_id", "n_words", "hits", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"row_id long, doc_id {kind}, n_words long, hits array<struct<a:long,b:long>>, items array<string>")


def _clean(docs: DataFrame, index) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the index occurs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        table = index.value
        single = any(isinstance(s, bytes) for s in table)
        for b in batches:
            clean = [not find_hits(words_of(t), table, single)[0] for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def _summary(found: DataFrame) -> DataFrame:
    """Ranges and items of a document as its digest columns."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            n_hit = [sum(y - x for x, y in merged((r["a"], r["b"]) for r in rs)) for rs in b.column("hits").to_pylist()]
            items = [sorted(set(x)) for x in b.column("items").to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(
        lean(run), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _index(docs: DataFrame, block: list[tuple], width: int):
    """The broadcast index of a block of items, ordered by the rarity of shingles in ``docs``."""
    send = docs.sparkSession.sparkContext.broadcast
    used = {s for _, t in block for w in windows_of(words_of(t), width) for s in shingles_of(w)}
    return send(build_index(block, _shingle_counts(docs, send(used)) if used else {}, width))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, unchanged, that no benchmark window occurs in; one pass per block of items."""
    for block in _blocks(benchmark, block_bytes)[0]:
        docs = _clean(docs, _index(docs.select("text"), block, width))
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    blocks, n_blocks = _blocks(benchmark, block_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_or_empty().cast("binary").alias("text"))
    if n_blocks > 1:  # row ids must hold between the passes
        rows = stored(rows, "decontaminate-rows")
    parts = []
    for block in blocks:
        hits = _hits(rows, _index(rows, block, width))
        parts.append(hits if n_blocks == 1 else stored(hits, "hits"))
    if n_blocks == 1:
        return _summary(parts[0])
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return _summary(found.groupBy("row_id", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
