"""Token-ID files by byte- or bit-plane shuffling.

Documents are range-partitioned by doc_id; a task encodes them with the
tokenizers library, appends the end id and cuts the stream, at document ends,
into files.  A file holds whole documents:

    magic "PLTF", version, plane mode, documents, ids, block length, blocks
    document table: doc_id, null flag, length (zstandard)
    chunk index: per block its ids, planes and the bytes of each plane
    planes: each block's ids, transposed and compressed plane by plane

A block is a fixed number of ids (the last of a file is shorter).  Spark's
Parquet writer stores one file per row, so a lost task leaves nothing half
written, and any store that Spark can reach will do.  Reading decodes files
independently; the global position of a file is the ids of the parts before its
own (one row per writing task) plus those before it in its part, which the writer notes.

Words that a Python worker has met are kept with their ids (about ``CACHE_WORDS``,
then it starts anew): no token spans a space, so a text's ids are its words' ids.

Defined cases: null text is empty and has the end id only; documents are in
ascending doc_id order, null ids first, equal ids by the hash of their text;
very long texts make a longer file; an empty table makes no file and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import PerWorker, WordIndex, pack, parallelism, ragged, shared_path, sums, text_or_empty, text_slices, unpack

CACHE_WORDS, CACHE_PIECES = 300_000, 600_000
BATCH_BYTES = 4 << 20
JOINED = 256
#: Bytes of words that are one pre-token, as they come and in lower case: letters of ASCII
#: and precomposed Latin ones (C3 and what may follow it but for the two signs between).
LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))])
#: Closing punctuation; none of these begins a contraction.
CLOSING = b".,;:!?"
FILE_IDS = 1 << 19
MAX_PARTS_SENT = 500_000
BLOCK_IDS = 1 << 16
MAGIC = b"PLTF"
MODES = ("byte", "bit")
HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("mode", "<u2"), ("docs", "<u8"), ("ids", "<u8"),
                 ("block", "<u4"), ("blocks", "<u4"), ("table", "<u8")])
INDEX = np.dtype([("ids", "<u4"), ("planes", "<u4")])


def _planes(ids: np.ndarray, mode: str) -> list[bytes]:
    bits = max(1, int(ids.max()).bit_length())
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((bits + 7) // 8)]
    shifted = (ids[None, :] >> np.arange(bits, dtype=np.uint32)[:, None]) & 1
    return [np.packbits(row.astype(np.uint8)).tobytes() for row in shifted]


def _from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def encode_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, mode: str = "byte", level: int = 1,
                block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of one file: ``ids`` (uint32) of whole documents, one after the other."""
    import zstandard
    z = zstandard.ZstdCompressor(level=level)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    signed = np.array([0 if d is None else d for d in doc_ids], np.int64)
    parts = [pack(signed.view(np.uint64)), pack(nulls), pack(lengths)]
    table = np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)
    index, payload = b"", []
    starts = range(0, len(ids), block_ids)
    for s in starts:
        block = ids[s:s + block_ids]
        planes = [z.compress(p) for p in _planes(block, mode)]
        index += np.array((len(block), len(planes)), INDEX).tobytes() + np.array([len(p) for p in planes], "<u4").tobytes()
        payload += planes
    head = np.array((MAGIC, 1, MODES.index(mode), len(doc_ids), len(ids), block_ids, len(starts), len(table)), HEAD)
    return head.tobytes() + table + index + b"".join(payload)


def decode_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, lengths and all ids of a file."""
    import zstandard
    z = zstandard.ZstdDecompressor()
    head = np.frombuffer(data, HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.itemsize
    sizes = np.frombuffer(data, "<u8", 3, at)
    spots = at + 24 + np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    signed, nulls, lengths = (unpack(data[a:b]) for a, b in zip(spots[:-1], spots[1:], strict=True))
    docs = [None if x else int(d) for d, x in zip(signed.view(np.int64), nulls, strict=True)]
    at += int(head["table"])
    blocks = []
    for _ in range(head["blocks"]):
        n, k = np.frombuffer(data, INDEX, 1, at)[0]
        blocks.append((int(n), np.frombuffer(data, "<u4", int(k), at + INDEX.itemsize).astype(int)))
        at += INDEX.itemsize + 4 * int(k)
    mode, ids = MODES[int(head["mode"])], []
    for n, planes in blocks:
        raw = []
        for size in planes:
            raw.append(z.decompress(data[at:at + size], max_output_size=max(1, 4 * n)))
            at += size
        ids.append(_from_planes(raw, n, mode))
    return docs, lengths.astype(np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32)


class WordEncoder:
    """Ids of texts by the tokenizers library, word by word."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        if ids("Ab cd. 5!") != [i for x in ("ab", "cd", ".", "5", "!") for i in ids(x)]:
            raise ValueError("the vocabulary must drop white space, lower-case and split punctuation off")
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.special = [s.encode() for s in special]
        self.divider = next(iter(special.items()), None)
        end = getattr(self.library.model, "end_of_word_suffix", None)
        # ids that end a pre-token; none where the vocabulary does not mark them
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if end and t.endswith(end)]] = True
        self.words = WordIndex(CACHE_WORDS, self.learn, self.reset)
        self.forget()
        self.reset()

    def forget(self):
        """No piece is known."""
        self.known: dict[bytes, int] = {}
        self.piece_ids, self.piece_first, self.piece_size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reset(self):
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.known) > CACHE_PIECES:
            self.forget()

    def library_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their numbers."""
        plain = np.fromiter((not w.translate(None, LETTERS) for w in words), bool, len(words))
        if not self.ends.any() or not plain.any():
            return self.other_ids(words)
        # many words in one call: each is one pre-token, whose last id is marked
        these = [w for w, p in zip(words, plain) if p]
        calls = [b" ".join(these[i:i + JOINED]).decode() for i in range(0, len(these), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(calls, add_special_tokens=False)])
        size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(size) != len(these):
            return self.other_ids(words)
        if plain.all():
            return ids, size
        more_ids, more_size = self.other_ids([w for w, p in zip(words, plain) if not p])
        both, first, sizes = np.concatenate([ids, more_ids]), np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = size, more_size
        first[plain], first[~plain] = np.cumsum(size) - size, len(ids) + np.cumsum(more_size) - more_size
        return both[ragged(first, sizes)], sizes

    def other_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:func:`library_ids` of any words."""
        joined = b" ".join(words)
        if self.divider and not any(s in joined for s in self.special):
            # many words in one call, told apart by a special token that none of them holds
            text, token = self.divider
            between = f" {text} ".encode()
            calls = [between.join(words[i:i + JOINED]).decode() for i in range(0, len(words), JOINED)]
            ids = np.concatenate([np.array([*e.ids, token], np.uint32)
                                  for e in self.library.encode_batch_fast(calls, add_special_tokens=False)])
            return ids[ids != token], np.diff(np.flatnonzero(ids == token), prepend=-1) - 1
        found = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def learn(self, words: list[bytes]) -> None:
        """A word is one piece, or two: closing punctuation behind a letter or digit
        is a pre-token of its own.  The vocabulary lower-cases, so ASCII pieces are
        met in lower case, and so are those of precomposed Latin letters (others would
        compose differently, and ``<|`` may begin a special string)."""
        pieces, parts = [], np.ones(len(words), np.int64)
        for i, w in enumerate(words):
            if not w.translate(None, LETTERS):
                pieces.append(w.lower())
                continue
            core = w.rstrip(CLOSING)
            if b"<|" in w:
                pieces.append(w)
                continue
            if len(core) < len(w) and core[-1:].isalnum():
                parts[i] = 2
            else:
                core = w
            pieces.append(core.lower() if core.isascii() or not core.translate(None, LETTERS) else core)
            if parts[i] == 2:
                pieces.append(w[len(core):])
        new = list(dict.fromkeys(x for x in pieces if x not in self.known))
        if new:
            ids, size = self.library_ids(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.piece_first = np.concatenate([self.piece_first, len(self.piece_ids) + np.cumsum(size) - size])
            self.piece_size = np.concatenate([self.piece_size, size])
            self.piece_ids = np.concatenate([self.piece_ids, ids])
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        size = sums(self.piece_size[which], parts)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, self.piece_ids[ragged(self.piece_first[which], self.piece_size[which])]])

    def batch(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths (with the end id) and ids of all texts, one after the other."""
        n_words, words = self.words.look(texts)
        size = self.size[words]
        n_ids = sums(size, n_words)
        ids = self.ids[ragged(self.first[words], size)]
        return n_ids + 1, np.insert(ids, np.cumsum(n_ids), end_id)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, mode: str = "byte") -> None:
    """Encode ``docs`` (doc_id, text) into files in ascending doc_id order below ``path``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        encoder = PerWorker.get("ids", tokenizer_path, lambda: WordEncoder(tokenizer_path))
        ids: list = []
        lengths: list = []
        doc_ids: list = []
        held = done = 0

        def flush():
            data = encode_file(doc_ids, np.concatenate(lengths), np.concatenate(ids), mode)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "seq", "first", "n_ids", "file"])

        for b in batches:
            for rows, texts in text_slices(b, BATCH_BYTES):
                n, got = encoder.batch(texts, end_id)
                ids.append(got)
                lengths.append(n)
                doc_ids += rows.column("doc_id").to_pylist()
                held += len(got)
                if held >= FILE_IDS:
                    yield flush()
                    done, seq = done + held, seq + 1
                    ids, lengths, doc_ids, held = [], [], [], 0
        if doc_ids:
            yield flush()

    tie = F.xxhash64(text_or_empty())
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), tie.alias("tie"))
               .repartitionByRange(parallelism(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .select("doc_id", "text"))
    (ordered.mapInArrow(run, "part int, seq int, first long, n_ids long, file binary")
     .write.option("compression", "none").parquet(path))


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for base, data in zip(b.column("base").to_pylist(), b.column("file").to_pylist(), strict=True):
                docs, lengths, ids = decode_file(data)
                starts = np.cumsum(lengths) - lengths
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + base), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the writer
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    # as many rows as the writer had tasks, 12 bytes each
    parts = F.broadcast(parts) if parallelism(spark) <= MAX_PARTS_SENT else parts
    return (files.join(parts, "part").select((F.col("part_base") + F.col("first")).alias("base"), "file")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, mode: str = "byte") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and report what the files hold."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, mode)
    return read_token_files(docs.sparkSession, path)
