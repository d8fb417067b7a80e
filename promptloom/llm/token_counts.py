"""Token counts by rank-synchronous array merging.

Texts split into words at ``[\\x20\\x09-\\x0D]``; no token spans such a space, so
a text has as many tokens as its words together.  Words not met before in the
task become pre-tokens (normalised, split by the vocabulary's own pattern), and
all new pre-tokens of a batch are held as one ragged array of symbol ids.  In
every round each sequence applies its lowest-ranked adjacent pair, at all its
places from left to right, all sequences at once; a sequence with no ranked pair
left is done, and its surviving symbols are its tokens.

Words of plain Latin characters are normalised in Python; any other word goes
through the vocabulary file's own normaliser and pre-tokeniser, so every text
counts exactly as with the library.  Special strings count one token, as by the
library's default.

A Python worker keeps the counts of the words it has met, about ``CACHE_WORDS``
(then it starts anew); this bounds memory and changes no result.

Defined cases: null text is empty (0 bytes, 0 tokens); ids may be null or
repeated; very long texts are whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import PerWorker, WordIndex, sums, text_or_empty, text_slices

CACHE_WORDS = 500_000
BATCH_BYTES = 4 << 20
NO_RANK = np.int64(1) << 40
#: Characters that need no library normalisation: printable ASCII, precomposed
#: Latin letters, common punctuation.
PLAIN = r"[\x20-\x7EÀ-ÿ–—‘’“”…]*"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Merges of a byte-level BPE vocabulary file, as sorted pair keys."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.library = Tokenizer.from_file(path)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in splits if s["type"] == "Split"))
        self.plain = regex.compile(PLAIN)
        self.byte_of = {s: b for b, s in enumerate(symbols)}

    def pre_tokens(self, word: str) -> tuple[int, list[bytes]]:
        """Special strings in the word, and its pre-tokens as bytes."""
        segments, n_special = [word], 0
        if self.special and "<" in word:
            segments = self.special.split(word)
            n_special = len(segments) - 1
        out = []
        for s in segments:
            if self.plain.fullmatch(s):
                out += [p.encode() for p in self.pattern.findall(s.lower())]
            elif s:
                norm = self.library.normalizer.normalize_str(s)
                out += [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return n_special, out

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NO_RANK), self.made[at]


def merged_lengths(table: MergeTable, pieces: list[bytes]) -> np.ndarray:
    """Symbols that survive in each (non-empty) pre-token."""
    out = np.zeros(len(pieces), np.int64)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = table.inner[raw]
    ends = np.cumsum(size)
    symbols[ends - 1] = table.last[raw[ends - 1]]
    live = np.arange(len(pieces))  # sequences that may still merge
    while len(live):
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(live)), size)
        rank = np.full(len(symbols), NO_RANK)
        made = np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside], made[inside] = table.rank(symbols[inside], symbols[inside + 1])
        lowest = np.minimum.reduceat(rank, starts)
        chosen = (rank == lowest[owner]) & (rank < NO_RANK)
        # of a run of chosen positions (x x x ...) every other one merges, from the left
        at = np.flatnonzero(chosen)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1)
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        left = np.add.reduceat(keep.astype(np.int64), starts)
        going = lowest < NO_RANK
        out[live] = left
        keep &= going[owner]
        symbols, size, live = symbols[keep], left[going], live[going]
    return out


class WordCounter:
    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.words = WordIndex(CACHE_WORDS, self.learn, self.reset)
        self.reset()

    def reset(self):
        self.counts = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        fixed = np.zeros(len(words), np.int64)
        pieces: dict[bytes, int] = {}
        owner, piece = [], []
        for i, w in enumerate(words):
            fixed[i], found = self.table.pre_tokens(w.decode())
            for p in found:
                owner.append(i)
                piece.append(pieces.setdefault(p, len(pieces)))
        if pieces:
            sizes = merged_lengths(self.table, list(pieces))
            fixed += np.bincount(owner, weights=sizes[piece], minlength=len(words)).astype(np.int64)
        self.counts = np.concatenate([self.counts, fixed])

    def batch(self, texts: list[bytes]) -> list[int]:
        n_words, words = self.words.look(texts)
        return sums(self.counts[words], n_words).tolist()


def count_tokens(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        counter = PerWorker.get("counts", tokenizer_path, lambda: WordCounter(tokenizer_path))
        for b in batches:
            counts: list[int] = []
            for _, texts in text_slices(b, BATCH_BYTES):
                counts += counter.batch(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
                       text_or_empty().cast("binary").alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
