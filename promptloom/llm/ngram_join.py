"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document's set is its distinct word n-grams, as 64-bit hashes.  Sizes fall
into bands whose ends grow by 1/threshold, so a pair spans at most two bands.
The band of the smaller set of a pair decides how the universe of n-grams is
cut into segments.  Two sets that reach the threshold differ in at most H
elements, so of any H+1 units that the larger set (the probe) picks, at least
one agrees: a segment is one unit if looked up exactly, two if looked up with its
one-deletion neighbourhood (the segment itself and it without any one element,
against the same of the other side).

Allocation.  Every set indexes all its non-empty segments in its own band (in
small bands, and in one segment in ``DELETION_EVERY`` of the others, with the
one-deletion neighbourhood).  A probe picks the H+1 cheapest units by expected
list length, which falls with the number of uncommon n-grams in the segment;
common ones are told by a fixed-size count sketch over all documents.  Empty
segments are never used, and the one-deletion unit needs two elements: without its
only one the other side's segment may be empty.  In smaller bands several independent partitions are
indexed, and a probe takes the first where its non-empty segments suffice;
a probe without any (rarer than one in 10^8) is compared with all sets in blocks.

Exchange.  Signatures travel packed (6 bytes) by signature bucket.  Documents
that share one meet in a star: every member with the member of lowest priority
hash, which tends to be the same for all signatures of a group of copies.  The
members of a centre then meet with their sets and are verified exactly, but never
two documents that are already connected: up to ``BLOCK`` members all with all, of
more, in blocks, each with the centre only.  What does not link with such a centre
meets the members of its stars again by prefix: a set's n-grams in the order of
their count in the sketch, of which two linked sets share one among the first
|s| - ceil(threshold |s|) + 1 of each.  Those signatures make smaller stars, since a
passage of many documents comes last.  What is open in a star of these that still
has more than ``BLOCK`` members meets the others by pairs of blocks, so a task holds
about ``BLOCK`` sets on either side.  No pair list of a group is ever made.  Links
become components.

Defined cases: null or empty text, or no words: n_shingles 0, its own component;
fewer words than n: the whole sequence is the one element; equal sets link;
repeated rows and doc_ids are separate documents (component_id is the smallest
doc_id; null ids count as larger than all others, and an all-null component has
null); an empty table gives an empty result; extra columns are ignored; a very long
text is a chunk of its own, held whole by its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.chunks import CHUNK_DOCS, chunk_words, mix, token_chunks
from promptloom.llm.common import each_row, lean, pack, parallelism, stored, stored_by, unpack
from promptloom.llm.components import components

SKETCH = 1 << 20  # cells of the n-gram count sketch
SMALL_BAND = 48  # bands up to here use one-deletion neighbourhoods everywhere
DELETION_EVERY = 32
BUCKET_ROWS = 500_000
BLOCK = 256
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Expected list length of a segment by its uncommon n-grams, and a part for all of them.
BY_LOAD, BY_SIZE = 4.0 ** -np.arange(21), 1e-3 * 2.0 ** -np.arange(21)
INDEX, PROBE, DELETED = 1 << 12, 1 << 13, 1 << 14  # flags above the 12 bits of a document's place


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a document's word hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i:len(words) - k + 1 + i] * STEPS[i]
    short = np.array([(n - k) * int(STEPS[7]) % 2**64], np.uint64)  # a short sequence is no n-gram
    return np.unique(mix(total + short))


def document_sets(lengths: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    ends = np.cumsum(lengths)
    return [shingle_set(hashes[e - k:e], n) for e, k in zip(ends, lengths, strict=True)]


def first_equal(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of a chunk, the place of the first that equals it."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(s.tobytes(), i) if len(s) else i for i, s in enumerate(sets)], np.int64)


class Bands:
    """Size bands and their partitions for a threshold of ``num`` percent."""

    def __init__(self, num: int = 75):
        self.num = num
        self.tops: list[int] = []
        self.salts: dict[tuple[int, int], tuple] = {}

    def _reach(self, size: int) -> None:
        while not self.tops or self.tops[-1] < size:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(max(low, low * 100 // self.num))

    def of(self, size: int) -> range:
        """The bands in which sets that may pair with this one, and are no larger, lie; its own is the last."""
        self._reach(size)
        smallest = -(-size * self.num // 100)
        own = int(np.searchsorted(self.tops, size))
        return range(int(np.searchsorted(self.tops, max(1, smallest))), own + 1)

    def differ(self, size: int, band: int) -> int:
        """Most elements in which a set of this size and a set of the band, no larger, may differ."""
        return (size + min(size, self.tops[band])) * (100 - self.num) // (100 + self.num)

    def salt(self, band: int, family: int, m: int) -> tuple[np.uint64, np.ndarray]:
        """Salts of a partition and of its segments."""
        if (band, family) not in self.salts:
            own = np.uint64((band * 8 + family + 1) * int(STEPS[5]) % 2**64)
            self.salts[band, family] = own, mix(np.arange(m, dtype=np.uint64) + own)
        return self.salts[band, family]

    def segments(self, band: int) -> tuple[int, int, int]:
        """Segments, how many of them have one-deletion neighbourhoods, partitions."""
        top = self.tops[band]
        most = self.differ(top * 100 // self.num, band)
        if top <= SMALL_BAND:
            m = (most + 2) // 2 + 1
            return m, m, 3
        m = (most + 1) * 5 // 4 + 4
        return m, max(1, m // DELETION_EVERY), 2 if top <= 150 else 1


def signatures(s: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Signatures (64 bits) and flags of one set; whether some band had too few units.
    ``common``: whether each element is a common n-gram."""
    sigs, flags, broad = [], [], False
    own = bands.of(len(s))[-1]
    for band in bands.of(len(s)):
        m, q, families = bands.segments(band)
        need = bands.differ(len(s), band) + 1
        served = False
        for family in range(families):
            salt, seg_salt = bands.salt(band, family, m)
            seg = ((mix(s ^ salt) >> np.uint64(24)) % np.uint64(m)).astype(np.int64)
            size = np.bincount(seg, minlength=m)
            load = np.bincount(seg, weights=~common, minlength=m)
            total = np.zeros(m, np.uint64)
            np.add.at(total, seg, s)
            exact = mix(total ^ seg_salt)
            used = np.flatnonzero(size)
            picked = np.zeros(m, np.int64)
            if not served:
                # units in rising cost: a list shortens with each uncommon n-gram of the segment
                cost = BY_LOAD[np.minimum(load[used], 20).astype(np.int64)] + BY_SIZE[np.minimum(size[used], 20)]
                near = np.flatnonzero((used < q) & (size[used] > 1))
                cost = np.concatenate([cost, 4 * size[used[near]] * cost[near]])
                units = np.concatenate([used, used[near]])[np.argsort(cost, kind="stable")[:need]]
                if len(units) == need:
                    np.add.at(picked, units, 1)
                    served = True
            index = band == own
            use = used if index else used[picked[used] > 0]
            sigs.append(exact[use])
            flags.append(np.where(picked[use] > 0, PROBE, 0) | (INDEX if index else 0))
            # deletions: of indexed segments that have them, and of segments picked twice
            wide = (np.arange(m) < q) if index else np.zeros(m, bool)
            el = np.flatnonzero((wide[seg] & (size[seg] > 1)) | (picked[seg] > 1))
            if len(el):
                owner = seg[el]
                sigs.append(mix((total[owner] - s[el]) ^ seg_salt[owner]))
                flags.append(np.where(picked[owner] > 1, PROBE, 0) | (INDEX if index else 0) | DELETED)
            if not index and served:
                break
        broad |= not served
    return np.concatenate(sigs), np.concatenate(flags), broad


class _Info:
    """Per chunk: set sizes and first equal sets; per task: the n-gram count sketch."""

    def __init__(self, n: int):
        self.n = n
        self.sketch = np.zeros(SKETCH, np.int64)

    def info(self, lengths, hashes) -> bytes:
        sets = document_sets(lengths, hashes, self.n)
        first = first_equal(sets)
        if sets:
            cells = np.concatenate(sets) & np.uint64(SKETCH - 1)
            self.sketch += np.bincount(cells.astype(np.int64), minlength=SKETCH)
        a = pack(np.array([len(s) for s in sets], np.int64))
        return len(a).to_bytes(8, "little") + a + pack(first)

    def finish(self) -> bytes:
        return pack(self.sketch)


def _read_info(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int.from_bytes(data[:8], "little")
    return unpack(data[8:8 + k]).astype(np.int64), unpack(data[8 + k:]).astype(np.int64)


def _sketch(chunks: DataFrame) -> np.ndarray:
    """The summed count sketch: added up in tasks, in a fixed number of slices."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for x in b.column("info").to_pylist():
                total += unpack(x).astype(np.int64)
        parts = np.split(total, 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([pack(p) for p in parts], pa.binary())],
                                         names=["slice", "cells"])

    def add(table):
        import pyarrow as pa
        total = sum(unpack(x).astype(np.int64) for x in table.column("cells").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "cells": pa.array([pack(total)], pa.binary())})

    rows = (chunks.filter("chunk < 0").select("info").mapInArrow(lean(cut), "slice int, cells binary")
            .groupBy("slice").applyInArrow(lean(add), "slice int, cells binary").orderBy("slice").collect())  # 16 rows
    return np.concatenate([unpack(r["cells"]) for r in rows]).astype(np.int64)


def _packed(chunk: int, sig: np.ndarray, flag: np.ndarray, n_buckets: int, broad: list[int]):
    """The signatures of a chunk as rows (bucket, chunk, sigs, flags), or nothing."""
    import pyarrow as pa
    bucket = ((sig >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    low, flag, bucket = (sig[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), flag[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    out = [(k, low[cuts[k]:cuts[k + 1]].tobytes(), flag[cuts[k]:cuts[k + 1]].tobytes()) for k in full]
    if broad:
        out.append((n_buckets, b"", np.array(broad, np.uint16).tobytes()))
    if out:
        ks, a, c = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ks, pa.int64()), pa.array([chunk] * len(ks), pa.int64()), pa.array(a, pa.binary()),
             pa.array(c, pa.binary())], names=["bucket", "chunk", "sigs", "flags"])


def _signature_rows(chunks: DataFrame, n: int, num: int, n_buckets: int, common_cells) -> DataFrame:
    """(bucket, chunk, sigs, flags): the chunk's signatures of one bucket; in the
    last bucket the places of documents to be compared with all."""

    def run(batches: Iterator) -> Iterator:
        bands, cells = Bands(num), common_cells.value
        for b in batches:
            for row in each_row(b):
                lengths, lexicon, words = chunk_words(row)
                sizes, first = _read_info(row["info"])
                sets = document_sets(lengths, lexicon[words], n)
                sigs, flags, broad = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
                for i, s in enumerate(sets):
                    if not len(s) or first[i] != i:
                        continue
                    found, flag, lacking = signatures(s, bands, cells[(s & np.uint64(SKETCH - 1)).astype(np.int64)])
                    sigs.append(found)
                    flags.append(flag | i)
                    if lacking:
                        broad.append(i)
                sig, flag = np.concatenate(sigs), np.concatenate(flags).astype(np.uint16)
                yield from _packed(row["chunk"], sig, flag, n_buckets, broad)

    return chunks.filter("chunk >= 0").select("chunk", "lengths", "lexicon", "words", "info").mapInArrow(
        lean(run), "bucket long, chunk long, sigs binary, flags binary")


def prefix(s: np.ndarray, counts: np.ndarray, num: int) -> np.ndarray:
    """The rarest n-grams of a set, of which a set that links with it has one among its own rarest."""
    k = len(s) + -num * len(s) // 100 + 1
    return s[np.lexsort((s, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:k]]


def _prefix_rows(chunks: DataFrame, wanted: DataFrame, n: int, num: int, n_buckets: int, counts) -> DataFrame:
    """(bucket, chunk, sigs, flags): prefixes of the wanted documents (x, open) by
    bucket; only open ones are indexed, so every pair has one of them."""
    by_chunk = wanted.groupBy(F.floor(F.col("x") / CHUNK_DOCS).alias("chunk")).agg(
        F.collect_list(F.struct("x", "open")).alias("wanted"))  # at most CHUNK_DOCS

    def run(batches: Iterator) -> Iterator:
        cells = counts.value
        for b in batches:
            for row in each_row(b):
                lengths, lexicon, words = chunk_words(row)
                ends = np.cumsum(lengths)
                sigs, flags = [], []
                for w in row["wanted"]:
                    i = w["x"] % CHUNK_DOCS
                    first = mix(prefix(shingle_set(lexicon[words[ends[i] - lengths[i]:ends[i]]], n), cells, num))
                    sigs.append(first)
                    flags.append(np.full(len(first), i | PROBE | (INDEX if w["open"] else 0), np.uint16))
                yield from _packed(row["chunk"], np.concatenate(sigs), np.concatenate(flags), n_buckets, [])

    slim = chunks.filter("chunk >= 0").select("chunk", "lengths", "lexicon", "words")
    return slim.join(by_chunk, "chunk").mapInArrow(lean(run), "bucket long, chunk long, sigs binary, flags binary")


def _stars(signature_rows: DataFrame, n_buckets: int) -> DataFrame:
    """(c, x): centre and member of every signature that a probe and an indexed
    set share; (-1, x) for the documents to be compared with all."""

    def run(table):
        import pyarrow as pa
        kind = pa.schema([("c", pa.int64()), ("x", pa.int64())])
        flags = [np.frombuffer(f, np.uint16) for f in table.column("flags").to_pylist()]
        chunk = np.repeat(np.array(table.column("chunk").to_pylist(), np.int64), [len(f) for f in flags])
        flag = np.concatenate(flags).astype(np.int64)
        node = chunk * CHUNK_DOCS + (flag & (CHUNK_DOCS - 1))
        if table.column("bucket")[0].as_py() == n_buckets:
            return pa.table({"c": np.full(len(node), -1), "x": node}, schema=kind)
        sig = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint32)
        order = np.argsort(sig, kind="stable")
        sig, node, flag = sig[order], node[order], flag[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        starts = np.flatnonzero(new)
        counts = np.diff(np.concatenate([starts, [len(sig)]]))
        kinds = np.bitwise_or.reduceat(flag & (INDEX | PROBE), starts)
        live = (counts > 1) & (kinds == (INDEX | PROBE))
        keep = np.repeat(live, counts)
        node, flag, counts = node[keep], flag[keep], counts[live]
        if not len(node):
            return kind.empty_table()
        starts = np.cumsum(counts) - counts
        rank = mix(node.astype(np.uint64)) >> np.uint64(1)
        rank[(flag & INDEX) == 0] = np.uint64(2**63)
        best = np.minimum.reduceat(rank, starts)
        group = np.repeat(np.arange(len(starts)), counts)
        is_best = np.flatnonzero(rank == best[group])
        centre = np.zeros(len(starts), np.int64)
        centre[group[is_best]] = node[is_best]
        pairs = np.unique(np.stack([centre[group], node], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table({"c": pairs[:, 0], "x": pairs[:, 1]}, schema=kind)

    return signature_rows.groupBy("bucket").applyInArrow(lean(run), "c long, x long")


def _sets_of(chunks: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(x, c, block, ...) -> (c, block, x, role, elements): the sets of the wanted documents."""
    by_chunk = wanted.groupBy(F.floor(F.col("x") / CHUNK_DOCS).alias("chunk")).agg(
        F.collect_list(F.struct("x", "c", "block", "role")).alias("wanted"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for row in each_row(b):
                lengths, lexicon, words = chunk_words(row)
                ends = np.cumsum(lengths)
                made: dict[int, bytes] = {}
                for i in {w["x"] % CHUNK_DOCS for w in row["wanted"]}:
                    made[i] = shingle_set(lexicon[words[ends[i] - lengths[i]:ends[i]]], n).tobytes()
                for k in range(0, len(row["wanted"]), 512):
                    part = row["wanted"][k:k + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["c"] for w in part], pa.int64()), pa.array([w["block"] for w in part], pa.int64()),
                         pa.array([w["x"] for w in part], pa.int64()), pa.array([w["role"] for w in part], pa.int32()),
                         pa.array([made[w["x"] % CHUNK_DOCS] for w in part], pa.binary())],
                        names=["c", "block", "x", "role", "elements"])

    slim = chunks.filter("chunk >= 0").select("chunk", "lengths", "lexicon", "words")
    return slim.join(by_chunk, "chunk").mapInArrow(lean(run), "c long, block long, x long, role int, elements binary")


class _Groups:
    """Union-find over a few documents."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def linked(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < num * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= num * (len(a) + len(b) - both)


def may_link(sets: list[np.ndarray], num: int) -> np.ndarray:
    """Whether enough of each set's elements occur in any other of these sets."""
    flat = np.concatenate(sets)
    _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    size = np.array([len(s) for s in sets])
    shared = np.add.reduceat((counts[where] > 1).astype(np.int64), np.cumsum(size) - size)
    return 100 * shared >= num * size


#: What a document is to a block: its centre or one of its members.
CENTRE, MEMBER = 0, 1
#: What it is to a pair of blocks: of the first side, open, not linked with the centre.
SIDE, OPEN, FAR = 1, 2, 4


def _verify(members: DataFrame, num: int) -> DataFrame:
    """(a, b, met): verified links of a block (met) and, in a centre with several
    blocks, the members that did not link with the centre (not met, b = centre)."""

    def run(table):
        import pyarrow as pa
        role = np.array(table.column("role").to_pylist())
        node = table.column("x").to_pylist()
        sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        split = table.column("block")[0].as_py() >= 0  # one of several blocks of its centre
        out: list[tuple[int, int, bool]] = []
        groups = _Groups(len(sets))
        centre = int(np.flatnonzero(role == CENTRE)[0])
        active = may_link(sets, num)

        def meet(i, j):
            if groups.root(i) != groups.root(j) and linked(sets[i], sets[j], num):
                groups.join(i, j)
                out.append((node[i], node[j], True))

        for i in range(len(sets)):
            if i != centre and active[i] and active[centre]:
                meet(i, centre)
        if split:
            near = groups.root(centre)
            out += [(node[i], node[centre], False) for i in range(len(sets)) if groups.root(i) != near]
        else:
            live = np.flatnonzero(active).tolist()
            for k, i in enumerate(live):
                for j in live[k + 1:]:
                    meet(i, j)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "met": pa.array(cols[2], pa.bool_())})

    return members.groupBy("c", "block").applyInArrow(lean(run), "a long, b long, met boolean")


def _cross(pairs: DataFrame, num: int) -> DataFrame:
    """(a, b): verified links of pairs of blocks: its open documents of the first
    side with the members of the second."""

    def run(table):
        import pyarrow as pa
        role = np.array(table.column("role").to_pylist())
        node = table.column("x").to_pylist()
        sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        groups = _Groups(len(sets))
        same: dict[int, int] = {}
        for i, x in enumerate(node):
            groups.join(i, same.setdefault(x, i))
        near = np.flatnonzero(role & FAR == 0).tolist()
        for i in near[1:]:  # connected through the centre
            groups.join(i, near[0])
        out: list[tuple[int, int]] = []
        others = np.flatnonzero(role & SIDE == 0).tolist()
        for i in np.flatnonzero(role & SIDE).tolist():
            for j in others:
                if role[j] & OPEN and node[j] < node[i]:
                    continue  # met with the sides exchanged
                if groups.root(i) != groups.root(j) and linked(sets[i], sets[j], num):
                    groups.join(i, j)
                    out.append((node[i], node[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("c", "block").applyInArrow(lean(run), "a long, b long")


def _star_round(chunks: DataFrame, stars: DataFrame, n: int, num: int, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Links of the stars, and (x, c) of the members of stars with several blocks that do not link with the centre."""
    sizes = stars.groupBy("c").agg(F.count("*").alias("k"))
    blocks = sizes.select("c", F.when(F.col("k") <= block, 0).otherwise(F.ceil(F.col("k") / block)).cast("long").alias("n_blocks"))
    own = F.when(F.col("n_blocks") == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("x"), F.greatest("n_blocks", F.lit(1)))).cast("long")
    centre_blocks = F.when(F.col("n_blocks") == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    in_blocks = stars.join(blocks, "c").select("x", "c", own.alias("block"), F.lit(MEMBER).alias("role"))
    centres = blocks.select(F.col("c").alias("x"), "c", F.explode(centre_blocks).alias("block"), F.lit(CENTRE).alias("role"))
    met = stored(_verify(_sets_of(chunks, in_blocks.unionByName(centres), n), num), name)
    return met.filter("met").select("a", "b"), met.filter("not met").select(F.col("a").alias("x"), F.col("b").alias("c"))


def _star_links(chunks: DataFrame, stars: DataFrame, n: int, num: int, block: int, n_buckets: int,
                sketch: np.ndarray) -> list[DataFrame]:
    first, rest = _star_round(chunks, stars, n, num, block, "star-links")
    if rest.isEmpty():
        return [first]
    # what did not link with the centre meets the members of its stars in smaller ones
    counts = chunks.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**32 - 1).astype(np.uint32))
    members = stars.join(rest.select("c").distinct(), "c", "left_semi").select("x").distinct()
    opened = rest.select("x").distinct().withColumn("open", F.lit(True))
    wanted = stored(members.join(opened, "x", "left").select("x", F.coalesce("open", F.lit(False)).alias("open")), "rest-members")
    again = stored(_stars(_prefix_rows(chunks, wanted, n, num, n_buckets, counts), n_buckets).distinct(), "rest-stars")
    second, far = _star_round(chunks, again, n, num, block, "rest-links")
    if far.isEmpty():
        return [first, second]
    # and what did not link with the centre of these, in pairs of blocks
    inside = (again.join(far.select("c").distinct(), "c", "left_semi").join(wanted, "x")
              .join(far.withColumn("far", F.lit(True)), ["x", "c"], "left"))
    inside = stored(inside.select("x", "c", "open", (F.when(F.col("open"), OPEN).otherwise(0)
                                                     + F.when(F.col("far"), FAR).otherwise(0)).alias("role")), "far-members")
    sides = inside.groupBy("c").agg(F.ceil(F.sum(F.col("open").cast("long")) / block).alias("n_first"),
                                    F.ceil(F.count("*") / block).alias("n_second"))
    placed = inside.join(sides.filter("n_first > 0"), "c")  # else the centre alone is open, and it met all
    up_to = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    one = placed.filter("open").withColumn("i", F.pmod(F.xxhash64("x"), "n_first")).withColumn("j", up_to("n_second"))
    other = placed.withColumn("j", F.pmod(F.xxhash64("x"), "n_second")).withColumn("i", up_to("n_first"))
    copies = one.withColumn("role", F.col("role") + SIDE).unionByName(other).select(
        "x", "c", (F.col("i") * F.col("n_second") + F.col("j")).alias("block"), "role")
    alone = inside.select("x", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("block"), F.lit(MEMBER).alias("role"))
    sets = stored(_sets_of(chunks, alone.distinct(), n).select("x", "elements"), "far-sets")
    return [first, second, stored(_cross(copies.join(sets, "x"), num), "far-links")]


def _broad_links(chunks: DataFrame, broad: DataFrame, n: int, num: int, block_bytes: int = 32 << 20) -> list[DataFrame]:
    """Links of the documents to be compared with all, in blocks of their sets."""
    spark = chunks.sparkSession
    wanted = broad.select("x", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("block"), F.lit(MEMBER).alias("role"))

    def against(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            for b in batches:
                for row in each_row(b):
                    lengths, lexicon, words = chunk_words(row)
                    base = row["chunk"] * CHUNK_DOCS
                    met = [(base + i, x) for i, s in enumerate(document_sets(lengths, lexicon[words], n)) if len(s)
                           for x, other in sent.value if linked(s, np.frombuffer(other, np.uint64), num)]
                    a, c = zip(*met, strict=True) if met else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

        slim = chunks.filter("chunk >= 0").select("chunk", "lengths", "lexicon", "words")
        return stored(slim.mapInArrow(lean(run), "a long, b long"), "broad-links")

    out, block, size = [], [], 0
    for r in stored(_sets_of(chunks, wanted, n), "broad-sets").toLocalIterator():
        block.append((r["x"], bytes(r["elements"])))
        size += len(r["elements"])
        if size > block_bytes:
            out.append(against(block))
            block, size = [], 0
    return out + ([against(block)] if block else [])


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    chunks = stored_by(token_chunks(docs, lambda: _Info(n)), "ngram_chunks", "chunk")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    if total == 0:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"),
                           F.col("doc_id").cast("long").alias("component_id"))
    sketch = _sketch(chunks)
    mean = sketch.mean()
    common = spark.sparkContext.broadcast(sketch > mean + 8 * np.sqrt(mean) + 32)  # one flag a cell
    n_buckets = max(parallelism(spark), total // BUCKET_ROWS)
    stars = stored(_stars(_signature_rows(chunks, n, percent, n_buckets, common), n_buckets).distinct(), "stars")
    links = _star_links(chunks, stars.filter("c >= 0"), n, percent, block, n_buckets, sketch)
    broad = stars.filter("c < 0").select("x")
    if not broad.isEmpty():
        links += _broad_links(chunks, broad, n, percent)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionAll(more)

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for row in each_row(b):
                sizes, first = _read_info(row["info"])
                base = row["chunk"] * CHUNK_DOCS
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(base + first)],
                                                 names=["doc_id", "n_shingles", "node"])

    rows = chunks.filter("chunk >= 0").select("chunk", "doc_ids", "info").mapInArrow(
        lean(describe), "doc_id long, n_shingles long, node long")
    rows = stored(rows, "set-rows")
    # a node is its smallest doc_id and its number, so the smallest node of a component names it
    no_id = F.lit(2**63 - 1)
    named = rows.groupBy("node").agg(F.coalesce(F.min("doc_id"), no_id).alias("id")).select("node", F.struct("id", "node").alias("name"))
    edges = (edges.join(named.select(F.col("node").alias("a"), F.col("name").alias("name_a")), "a")
             .join(named.select(F.col("node").alias("b"), F.col("name").alias("name_b")), "b")
             .select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    roots = components(edges).select(F.col("node.node").alias("node"), F.col("root.id").alias("root"))
    out = (rows.join(named.select("node", F.col("name.id").alias("id")), "node").join(roots, "node", "left")
           .withColumn("c", F.coalesce("root", "id")))
    return out.select("doc_id", "n_shingles", F.when(F.col("c") < no_id, F.col("c")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One row of every component of ``docs``, with all its columns.

    The join knows rows by a hash of doc_id and text, so repeated ids do no harm.  Of
    rows with equal id and text the one of least hash over all columns stays; rows are
    taken for equal by id and SHA-256 of the text, so two unlike rows whose 64-bit
    hashes collide both stay rather than one of them being lost."""
    key = F.xxhash64("doc_id", "text")
    found = ngram_join(docs.select(key.alias("doc_id"), "text"), n, percent)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row_key")).distinct()
    names = docs.columns
    every = [F.col(f"`{c}`") for c in names]
    rows = docs.select(key.alias("row_key"), F.col("doc_id").alias("row_id"), F.sha2("text", 256).alias("row_text"),
                       F.xxhash64(*every).alias("row_rank"), F.struct(*every).alias("row"))
    one = rows.join(kept, "row_key", "left_semi").groupBy("row_key", "row_id", "row_text").agg(F.min_by("row", "row_rank").alias("row"))
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
