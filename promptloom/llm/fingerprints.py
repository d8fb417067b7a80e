"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased),
each with up to ``words - 1`` words before it; a term's weight is how often it
occurs.  Sample ``s`` of a text draws for every term k three variates that only
(k, s) decide, r and c ~ Gamma(2, 1) and b ~ U(0, 1), and with weight w

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r.

The term of least a wins (ties: the smallest term hash) and (k, t) is the sample.
Two texts share a sample with a probability of their generalised Jaccard
similarity, sum of min(w) over sum of max(w).  A fingerprint holds 16 bits of each
of ``SAMPLES`` samples as hex; the share of equal samples estimates the similarity.

Few terms can win a sample.  With u = exp(-r), a >= c u / w, a = c u^(1 - b) where
w = 1, and c >= 1 - exp(-c).  The first bits of the uniforms behind them bound a from
below; only terms whose bound is not above the best a so far are drawn in full, which
changes no result.

:func:`fingerprint` is a map.  :func:`with_next` compares each document with the
one after it: rows are dealt into ranges of (id, hash of the text) that begin at
pivot documents, which are copied to the end of the range before.  Pivots are the
rows of least hash, a number fixed by the partitions; the first document of all is
one.  A row's text is exchanged once and no row meets more than its neighbours.

Defined cases: a null text is empty; a text without words has the fingerprint ''
(likeness 1 to itself, 0 to others); ids may be null (first) or repeated (then in
the order of the text's hash, and of the text); equal rows may lie anywhere next to
each other; a lone document follows itself; an empty table gives an empty result;
extra columns are ignored.  Very long texts are whole: they are hashed in chunks,
and a task holds the text, its neighbour and some 50 bytes for every word of both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import lean, parallelism, text_or_empty, text_slices

SAMPLES = 64
WORDS = 5
#: Candidate pivots for each range (their number decides how even the ranges are).
PIVOTS = 16
CHUNK = 1 << 16
BATCH_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = _U(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (multiply and shift)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Terms:
    """Hashes of the terms of texts, in numpy, a chunk of bytes at a time."""

    def __init__(self, words: int):
        self.words = words
        value = mix(np.arange(1, 257, dtype=np.uint64))
        value[65:91] = value[97:123]
        self.value = value
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.power = self._powers(_BASE)
        self.inverse = self._powers(pow(_BASE, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        p = np.full(CHUNK + 1, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    def word_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word.  A word's hash is the sum of its bytes'
        values times powers of a base, by which a word cut by a chunk is continued."""
        starts, hashes = [], []
        open_at = open_hash = 0
        is_open = False
        for a in range(0, len(raw), CHUNK):
            part = raw[a:a + CHUNK]
            gap = self.space[part]
            first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
            end = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[part] * self.power[:len(part)], dtype=np.uint64)])
            h = (total[end] - total[first]) * self.inverse[first]
            at = first + a
            if is_open and len(part) and not gap[0]:  # the word of the chunk before goes on
                open_hash = (open_hash + pow(_BASE, a - open_at, 1 << 64) * int(h[0])) & _MASK
                at[0], h[0] = open_at, open_hash
            elif is_open:
                starts.append(np.array([open_at]))
                hashes.append(np.array([open_hash], np.uint64))
            is_open = bool(len(part)) and not gap[-1]
            if is_open:
                open_at, open_hash = int(at[-1]), int(h[-1])
                at, h = at[:-1], h[:-1]
            starts.append(at)
            hashes.append(h)
        if is_open:
            starts.append(np.array([open_at]))
            hashes.append(np.array([open_hash], np.uint64))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, hash) of every term of every text, owners ascending."""
        starts, word = self.word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
        edges = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(edges, starts, "right")
        word = mix(word)
        run = np.arange(len(word)) - np.searchsorted(owner, np.arange(len(texts)))[owner]  # words before it in its text
        out = word + np.minimum(run, self.words - 1).astype(np.uint64)
        factor = 1
        for j in range(1, min(self.words, len(word))):
            factor = factor * int(_STEP) & _MASK
            out[j:] += np.where(run[j:] >= j, word[:-j] * _U(factor), _U(0))
        return owner, mix(out)


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits, in place (its input is mixed already, but for a constant)."""
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _log2(x: np.ndarray) -> np.ndarray:
    """A lower bound of the binary logarithm of positive float32 numbers, off by
    0.09 at most: exponent and mantissa, read as one number."""
    out = x.view(np.int32).astype(np.float32)
    out *= np.float32(2.0 ** -23)
    out -= np.float32(127)
    return out


class Sampler:
    """The ``samples`` consistent samples of weighted term sets."""

    BLOCK = 512

    def __init__(self, samples: int):
        self.samples = samples
        seed = mix(np.arange(1, samples + 1, dtype=np.uint64) * _STEP)
        self.flip_u, self.flip_v = (seed >> _U(32)).astype(np.uint32), seed.astype(np.uint32)

    def codes(self, term: np.ndarray, weight: np.ndarray, left: int, right: int):
        """Codes of two sets that share terms of equal weight: entries [0, right) are the
        first set's, entries [left, end) the second's.  Entries of a set are distinct."""
        first, second = self._none(), self._none()
        for i in range(0, len(term), self.BLOCK):
            k, w = term[i:i + self.BLOCK], weight[i:i + self.BLOCK]
            lo, hi = max(0, left - i), max(0, min(len(k), right - i))
            xu = _mix32((k >> _U(32)).astype(np.uint32)[:, None] ^ self.flip_u)
            xv = _mix32(k.astype(np.uint32)[:, None] ^ self.flip_v)
            bound = self._bound(xu, xv, w)
            if i == 0 or i <= left < i + self.BLOCK:  # first limits: the entry of least bound in every sample
                columns = np.arange(self.samples)
                at = [bound[:hi].argmin(0) * self.samples + columns] if hi else []
                at += [(lo + bound[lo:].argmin(0)) * self.samples + columns] if lo < len(k) else []
                self._draw(first, second, lo, hi, k, w, xu, xv, np.concatenate(at))
            # more than float32 rounds away
            a, b = ((np.log2(x[0]) + 1e-3).astype(np.float32) for x in (first, second))
            cut = [bound[:min(lo, hi)] <= a, bound[min(lo, hi):hi] <= np.maximum(a, b), bound[hi:] <= b]
            self._draw(first, second, lo, hi, k, w, xu, xv, np.flatnonzero(np.concatenate(cut)))
        return self._code(first), self._code(second)

    def _none(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best a, its term and its t, before any term was seen."""
        return np.full(self.samples, np.inf), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)

    @staticmethod
    def _bound(xu: np.ndarray, xv: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A lower bound of log2 a, from the heads of the uniforms."""
        log_u = _log2((xu >> np.uint32(21)).astype(np.float32) * (xu & np.uint32(2047)).astype(np.float32))
        log_u -= np.float32(22)
        part = ((xu >> np.uint32(11)) & np.uint32(1023)).astype(np.float32)  # of b
        part *= np.float32(-1 / 1024)
        part += np.float32(1)
        heavy = w > 1
        if heavy.any():  # y <= w is all that is known
            part[heavy] = 1
        log_u *= part
        v = (xv >> np.uint32(16)).astype(np.float32)
        v += np.float32(1)
        other = (xv & np.uint32(0xFFFF)).astype(np.float32)
        other += np.float32(1)
        v *= other
        np.subtract(np.float32(2.0 ** 32 - 512), v, out=v)  # 512: more than float32 rounds away
        bound = _log2(np.maximum(v, np.float32(1), out=v))
        bound -= np.float32(32)
        bound += log_u
        if heavy.any():
            bound[heavy] -= np.log2(w[heavy]).astype(np.float32)[:, None]
        return bound

    def _draw(self, first, second, lo, hi, k, w, xu, xv, at: np.ndarray) -> None:
        """Draw the places ``at`` (entry by sample) in full and take what is better."""
        if not len(at):
            return
        row, col = at // self.samples, at % self.samples
        kk, hu, hv = k[row], xu.ravel()[at], xv.ravel()[at]
        tail = mix(kk ^ ((hu.astype(np.uint64) << _U(32)) | hv))
        more = mix(tail + _STEP)

        def uniform(head, bits, x, shift):
            return (head * 65536.0 + ((x >> _U(shift)) & _U(0xFFFF)) + 0.5) * 2.0 ** -(bits + 16)

        r = -np.log(uniform(hu >> np.uint32(21), 11, tail, 0) * uniform(hu & np.uint32(2047), 11, tail, 16))
        c = -np.log(uniform(hv >> np.uint32(16), 16, tail, 32) * uniform(hv & np.uint32(0xFFFF), 16, tail, 48))
        beta = uniform((hu >> np.uint32(11)) & np.uint32(1023), 10, more, 0)
        ww = w[row]
        t = np.floor(np.log(ww) / r + beta) if ww.max() > 1 else np.zeros(len(r))
        a = c * np.exp(-r * (t - beta + 1))
        order = np.lexsort((kk, a, col))
        for (least, key, step), mine in ((first, row < hi), (second, row >= lo)):
            o = order[mine[order]]
            o = o[np.concatenate([[True], col[o][1:] != col[o][:-1]])[:len(o)]]
            s = col[o]
            wins = (a[o] < least[s]) | ((a[o] == least[s]) & (kk[o] < key[s]))
            s, o = s[wins], o[wins]
            least[s], key[s], step[s] = a[o], kk[o], t[o].astype(np.int64)

    def _code(self, best) -> np.ndarray | None:
        """16 bits of every sample, or None where there was no term."""
        least, key, step = best
        if np.isinf(least[0]):
            return None
        return (mix(mix(key) + step.astype(np.uint64) * _STEP) >> _U(48)).astype(">u2")


def shown(code: np.ndarray | None) -> str:
    return "" if code is None else code.tobytes().hex()


def alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.mean(a == b))


class Printer:
    """Codes of texts and of their edits, which share most of their terms."""

    def __init__(self, samples: int, words: int):
        self.terms, self.sampler = Terms(words), Sampler(samples)

    def codes(self, texts: list[str], edits: list[str] | None = None):
        """The code of every text, and of every edit (None without edits)."""
        both = [t.encode() for t in texts] + [t.encode() for t in edits or []]
        n = len(texts)
        owner, term = self.terms.of(both)
        side, pair = owner // max(1, n), owner % max(1, n)
        order = np.lexsort((term, pair))
        side, pair, term = side[order], pair[order], term[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (term[1:] != term[:-1])])[:len(term)]
        group = np.cumsum(new) - 1
        n_groups = int(group[-1]) + 1 if len(group) else 0
        mine = np.bincount(group[side == 0], minlength=n_groups).astype(np.float64)
        other = np.bincount(group[side == 1], minlength=n_groups).astype(np.float64)
        pair, term = pair[new], term[new]
        edges = np.searchsorted(pair, np.arange(n + 1))
        out = []
        for i in range(n):
            k, a, b = (x[edges[i]:edges[i + 1]] for x in (term, mine, other))
            same = a == b
            p, q = ~same & (a > 0), ~same & (b > 0)
            left = int(p.sum())
            right = left + int(same.sum())
            out.append(self.sampler.codes(np.concatenate([k[p], k[same], k[q]]), np.concatenate([a[p], a[same], b[q]]), left, right))
        return [x for x, _ in out], [x for _, x in out]


def fingerprint(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint of every document (a map over its rows)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        printer = Printer(samples, words)
        for b in batches:
            for part, texts in text_slices(b, BATCH_BYTES):
                codes, _ = printer.codes([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(shown, codes), pa.string())],
                                                 names=["doc_id", "fingerprint"])

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprint columns (null where one is null)."""
    n = f"octet_length(`{a}`) div 4"
    return F.expr(f"""CASE WHEN `{a}` = `{b}` THEN 1D WHEN `{a}` = '' OR `{b}` = '' THEN 0D ELSE
        aggregate(sequence(0, {n} - 1), 0, (n, i) -> n + if(substr(`{a}`, 4 * i + 1, 4) = substr(`{b}`, 4 * i + 1, 4), 1, 0))
        / CAST({n} AS double) END""")


def pivots(keys: DataFrame, n: int) -> list[tuple]:
    """At most ``n`` keys (id, hash) that begin ranges of about equal numbers of
    rows, ascending; the first is the least of all."""
    first = keys.orderBy("doc_id", "h").limit(1).collect()
    if not first:
        return []
    some = keys.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(PIVOTS * n).collect()
    some = sorted({_key(r["doc_id"], r["h"]) for r in some})
    step = max(1, len(some) // n)
    return sorted({_key(first[0]["doc_id"], first[0]["h"]), *some[step::step][:n - 1]})


def _key(doc_id, h) -> tuple:
    return (False, 0, h) if doc_id is None else (True, doc_id, h)


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges of the order (doc_id, hash, text), one range or more
    a partition, sorted; each ends with a copy (``after``) of the next range's first row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    n = parallelism(spark)
    begins = pivots(rows.select("doc_id", "h"), n)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa
        at = {k: i for i, k in enumerate(begins)}
        for b in batches:
            keys = list(map(_key, b.column("doc_id").to_pylist(), b.column("h").to_pylist()))
            place = np.array([bisect_right(begins, k) - 1 for k in keys], np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.zeros(len(keys), bool))], names=names)
            copied = [i for i, k in enumerate(keys) if k in at]
            if copied:
                before = np.array([(at[keys[i]] - 1) % len(begins) for i in copied], np.int32)
                c = b.take(pa.array(copied))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(before), pa.array(np.ones(len(copied), bool))], names=names)

    names = ["doc_id", "text", "h", "place", "after"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(lean(deal), f"doc_id {kind}, text string, h long, place int, after boolean")
    return dealt.repartitionById(n, F.col("place")).sortWithinPartitions("place", "after", "doc_id", "h", "text")


def with_next(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its last floor(n_chars / 4) code points replaced by
    the first as many (or all) of the next document's, ascending doc_id; the last is
    followed by the first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        printer = Printer(samples, words)
        rows: list[tuple] = []  # (range, after, id, text), not finished
        size = 0

        def finish(last: bool):
            """Results of all rows that have their successor; the others stay."""
            nonlocal rows, size
            own = [i for i in range(len(rows) - 1) if not rows[i][1]]
            if own or last:
                edits = [t[:len(t) - len(t) // 4] + rows[i + 1][3][:len(t) // 4] for i in own for t in [rows[i][3]]]
                codes, edited = printer.codes([rows[i][3] for i in own], edits)
                code_at = dict(zip(own, codes))
                follow = [i + 1 for i in own if i + 1 not in code_at]
                code_at.update(zip(follow, printer.codes([rows[i][3] for i in follow])[0]))
                out = [(rows[i][2], len(rows[i][3]), hashlib.sha256(e.encode()).hexdigest(), shown(code_at[i]), shown(c),
                        alike(code_at[i], c), alike(code_at[i], code_at[i + 1])) for i, e, c in zip(own, edits, edited)]
                rows = rows[-1:]
                size = 0
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out
                                                 else [pa.array([], f.type) for f in schema], schema=schema)

        schema = None
        for b in batches:
            if schema is None:
                schema = pa.schema([("doc_id", b.schema.field("doc_id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                                    ("near_next", pa.float64())])
            for part, texts in text_slices(b, BATCH_BYTES):
                for place, after, i, t in zip(part.column("place").to_pylist(), part.column("after").to_pylist(),
                                              part.column("doc_id").to_pylist(), texts):
                    if after and rows and rows[-1][1] and rows[-1][0] == place:
                        continue  # equal rows of a pivot: one copy is enough
                    rows.append((place, after, i, t.decode()))
                    size += len(t)
                    if size > BATCH_BYTES:
                        yield from finish(False)
        if schema is not None:
            yield from finish(True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = in_ranges(docs).select("place", "after", "doc_id", F.col("text").cast("binary").alias("text"))
    return ordered.mapInArrow(lean(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")
