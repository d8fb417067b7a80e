"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

Tokens are lower-cased words and one end per document; the history of the first
is the start.  With counts c over the training documents and discounts d_r (r up
to 5: Katz's Good-Turing formula from the counts of counts n_r of that order;
where these give none between 0 and 1, the absolute discount (r - 0.5) / r):

    P1(w)   = d c(w) / N; an unknown word gets all discounted mass
    P2(w|h) = d c(h,w) / c(h) if that bigram was seen, else a(h) P1(w)
    a(h)    = (1 - sum of P2 over words seen after h) / (1 - sum of their P1)

so P2 sums to one over the vocabulary and the unknown word for every h.  Where no
count is small enough to be discounted, one is added to the total, which leaves
the mass 1 / (total + 1).  An unseen history has a(h) = 1.

Tables.  Documents become token chunks in the shared folder.  Unigram counts are
partitioned by word, bigram counts by history; both grow with the corpus and
neither passes through the driver (only counts of counts do).  A chunk sends its
distinct words with training counts to their partitions and gets back their
totals and a dense number; then its distinct bigrams, packed, to the history's
partition, and gets back their totals and, per history, the terms of a(h): c(h),
the words seen 1..5 times after it, and the P1 mass of all seen.  A frequent
history is split over partitions by the following word, in as many parts as its
count asks for, and the chunk adds up their terms.

Defined cases: null or empty text is its end alone; null ids may score but not
train; without training documents every token is unknown (probability 1); ties
and repeated rows are ordinary; an empty table gives an empty result; extra
columns are ignored; a very long text is a chunk of its own and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.chunks import chunk_words, mix, token_chunks
from promptloom.llm.common import each_row, lean, pack, parallelism, ragged, stored, stored_by, sums, unpack

CUTOFF = 5  # Good-Turing discounts counts up to here
WORD_ROWS, PAIR_ROWS = 3_000_000, 1_500_000  # corpus words for a partition of the unigram and bigram tables
HISTORY_ROWS = 1_000_000  # a history of more tokens is split
END = np.uint64(0x8D2F0A6C5B1E9743)  # the hash that stands for the end token
START_ID = 0  # dense numbers of words begin at 1


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0..d_5 from the counts of counts n_1..n_6 (d_0 is not used)."""
    out = np.ones(CUTOFF + 1)
    common = (CUTOFF + 1) * n[CUTOFF] / n[0] if n[0] else 1.0
    for r in range(1, CUTOFF + 1):
        found = 0.0
        if n[r - 1] and common < 1:
            found = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
        out[r] = found if 0 < found < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= CUTOFF, d[np.minimum(counts, CUTOFF)], 1.0)


def free_mass(total, small, d) -> np.ndarray:
    """Discounted counts, summed: ``small[..., r-1]`` items were seen r times."""
    r = np.arange(1, CUTOFF + 1)
    return (small * (r * (1 - d[1:]))).sum(axis=-1)


class Unigrams:
    """P1 as a function of a word's training count."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types = total, types
        self.d = discounts(n)
        free = float(free_mass(total, n[:CUTOFF], self.d))
        self.scale = float(total) if free > 1e-9 else total + 1.0
        self.unknown = (free if free > 1e-9 else 1.0) / self.scale

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.scale, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.types + 1)))


def _lexicon(lexicon: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words with the end, in the order of their partitions, and where each partition begins."""
    words = np.append(lexicon, END)
    part = ((words >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return words, order, np.searchsorted(part[order], np.arange(n_parts + 1))


def _send_words(chunks: DataFrame, n_parts: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for row in each_row(b):
                lengths, lexicon, tokens = chunk_words(row)
                train = np.frombuffer(row["marks"], np.uint8).astype(bool)
                counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(lexicon))
                counts = np.append(counts, int(train.sum()))
                words, order, cuts = _lexicon(lexicon, n_parts)
                words, counts = words[order], counts[order]
                full = np.flatnonzero(np.diff(cuts)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([row["chunk"]] * len(full), pa.int64()),
                     pa.array([words[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary()),
                     pa.array([pack(counts[cuts[k]:cuts[k + 1]]) for k in full], pa.binary())],
                    names=["part", "chunk", "words", "counts"])

    return chunks.select("chunk", "lengths", "lexicon", "words", "marks").mapInArrow(
        lean(run), "part long, chunk long, words binary, counts binary")


def _count_words(sent: DataFrame, n_parts: int) -> DataFrame:
    """Per partition and chunk: total counts and dense numbers of the words sent;
    one row per partition (chunk -1) has N, V and n_1..n_6."""

    def run(table):
        import pyarrow as pa
        part = table.column("part")[0].as_py()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)
        seen = total[total > 0]
        stats = [int(seen.sum()), len(seen), *np.bincount(seen[seen <= CUTOFF + 1], minlength=CUTOFF + 2)[1:].tolist()]
        cuts = np.cumsum([len(w) for w in words])[:-1]
        replies = [(pack(total[x]), pack(x * n_parts + part + 1)) for x in np.split(at, cuts)]
        chunk = table.column("chunk").to_pylist()
        return pa.table({
            "chunk": pa.array([*chunk, -1], pa.int64()), "part": pa.array([part] * (len(chunk) + 1), pa.int64()),
            "counts": pa.array([*(c for c, _ in replies), b""], pa.binary()),
            "ids": pa.array([*(i for _, i in replies), b""], pa.binary()),
            "stats": pa.array([None] * len(chunk) + [stats], pa.list_(pa.int64()))})

    return sent.groupBy("part").applyInArrow(lean(run), "chunk long, part long, counts binary, ids binary, stats array<long>")


def _stats(replies: DataFrame) -> list[int]:
    rows = replies.filter("chunk = -1").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    return [r["n"] for r in rows]


class Pairs:
    """The distinct bigrams of a chunk, in the order in which they are sent.

    A run is a history, or a part of a split one; runs go by partition, history
    and part, and the bigrams of a run by the number of their second word."""

    def __init__(self, row: dict, n_word_parts: int, n_pair_parts: int):
        lengths, lexicon, tokens = chunk_words(row)
        words, order, _ = _lexicon(lexicon, n_word_parts)
        reply = sorted(row["words_back"], key=lambda r: r["part"])
        self.counts, ids = np.zeros(len(words), np.int64), np.zeros(len(words) + 1, np.int64)
        self.counts[order] = np.concatenate([unpack(r["counts"]) for r in reply])
        ids[order] = np.concatenate([unpack(r["ids"]) for r in reply])
        end, start = len(words) - 1, len(words)
        ids[start] = START_ID
        ends = np.cumsum(lengths)
        # every document: its words and the end; before them the start
        self.tokens = np.insert(tokens, ends, end)
        self.n_tokens = lengths + 1
        firsts = np.cumsum(self.n_tokens) - self.n_tokens
        before = np.concatenate([[start], self.tokens[:-1]])
        before[firsts] = start
        self.train = np.frombuffer(row["marks"], np.uint8).astype(bool)
        code, self.at = np.unique(before * (len(words) + 1) + self.tokens, return_inverse=True)
        history, self.second = np.divmod(code, len(words) + 1)
        trained = np.bincount(self.at, weights=np.repeat(self.train, self.n_tokens), minlength=len(code)).astype(np.int64)
        # runs
        used, which = np.unique(history, return_inverse=True)
        tokens_of = np.append(self.counts, self.counts[end])  # the start is as frequent as the end
        n_runs = 1 + tokens_of[used] // HISTORY_ROWS
        first_run = np.cumsum(n_runs) - n_runs
        self.run_history = np.repeat(np.arange(len(used)), n_runs)
        run_part = ragged(np.zeros(len(used), np.int64), n_runs)
        run_id = ids[used][self.run_history]
        place = (mix(run_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + run_part.astype(np.uint64))
                 % np.uint64(n_pair_parts)).astype(np.int64)
        run_order = np.lexsort((run_part, run_id, place))
        rank = np.empty(len(run_order), np.int64)
        rank[run_order] = np.arange(len(run_order))
        word_id = ids[self.second]
        run = rank[first_run[which] + (mix(word_id.astype(np.uint64)) % n_runs[which].astype(np.uint64)).astype(np.int64)]
        self.order = np.lexsort((word_id, run))
        self.run_history = self.run_history[run_order]
        self.n_histories = len(used)
        self.history_of = which
        self.run_keys = run_id[run_order], run_part[run_order]
        self.run_sizes = np.bincount(run, minlength=len(run_order))
        self.sent_words, self.sent_counts = word_id[self.order], trained[self.order]
        self.sent_lower = self.counts[self.second][self.order]
        self.run_cuts = np.searchsorted(place[run_order], np.arange(n_pair_parts + 1))
        self.pair_cuts = np.concatenate([[0], np.cumsum(self.run_sizes)])[self.run_cuts]


def _send_pairs(joined: DataFrame, n_word_parts: int, n_pair_parts: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for row in each_row(b):
                p = Pairs(row, n_word_parts, n_pair_parts)
                out = []
                for k in np.flatnonzero(np.diff(p.run_cuts)).tolist():
                    runs, pairs = slice(*p.run_cuts[k:k + 2]), slice(*p.pair_cuts[k:k + 2])
                    keys, parts = p.run_keys[0][runs], p.run_keys[1][runs]
                    out.append((k, pack(np.diff(keys, prepend=0)), pack(parts), pack(p.run_sizes[runs]), pack(p.sent_words[pairs]),
                                pack(p.sent_counts[pairs]), pack(p.sent_lower[pairs])))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array([row["chunk"]] * len(out), pa.int64()),
                     *(pa.array(c, pa.binary()) for c in cols[1:])],
                    names=["part", "chunk", "history", "split", "size", "word", "count", "lower"])

    return joined.mapInArrow(lean(run), "part long, chunk long, history binary, split binary, size binary, word binary, "
                                  "count binary, lower binary")


def _count_pairs(sent: DataFrame, unigrams: Unigrams) -> DataFrame:
    """Per partition and chunk: totals of the bigrams sent; per run c(h), words
    seen 1..5 times and the P1 mass of the words seen."""

    def run(table):
        import pyarrow as pa
        rows = table.to_pylist()
        size = [unpack(r["size"]).astype(np.int64) for r in rows]
        keys = np.concatenate([np.cumsum(unpack(r["history"]).astype(np.int64)) for r in rows])
        splits = np.concatenate([unpack(r["split"]).astype(np.int64) for r in rows])
        order = np.lexsort((splits, keys))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(keys[order]) != 0) | (np.diff(splits[order]) != 0)
        run_of = np.empty(len(order), np.int64)
        run_of[order] = np.cumsum(fresh) - 1  # the same history and part, whatever chunk sent it
        n_runs = int(fresh.sum())
        word = np.concatenate([unpack(r["word"]).astype(np.int64) for r in rows])
        count = np.concatenate([unpack(r["count"]).astype(np.int64) for r in rows])
        lower = np.concatenate([unpack(r["lower"]).astype(np.int64) for r in rows])
        owner = np.repeat(run_of, np.concatenate(size))
        by = np.lexsort((word, owner))
        first = np.ones(len(by), bool)
        first[1:] = (np.diff(word[by]) != 0) | (np.diff(owner[by]) != 0)
        pair = np.empty(len(by), np.int64)
        pair[by] = np.cumsum(first) - 1
        total = np.bincount(pair, weights=count, minlength=int(first.sum())).astype(np.int64)
        one = by[first]  # one place of each distinct bigram, in order
        pair_run, p1 = owner[one], unigrams.p(lower[one])
        seen = total > 0
        run_total = np.bincount(pair_run, weights=total, minlength=n_runs).astype(np.int64)
        mass = np.bincount(pair_run[seen], weights=p1[seen], minlength=n_runs)
        small = [np.bincount(pair_run[total == r], minlength=n_runs) for r in range(1, CUTOFF + 1)]
        stats = np.bincount(total[seen & (total <= CUTOFF + 1)], minlength=CUTOFF + 2)[1:].tolist()
        out, at_run, at_pair = [], 0, 0
        for s in size:
            runs = run_of[at_run:at_run + len(s)]
            pairs = pair[at_pair:at_pair + int(s.sum())]
            out.append((pack(total[pairs]), pack(run_total[runs]), pack(np.concatenate([m[runs] for m in small])),
                        pack(mass[runs].view(np.uint64))))
            at_run, at_pair = at_run + len(runs), at_pair + len(pairs)
        cols = list(zip(*out, strict=True))
        part = rows[0]["part"]
        return pa.table({
            "chunk": pa.array([*(r["chunk"] for r in rows), -1], pa.int64()), "part": pa.array([part] * (len(rows) + 1), pa.int64()),
            **{c: pa.array([*v, b""], pa.binary()) for c, v in zip(("counts", "totals", "small", "mass"), cols, strict=True)},
            "stats": pa.array([None] * len(rows) + [stats], pa.list_(pa.int64()))})

    return sent.groupBy("part").applyInArrow(
        lean(run), "chunk long, part long, counts binary, totals binary, small binary, mass binary, stats array<long>")


def _scores(joined: DataFrame, n_word_parts: int, n_pair_parts: int, unigrams: Unigrams, n2: np.ndarray) -> DataFrame:
    d2 = discounts(n2)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for row in each_row(b):
                p = Pairs(row, n_word_parts, n_pair_parts)
                reply = sorted(row["pairs_back"], key=lambda r: r["part"])
                pair_count = np.empty(len(p.order), np.int64)
                pair_count[p.order] = np.concatenate([unpack(r["counts"]) for r in reply])
                totals = np.concatenate([unpack(r["totals"]) for r in reply]).astype(np.int64)
                small = np.concatenate([unpack(r["small"]).reshape(CUTOFF, -1).T for r in reply]).astype(np.int64)
                mass = np.concatenate([unpack(r["mass"]).view(np.float64) for r in reply])
                # a history's terms are the sum over its runs
                total = np.bincount(p.run_history, weights=totals, minlength=p.n_histories)
                seen_p1 = np.bincount(p.run_history, weights=mass, minlength=p.n_histories)
                few = np.stack([np.bincount(p.run_history, weights=small[:, r], minlength=p.n_histories) for r in range(CUTOFF)], axis=1)
                free = free_mass(total, few, d2)
                scale = np.where(free > 1e-9, total, total + 1)
                free = np.where(free > 1e-9, free, 1.0)
                backoff = np.where(total > 0, free / scale / np.maximum(1 - seen_p1, 1e-300), 1.0)
                p1 = unigrams.p(p.counts)[p.second]
                h = p.history_of
                prob = np.where(pair_count > 0, discounted(pair_count, d2) / scale[h], backoff[h] * p1)
                known = p.counts[p.tokens] > 0
                score = sums(np.log10(prob)[p.at], p.n_tokens)
                base = sums(unigrams.base(p.counts)[p.tokens], p.n_tokens)
                n = len(p.n_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(p.train), pa.array(p.n_tokens),
                     pa.array(sums(known.astype(np.int64), p.n_tokens)), pa.array([unigrams.total] * n, pa.int64()), pa.array(base),
                     pa.array(score)],
                    names=["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(lean(run), "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")


def katz_scores(docs: DataFrame, training: Column) -> DataFrame:
    """Train on the rows where ``training`` holds and score all: doc_id, trained,
    n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    chunks = stored_by(token_chunks(docs, mark=training), "katz_chunks", "chunk")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_word_parts = max(parallelism(spark), total // WORD_ROWS)
    n_pair_parts = max(parallelism(spark), total // PAIR_ROWS)
    words = stored(_count_words(_send_words(chunks, n_word_parts), n_word_parts), "unigrams", "none")
    stats = _stats(words) or [0] * (CUTOFF + 3)
    unigrams = Unigrams(stats[0], stats[1], np.array(stats[2:], float))
    back = words.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "ids")).alias("words_back"))
    with_words = chunks.select("chunk", "doc_ids", "marks", "lengths", "lexicon", "words").join(back, "chunk")
    pairs = stored(_count_pairs(_send_pairs(with_words, n_word_parts, n_pair_parts), unigrams), "bigrams", "none")
    n2 = np.array(_stats(pairs) or [0] * (CUTOFF + 1), float)
    pairs_back = pairs.filter("chunk >= 0").groupBy("chunk").agg(
        F.collect_list(F.struct("part", "counts", "totals", "small", "mass")).alias("pairs_back"))
    return _scores(with_words.join(pairs_back, "chunk"), n_word_parts, n_pair_parts, unigrams, n2)
