"""Spelling variants of corpus words by a frequency-vector trie.

Two words are near when one inserted, deleted or replaced code point turns one into
the other.  Every word has a vector: how often each group of letters occurs in it
(26 groups of one letter, six for all other code points).  A trie arranges words by
the first count, then the second, and so on.  One edit adds at most one letter of one
group and takes at most one of another, so a depth-first search from a word follows
equal counts for free, a count greater by one for its only surplus and a count less
by one for its only deficit.  A pair is met once: an insertion from the shorter word,
a replacement from the word whose first unequal count is the lesser one, so a deficit
is never spent before the surplus.  Leaves hold few words, which are verified by the
lengths of common beginnings and ends.

On Spark the trie is cut into cells of about ``CELL`` words.  Its upper part is laid
out from a sample of the words (those of least hash, a bounded number), every node as
ranges of counts, so each word of the whole vocabulary has one cell.  A word goes to
its cell as an entry and, by the same search, to all cells that an edit can reach as a
query.  A task builds a cell's lower trie and searches it with the cell's queries,
carrying at each node the queries that reach it.  Words of one vector that overfill a
cell are dealt over several; queries go to all of these.

:func:`corpus_words` counts the damaged words of documents in SQL; :func:`variants`
works on any table of words and counts.  Forms are the most frequent near words, and
roots come from them by pointer doubling (a form is at least twice as frequent as its
word, so chains are logarithmic).

Defined cases: null texts have no words, a null id reads as an empty string in the
damage rule; repeated rows count as often as they occur; ties between forms go to the
least in code-point order; very long words are compared piece by piece; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import lean, ragged, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE = 97
#: Words of a cell (more where the vocabulary needs more than ``MAX_CELLS`` of them).
CELL = 8192
MAX_CELLS = 16384
#: Sampled words that stand for the words of one cell.
SHARE = 32
LEAF = 4
QUERIES = 1 << 15
PAIRS = 1 << 14
WINDOW = 16
#: Letters that occur often come first: they tell words apart near the root.
ORDER = "eainrtosludcmhgpbfvkwzyjxq"
OTHERS = 6
GROUPS = len(ORDER) + OTHERS


def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: letter runs, A-Z lower-cased; where crc32 of '<doc_id>:<run>' is a
    multiple of 97, its code point number crc32 % length is deleted."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    marked = low.withColumn("crc", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.col("crc") % F.char_length("run")
    damaged = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.char_length("run")))
    words = marked.select(F.when(F.col("crc") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def _group(points: np.ndarray) -> np.ndarray:
    table = np.full(128, -1, np.int64)
    table[[ord(c) for c in ORDER]] = np.arange(len(ORDER))
    out = len(ORDER) + points.astype(np.int64) % OTHERS
    plain = points < 128
    known = table[points[plain]]
    out[plain] = np.where(known >= 0, known, out[plain])
    return out


class Words:
    """Words as one buffer of code points, with their vectors."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.length = np.fromiter(map(len, words), np.int64, self.n)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.repeat(np.arange(self.n), self.length) * GROUPS + _group(self.points)
        self.vector = np.bincount(place, minlength=self.n * GROUPS).reshape(self.n, GROUPS).astype(np.int32)


def _step(count, own: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries that may go on to a count, and their states there (0: no edit yet,
    1: surplus spent, 2: deficit spent too)."""
    d = count - own
    go = (d == 0) | ((d == 1) & (state == 0)) | ((d == -1) & (state == 1))
    return go, state + (d != 0)


class Cells:
    """The upper trie: nodes are (level, lows, children), leaves (first cell, cells)."""

    def __init__(self, sample: list[str], share: int):
        self.n = 0
        self.share = share
        vector = Words(sample).vector
        self.root = self._node(vector, 0)

    def _leaf(self, size: int):
        cells = max(1, -(-size // self.share))
        self.n += cells
        return (self.n - cells, cells)

    def _node(self, vector: np.ndarray, level: int):
        if level == GROUPS or len(vector) <= self.share:
            return self._leaf(len(vector))
        counts, at = np.unique(vector[:, level], return_inverse=True)
        size = np.bincount(at)
        lows, children, i = [], [], 0
        while i < len(counts):
            j = i + 1
            while j < len(counts) and size[i:j + 1].sum() <= self.share:
                j += 1
            lows.append(int(counts[i]) if i else -(1 << 30))
            children.append(self._node(vector[(at >= i) & (at < j)], level + 1))
            i = j
        return (level, lows, children)

    def route(self, vector: np.ndarray) -> tuple[list, list]:
        """(rows, (first cell, cells)) of every leaf: rows that live there, and rows
        whose neighbours may.  A range of counts can leave open what a query has spent,
        so it carries the set of its possible states (bits 0 to 2)."""
        entries, queries = [], []
        every = np.arange(len(vector))
        stack = [(self.root, every, every, np.ones(len(vector), np.int8))]
        while stack:
            node, own, q, states = stack.pop()
            if not len(q):
                continue
            if len(node) == 2:
                entries.append((own, node))
                queries.append((q, node))
                continue
            level, lows, children = node
            f_own, f = vector[own, level], vector[q, level]
            for lo, hi, child in zip(lows, [*lows[1:], 1 << 30], children):
                after = np.where((f >= lo) & (f < hi), states, 0)
                after |= np.where((f + 1 >= lo) & (f + 1 < hi), (states & 1) << 1, 0)
                after |= np.where((f - 1 >= lo) & (f - 1 < hi), (states & 2) << 1, 0)
                go = after > 0
                stack.append((child, own[(f_own >= lo) & (f_own < hi)], q[go], after[go].astype(np.int8)))
        return entries, queries


def _common(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """Equal code points from each pair of places on, ``most`` at most, forwards or backwards."""
    out = np.zeros(len(most), np.int64)
    live = np.flatnonzero(most > 0)
    shift = np.arange(WINDOW)
    while len(live):
        k = out[live][:, None] + shift
        inside = k < most[live][:, None]
        k = np.where(inside, k, 0) * way
        equal = inside & (a[at_a[live][:, None] + k] == b[at_b[live][:, None] + k])
        run = np.where(equal.all(1), WINDOW, equal.argmin(1))
        out[live] += run
        live = live[(run == WINDOW) & (out[live] < most[live])]
    return out


def verified(q: Words, w: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i of ``q``, j of ``w``) are near and are met in this direction."""
    extra = w.length[j] - q.length[i]
    ok = (extra == 0) | (extra == 1)
    at = np.flatnonzero(ok)
    i, j, extra = i[at], j[at], extra[at]
    begin = _common(q.points, q.start[i], w.points, w.start[j], q.length[i], 1)
    begin_ok = begin < w.length[j]  # else the words are equal
    end = _common(q.points, q.end[i] - 1, w.points, w.end[j] - 1, q.length[i] - begin, -1)
    near = begin_ok & (begin + end >= q.length[i] - (extra == 0))
    swap = np.flatnonzero(near & (extra == 0))
    x, y = q.points[q.start[i[swap]] + begin[swap]], w.points[w.start[j[swap]] + begin[swap]]
    gx, gy = _group(x), _group(y)
    near[swap] = (gy < gx) | ((gy == gx) & (x < y))
    ok[at] = near
    return ok


def search(q: Words, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (query, word), by depth-first search of the trie over ``w``."""
    order = np.lexsort(w.vector.T[::-1])
    vector = w.vector[order]
    stack = [(0, w.n, 0, np.arange(q.n), np.zeros(q.n, np.int8))]
    found_i, found_j, waiting = [], [], 0
    while stack or found_i:
        if waiting > PAIRS or not stack:
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            found_i, found_j, waiting = [], [], 0
            for a in range(0, len(i), PAIRS):
                near = verified(q, w, i[a:a + PAIRS], j[a:a + PAIRS])
                yield i[a:a + PAIRS][near], j[a:a + PAIRS][near]
            continue
        lo, hi, level, rows, state = stack.pop()
        if hi - lo <= LEAF or level == GROUPS:
            step = max(1, PAIRS // (hi - lo))
            if len(rows) > step:  # a large leaf, or many queries: in parts
                stack.append((lo, hi, GROUPS, rows[step:], state[step:]))
                rows = rows[:step]
            found_i.append(np.repeat(rows, hi - lo))
            found_j.append(np.tile(order[lo:hi], len(rows)))
            waiting += len(rows) * (hi - lo)
            continue
        column = vector[lo:hi, level]
        cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]])
        own = q.vector[rows, level]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            go, after = _step(column[a], own, state)
            if go.any():
                stack.append((lo + a, lo + b, level + 1, rows[go], after[go].astype(np.int8)))


def near_pairs(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, near and near_n for both directions of every near pair of ``words`` (word, n)."""
    total = words.count()
    cell = max(cell, -(-total // MAX_CELLS))
    size = max(1, SHARE * total // cell)  # at most SHARE * MAX_CELLS rows
    sample = [r["word"] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(size).collect()]
    cells = Cells(sample, SHARE)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            names = b.column("word").to_pylist()
            w = Words(names)
            place = np.array([zlib.crc32(x.encode()) for x in names], np.int64)
            entries, queries = cells.route(w.vector)
            for leaves, entry in ((entries, True), (queries, False)):
                for rows, (first, n) in leaves:
                    if not len(rows):
                        continue
                    at = first + place[rows] % n if entry else ragged(np.full(len(rows), first), np.full(len(rows), n))
                    rows = rows if entry else np.repeat(rows, n)
                    take = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(rows), entry)),
                                                      take.column("word"), take.column("n")], names=["cell", "entry", "word", "n"])

    def match(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        empty = {"word": pa.string(), "near": pa.string(), "near_n": pa.int64()}
        entry = table.filter(table.column("entry"))
        query = table.filter(pc.invert(table.column("entry")))
        out = [pa.table({k: pa.array([], t) for k, t in empty.items()})]
        if entry.num_rows:
            w = Words(entry.column("word").to_pylist())
            for a in range(0, query.num_rows, QUERIES):
                part = query.slice(a, QUERIES)
                q = Words(part.column("word").to_pylist())
                for i, j in search(q, w):
                    if len(i):
                        x, y = part.take(pa.array(i)), entry.take(pa.array(j))
                        for p, o in ((x, y), (y, x)):
                            out.append(pa.table({"word": p.column("word"), "near": o.column("word"), "near_n": o.column("n")}))
        return pa.concat_tables(out).cast(pa.schema(empty))

    dealt = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(
        lean(deal), "cell int, entry boolean, word string, n long")
    return dealt.groupBy("cell").applyInArrow(lean(match), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for rows (word, form): forms followed to the last, by doubling."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = doubled.select("word", "root")
        if doubled.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near and form_n for every row (word, n) of a vocabulary."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = near_pairs(words, cell).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    likely = -F.col("best.less") >= 2 * F.col("n")
    table = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.near")).alias("form"),
        F.when(likely, -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(table.filter(F.col("form").isNotNull()))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
