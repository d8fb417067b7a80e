"""Soft matching of predicted entity names (M4) within their samples.

Reference rule: a prediction p is replaced by the gold name g* of highest
Ratcliff-Obershelp ratio among the sample's gold names (first on ties) when
ratio > 0.5, g* != p and one contains the other.

Exact plan (no candidate caps):
1. Names are taken once per sample.  A prediction that is a gold name keeps itself
   (ratio 1 is the maximum).
2. The others meet the sample's gold names in blocks of bounded size.  Samples of usual
   length are matched where their rows are (:func:`soften_rows`); the blocks of a long
   one spread over tasks (:func:`changed_names`).  A name's characters are bits of a
   word; the bits that a pair has in common bound its ratio from above.
3. Containment holds only where no bit is missing, of characters and of neighbours; such a
   pair's ratio is 2 min(|p|, |g|) / (|p| + |g|).  A prediction without one above 0.5 stays.
4. The best containing name is replaced unless a rival of the sample has a higher
   ratio, or the same at an earlier place.  Only pairs whose bounds allow that are
   looked at, best bound first, until a rival is found, thousands of them at once: a longest
   common subsequence, which is no shorter than the blocks of the ratio, then the blocks.
   Names of more than SHORT characters are scored one pair at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions.similarity import SHORT, ratio
from promptloom.operators.joins import join_small
from promptloom.session import materialize

THRESHOLD = 0.5
AUTOJUNK_LEN = 200  # difflib's popularity heuristic applies from this length on
EPS = 1e-9
PRED_BLOCK = 1024
GOLD_BLOCK = 4096
CELLS = 1 << 16  # of a matrix of 64-bit marks that is worked on at once
PAIRS = 8192
KEYS = 1 << 36
TABLE = 1 << 20  # entries of a table of character positions
OPEN_PAIRS = 1 << 18  # pairs that wait to be scored


class Names:
    """Names with 64-bit marks: a bit for every character and one for every two neighbours, each
    with its occurrence in the name.  Bits may be shared, so what is missing is at least as many
    characters as bits are missing."""

    def __init__(self, names: list[str]):
        n = len(names)
        self.names = np.array(names, object)
        self.length = np.fromiter(map(len, names), np.int64, n)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters, self.code = np.unique(points, return_inverse=True)
        self.letters = len(letters)
        own = np.repeat(np.arange(n), self.length)
        self.marks = _marks(own, points, n)
        pair = own[1:] == own[:-1]
        two = ((points[:-1] << 21 | points[1:]) * 0x9E3779B1 >> 24 & KEYS - 1)[pair]  # of 42 bits, told apart by hash
        self.pairs = _marks(own[1:][pair], two, n)

    def take(self, at: np.ndarray) -> "Block":
        return Block(self, at)


class Block:
    """Some of the names, by their places."""

    def __init__(self, names: Names, at: np.ndarray):
        self.at, self.names = at, names.names
        self.length, self.marks, self.pairs = names.length[at], names.marks[at], names.pairs[at]
        self.n_marks = np.bitwise_count(self.marks)
        self.small = len(at) == 0 or int(self.length.max()) <= SHORT  # lengths and their threefold fit a byte


def _marks(own: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The bits of the keys (below KEYS) of each of ``n`` names, a key's occurrences counted."""
    out = np.zeros(n, np.uint64)
    if len(own):
        both = np.sort(own * KEYS + key)
        o, k = both // KEYS, both % KEYS
        at = np.arange(len(o))
        begins = np.concatenate([[True], both[1:] != both[:-1]])
        nth = at - np.maximum.accumulate(np.where(begins, at, 0))
        np.bitwise_or.at(out, o, np.left_shift(np.uint64(1), ((k + 29 * nth) % 64).astype(np.uint64)))
    return out


def shared_marks(p: Block, g: Block) -> np.ndarray:
    """How many marks each pair has in common."""
    out = np.empty((len(p.marks), len(g.marks)), np.uint8)
    step = max(1, CELLS // max(1, len(g.marks)))
    for k in range(0, len(out), step):
        np.bitwise_count(p.marks[k:k + step, None] & g.marks, out=out[k:k + step])
    return out


@lru_cache(maxsize=1 << 18)
def _ratio(p: str, g: str) -> float:
    return ratio(p, g)


def best_containing(p: Block, g: Block, gidx: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction rows, gold rows, ratios): for each prediction that has one, the best gold
    name above the threshold that contains it or is contained."""
    kind = np.uint8 if p.small and g.small else np.int64
    lp, lg = p.length.astype(kind)[:, None], g.length.astype(kind)
    i, j = _where(((shared == p.n_marks[:, None]) | (shared == g.n_marks)) & (lg < 3 * lp) & (lp < 3 * lg))
    x, y = p.length[i], g.length[j]
    least, both = np.where(x < y, p.pairs[i], g.pairs[j]), p.pairs[i] & g.pairs[j]
    may = (x != y) & (both == least)  # the neighbours of the shorter one are all in the other
    i, j, x, y = i[may], j[may], x[may], y[may]
    r = 2.0 * np.minimum(x, y) / (x + y)
    for k in np.flatnonzero(np.maximum(x, y) >= AUTOJUNK_LEN):
        a, b = p.names[p.at[i[k]]], g.names[g.at[j[k]]]
        r[k] = _ratio(a, b) if a in b or b in a else 0.0
    order = np.lexsort((gidx[j], -r, i))  # the first that holds is the best
    order = order[r[order] > THRESHOLD]
    found, last = [], -1
    for k, row, a, b in zip(order.tolist(), i[order].tolist(), p.names[p.at[i[order]]].tolist(), g.names[g.at[j[order]]].tolist()):
        if row != last and (a in b or b in a):
            found.append(k)
            last = row
    found = np.array(found, np.int64)
    return i[found], j[found], r[found]


def _where(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero``, which takes longer."""
    return np.divmod(np.flatnonzero(matrix), max(1, matrix.shape[1]))


def _hope(most: np.ndarray, best: np.ndarray, early: np.ndarray) -> np.ndarray:
    """Which upper bounds leave a chance to beat the ratio ``best``."""
    return np.where(early, most >= best - EPS, most > best + EPS)


def rivals(p: Block, g: Block, gidx: np.ndarray, shared: np.ndarray, rows: np.ndarray, r: np.ndarray,
           place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, gold rows, bounds, early): the gold names that may beat the ratio ``r[at]`` at
    ``place[at]`` of the prediction ``rows[at]``, and whether they stand before that place."""
    lp, lg = p.length[rows], g.length
    # marks that are no character's own are had in common at most as often as in either name
    slack = np.minimum((lp - p.n_marks[rows])[:, None], lg - g.n_marks) if not (p.small and g.small) else np.minimum(
        (lp - p.n_marks[rows]).astype(np.uint8)[:, None], (lg - g.n_marks).astype(np.uint8))
    half = 0.9999 * r / 2  # a little less than what it takes
    a, j = _where(shared[rows] + slack >= half.astype(np.float32)[:, None] * lg.astype(np.float32) + (half * lp).astype(np.float32)[:, None])
    x, y, at = lp[a], lg[j], rows[a]
    most = 2.0 * (shared[at, j] + np.minimum(x - p.n_marks[at], y - g.n_marks[j])) / (x + y)
    early = gidx[j] < place[a]
    left = _hope(most, r[a], early)
    # between two blocks that match stands a character that does not, so of M in blocks at most
    # x + y - 2M + 1 have no neighbour in their block
    apart = np.bitwise_count(p.pairs[at] & ~g.pairs[j])
    left &= np.maximum(x - 1, 0) - apart >= 1.5 * r[a] * (x + y) - (x + y) - 1 - EPS * (x + y)
    return a[left], j[left], most[left], early[left]


def _positions(names: Names, p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each pair (a column) and each character of the second (a row), the places of that
    character in the first as bits.  No name has more than 64."""
    firsts, own = np.unique(p, return_inverse=True)
    seconds, other = np.unique(g, return_inverse=True)
    lp, lg = names.length[firsts], names.length[seconds]
    up, down, width = _count_up(lp), _count_up(lg), names.letters + 1
    table = np.zeros(len(firsts) * width, np.uint64)  # the last of a row: no character
    np.bitwise_or.at(table, np.arange(len(firsts)).repeat(lp) * width + names.code[names.start[firsts].repeat(lp) + up],
                     np.left_shift(np.uint64(1), up.astype(np.uint64)))
    text = np.full((int(lg.max()), len(seconds)), names.letters)
    text[down, np.arange(len(seconds)).repeat(lg)] = names.code[names.start[seconds].repeat(lg) + down]
    return table[own * width + text[:, other]]


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _subsequence(where: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair of :func:`_positions`."""
    v = np.full(where.shape[1], ~np.uint64(0))
    for m in where:
        u = v & m
        v = (v + u) | (v - u)
    return np.bitwise_count(~v)  # a bit that stands for no character never falls


def _matched(where: np.ndarray) -> np.ndarray:
    """Characters in difflib's matching blocks of each pair of :func:`_positions`: the longest
    common block, the first in the first name and then in the second of equals, and the
    same to its left and its right."""
    t, n = where.shape
    total = np.zeros(n, np.int64)
    at, own = np.arange(t)[:, None], np.arange(n)
    mask, low, high = np.full(n, ~np.uint64(0)), np.zeros(n, np.int64), np.full(n, t)
    while len(own):
        one = np.where((at >= low) & (at < high), where[:, own] & mask, np.uint64(0))
        ends, some = one, np.bitwise_or.reduce(one, axis=0)  # of blocks of k
        keep = np.flatnonzero(some)
        one, ends, some = one[:, keep], ends[:, keep], some[keep]
        k, parts = 1, []
        while len(keep):
            more = np.zeros_like(ends)
            more[1:] = one[1:] & (ends[:-1] << np.uint64(1))
            longer = np.bitwise_or.reduce(more, axis=0)
            done = longer == 0
            if done.any():
                bit = some[done] & (~some[done] + np.uint64(1))  # where the first in the first name ends
                last = ((ends[:, done] & bit) != 0).argmax(axis=0)
                it = keep[done]
                np.add.at(total, own[it], k)  # both sides of a block may have one
                parts.append((own[it], mask[it] & ((bit >> np.uint64(k - 1)) - np.uint64(1)), low[it], last - k + 1))
                parts.append((own[it], mask[it] & ~((bit << np.uint64(1)) - np.uint64(1)), last + 1, high[it]))
            left = ~done
            keep, one, ends, some = keep[left], one[:, left], more[:, left], longer[left]
            k += 1
        if not parts:
            break
        own, mask, low, high = (np.concatenate(x) for x in zip(*parts))
        go = (mask != 0) & (low < high)
        own, mask, low, high = own[go], mask[go], low[go], high[go]
    return total


def beat(names: Names, p: np.ndarray, g: np.ndarray, most: np.ndarray, r: np.ndarray, early: np.ndarray, own: np.ndarray, beaten: np.ndarray) -> None:
    """Sets ``beaten[own]`` where the ratio of the names ``p`` and ``g`` is above ``r``, or as high
    and ``early``.  The pairs of most hope of each ``own`` come first; the others only while none
    has won."""
    order = np.lexsort((-most, own))
    o = own[order]
    at = np.arange(len(o))
    nth = at - np.maximum.accumulate(np.where(np.concatenate([[True], o[1:] != o[:-1]]), at, 0)) if len(o) else at
    order = order[np.argsort(nth, kind="stable")]
    wide = np.maximum(names.length[p], names.length[g]) > SHORT
    for k in order[wide[order]].tolist():
        if not beaten[own[k]]:
            x = _ratio(names.names[p[k]], names.names[g[k]])
            beaten[own[k]] = x > r[k] or (x == r[k] and early[k])
    order = order[~wide[order]]
    # a table of positions has a row for each name and a column for each character
    step = max(1, min(PAIRS, TABLE // (names.letters + 1)))
    while len(order):
        order = order[~beaten[own[order]]]
        k, order = order[:step], order[step:]
        k = k[(names.length[p[k]] > 0) & (names.length[g[k]] > 0)]
        if not len(k):
            continue
        where, size = _positions(names, p[k], g[k]), names.length[p[k]] + names.length[g[k]]
        left = np.flatnonzero(_hope(2.0 * _subsequence(where) / size, r[k], early[k]))
        if len(left):
            k, x = k[left], 2.0 * _matched(where[:, left]) / size[left]
            beaten[own[k[(x > r[k]) | ((x == r[k]) & early[k])]]] = True


def choose_all(names: Names, samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each sample (predictions, gold names, gidx: the latter's places in the sample; names by
    their places in ``names``) the gold name of each prediction that is replaced, or -1.  No
    prediction is a gold name.  Matrices hold one block of predictions by one of gold names."""
    out, first = [], 0
    beaten = np.zeros(sum(len(pred) for pred, _, _ in samples), bool)
    waiting, n = [], 0

    def settle():
        beat(names, *(np.concatenate(x) for x in zip(*waiting)), beaten)
        waiting.clear()

    for pred, gold, gidx in samples:
        chosen = np.full(len(pred), -1)
        golds = [(names.take(gold[k:k + GOLD_BLOCK]), gidx[k:k + GOLD_BLOCK]) for k in range(0, len(gold), GOLD_BLOCK)]
        for a in range(0, len(pred), PRED_BLOCK):
            p, shared = names.take(pred[a:a + PRED_BLOCK]), None
            best, place, name = np.zeros(len(p.at)), np.zeros(len(p.at), np.int64), chosen[a:a + PRED_BLOCK]
            for g, at in golds:
                shared = shared_marks(p, g)
                i, j, r = best_containing(p, g, at, shared)
                top = (r > best[i]) | ((r == best[i]) & (at[j] < place[i]))
                i, j = i[top], j[top]
                best[i], place[i], name[i] = r[top], at[j], g.at[j]
            rows = np.flatnonzero(name >= 0)
            for g, at in golds if len(rows) else ():
                x, j, most, early = rivals(p, g, at, shared if len(golds) == 1 else shared_marks(p, g), rows, best[rows], place[rows])
                waiting.append((p.at[rows[x]], g.at[j], most, best[rows[x]], early, first + a + rows[x]))
                n += len(x)
                if n > OPEN_PAIRS:
                    settle()
                    n = 0
        out.append(chosen)
        first += len(pred)
    if waiting:
        settle()
    first = 0
    for chosen in out:
        chosen[beaten[first:first + len(chosen)]] = -1
        first += len(chosen)
    return out


def choose(pred: list[str], gold: list[str], gidx: np.ndarray) -> dict[str, str]:
    """:func:`choose_all` of one sample, by name."""
    names = [*pred, *gold]
    chosen, = choose_all(Names(names), [(np.arange(len(pred)), np.arange(len(pred), len(names)), np.asarray(gidx))])
    return {p: names[k] for p, k in zip(pred, chosen.tolist()) if k >= 0}


def soften_rows(counts: DataFrame, doc: str, name: str = "e_name") -> DataFrame:
    """``counts`` (doc, name, n_gold, n_pred, gidx and others; gidx the name's first place among
    the gold names) with ``soft_name``, null where the name stays.

    Rows are sorted where they are, so those that are dealt by sample do not move; a task
    holds the rows of an Arrow batch and of one sample.  A row whose sample is null stays."""
    def soft(table):
        import pyarrow as pa
        names, _, new = _softened(table, doc, name)
        return table.append_column("soft_name", names.take(pa.array(new, mask=new < 0)).cast(pa.string()))

    return _by_sample(counts, doc, soft, T.StructType([*counts.schema.fields, T.StructField("soft_name", T.StringType())]))


def soften_codes(counts: DataFrame, doc: str, kind: str = "e_type", name: str = "e_name") -> DataFrame:
    """What :func:`soften_rows` gives as (doc, kind, hard, soft, n_gold, n_pred): kinds and names, as
    they were and softened, are numbers that differ where the values do, within one sample."""
    def soft(table):
        import pyarrow as pa
        _, code, new = _softened(table, doc, name)
        kinds = table.column(kind).combine_chunks().dictionary_encode().indices.cast(pa.int32())
        hard, soft = (pa.array(x.astype(np.int32), mask=code < 0) for x in (code, np.where(new < 0, code, new)))
        return pa.table([table.column(doc), kinds, hard, soft, table.column("n_gold"), table.column("n_pred")], names=out.fieldNames())

    out = T.StructType([counts.schema[doc], *[T.StructField(c, T.IntegerType()) for c in (kind, "hard", "soft")],
                        counts.schema["n_gold"], counts.schema["n_pred"]])
    return _by_sample(counts, doc, soft, out)


def _softened(table, doc: str, name: str):
    """(names, codes, new codes) of rows of whole samples: each row's name, and the one that
    replaces it or -1, by their places in ``names``."""
    import pyarrow.compute as pc
    docs = table.column(doc).combine_chunks()
    coded = table.column(name).combine_chunks().dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n_gold, n_pred = (pc.fill_null(table.column(c), 0).to_numpy() for c in ("n_gold", "n_pred"))
    gidx = pc.fill_null(table.column("gidx"), -1).to_numpy().astype(np.int64)
    ends = np.array(_runs(docs))
    sample = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    key = sample * max(1, len(coded.dictionary)) + code  # of a name in its sample
    known = (code >= 0) & docs.is_valid().to_numpy(zero_copy_only=False)
    g = np.flatnonzero(known & (n_gold > 0))
    g = g[np.lexsort((gidx[g], key[g]))]
    g = g[np.concatenate([[True], np.diff(key[g]) != 0])] if len(g) else g  # a name's first place
    p = np.flatnonzero(known & (n_pred > 0))
    p = p[~np.isin(key[p], key[g])]
    mine, own = np.unique(key[p], return_index=True)
    own = p[own]
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    g = g[np.lexsort((gidx[g], sample[g]))]
    if ((np.diff(sample[g]) == 0) & (np.diff(gidx[g]) == 0)).any():  # places of several names: by name then
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        g = g[np.lexsort((rank[code[g]], gidx[g], sample[g]))]
    both = np.intersect1d(sample[g], sample[own])
    cuts = [np.searchsorted(sample[x], both, side) for x in (own, g) for side in ("left", "right")]
    found = choose_all(Names(names), [(code[own[a:b]], code[g[c:d]], gidx[g[c:d]]) for a, b, c, d in zip(*cuts)])
    new = np.full(len(code), -1)
    if len(mine):
        soft_code = np.full(len(mine), -1)
        for a, b, f in zip(*cuts[:2], found):
            soft_code[a:b] = f
        new[p] = soft_code[np.searchsorted(mine, key[p])]
    return coded.dictionary, code, new


def _by_sample(counts: DataFrame, doc: str, soft, schema: T.StructType) -> DataFrame:
    """``soft`` of Arrow tables that hold whole samples."""
    def run(batches):
        import pyarrow as pa
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            part = pa.Table.from_batches([b])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            last = _runs(held.column(doc).combine_chunks())[-2]  # the last sample may go on
            if last:
                yield from soft(held.slice(0, last)).to_batches()
                held = held.slice(last)
        if held is not None:
            yield from soft(held).to_batches()

    return counts.sortWithinPartitions(doc).mapInArrow(run, schema)


def _runs(column) -> list[int]:
    """Where runs of equal values begin, and the end."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]


def _blocks(names: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, name, gidx) of both sides dealt to pairs of bounded blocks (_pb, _gb):
    predictions (gidx null) of one block with gold names of one block."""
    sizes = names.groupBy(doc).agg(F.count_if(F.col("gidx").isNull()).alias("_np"), F.count("gidx").alias("_ng"))
    large = sizes.filter((F.col("_np") > PRED_BLOCK) | (F.col("_ng") > GOLD_BLOCK)).select(
        doc, F.ceil(F.greatest(F.col("_np"), F.lit(1)) / PRED_BLOCK).cast("int").alias("_nb"),
        F.ceil(F.greatest(F.col("_ng"), F.lit(1)) / GOLD_BLOCK).cast("int").alias("_mb"))
    rows = join_small(names, large, [doc], "left")
    n, m = F.coalesce("_nb", F.lit(1)), F.coalesce("_mb", F.lit(1))
    h, is_pred = F.xxhash64("name"), F.col("gidx").isNull()
    rows = rows.select(doc, "name", "gidx", m.alias("_mb"), F.when(is_pred, F.pmod(h, n)).otherwise(F.pmod(h, m)).cast("int").alias("_own"),
                       F.explode(F.sequence(F.lit(0), F.when(is_pred, m).otherwise(n) - 1)).alias("_other"))
    return rows.select(doc, "name", "gidx", "_mb", F.when(is_pred, F.col("_own")).otherwise(F.col("_other")).alias("_pb"),
                       F.when(is_pred, F.col("_other")).otherwise(F.col("_own")).alias("_gb"))


def _sides(table, doc: str):
    import pyarrow.compute as pc
    is_pred = pc.is_null(table.column("gidx"))
    return table.filter(is_pred), table.filter(pc.invert(is_pred))


def _both(mine, other) -> tuple[Names, Block, Block]:
    """The names of both sides, the predictions, the gold names."""
    p, g = mine.column("name").to_pylist(), other.column("name").to_pylist()
    names = Names([*p, *g])
    return names, names.take(np.arange(len(p))), names.take(np.arange(len(p), len(p) + len(g)))


def have_rivals(names: Names, p: Block, g: Block, gidx: np.ndarray, shared: np.ndarray, rows: np.ndarray, r: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a gold name beats the ratio ``r`` at ``place`` of each prediction row."""
    out = np.zeros(len(rows), bool)
    a, j, most, early = rivals(p, g, gidx, shared, rows, r, place)
    beat(names, p.at[rows[a]], g.at[j], most, r[a], early, a, out)
    return out


def soft_names(gold: DataFrame, pred: DataFrame, doc: str) -> DataFrame:
    """(doc, name, soft_name) for every distinct predicted name of a sample."""
    return (pred.select(doc, "name").distinct().join(changed_names(gold, pred, doc), [doc, "name"], "left")
            .withColumn("soft_name", F.coalesce("soft_name", "name")))


def changed_names(gold: DataFrame, pred: DataFrame, doc: str) -> DataFrame:
    """(doc, name, soft_name) for every distinct predicted name of a sample that is replaced.

    ``gold``: (doc, gidx, name) with gidx the position in the sample's gold
    list; ``pred``: (doc, name)."""
    side = gold.select(doc, "name", F.col("gidx").cast("long").alias("gidx")).unionByName(
        pred.select(doc, "name", F.lit(None).cast("long").alias("gidx")))
    names = materialize(side.groupBy(doc, "name").agg(F.min("gidx").alias("gidx")), "soft-names")  # gidx null: predicted only
    blocks = _blocks(names, doc)
    kind = names.schema[doc].dataType.simpleString()
    found = f"`{doc}` {kind}, name string, gname string, gidx long, r double, open boolean"

    def contained(table):
        import pyarrow as pa
        mine, other = _sides(table, doc)
        i = j = r = np.zeros(0, np.int64)
        gidx = np.zeros(0, np.int64)
        whole = True
        if mine.num_rows and other.num_rows:
            names_, p, g = _both(mine, other)
            gidx = other.column("gidx").to_numpy()
            shared = shared_marks(p, g)
            i, j, r = best_containing(p, g, gidx, shared)
            whole = other.column("_mb")[0].as_py() == 1
            if whole:
                stays = ~have_rivals(names_, p, g, gidx, shared, i, r, gidx[j])
                i, j, r = i[stays], j[stays], r[stays]
        rows, theirs = mine.take(pa.array(i, pa.int64())), other.take(pa.array(j, pa.int64()))
        return pa.table({doc: rows.column(doc), "name": rows.column("name"), "gname": theirs.column("name"),
                         "gidx": theirs.column("gidx"), "r": pa.array(r, pa.float64()), "open": pa.array(np.full(len(i), not whole))})

    best = materialize(blocks.groupBy(doc, "_pb", "_gb").applyInArrow(contained, found), "soft-best")
    settled = best.filter(~F.col("open")).select(doc, "name", F.col("gname").alias("soft_name"))

    # samples of several gold blocks: the best of all blocks, then rivals in every block
    top = materialize(best.filter("open").groupBy(doc, "name").agg(
        F.max_by(F.struct("gname", "gidx", "r"), F.struct(F.col("r"), -F.col("gidx"))).alias("b")).select(doc, "name", "b.*"), "soft-top")

    def beaten_by(table):
        import pyarrow as pa
        mine, other = _sides(table, doc)
        at = np.zeros(0, np.int64)
        if mine.num_rows and other.num_rows:
            names_, p, g = _both(mine, other)
            gidx = other.column("gidx").to_numpy()
            some = np.flatnonzero(mine.column("r").is_valid().to_numpy())
            r, place = (mine.column(c).take(pa.array(some)).to_numpy() for c in ("r", "place"))
            at = some[have_rivals(names_, p, g, gidx, shared_marks(p, g), some, r, place)]
        rows = mine.take(pa.array(at, pa.int64()))
        return pa.table({doc: rows.column(doc), "name": rows.column("name")})

    again = blocks.filter(F.col("_mb") > 1).join(
        top.select(doc, "name", "r", F.col("gidx").alias("place")), [doc, "name"], "left").filter(F.col("gidx").isNotNull() | F.col("r").isNotNull())
    beaten = again.groupBy(doc, "_pb", "_gb").applyInArrow(beaten_by, f"`{doc}` {kind}, name string").distinct()
    left = top.join(beaten, [doc, "name"], "left_anti").select(doc, "name", F.col("gname").alias("soft_name"))
    return settled.unionByName(left)
