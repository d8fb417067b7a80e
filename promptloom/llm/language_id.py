"""Language ID by segmentation-marginalised unigrams.

A text is its letter words, lower-cased, each behind a word mark.  A language
gives every piece of a fixed public vocabulary a probability; a word's
probability is the sum over all its segmentations into pieces of the product of
their probabilities, computed by the forward algorithm, and a text's is the
product over its words.  The prediction is the language of the highest
likelihood, its score the posterior under equal priors.

Training is expectation maximisation on word counts of a bounded, hash-chosen
sample of labelled rows (about ``fit_docs`` a language): the forward-backward
pass over a task's words gives expected piece counts, which Spark adds up; what
reaches the driver are languages x pieces numbers.  Prediction covers every
whole text.  A Python worker scores a word once (it keeps about
``CACHE_WORDS``, then starts anew).

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
characters outside the vocabulary are one unknown piece each; with no labelled
row everything is ``und``; ties go to the first language by code point; ids may
be null or repeated; an empty table gives an empty result; all other columns are
carried along (``lang_pred`` and ``score`` of the input are replaced); very long texts
are whole, very long words are scored position by position.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from promptloom.llm.common import PerWorker, WordIndex, stored, sums, text_slices

MARK = "▁"
LETTERS = r"\p{L}[\p{L}\p{M}]*"
CACHE_WORDS, CACHE_LETTER_WORDS = 300_000, 600_000
LATTICE_WORDS = 20_000
LONG_WORD = 1_000  # letters; longer words are scored by themselves, and train in parts
BATCH_BYTES = 2 << 20
UND = "und"


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file; the last entry stands for any unknown character."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [sp.id_to_piece(i) for i in ids] + [""]


class Lattice:
    """All segmentations of a list of words, as edges between positions of one flat array."""

    def __init__(self, words: list[str], at: dict[str, int], longest: int, unknown: int):
        src, dst, piece, first, last = [], [], [], [], []
        base = 0
        for w in words:
            n = len(w)
            for i in range(n):
                one = at.get(w[i], unknown)
                src.append(base + i)
                dst.append(base + i + 1)
                piece.append(one)
                for j in range(i + 2, min(n, i + longest) + 1):
                    p = at.get(w[i:j])
                    if p is not None:
                        src.append(base + i)
                        dst.append(base + j)
                        piece.append(p)
            first.append(base)
            last.append(base + n)
            base += n + 1
        self.size = base
        self.src, self.dst, self.piece = (np.array(x, np.int64) for x in (src, dst, piece))
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.start = np.zeros(base, np.int64)  # where each position's word begins
        for_word = self.last - self.first + 1
        self.start[:] = np.repeat(self.first, for_word)

    def _pass(self, edge_logs: np.ndarray, ends: np.ndarray, into: np.ndarray, out_of: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Log sums over all paths from ``ends``; ``depth`` of an edge's target orders the work."""
        total = np.full((self.size, edge_logs.shape[1]), -np.inf)
        total[ends] = 0.0
        order = np.lexsort((into, depth))
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            target = into[part]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1])
            counts = np.diff(np.concatenate([starts, [len(target)]]))
            values = total[out_of[part]] + edge_logs[part]
            top = np.maximum.reduceat(values, starts)
            total[target[starts]] = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, counts, axis=0)), starts))
        return total

    def forward(self, edge_logs: np.ndarray) -> np.ndarray:
        return self._pass(edge_logs, self.first, self.dst, self.src, self.dst - self.start[self.dst])

    def backward(self, edge_logs: np.ndarray) -> np.ndarray:
        length = np.repeat(self.last, self.last - self.first + 1)
        return self._pass(edge_logs, self.last, self.src, self.dst, length[self.src] - self.src)


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    logs: np.ndarray  # pieces x languages

    def index(self) -> tuple[dict[str, int], int]:
        return ({p: i for i, p in enumerate(self.pieces[:-1])}, max(map(len, self.pieces), default=1))


def letter_words(word: str, pattern) -> list[str]:
    return [MARK + w for w in pattern.findall(word.lower())]


def long_word_logs(word: str, model: Model, at: dict[str, int], longest: int) -> np.ndarray:
    """The forward algorithm over one long word, position by position: memory is
    bounded by the longest piece."""
    alpha = [np.zeros(len(model.languages))]
    for j in range(1, len(word) + 1):
        values = []
        for k in range(1, min(len(alpha), longest) + 1):
            piece = at.get(word[j - k:j], len(model.pieces) - 1 if k == 1 else None)
            if piece is not None:
                values.append(alpha[-k] + model.logs[piece])
        alpha.append(np.logaddexp.reduce(values, axis=0))
        if len(alpha) > longest:
            del alpha[0]
    return alpha[-1]


def _word_counts(sample: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, word, n)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex
        pattern = regex.compile(LETTERS)
        counts: Counter = Counter()
        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                counts.update((lang, w[i:i + LONG_WORD]) for w in letter_words(t, pattern) for i in range(0, len(w), LONG_WORD))
        if counts:
            langs, words = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())],
                                             names=["lang", "word", "n"])

    return sample.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def _expected_counts(words: DataFrame, model) -> DataFrame:
    """(lang, word, n) -> (lang index, piece, expected count) under the broadcast model."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        m = model.value
        at, longest = m.index()
        lang_at = {x: i for i, x in enumerate(m.languages)}
        total = np.zeros_like(m.logs)
        for b in batches:
            lang = np.array([lang_at[x] for x in b.column("lang").to_pylist()], np.int64)
            lattice = Lattice(b.column("word").to_pylist(), at, longest, len(m.pieces) - 1)
            if not lattice.size:
                continue
            word_of = np.repeat(np.arange(len(lang)), lattice.last - lattice.first + 1)
            edge_lang = lang[word_of[lattice.src]]
            logs = m.logs[lattice.piece, edge_lang][:, None]
            alpha, beta = lattice.forward(logs), lattice.backward(logs)
            whole = alpha[lattice.last][word_of[lattice.src]]
            weight = np.asarray(b.column("n").to_numpy(zero_copy_only=False), float)[word_of[lattice.src]]
            part = weight * np.exp(alpha[lattice.src] + logs + beta[lattice.dst] - whole)[:, 0]
            np.add.at(total, (lattice.piece, edge_lang), part)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[piece, lang])], names=["lang", "piece", "n"])

    return words.mapInArrow(run, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces_path: str, fit_docs: int = 3000, iterations: int = 2, smoothing: float = 0.1,
          seed: int = 5) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) with both text and lang."""
    spark = docs.sparkSession
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, pieces = sorted(per_lang), load_pieces(pieces_path)
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), -np.log(len(pieces))))
    if not languages:
        return model
    # a row is chosen when its number among 2^40 lies in its language's share
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(2**40 * min(1.0, fit_docs / per_lang[k]))))])
    chosen = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) < shares[F.col("lang")]
    words = stored(_word_counts(labelled.filter(chosen)), "langid-words")
    for _ in range(iterations):
        counts = np.full(model.logs.shape, smoothing)
        for r in _expected_counts(words, spark.sparkContext.broadcast(model)).toLocalIterator():
            counts[r["piece"], r["lang"]] += r["n"]
        model = Model(languages, pieces, np.log(counts / counts.sum(axis=0)))
    return model


class Scorer:
    """Log likelihoods of texts; a letter word is scored once."""

    def __init__(self, model: Model):
        import regex
        self.model = model
        self.at, self.longest = model.index()
        self.pattern = regex.compile(LETTERS)
        self.words = WordIndex(CACHE_WORDS, self.learn, self.reset)
        self.inner: dict[str, int] = {}
        self.inner_logs = np.zeros((0, len(self.model.languages)))
        self.reset()

    def reset(self):
        if len(self.inner) > CACHE_LETTER_WORDS:
            self.inner, self.inner_logs = {}, self.inner_logs[:0]
        self.logs = np.zeros((0, len(self.model.languages)))
        self.n_letters = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        found = [letter_words(w.decode(), self.pattern) for w in words]
        new = list(dict.fromkeys(x for xs in found for x in xs if x not in self.inner))
        for x in [x for x in new if len(x) > LONG_WORD]:
            self.inner[x] = len(self.inner)
            self.inner_logs = np.concatenate([self.inner_logs, [long_word_logs(x, self.model, self.at, self.longest)]])
        new = [x for x in new if len(x) <= LONG_WORD]
        for i in range(0, len(new), LATTICE_WORDS):
            part = new[i:i + LATTICE_WORDS]
            lattice = Lattice(part, self.at, self.longest, len(self.model.pieces) - 1)
            scores = lattice.forward(self.model.logs[lattice.piece])[lattice.last]
            self.inner.update(zip(part, range(len(self.inner), len(self.inner) + len(part)), strict=True))
            self.inner_logs = np.concatenate([self.inner_logs, scores])
        n = np.fromiter(map(len, found), np.int64, len(found))
        which = np.fromiter((self.inner[x] for xs in found for x in xs), np.int64, int(n.sum()))
        logs = np.stack([sums(self.inner_logs[which, k], n) for k in range(len(self.model.languages))], axis=1) \
            if self.model.languages else np.zeros((len(words), 0))
        self.logs = np.concatenate([self.logs, logs])
        self.n_letters = np.concatenate([self.n_letters, n])

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        n_words, words = self.words.look(texts)
        letters = sums(self.n_letters[words], n_words)
        if not self.model.languages:
            return [UND] * len(texts), [0.0] * len(texts)
        total = np.stack([sums(self.logs[words, k], n_words) for k in range(len(self.model.languages))], axis=1)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return ([self.model.languages[k] if n else UND for k, n in zip(best, letters, strict=True)],
                np.where(letters > 0, score, 0.0).tolist())


def _told(batch, scorer: Scorer) -> tuple[list[str], list[float]]:
    """Languages and scores of an Arrow batch with a text column."""
    import pyarrow as pa
    text = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.binary())], names=["text"])
    langs: list[str] = []
    scores: list[float] = []
    for _, texts in text_slices(text, BATCH_BYTES):
        found = scorer.predict([t or b"" for t in texts])
        langs += found[0]
        scores += found[1]
    return langs, scores


def _scorer(docs: DataFrame, model: Model):
    """What a task calls for its worker's scorer; the model (pieces x languages numbers) is broadcast."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    return lambda: PerWorker.get("languages", name, lambda: Scorer(sent.value))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score, from its text alone."""
    docs = docs.drop("lang_pred", "score")
    scorer = _scorer(docs, model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            langs, scores = _told(b, scorer())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told with at least ``min_score``."""
    scorer = _scorer(docs, model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            langs, scores = _told(b, scorer())
            yield b.filter(pa.array([x != UND and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int = 3):
    """Whether crc32 of the doc_id as text leaves 1."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(rest == 1, F.lit(False))


def training_rows(docs: DataFrame, modulus: int = 3) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(modulus))
