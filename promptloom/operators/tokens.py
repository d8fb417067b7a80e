"""Tokenised-feature operators.

Tokenizer (T1) is pluggable.  The built-in one is a word-level tokenizer: words
are whitespace-separated pieces; the vocabulary holds every word of the training
texts in falling frequency (ties by word), or the ``vocab_size`` most frequent
ones where the caller gives a size; ids follow the reserved specials; words
outside it map to ``unk``.  It grows with the texts, so its bytes decide whether
it is sent to the tasks or joined.
A caller-supplied tokenizer runs through ``encode_with`` (Arrow batches via
``mapInPandas``).  Everything after encoding (concatenation, truncation,
masking, padding, batching) is array functions on each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.joins import MAX_BROADCAST_BYTES, join_small, n_bytes
from promptloom.operators.order import with_global_index
from promptloom.session import materialize

PAD, BOS, EOS, UNK = 0, 1, 2, 3
IGNORE = -100
N_SPECIAL = 4


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def build_vocab(texts: DataFrame, text_col: str, vocab_size: int | None = None) -> DataFrame:
    """(word, id): all words by (count desc, word), ids from N_SPECIAL; with
    ``vocab_size`` only the first so many.

    Counting is a partial aggregation and the numbering range-partitioned
    positions: no task holds the whole vocabulary.
    """
    counts = (texts.select(F.explode(words(F.col(text_col))).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    ranked = with_global_index(counts.withColumn("_neg", -F.col("n")), ["_neg", "word"], "_rank")
    if vocab_size is not None:
        ranked = ranked.filter(F.col("_rank") < vocab_size)
    return ranked.select("word", (F.col("_rank") + N_SPECIAL).cast("int").alias("id"))


def encode_fields(df: DataFrame, key_cols: list[str], fields: dict[str, Column], vocab: DataFrame,
                  bos: dict[str, bool] | None = None, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """T1 (built-in tokenizer): one ``array<int>`` column per entry of ``fields``
    (word arrays, already cut to the length that is wanted).

    A vocabulary of at most ``max_bytes`` is sent to the tasks once and words are looked
    up where their row is: no word is shuffled.  For a larger one words are exploded,
    joined to the vocabulary and gathered by key (all fields in one shuffle).  A field
    without words encodes to [] (or [bos])."""
    bos = bos or {}
    vocab = materialize(vocab.select("word", F.col("id").cast("int").alias("_id")))
    cut = df.select(*key_cols, *[c.alias(n) for n, c in fields.items()])
    found = _looked_up if n_bytes(vocab) <= max_bytes else _joined
    out = found(cut, key_cols, list(fields), vocab)
    return out.select(*key_cols, *[(F.concat(F.array(F.lit(BOS)), n) if bos.get(n) else F.col(n)).alias(n) for n in fields])


def _looked_up(df: DataFrame, key_cols: list[str], names: list[str], vocab: DataFrame) -> DataFrame:
    import pyarrow as pa
    table = vocab.toArrow().combine_chunks()  # bounded by the caller
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    sent = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    schema = T.StructType([*[df.schema[c] for c in key_cols], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        known = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        words, ids = (known.column(c).combine_chunks() for c in ("word", "_id"))
        for b in batches:
            out = [b.column(b.schema.get_field_index(c)) for c in key_cols]
            for n in names:
                lists = b.column(b.schema.get_field_index(n))
                flat = lists.flatten().cast(words.type)
                at = pc.index_in(flat, value_set=words)
                found = pc.fill_null(ids.take(at), UNK).cast(pa.int32())
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
                out.append(pa.ListArray.from_arrays(ends, found))
            yield pa.RecordBatch.from_arrays(out, names=[*key_cols, *names])

    return df.mapInArrow(run, schema)


def _joined(df: DataFrame, key_cols: list[str], names: list[str], vocab: DataFrame) -> DataFrame:
    exploded = None
    for name in names:
        e = df.select(*key_cols, F.lit(name).alias("_f"), F.posexplode_outer(name).alias("_pos", "word"))
        exploded = e if exploded is None else exploded.unionByName(e)
    j = join_small(exploded, vocab, ["word"], "left").withColumn(
        "_id", F.when(F.col("word").isNull(), None).otherwise(F.coalesce(F.col("_id"), F.lit(UNK))))
    aggs = [F.sort_array(F.collect_list(F.when((F.col("_f") == n) & F.col("_id").isNotNull(),
                                               F.struct("_pos", "_id")))).alias(f"_{n}") for n in names]
    g = j.groupBy(*key_cols).agg(*aggs)
    return g.select(*key_cols, *[F.transform(f"_{n}", lambda x: x["_id"]).alias(n) for n in names])


def encode_with(df: DataFrame, text_col: str, out_col: str, make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]],
                batch_rows: int | None = None) -> DataFrame:
    """T1 plug-in: ``make_encoder()`` is called once per task (load the tokenizer
    there) and returns a batch function texts -> id lists."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = make_encoder()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            step = batch_rows or max(1, len(texts))
            pdf[out_col] = [ids for i in range(0, len(texts), step) for ids in enc(texts[i:i + step])]
            yield pdf

    return df.mapInPandas(run, schema)


def causal_lm_features(prompt_ids: Column, target_ids: Column, max_len: int, skip_overlength: bool) -> dict[str, Column]:
    """Each part cut to ``max_len``; input = prompt + target + [eos];
    seq_len = #prompt ids; overlength rows are flagged (dropped by the caller
    when ``skip_overlength``) or cut to ``max_len`` (the cut may drop eos)."""
    p = F.slice(prompt_ids, 1, max_len)
    t = F.slice(target_ids, 1, max_len)
    full = F.concat(p, t, F.array(F.lit(EOS)))
    over = F.size(full) > max_len
    return {"input_ids": F.slice(full, 1, max_len), "seq_len": F.size(p), "overlength": over,
            "keep": ~over if skip_overlength else F.lit(True)}


def prompt_masked_labels(ids: Column, seq_len: Column, longest: Column) -> Column:
    """T7 + T8: [-100]*(s-1) + ids[s-1:] + [-100]*(longest-len), s = max(seq_len, 1).
    The last prompt token stays unmasked, as in the reference collator."""
    s = F.greatest(seq_len, F.lit(1))
    n = F.size(ids)
    return F.concat(F.array_repeat(F.lit(IGNORE), s - 1), F.slice(ids, s, n - s + 1),
                    F.array_repeat(F.lit(IGNORE), longest - n))


def length_batches(df: DataFrame, length: Column, id_cols: list[str], batch_size: int, order: str = "length") -> DataFrame:
    """T8 + T9 over a whole corpus: ``batch_id`` and ``longest`` (the batch's padded width)
    of every row, in batches of ``batch_size`` rows.

    ``order`` "length" sorts the corpus by falling length (ties by ``id_cols``), so that
    a batch holds rows of about one length; "given" keeps the order of ``id_cols``.  The
    positions come from ranges (see ``with_global_index``): a corpus of one length is
    dealt by id like any other, and a batch may begin in one range and end in the next."""
    rows = df.withColumn("_len", length.cast("long")).withColumn("_less", -F.col("_len"))
    at = with_global_index(rows, [*(["_less"] if order == "length" else []), *id_cols], "_at")
    at = at.withColumn("batch_id", F.floor(F.col("_at") / batch_size).cast("long"))
    return at.withColumn("longest", F.max("_len").over(Window.partitionBy("batch_id"))).drop("_at", "_less", "_len")


def padding(batches: DataFrame, length: Column) -> DataFrame:
    """Rows, width and padding of every batch of :func:`length_batches`."""
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("longest").alias("width"),
        (F.max("longest") * F.count(F.lit(1)) - F.sum(length.cast("long"))).cast("long").alias("padding"))


def plain_labels(ids: Column, longest: Column) -> Column:
    """Unmasked labels = ids, padding positions -100."""
    return F.concat(ids, F.array_repeat(F.lit(IGNORE), longest - F.size(ids)))


def right_pad(ids: Column, longest: Column, pad: int = PAD) -> Column:
    """Pad to the batch's longest sequence."""
    return F.concat(ids, F.array_repeat(F.lit(pad), longest - F.size(ids)))


def left_pad(ids: Column, longest: Column, pad: int = PAD) -> Column:
    """Left padding for generation."""
    return F.concat(F.array_repeat(F.lit(pad), longest - F.size(ids)), ids)


def last_non_pad(ids: Column, pad: int = PAD) -> Column:
    """sum(ids != pad) - 1 (explicit pad id; see the eos-as-pad quirk)."""
    return F.size(F.filter(ids, lambda x: x != pad)) - 1


def attention_mask(ids: Column) -> Column:
    """T4: all-ones mask of the sequence length."""
    return F.array_repeat(F.lit(1), F.size(ids))


def ids_md5(ids: Column) -> Column:
    """Compact, engine-independent fingerprint of an id array."""
    return F.md5(F.array_join(ids.cast("array<string>"), ","))
