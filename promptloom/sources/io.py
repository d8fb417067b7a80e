"""File sources (S1-S8) and sinks (K1-K8).

Readers attach a stable ``line_no`` (file order) where the reference relies on
list positions.  Lines stay where they are read: the parts of files that Spark
reads as a whole are counted, and a line's number is the number of lines before
its part (from one row a part) plus its place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.operators.joins import join_small
from promptloom.session import materialize


def _line_numbers(df: DataFrame, file_line: str | None = None) -> DataFrame:
    """Dense 0-based positions in file order (path, then offset) of rows straight from
    a file reader; ``file_line`` names a column for the position in the row's own file."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    parts = materialize(placed.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = lambda w: F.sum("_n").over(w.orderBy("_file", "_block")) - F.col("_n")
    starts = parts.select("_file", "_block", "_first", "_n", before(Window.partitionBy()).alias("_all"),
                          before(Window.partitionBy("_file")).alias("_own"))
    out = join_small(placed, starts, ["_file", "_block"])
    # both scans deal the parts to tasks alike; were it not so, no line would get a wrong number
    at = F.col("_id") - F.col("_first")
    at = F.when((at >= 0) & (at < F.col("_n")), at).otherwise(F.raise_error(F.lit("files were read in other parts than they were counted")).cast("long"))
    out = out.withColumn("line_no", F.col("_all") + at)
    if file_line is not None:
        return out.withColumn(file_line, F.col("_own") + at).drop("_block", "_id", "_first", "_n", "_all", "_own")
    return out.drop("_file", "_block", "_id", "_first", "_n", "_all", "_own")


def _require(c: Column, what: str) -> Column:
    return F.coalesce(c, F.raise_error(F.lit(what)))


def read_jsonl(spark: SparkSession, path: str, prompt_key: str = "prompt", target_key: str = "target",
               strict: bool = True, first_n: int | None = None) -> DataFrame:
    """S1 (+S2, S8): JSON lines projected to (line_no, prompt, target).

    ``strict`` fails the job on a malformed line or a missing key, as the
    reference's reader does; otherwise such rows keep nulls.  ``first_n``
    keeps lines with line_no < first_n (order-safe, unlike a bare limit)."""
    lines = _line_numbers(spark.read.text(path))
    schema = f"`{prompt_key}` string, `{target_key}` string"
    j = lines.select("line_no", F.from_json("value", schema).alias("j"), "value")
    p, t = F.col(f"j.`{prompt_key}`"), F.col(f"j.`{target_key}`")
    if strict:
        p = _require(p, f"missing or malformed '{prompt_key}'")
        t = _require(t, f"missing or malformed '{target_key}'")
    out = j.select("line_no", p.alias(prompt_key), t.alias(target_key))
    return first_lines(out, first_n) if first_n is not None else out


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of a reader that numbers them."""
    return lines.filter(F.col("line_no") < n)


def read_jsonl_quarantined(spark: SparkSession, path: str, side_path: str, prompt_key: str = "prompt",
                           target_key: str = "target", max_bad_share: float = 0.01) -> DataFrame:
    """S1 for files with some bad lines: (line_no, prompt, target) of the good ones.

    Bad lines go to the table at ``side_path``: file, file_line (0-based, in that file),
    line_no, reason (``malformed`` or ``missing key``) and the line itself.  More than
    ``max_bad_share`` of them fail the job, after they are written.  The table is
    overwritten, so a repeated read leaves one copy."""
    lines = _line_numbers(spark.read.text(path), "file_line")
    schema = f"`{prompt_key}` string, `{target_key}` string, _corrupt_record string"
    j = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    p, t = F.col(f"j.`{prompt_key}`"), F.col(f"j.`{target_key}`")
    reason = F.when(F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), "malformed").when(p.isNull() | t.isNull(), "missing key")
    marked = lines.select(F.col("_file").alias("file"), "file_line", "line_no", "value", j.alias("j")).withColumn("reason", reason)
    bad = marked.filter(F.col("reason").isNotNull()).select("file", "file_line", "line_no", "reason", F.col("value").alias("line"))
    bad.write.mode("overwrite").parquet(side_path)
    n_bad = spark.read.parquet(side_path).count()
    if n_bad > max_bad_share * (n_all := spark.read.text(path).count()):
        raise ValueError(f"{n_bad} of {n_all} lines of {path} are bad; see {side_path}")
    return marked.filter(F.col("reason").isNull()).select("line_no", p.alias(prompt_key), t.alias(target_key))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: files holding one JSON array each; one row per element, with line_no."""
    return _line_numbers(spark.read.schema(schema).option("multiLine", "true").json(path))


def write_json_arrays(df: DataFrame, key: str, path: str, keys_per_array: int = 100_000) -> None:
    """A folder of files for :func:`read_json_array`, each one JSON array: the rows
    of a range of ``keys_per_array`` values of an integer key that is unique, so
    that an array stays the size of a task's work."""
    lines = df.select(F.floor(F.col(key) / keys_per_array).alias("part"), F.to_json(F.struct(*df.columns)).alias("j"))
    arrays = lines.groupBy("part").agg(
        F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("part").text(path)  # a file holds one array by its format


def read_type_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """{"entities": {code: {"verbose", "short"}}, ...} -> (code, verbose, short)."""
    d = spark.read.schema("entities map<string, struct<verbose: string, short: string>>") \
        .option("multiLine", "true").json(path)
    return d.select(F.explode("entities").alias("code", "v")).select("code", "v.verbose", "v.short")


def read_qa_csv(spark: SparkSession, path: str, q_col: str = "question", a_col: str = "answer") -> DataFrame:
    """Header CSV -> (q, a)."""
    d = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(f"`{q_col}` string, `{a_col}` string").csv(path)
    return d.select(F.col(q_col).alias("q"), F.col(a_col).alias("a"))


def read_tokenized(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A persisted tokenised dataset; ``split`` selects a partition."""
    d = spark.read.parquet(path)
    return d.filter(F.col("split") == split) if split is not None else d


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(content, msg) pair table (the reference's pickled pair list)."""
    return spark.read.format(fmt).load(path).select("content", "msg")


# ---------------------------------------------------------------------------- sinks

def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1/K6: JSON lines, UTF-8 unescaped, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_corpus(corpus: DataFrame, types: DataFrame, path: str) -> None:
    """K6: an annotated corpus with a copy of its type dictionary beside it."""
    write_jsonl(corpus, f"{path}/corpus")
    write_jsonl(types, f"{path}/types")


def write_tokenized(df: DataFrame, path: str) -> None:
    """K2: tokenised dataset as parquet, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_result_csv(df: DataFrame, path: str, float_cols: list[str], single_file: bool = False) -> None:
    """K3: CSV with 4-decimal floats (as ``float_format='%.4f'``).  ``single_file``
    suits a small result table only: one task writes it."""
    cols = [F.format_string("%.4f", F.col(c)).alias(c) if c in float_cols else F.col(c) for c in df.columns]
    out = df.select(*cols)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_wrong_format(df: DataFrame, path: str) -> bool:
    """K4: side output of samples with a non-empty error_type, only if any."""
    bad = materialize(df.filter(F.col("error_type") != ""))  # read twice, computed once
    if bad.isEmpty():
        return False
    write_jsonl(bad, path)
    return True


def append_metrics(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """K5: add one metric record a row (dataset, result_file, mode, match, ...).

    With ``key`` (columns without nulls that tell a record) every record has a folder of
    its own, which a write replaces: what a repeated run writes again is there once.
    Without it records are appended as they come."""
    if key is None:
        df.write.mode("append").option("ignoreNullFields", "false").json(path)
        return
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
     .partitionBy(*key).json(path))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K5: the records of :func:`append_metrics`."""
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """K8: output folder per (model, dataset, ...)."""
    df.write.mode("overwrite").partitionBy(*by).json(path)
