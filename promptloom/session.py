"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "promptloom", cpus: int | str | None = None,
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    settings["spark.driver.memory"] = os.environ.get("PROMPTLOOM_DRIVER_MEMORY", "8g")
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is only read.  A
    private folder is made only where the setting is absent and driver and tasks
    are one process (``local`` masters, as in tests); elsewhere that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="promptloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_MADE: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which :func:`release` will delete."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage of an intermediate that several later steps read: a Parquet table in
    the shared ``spark.checkpoint.dir``.  It survives the loss of executors (unlike cached
    blocks), later steps read only the columns they need, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all intermediate folders that this session has made so far, and tell their
    number.  Frames that were built on them cannot be evaluated any more."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for p in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 << 20,
                  expansion: float = 4.0) -> int:
    """Set shuffle parallelism from the input size: exploded text and tokens
    grow the shuffled volume by ``expansion`` over the compressed parquet
    input; each partition aims at ``target_bytes``.  AQE then coalesces small
    partitions and splits skewed ones at run time."""
    cores = spark.sparkContext.defaultParallelism
    n = max(2 * cores, int(input_bytes * expansion // target_bytes) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(target_bytes, 128 << 20)))
    return n
