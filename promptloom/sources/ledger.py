"""A folder of results that are written part by part and survive a stop.

Every part is one write into its own folder; a record of its name in the ledger
makes it count.  A part without a record (its writer was stopped) is written anew,
and a part with one is never written again, so a repeated or resumed job adds
nothing twice.  Readers see recorded parts only.  Everything goes through Spark's
readers and writers, so the folder may lie on any storage that they know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = "part string"


class Ledger:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._row("").filter("false").write.mode("ignore").parquet(f"{self.base}/ledger")

    def _row(self, part: str) -> DataFrame:
        return self.spark.range(0, 1, 1, 1).select(F.lit(part).alias("part"))

    def recorded(self) -> set[str]:
        """Names of finished parts: one short string for every write, not for every row."""
        return {r["part"] for r in self.spark.read.schema(_RECORD).parquet(f"{self.base}/ledger").collect()}

    def write(self, part: str, df: DataFrame) -> bool:
        """Write ``df`` as ``part`` unless it is recorded; tells whether it was written."""
        if part in self.recorded():
            return False
        df.write.mode("overwrite").parquet(f"{self.base}/parts/{part}")
        self.record(part)
        return True

    def record(self, part: str) -> None:
        self._row(part).write.mode("append").parquet(f"{self.base}/ledger")

    def read(self, schema: T.StructType | str, begins: str = "") -> DataFrame:
        """Rows of all recorded parts whose names begin with ``begins``."""
        paths = [f"{self.base}/parts/{p}" for p in sorted(self.recorded()) if p.startswith(begins)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
