"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapanel.sources.scratch import folder

#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


class Tables:
    """The intermediate tables of one run of an operator.

    Writing a table cuts the lineage: an executor that is lost afterwards costs
    a reread, not a recomputation of everything before.  Tables that a result
    still reads are left; the others are removed as soon as they are used up.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = folder(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as Parquet in the shared folder, read back."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        """On whatever file system the folder is."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB from here on, unless the session already has smaller ones.

    Texts differ in length by orders of magnitude, so a number of rows bounds
    no memory; batches of this size cost nothing measurable.  Queries and
    pipeline stages call this; operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key, "64m").lower().rstrip("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    if not size.rstrip("kmg").isdigit() or int(size.rstrip("kmg")) * factor > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
