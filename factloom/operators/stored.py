"""Tables between the steps of an iteration, in the folder that all machines share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.session import shared_dir


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark knows; nothing happens if it is gone."""
    with contextlib.suppress(Exception):  # at the end of Python the session may be gone as well
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Steps:
    """Numbered tables of one iteration; only the last two are kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(remove, spark, self.root)

    def next(self, df: DataFrame) -> DataFrame:
        schema, self.n = df.schema, self.n + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{self.n}")
        remove(self.spark, f"{self.root}/{self.n - 2}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.n}")
