"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import shared_dir

#: White space between words: the six ASCII characters.
SPACES = r"[\x20\x09-\x0D]+"
#: A character of a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row, however often body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none if it is null."""
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":  # five searches for one byte and a split at one character: no regular expression runs
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(blank, " ", -1), "")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        _delete(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Folders of tables that this Python process has made and not removed.
_FOLDERS: set[str] = set()


def clear_scratch(spark: SparkSession) -> None:
    """Removes all tables between steps that this process has made: to be called in a long session when results are written."""
    while _FOLDERS:
        _delete_quietly(spark, _FOLDERS.pop())


class Scratch:
    """Tables in the shared folder, which outlive any executor. drop() removes one early; clear_scratch() removes all, at the
    latest when Python ends. Results read them lazily, so they stay until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if not _FOLDERS:
            atexit.unregister(clear_scratch)
            atexit.register(clear_scratch, spark)
        _FOLDERS.add(self.root)

    def write(self, df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
        """df as a table. arrow_rows: rows that go to Python workers together while it is written, where rows are large."""
        schema, setting = df.schema, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting, None)
        if arrow_rows:
            self.spark.conf.set(setting, str(arrow_rows))
        try:
            self._write(df, name)
        finally:
            if arrow_rows:
                self.spark.conf.unset(setting) if before is None else self.spark.conf.set(setting, before)
        del df
        free_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        _delete_quietly(self.spark, f"{self.root}/{name}")
