"""The ledger as a stream: batches of stamps laid over a table of Parquet, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ledger import Pillar
from factloom.operators.stored import exists, remove


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _index(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """Which batch wrote each bucket last, as of batch n: at most as many rows as there are buckets."""
    if n < 0 or not exists(spark, f"{path}/index{n}"):
        return {}
    return {r["bucket"]: r["v"] for r in spark.read.parquet(f"{path}/index{n}").collect()}


def _rows(spark: SparkSession, path: str, pillar: Pillar, parts: dict[int, int]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in pillar.columns)
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/v{v}/bucket={b}" for b, v in sorted(parts.items())])


def read_ledger(spark: SparkSession, path: str, pillar: Pillar, batch: int) -> DataFrame:
    """The ledger as batch left it."""
    return _rows(spark, path, pillar, _index(spark, path, batch))


def keep_ledger(spark: SparkSession, stamps: DataFrame, path: str, checkpoint: str, pillar: Pillar, order: str = "seq", buckets: int = 64):
    """Runs over all stamps that are there and ends.

    The ledger lies in buckets of keys. A batch reads and writes only the buckets that its stamps touch, under its own number,
    and then an index of which batch holds each bucket; so a batch that is run again after a failure writes the same again, and
    what no index of the last two batches names is removed.
    """

    def merge(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("_bucket", bucket(pillar.key, buckets))
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # at most `buckets`
        before = _index(spark, path, n - 1)
        known = _rows(spark, path, pillar, {b: v for b, v in before.items() if b in touched})
        after = pillar.merged(known, batch.drop("_bucket"), order).withColumn("bucket", bucket(pillar.key, buckets))
        after.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{n}")
        index = before | {b: n for b in touched}
        if index:
            spark.createDataFrame(sorted(index.items()), "bucket int, v int").coalesce(1).write.mode("overwrite").parquet(f"{path}/index{n}")
        older = _index(spark, path, n - 2)
        for v in set(older.values()) - set(before.values()) - set(index.values()):
            remove(spark, f"{path}/v{v}")
        remove(spark, f"{path}/index{n - 2}")

    return stamps.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by window and type, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
