"""Sharding by extendible hashing [native].

A shard is a prefix of the hash bits of a document's key. A bucket that exceeds the byte limit splits on one more bit, others stay,
so hot ranges get deep prefixes and the rest shallow ones. Sums of eight bits' worth of splits come from one aggregation over the
buckets still too large; texts are never moved, only their lengths are read. After the bits of the key come bits of the row, so
even a key that a third of all rows share splits on until it fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table

LIMIT = 64 << 20
KEY_BITS, ROW_BITS, STEP = 60, 60, 8


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def row_bits() -> Column:
    """60 bits that differ from row to row."""
    return F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def prefix(high: Column, low: Column, depth: Column) -> tuple[Column, Column]:
    """The first `depth` of the 120 bits in high and low, as numbers."""
    drop = lambda bits, n: F.call_function("shiftright", bits, (F.lit(60) - n).cast("int"))
    return drop(high, F.least(depth, F.lit(KEY_BITS))), drop(low, F.greatest(depth - KEY_BITS, F.lit(0)))


def bit_text(high: Column, low: Column, depth: Column) -> Column:
    """A prefix as text of 0 and 1."""
    digits = lambda bits, n: F.call_function("lpad", F.bin(bits), n, F.lit("0"))
    return F.concat(digits(high, F.least(depth, F.lit(KEY_BITS))), digits(low, F.greatest(depth - KEY_BITS, F.lit(0))))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, shard_id (prefix bits; empty if all fits one shard), depth, shard_bytes, shard_docs.

    Every shard holds limit bytes at most, or one document. Null text: 0 bytes. Null doc_id: a key of its own. Rows of one
    doc_id part only if together they exceed the limit; rows alike in everything part by their place. Empty table: empty
    result. Further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), key_bits(F.col(id_col)).alias("high"), row_bits().alias("low"))
    left = scratch.write(rows, "rows")
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1)
    out, at, leaf = None, 0, ["leaf_high", "leaf_low"]
    while True:
        deep = min(at + STEP, KEY_BITS + ROW_BITS)
        with_leaf = left.withColumns(dict(zip(leaf, prefix(F.col("high"), F.col("low"), F.lit(deep)), strict=True)))
        leaves = with_leaf.groupBy(*leaf).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        leaves = scratch.write(leaves, f"leaves{deep}")
        # Bits of a leaf back in their places, so that shorter prefixes can be cut from them.
        back = lambda c, n: F.call_function("shiftleft", F.col(c), F.lit(60 - n))
        whole = back("leaf_high", min(deep, KEY_BITS)), back("leaf_low", max(0, deep - KEY_BITS))
        paths = leaves.select(*leaf, "b", "n", F.explode(F.sequence(F.lit(at), F.lit(deep))).alias("depth"))
        paths = paths.withColumns(dict(zip(("high", "low"), prefix(*whole, F.col("depth")), strict=True)))
        nodes = paths.groupBy("high", "low", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        # The last bits decide whatever is left: only rows of equal bits throughout are still together there.
        good = nodes.where(fits | (F.col("depth") == KEY_BITS + ROW_BITS)).withColumn("shard_id", bit_text(F.col("high"), F.col("low"), F.col("depth")))
        first = paths.drop("b", "n").join(good, ["high", "low", "depth"]).groupBy(*leaf).agg(F.min_by(F.struct("shard_id", "depth", "shard_bytes", "shard_docs"), "depth").alias("s"))
        first = scratch.write(first, f"first{deep}")
        done = with_leaf.join(first, leaf).select("doc_id", "n_bytes", "s.*")
        out = done if out is None else out.union(done)
        if deep == KEY_BITS + ROW_BITS or not leaves.join(first, leaf, "left_anti").head(1):
            return out
        left = scratch.write(with_leaf.join(first, leaf, "left_anti").drop(*leaf), f"rows{deep}")
        at = deep


def oracle(limit: int) -> str:
    """SQL for shards of documents under a limit that no more than 24 bits are needed for."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
n AS (SELECT d AS depth, substr(bits, 1, d) AS shard_id, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
    FROM r, (SELECT unnest(range(0, 25))::INTEGER AS d) GROUP BY ALL),
p AS (SELECT r.doc_id, r.n_bytes, n.* FROM r JOIN n ON n.shard_id = substr(r.bits, 1, n.depth)
    WHERE n.shard_bytes <= {limit} OR n.shard_docs = 1)
SELECT doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs FROM p
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


ORACLE = oracle(LIMIT)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their shard of 64 MiB at most."""
    return shards(table(spark, sf_dir, "documents"))
