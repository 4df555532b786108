"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that moves in a straight line from the start of training to its end, around its mean. The integral of
that line says how much of the source's target is spent by any point of training; turned around, it gives each document the
point at which its first word falls due. Documents of a source queue in a hashed order; range-sorting all by position mixes them.

No source is ever gathered in one task: the queue of each source comes from a range sort over (source, hash) and prefix sums
over partition totals, so a hot source spreads over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from factloom.llm.common import Scratch, table, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: End weight over start weight, by turns: the curriculum moves from the second kind of source to the first.
SLOPES = (2.0, 0.5, 1.0)


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words_of(text)).cast("bigint")


def ranked_sources(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, rank from 0 by code point, null last; ranked by a range sort, not in one task."""
    totals = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    ordered = totals.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    ordered = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", before.alias("base"))
    return scratch.write(ordered.join(bases, "part").select("source", "source_size", (F.col("base") + F.col("place")).alias("rank")), "ranked")


def cycle(values: tuple[float, ...], rank: Column) -> Column:
    """values by turns along the rank."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources with target: share of all sizes by weight, none above most times its source's size, the excess reshared by weight.

    Each round sums the sources on the cluster and brings two numbers back: what the full ones take and the others' weight.
    A source once full stays full, so the rounds end; they are as many as there are levels of fullness.
    """
    sources = sources.withColumn("weight", cycle(weights, F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    whole = min(whole, float(sources.agg(F.sum("cap")).first()[0] or 0))
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        n, taken, weight = sources.agg(
            F.sum(F.when(is_full, 1).otherwise(0)), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not weight or n == full:
            break
        full, level = n, max(0.0, whole - taken) / weight
    return sources.withColumn("target", F.least("cap", F.col("weight") * F.lit(level if level is not None else 0.0)) if level is not None else F.lit(0.0))


def queued(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with before: the sizes of the same source's rows that stand earlier in the order of (h1, h2, row)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, rank, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            before = []
            for r, size in zip(batch.column("rank").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if r != rank:
                    rank, total = r, 0
                before.append(total)
                total += size
            columns = [*batch.columns, pa.array([pid] * batch.num_rows, pa.int32()), pa.array(before, pa.int64())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "pid", "inside"])

    order = ["rank", "h1", "h2", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{n} {t}" for n, t in ordered.dtypes)
    ordered = scratch.write(ordered.mapInArrow(sums, f"{kinds}, pid int, inside bigint"), "queue")
    parts = ordered.groupBy("rank", "pid").agg(F.sum("size").alias("n"))  # at most sources + partitions rows
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("rank", "pid", earlier.alias("base"))
    return ordered.join(bases, ["rank", "pid"]).withColumn("before", F.col("base") + F.col("inside")).drop("pid", "inside", "base")


def due(spent: Column, slope: Column) -> Column:
    """Point of training (0 to 1) by which a source whose weight ends at slope times its start has spent this share of its target.

    The weight 1 + (slope - 1) x integrates to x + (slope - 1) x^2 / 2 out of (1 + slope) / 2; this solves that for x.
    """
    bend = slope - 1
    return F.when(F.abs(bend) < 1e-9, spent).otherwise((F.sqrt(1 + bend * spent * (1 + slope)) - 1) / bend)


def mixing_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, slopes: tuple[float, ...] = SLOPES, seed: int = 7) -> DataFrame:
    """rows (doc_id, source, size, key, row; no text) with source_size, target, taken, passes, rest and position.

    A source's queue is read round and round until its target is spent: every row is taken `passes` times whole, and `rest`
    more words of it fall in the last, broken round. Position is that of the row's first word; null if nothing is taken.
    key, and after it row, tell rows of one doc_id apart; rows equal in all are interchangeable, so reruns agree.
    """
    scratch = Scratch(rows.sparkSession, "mixing")
    rows = scratch.write(rows, "sizes")
    sources = scratch.write(with_targets(ranked_sources(rows, scratch), weights, share, most), "targets")
    same = rows["source"].eqNullSafe(sources["source"])
    rows = rows.join(sources.select("source", "source_size", "rank", "target"), same).drop(sources["source"])
    rows = rows.withColumn("h1", F.xxhash64(F.lit(seed), "doc_id", "key")).withColumn("h2", F.xxhash64("key", F.lit(seed)))
    rows = queued(rows, scratch)
    target = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumn("passes", passes).withColumn("left", target - F.col("passes") * F.col("source_size") - F.col("before"))
    rows = rows.withColumn("rest", F.greatest(F.lit(0).cast("bigint"), F.least("size", "left")))
    spent = F.least(F.lit(1.0), F.col("before") / F.greatest("target", F.lit(1.0)))
    taken = F.col("passes") * F.col("size") + F.col("rest")
    position = F.when((taken > 0), due(spent, cycle(slopes, F.col("rank"))))
    return rows.withColumn("taken", taken).withColumn("position", position).drop("left", "h2")


def whole_key(docs: DataFrame, seed: int) -> Column:
    """Hash of all columns of a row."""
    parts = [F.lit(seed)]
    for f in docs.schema:
        own = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, (ArrayType, MapType, StructType))
        parts += [own if plain else F.to_json(F.struct(own)), own.isNull()]
    return F.xxhash64(*parts)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column | None = None) -> DataFrame:
    """What the plan needs of each row: doc_id, source, size, key (of its text), row (0, or what tells rows apart further)."""
    text = F.col(text_col).cast("string")
    row = F.lit(0).cast("bigint") if row is None else row
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text, text.isNull()).alias("key"), row.alias("row"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, passes, rest, position; range-sorted by position.

    Null text: size 0, takes nothing. Null source: a source like others, last in order. Null or repeated doc_id, repeated
    rows: each row queues by itself. Source without words: target 0. Empty table: empty result. Further columns are not read.
    """
    plan = mixing_plan(sizes(docs, id_col, text_col, source_col), **settings).drop("row")
    return plan.repartitionByRange("position", "h1").sortWithinPartitions("position", "h1")


#: Words of a partition of the mix, where the session allows so many partitions.
PART_WORDS = 4_000_000


def in_rounds(rows: DataFrame, slopes: tuple[float, ...]) -> DataFrame:
    """rows of the plan once for each round that takes some of them: _last (the broken round) and _position."""
    rounds = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("_t.passes")),
        lambda k: F.struct((F.col("_t.before") + k * F.col("_t.source_size")).alias("spent"), (k == F.col("_t.passes")).alias("last")),
    )
    rows = rows.withColumn("_round", F.explode(rounds)).where(~F.col("_round.last") | (F.col("_t.rest") > 0))
    at = due(F.least(F.lit(1.0), F.col("_round.spent") / F.greatest("_t.target", F.lit(1.0))), cycle(slopes, F.col("_t.rank")))
    return rows.withColumn("_position", at).withColumn("_last", F.col("_round.last")).drop("_round")


def partition_at(plan: DataFrame, slopes: tuple[float, ...]) -> tuple[int, Column]:
    """Number of partitions, and the one of _position: cuts of training with about as many words each, found on the plan alone.

    Words are summed by bins of training, sixteen for each partition that the session allows; that many numbers come to the driver.
    """
    most = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = 16 * most
    bin_of = F.least(F.floor(F.col("_position") * bins), F.lit(bins - 1)).cast("int")
    words = F.when(F.col("_last"), F.col("_t.rest")).otherwise(F.col("_size"))
    sums = {r["bin"]: r["n"] for r in in_rounds(plan, slopes).groupBy(bin_of.alias("bin")).agg(F.sum(words).alias("n")).collect()}
    total = sum(sums.values())
    parts = max(1, min(most, -(-total // PART_WORDS)))
    part, done = [], 0
    for k in range(bins):
        part.append(min(parts - 1, done * parts // max(1, total)))
        done += sums.get(k, 0)
    return parts, F.element_at(F.array(*map(F.lit, part)) if bins <= 1024 else F.from_json(F.lit(str(part)), "array<int>"), bin_of + 1)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None, slopes: tuple[float, ...] = SLOPES, **settings) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, as often as it takes them, in the order of position.

    The one row of a source where the last round breaks off is cut after its `rest` words, which then stand one space apart;
    chars_col, if named and there, gets the length of the cut text. Rows are told apart by all their columns; rows equal in
    all take turns, so one serves all rows of the plan that are equal. Null text: size 0, taken never, as are texts without
    words. Null source: a source like others. Null or repeated doc_id: each row by itself. Empty table: empty result.

    Which partition a row goes to is found on the plan, which holds no text, so texts are joined and moved once.
    """
    columns = docs.columns
    scratch = Scratch(docs.sparkSession, "mixed")
    key = [whole_key(docs, 1).alias("_k1"), whole_key(docs, 2).alias("_k2")]
    plan = mixing_plan(sizes(docs, id_col, text_col, source_col, F.struct(*key)), slopes=slopes, **settings).where(F.col("taken") > 0)
    plan = plan.select("row.*", F.col("size").alias("_size"), F.struct("passes", "rest", "before", "source_size", "target", "rank").alias("_t"))
    plan = scratch.write(plan, "plan")
    parts, part = partition_at(plan, slopes)
    once = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *key).dropDuplicates(["_k1", "_k2"])
    rows = in_rounds(once.join(plan, ["_k1", "_k2"]), slopes).withColumn("_part", part)
    own = F.col("_row").getField(text_col)
    pieces = words_of(own)
    cut = F.col("_last") & (F.col("_t.rest") < F.size(pieces))
    shortened = F.array_join(F.slice(pieces, F.lit(1), F.col("_t.rest").cast("int")), " ")
    kept = F.when(cut, shortened).otherwise(own)
    chars = F.when(cut, F.length(kept)).otherwise(F.col("_row").getField(chars_col)).cast(docs.schema[chars_col].dataType) if chars_col in columns else None
    field = lambda c: kept if c == text_col else chars if c == chars_col else F.col("_row").getField(c)
    rows = rows.select(F.struct(*[field(c).alias(c) for c in columns]).alias("_row"), "_part", "_position", F.col("_t.rank").alias("_rank"))
    return rows.repartitionById(parts, F.col("_part")).sortWithinPartitions("_position", "_rank").select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what the mix takes of every document, and its position in training."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")
