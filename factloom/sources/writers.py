"""Writers: ordered tables, staged replacement, upserts with precedence, append-only logs, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.stored import exists, remove


def write_ordered_csv(rows: DataFrame, path: str, *order: str) -> int:
    """CSV sorted over all files by the order, null as empty; returns the number of rows."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return rows.count()


def replace_atomically(rows: DataFrame, path: str) -> None:
    """A table written beside the old one and then put in its place, so a reader sees the one or the other. The old one stays
    until the new one is whole."""
    spark = rows.sparkSession
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    remove(spark, fresh)
    rows.write.parquet(fresh)
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    remove(spark, old)
    if exists(spark, path):
        system.rename(at(path), at(old))
    system.rename(at(fresh), at(path))
    remove(spark, old)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that rows holds are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows under those that are there."""
    rows.write.mode("append").parquet(path)


def last_lines(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of an append-only log the last row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def upserted_by_hand(old: DataFrame, new: DataFrame, key: str, judge: str, machine: str = "gpt") -> DataFrame:
    """old with new laid over it by key; a row that a person judged is never overwritten by a machine's."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    hand = F.col(f"a.{key}").isNotNull() & ~F.coalesce(F.startswith(F.col(f"a.{judge}"), F.lit(machine)), F.lit(False))
    keep = hand | F.col(f"b.{key}").isNull()
    return both.select(*[F.when(keep, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in old.columns])


def appended_new(old: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """old and those rows of new whose key it does not hold; of new rows with one key the least."""
    known = old.select(key.alias("_k")).distinct()
    rest = [c for c in new.columns]
    fresh = new.select("*", key.alias("_k")).join(known, "_k", "left_anti").groupBy("_k").agg(F.min(F.struct(*rest)).alias("_r")).select("_r.*")
    return old.unionByName(fresh)


def sections_upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Records (keys, sections: a map) with the sections of new put in: a null section is taken out, a record without any goes;
    state says whether a record is new, changed, unchanged or gone."""
    a = old.select(*keys, F.col("sections").alias("_a"))
    b = new.select(*keys, F.col("sections").alias("_b"))
    both = a.join(b, keys, "full_outer")
    none = F.create_map().cast("map<string,string>")
    before = F.coalesce("_a", none)
    kept = F.map_filter(before, lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_b", none)), k))
    put = F.map_filter(F.coalesce("_b", none), lambda _, v: v.isNotNull())
    after = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, put))))
    plain = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    rows = both.select(*keys, after.alias("sections"), F.col("_a").isNull().alias("_new"), (plain(before) == plain(after)).alias("_same"))
    state = F.when(F.size("sections") == 0, "gone").when(F.col("_new"), "new").when(F.col("_same"), "unchanged").otherwise("changed")
    return rows.select(*keys, "sections", state.alias("state"))


def write_nested_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out."""
    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).write.mode("overwrite").text(path)


def write_entities(rows: DataFrame, path: str, key: str) -> None:
    """One JSON file an entity, in a folder of its name; a sign in a name that would part folders is written by its number."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    rows.select(F.col(key).alias("entity"), body.alias("value")).repartition("entity").write.mode("overwrite").partitionBy("entity").text(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table, in one job."""
    out = None
    for name, t in sorted(tables.items()):
        row = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.union(row)
    return out


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small table as a report; more rows than `most` are counted and not shown."""
    found = rows.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |" for r in found[:most]]
    return "\n".join(lines + ([f"\n{rows.count() - most} more rows"] if len(found) > most else [])) + "\n"
