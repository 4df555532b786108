"""N-gram Jaccard join by chosen paths.

Each text is the set of its five-word shingles; texts of one set are one node with a weight. A run follows, for every set, a path
of sampled tokens: at each step the set's token that is least under a hash of that run and step, so that two sets take the same
step with the probability of their similarity. Buckets that a step leaves too large are split by the next step, small ones are
compared, and runs are repeated until a target recall: a pair of similarity s meets in a run with probability s^steps at least, so
as many runs are made as miss a pair at the threshold with no more than MISSED at the last step: twelve at 0.8 and two steps
(0.36^12, 5e-6), however large its group.
A bucket that the last step leaves too large is cut into tiles, and all pairs of tiles are compared, each in a task of bounded
size. Pairs are never rows: a comparison hands on counts for its members, and a spanning forest of their links.

First compared are 72 samples of each set or more, which drop pairs far below the threshold (one at the threshold with no more
than UNSEEN); the sets themselves are then built for what is left, and decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table, words_of
from factloom.llm.graph import connected_components, forest

SHINGLE = 5
THRESHOLD = 0.8
DEPTH = 2
#: Probabilities that a pair at the threshold meets in no run, and that its samples drop it; samples of a set at least.
MISSED, UNSEEN, SAMPLES = 5e-6, 1e-6, 72
#: Texts and sets that go to a Python worker together.
TEXTS = 2000
#: Sets that are compared with each other in one step at most (a bucket, or two tiles of half of it).
BUCKET = 1024
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def runs_for(threshold: float, depth: int, missed: float = MISSED) -> int:
    """Runs after which a pair at the threshold that needs all steps has met but for a probability of missed."""
    met = threshold**depth
    return max(1, math.ceil(math.log(missed) / math.log1p(-met))) if met < 1 else 1


def least_common(count: int, threshold: float, unseen: float = UNSEEN) -> int:
    """Common samples of count that a pair at the threshold falls short of with probability unseen at most."""
    below = 0.0
    for k in range(count + 1):
        below += math.comb(count, k) * threshold**k * (1 - threshold) ** (count - k)
        if below > unseen:
            return k
    return count


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[2])
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive elements, by doubling: a window is told by two that overlap or meet."""
    out, have = mix64(words * np.uint64(MULTIPLIERS[0])), 1
    if len(words) < n:
        return np.zeros(0, np.uint64)
    while have < n:
        step = min(have, n - have)
        out = mix64(out[: len(out) - step] * np.uint64(MULTIPLIERS[0]) + out[step:])
        have += step
    return out


def other_words(words: np.ndarray) -> np.ndarray:
    """Word hashes from which a second hash of windows follows, independent of the first."""
    return mix64(words ^ np.uint64(MULTIPLIERS[2]))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the windows of n words; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(n, len(words))))


def samples(tokens: np.ndarray, count: int) -> np.ndarray:
    """For each of count hashes, the least hash of the tokens (its upper 32 bits)."""
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(MULTIPLIERS[0])) | np.uint64(1)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 4096):
        part = mix64(tokens[k : k + 4096])
        least = np.minimum(least, (part[None, :] * seeds[:, None] ^ (part[None, :] >> np.uint64(29))).min(axis=1))
    return (mix64(least) >> np.uint64(32)).astype("<u4")


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a set."""
    return int(mix64(np.array([mix64(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def second_key(tokens: np.ndarray) -> int:
    """Another one, by which sets that share the first are told apart."""
    return int(mix64(np.array([mix64(other_words(tokens)).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows with sid and sid2: where different sets share a sid, as clashes lists, both make a new one."""
    if clashes is None:
        return rows.drop("sid2")
    rows = rows.join(clashes.withColumn("_clash", F.lit(True)), "sid", "left")
    return rows.withColumn("sid", F.when(F.col("_clash"), F.xxhash64("sid", "sid2")).otherwise(F.col("sid"))).drop("_clash", "sid2")


def hashed_words(text: str):
    return F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))


def each_row(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The word hashes of each row, without copies."""
    lists = batch.column(column)
    values, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), 0
    for n in lists.value_lengths().to_pylist():
        yield values[at : at + (n or 0)]
        at += n or 0


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def per_group(df: DataFrame, key: str, work: Callable[[pa.Table], list[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """work over the rows of each key; a key's rows must be of bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        send = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(arrow), arrow.types, strict=True)], schema=arrow)
        for group in groups(batches, key):
            out += work(group)
            if len(out) >= 5000:
                yield send()
                out = []
        yield send()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def signed_sets(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """Per row of docs: doc_id, tk (hash of the text), sid and sid2 (keys of its set; null without words), n (tokens), sig (samples)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, sid2, n, sig = [], [], [], []
            for words in each_row(batch, "wh"):
                tokens = shingles(words)
                n.append(len(tokens))
                sid.append(set_key(tokens) if len(tokens) else None)
                sid2.append(second_key(tokens) if len(tokens) else None)
                sig.append(samples(tokens, count).tobytes() if len(tokens) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("tk"), *[pa.array(x, pa.int64()) for x in (sid, sid2, n)], pa.array(sig, pa.binary())], names=["doc_id", "tk", "sid", "sid2", "n", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("tk"), hashed_words("t").alias("wh"))
    return rows.mapInArrow(sign, "doc_id long, tk long, sid long, sid2 long, n long, sig binary")


def paths(sets: DataFrame, scratch: Scratch, runs: int, depth: int, bucket: int) -> DataFrame:
    """cell, run, sid: the buckets that hold two sets or more, of bounded size each.

    leaf is the bucket before tiling; side is -1 where all pairs of a cell count, else the tile: pairs of two tiles count.
    """
    step = lambda d: F.substring("sig", F.col("run") * (depth * 4) + d * 4 + 1, F.lit(4))
    rows = sets.select("sid", "sig", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.withColumn("leaf", F.xxhash64("run", step(0)))
    found = []
    for d in range(depth):
        rows = scratch.write(rows, f"paths{d}")
        sizes = scratch.write(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), f"sizes{d}")
        small = sizes.where(F.col("members") <= bucket).select("leaf")
        # A table of its own, so that its size is known: few buckets are large, and few rows then go on to the next step.
        large = scratch.write(sizes.where(F.col("members") > bucket), f"large{d}")
        found.append(rows.join(small.hint("merge"), "leaf", "left_semi").select("sid", "run", "leaf", F.col("leaf").alias("cell"), F.lit(-1).alias("side")))
        if d == depth - 1 or not large.head(1):
            break
        rows = rows.join(large.select("leaf"), "leaf", "left_semi").withColumn("leaf", F.xxhash64("leaf", step(d + 1)))
    half = bucket // 2
    tiled = rows.join(large, "leaf").withColumn("tiles", F.ceil(F.col("members") / F.lit(half * 0.9)).cast("int"))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("tiles")).cast("int"))
    tiled = tiled.select("sid", "run", "leaf", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    found.append(tiled.select("sid", "run", "leaf", F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def first_look(runs: int, count: int, threshold: float) -> Callable[[pa.Table], list[tuple]]:
    """Of a cell, the members with a pair that no earlier run compares, whose samples and sizes allow the threshold; mask: with whom."""
    least = least_common(count, threshold)

    def look(cell: pa.Table) -> list[tuple]:
        m = cell.num_rows
        if m < 2:
            return []
        order = np.argsort(cell.column("sid").to_numpy(), kind="stable")
        cell = cell.take(pa.array(order))
        sig = np.stack([np.frombuffer(x, "<u4") for x in cell.column("sig").to_pylist()])
        met = np.zeros((m, runs), np.int64)
        for k, leaves in enumerate(cell.column("leaves").to_pylist()):
            for x in leaves:
                met[k, x["run"]] = x["leaf"]
        side = cell.column("side").to_numpy()
        n, run = cell.column("n").to_numpy(), cell.column("run")[0].as_py()
        masks = np.zeros((m, m), bool)
        for i in range(m - 1):
            rest = slice(i + 1, m)
            good = np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i])
            if side[i] >= 0:
                good &= side[rest] != side[i]
            if run:
                good &= ~((met[rest, :run] == met[i, :run]) & (met[rest, :run] != 0)).any(axis=1)
            if good.any():
                good[good] = (sig[rest][good] == sig[i]).sum(axis=1) >= least
                masks[i, rest] = good
        masks |= masks.T
        used = np.flatnonzero(masks.any(axis=1))
        masks = masks[np.ix_(used, used)]
        key, sid, weight, rep = (cell.column(c).to_pylist() for c in ("cell", "sid", "weight", "tk"))
        return [(key[i], sid[i], weight[i], rep[i], k, np.packbits(masks[k]).tobytes()) for k, i in enumerate(used)]

    return look


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common tokens of each two sets, by products of blocks of the incidence matrix."""
    m = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    many = np.diff(np.append(starts, len(tokens))) > 1
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), np.diff(np.append(starts, len(tokens))))
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((m, m), np.float64)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        block = np.zeros((m, min(width, int(column[hi - 1]) - a + 1)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out


def second_look(threshold: float) -> Callable[[pa.Table], list[tuple]]:
    """Links of a cell by the sets themselves: (sid, links, root): weight of the members linked with, and where the forest hangs it."""

    def look(cell: pa.Table) -> list[tuple]:
        order = np.argsort(cell.column("at").to_numpy(), kind="stable")
        cell = cell.take(pa.array(order))
        m = cell.num_rows
        sets = [np.frombuffer(x, "<u8") for x in cell.column("tokens").to_pylist()]
        masks = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x in cell.column("mask").to_pylist()]).astype(bool)
        left, right = np.nonzero(np.triu(masks, 1))
        n = np.array([len(s) for s in sets], np.float64)
        if len(left) <= 4 * m:
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.float64)
        else:
            both = shared_counts(sets)[left, right]
        linked = both >= threshold * (n[left] + n[right] - both) - 1e-9
        left, right = left[linked], right[linked]
        if not len(left):
            return []
        weight, sid = cell.column("weight").to_numpy().astype(np.int64), cell.column("sid").to_pylist()
        links = np.zeros(m, np.int64)
        np.add.at(links, left, weight[right])
        np.add.at(links, right, weight[left])
        hung = dict(forest(m, left, right))
        return [(sid[i], int(links[i]), sid[hung.get(i, i)]) for i in np.flatnonzero(links)]

    return look


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, runs: int | None = None, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """Per row of docs: doc_id, tk, component, class_id, n_links, kept.

    Rows are linked if the sets of their five-word shingles have similarity threshold or more; a class is what links connect,
    named by its least doc_id; component tells classes apart where ids are null or repeated, and is null for a text without
    words, a class of its own; n_links counts the other rows linked directly, copies included. kept: the row that names the class.
    Null and empty texts have no shingle and link with nothing; texts of one to four words are one shingle. Rows of one doc_id
    are rows of their own; a null doc_id is never the least unless it is the class's only one. Empty table: empty result.
    Further columns are not read. Without runs, there are as many as the target recall needs (runs_for).

    The joins that carry samples, texts or sets are sort-merge joins at every size: their sides grow with the input.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    runs = runs or runs_for(threshold, depth)
    count = max(SAMPLES, runs * depth)
    members = scratch.write(signed_sets(docs, id_col, text_col, count), "members", TEXTS)
    alike = members.where("sid is not null").groupBy("sid").agg(F.min("sid2").alias("a"), F.max("sid2").alias("b")).where("a <> b").select("sid")
    clashes = scratch.write(alike, "clashes")
    clashes = clashes if clashes.head(1) else None  # some 25 in 3 * 10^10 different sets
    members = told_apart(members, clashes)
    some = members.where("sid is not null")
    sets = scratch.write(some.groupBy("sid").agg(F.count(F.lit(1)).alias("weight"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("tk").alias("tk")), "sets")
    found = scratch.write(paths(sets, scratch, runs, depth, bucket), "cells")
    leaves = found.select("sid", "run", "leaf").distinct().groupBy("sid").agg(F.collect_list(F.struct("run", "leaf")).alias("leaves"))  # one for each run
    cells = found.select("sid", "run", "cell", "side").join(sets.join(leaves.hint("merge"), "sid").hint("merge"), "sid")
    schema = pa.schema([("cell", pa.int64()), ("sid", pa.int64()), ("weight", pa.int64()), ("tk", pa.int64()), ("at", pa.int32()), ("mask", pa.binary())])
    close = per_group(cells, "cell", first_look(runs, count, threshold), "cell long, sid long, weight long, tk long, at int, mask binary", schema)
    close = scratch.write(close, "close")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shingles(words) for words in each_row(batch, "wh")]
            keys = [pa.array([key(x) if len(x) else None for x in out], pa.int64()) for key in (set_key, second_key)]
            yield pa.record_batch([*keys, pa.array([x.tobytes() for x in out], pa.binary())], names=["sid", "sid2", "tokens"])

    wanted = close.select("tk").distinct()
    texts = docs.select(F.col(text_col).cast("string").alias("t")).withColumn("tk", F.xxhash64("t")).join(wanted.hint("merge"), "tk", "left_semi")
    texts = texts.groupBy("tk", F.xxhash64(F.lit(2), "t")).agg(F.first("t").alias("t")).select(hashed_words("t").alias("wh"))
    built = told_apart(texts.mapInArrow(tokens, "sid long, sid2 long, tokens binary"), clashes).dropDuplicates(["sid"])
    schema = pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    links = scratch.write(per_group(close.join(built.hint("merge"), "sid"), "cell", second_look(threshold), "sid long, links long, root long", schema), "links", TEXTS)
    linked = links.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = connected_components(links.select(F.col("sid").alias("u"), F.col("root").alias("v")), "jaccard-classes")
    nodes = sets.select("sid", "weight").join(classes, sets["sid"] == classes["node"], "left").drop("node").join(linked, "sid", "left")
    nodes = nodes.select("sid", "weight", F.coalesce("component", "sid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = some.groupBy("sid").agg(F.min("doc_id").alias("least"))  # summed before the shuffle: a hot class is one row a task
    nodes = scratch.write(nodes.join(least, "sid"), "nodes")
    names = nodes.groupBy("component").agg(F.min("least").alias("class_id"))
    nodes = nodes.join(names, "component").select("sid", "component", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    rows = members.select("doc_id", "tk", "sid").join(nodes, "sid", "left")
    alone = F.col("sid").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", "tk", "component", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each class, with all columns of docs: the one with the least doc_id, by the hash of its text among those.

    Rows without words link with nothing: each is a class of its own, and stays.
    """
    keys = lambda i, t: (F.xxhash64(F.lit(1), i, i.isNull(), t), F.xxhash64(F.lit(2), t, i, i.isNull()))
    found = jaccard_classes(docs, id_col, text_col, **settings).where("kept and component is not null")
    first = found.groupBy("component").agg(F.min("class_id").alias("class_id"), F.min("tk").alias("tk"))
    k1, k2 = keys(F.col("class_id"), F.col("tk"))
    first = first.select(k1.alias("_k1"), k2.alias("_k2"))
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    k1, k2 = keys(doc_id, F.xxhash64(text))
    blank = F.size(words_of(text)) == 0
    rows = docs.where(~blank).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    return rows.join(first, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*").union(docs.where(blank))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of near copies and number of links."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")
