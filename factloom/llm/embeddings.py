"""Embedding near-dedup by PCA-ordered tiles.

Vectors are turned onto the principal axes of all vectors, so that the leading coordinates hold most of their length. They are
sorted along the first axes and cut into blocks; two blocks whose boxes lie further apart than the threshold allows are never
compared. Blocks that follow each other travel in groups: two groups with near blocks are one task's rows, so a block is
moved once for many comparisons. Within a tile (two blocks) products grow by some coordinates at a time; what the rest can still add is bounded by the
product of the suffix norms, and rows and columns that cannot reach the threshold any more drop out. Pairs that are left are
decided by the cosine of the vectors as they came, in double precision.

Equal vectors are one node with a weight. A tile hands on counts for its members and a spanning forest of its links, never pairs,
so the rows that leave it are at most as many as its members, however many of them are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table
from factloom.llm.graph import connected_components
from factloom.llm.jaccard import groups

THRESHOLD = 0.98
BLOCK = 1024
STEP = 16
#: Leading coordinates that a block's box covers.
BOX = 8
#: Numbers in the axes that are broadcast (64 MB): axes are found for the most common lengths as far as they fit; others keep
#: the axes they have.
MOST_NUMBERS = 1 << 23
#: Bytes of vectors in two groups of blocks.
GROUP_BYTES = 64 << 20
#: Blocks of one label and length from which their cells take a second and a third axis.
MORE_AXES = (64, 4096)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Length and row numbers of the vectors of each length."""
    lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        yield int(dim), np.flatnonzero(lengths == dim)


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Axes by descending variance for the most common lengths, from the second moments of all vectors."""
    common, numbers = [], 0
    for r in nodes.where(F.col("dim") * F.col("dim") <= MOST_NUMBERS).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1024).collect():
        if numbers + r["dim"] ** 2 <= MOST_NUMBERS:
            common.append(r["dim"])
            numbers += r["dim"] ** 2

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at in by_length(batch):
                rows = unit(matrix(batch.column("v").take(pa.array(at)), dim))
                sums[dim] = sums.get(dim, 0) + rows.T @ rows
        for dim, total in sums.items():
            i, j = np.triu_indices(dim)
            yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["dim", "i", "j", "x"])

    found = nodes.where(F.col("dim").isin(common)).select("v").mapInArrow(moments, "dim int, i int, j int, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    dims, i, j, x = (found.column(c).to_numpy() for c in ("dim", "i", "j", "x"))
    for dim in common:
        at, total = dims == dim, np.zeros((dim, dim))
        total[i[at], j[at]] = total[j[at], i[at]] = x[at]
        out[dim] = np.linalg.eigh(total)[1][:, ::-1].copy()
    return out


def blocks(nodes: DataFrame, axes, reach: float) -> DataFrame:
    """Rows of block, label, dim, lo, hi (box), nid, weight and v (bytes): at most BLOCK vectors, near each other on the first axes."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = np.zeros((batch.num_rows, BOX))
            for dim, at in by_length(batch):
                rows = unit(matrix(batch.column("v").take(pa.array(at)), dim))
                rows = rows @ axes.value[dim] if dim in axes.value else rows
                box[at, : min(BOX, dim)] = rows[:, :BOX]
            box = pa.FixedSizeListArray.from_arrays(pa.array(box.ravel()), BOX).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, box], names=[*batch.schema.names, "box"])

    placed = nodes.mapInArrow(lead, "nid long, label string, dim int, weight long, v array<double>, box array<double>")
    cell = lambda k: F.floor(F.col("box")[k] / F.lit(reach / 2))
    order = ["label", "dim", cell(0), cell(1), cell(2), F.col("box")[3], "nid"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, key, held = TaskContext.get().partitionId() << 32, None, []

        def sent() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            box = matrix(rows.column("box").chunk(0), BOX)
            vectors = rows.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            values = [name, *key, box.min(axis=0).tolist(), box.max(axis=0).tolist(), *(rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("nid", "weight")), vectors.tobytes()]
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 3]
            return pa.record_batch([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=["block", "label", "dim", "lo", "hi", "nid", "weight", "v"])

        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            at = 0
            while at < batch.num_rows:
                if held and (key != (labels[at], dims[at]) or sum(x.num_rows for x in held) >= BLOCK):
                    yield sent()
                    name, held = name + 1, []
                key = (labels[at], dims[at])
                end, most = at, at + BLOCK - sum(x.num_rows for x in held)
                while end < min(batch.num_rows, most) and (labels[end], dims[end]) == key:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield sent()

    return placed.mapInArrow(cut, "block long, label string, dim int, lo array<double>, hi array<double>, nid binary, weight binary, v binary")


def near_pairs(found: DataFrame, reach: float) -> DataFrame:
    """a and b of the blocks (a <= b) of one label and length whose boxes are within reach.

    They meet by the cells of up to three axes that their boxes touch, the more blocks a label has the more axes; the boxes'
    distance then decides, before pairs that meet in several cells are made one.
    """
    sizes = found.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    boxes = found.select("block", "label", "dim", "lo", "hi").join(sizes, ["label", "dim"])
    axes = F.lit(1) + sum((F.col("n") > x).cast("int") for x in MORE_AXES)

    def cells(wide: int) -> Column:
        span = lambda k: F.when(axes > k, F.sequence(F.floor(F.col("lo")[k] / reach) - wide, F.floor(F.col("hi")[k] / reach) + wide)).otherwise(F.array(F.lit(0).cast("bigint")))
        return F.flatten(F.flatten(F.transform(span(0), lambda x: F.transform(span(1), lambda y: F.transform(span(2), lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))

    side = lambda x, wide: boxes.select(F.col("block").alias(x), "label", "dim", F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), F.explode(cells(wide)).alias("cell"))
    pairs = side("a", 0).join(side("b", 1), ["label", "dim", "cell"]).where("a <= b")
    gap = lambda k: F.greatest(F.lit(0.0), F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k])
    apart = sum((gap(k) * gap(k) for k in range(1, BOX)), gap(0) * gap(0))
    return pairs.where(apart <= reach * reach * (1 + 1e-9)).select("dim", "a", "b").distinct()


def in_reach(lo: np.ndarray, hi: np.ndarray, reach: float) -> np.ndarray:
    """Whether the boxes of each two blocks are within reach, as near_pairs has it."""
    gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
    return (gap * gap).sum(axis=2) <= reach * reach * (1 + 1e-9)


def tiles_of(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks of each two groups that have near blocks: tile, ga, gb and the block's columns. A group is as many blocks that
    follow each other (a power of two, eight at most) as GROUP_BYTES allows for their length."""
    size = lambda k: F.lit(2 * k * BLOCK * 8).cast("bigint") * F.col("dim") <= GROUP_BYTES
    shift = F.when(size(8), 3).when(size(4), 2).when(size(2), 1).otherwise(0)
    pairs = pairs.select("a", "b", shift.alias("s")).select("a", "b", F.call_function("shiftright", F.col("a"), F.col("s")).alias("ga"), F.call_function("shiftright", F.col("b"), F.col("s")).alias("gb"))
    held = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("block"), "ga", "gb").distinct()
    return held.join(found, "block").withColumn("tile", F.xxhash64("ga", "gb", "label", "dim"))


def linked_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with cosine of threshold or more; of one block, those with the first number below the second."""
    a, b = unit(left), unit(right)
    if axes is not None:
        a, b = a @ axes, b @ axes
    rest = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))
    rest_a, rest_b = rest(a), rest(b)
    rows, columns, dim = np.arange(len(a)), np.arange(len(b)), a.shape[1]
    sums = np.zeros((len(a), len(b)))
    for at in range(0, dim, STEP):
        sums += a[rows, at : at + STEP] @ b[columns, at : at + STEP].T
        if at + STEP >= dim:
            break
        can = sums + rest_a[rows, at + STEP, None] * rest_b[columns, at + STEP] >= threshold - 1e-9
        if same:
            can &= rows[:, None] < columns
        r, c = can.any(axis=1), can.any(axis=0)
        rows, columns, sums = rows[r], columns[c], sums[np.ix_(r, c)]
        if not len(rows):
            break
    near = sums >= threshold - 1e-9
    if same:
        near &= rows[:, None] < columns
    i, j = np.nonzero(near)
    i, j = rows[i], columns[j]
    good = np.zeros(len(i), bool)
    length = lambda m: np.sqrt((m * m).sum(axis=1))
    scale = lambda m: m / np.abs(m).max(axis=1, keepdims=True)
    left, right = scale(left), scale(right)
    n_left, n_right = length(left), length(right)
    for k in range(0, len(i), 1 << 15):
        s = slice(k, k + (1 << 15))
        good[s] = (left[i[s]] * right[j[s]]).sum(axis=1) / (n_left[i[s]] * n_right[j[s]]) >= threshold
    return i[good], j[good]


def by_values(rows: pa.Table, columns: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Row numbers for each combination of the columns' values."""
    values = np.column_stack([rows.column(c).to_numpy() for c in columns])
    for x in np.unique(values, axis=0):
        yield tuple(x.tolist()), np.flatnonzero((values == x).all(axis=1))


def joined(component: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """component (for each node its component's least node) after links between i and j: least labels spread over the links of
    components, with pointers doubled, until nothing changes."""
    a, b = component[i], component[j]
    apart = a != b
    pairs = np.unique(a[apart] * len(component) + b[apart])
    a, b = pairs // len(component), pairs % len(component)
    least = np.arange(len(component))
    while len(a):
        new = least.copy()
        np.minimum.at(new, least[a], least[b])
        np.minimum.at(new, least[b], least[a])
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    return least[component]


def links_of(blocks: list[dict], ga: int, gb: int, axes: dict[int, np.ndarray], threshold: float, reach: float) -> Iterator[pa.RecordBatch]:
    """nid, links and root for the pairs of near blocks, the first of group ga, the second of group gb.

    Links of one pair of blocks at a time become counts and components, so memory is that of one tile however many are alike;
    and at most as many rows leave as there are vectors in the groups.
    """
    dim = blocks[0]["dim"]
    shift = next(s for s in (3, 2, 1, 0) if s == 0 or (2 << s) * BLOCK * 8 * dim <= GROUP_BYTES)
    blocks = sorted(blocks, key=lambda x: x["block"])
    vectors = [np.frombuffer(x["v"]).reshape(-1, dim) for x in blocks]
    nid, weight = (np.concatenate([np.frombuffer(x[c], np.int64) for x in blocks]) for c in ("nid", "weight"))
    first = np.cumsum([0, *map(len, vectors)])
    near = in_reach(np.array([x["lo"] for x in blocks]), np.array([x["hi"] for x in blocks]), reach)
    links, component = np.zeros(len(nid)), np.arange(len(nid))
    for x, a in enumerate(blocks):
        for y in range(x, len(blocks)):
            b = blocks[y]
            if not near[x, y] or a["label"] != b["label"] or (a["block"] >> shift, b["block"] >> shift) != (ga, gb):
                continue
            i, j = linked_pairs(vectors[x], vectors[y], axes.get(dim), threshold, x == y)
            i, j = i + first[x], j + first[y]
            links += np.bincount(i, weight[j], len(nid)) + np.bincount(j, weight[i], len(nid))
            component = joined(component, i, j)
    at = np.flatnonzero(links)
    if len(at):
        yield pa.record_batch([pa.array(nid[at]), pa.array(links[at].astype(np.int64)), pa.array(nid[component[at]])], names=["nid", "links", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and not null, their lengths equal and their cosine is threshold or more. Null,
    empty and zero vectors and those with null or non-finite components link with nothing. Repeated rows are rows of their own,
    linked with each other. A null vec_id is never the least unless its component has no other. Empty table: empty result.
    Further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    good = usable(F.col("v")) & F.col("label").isNotNull()
    rows = rows.withColumn("nid", F.when(good, F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0)))))
    nodes = rows.where("nid is not null").groupBy("nid").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    nodes = scratch.write(nodes.select("nid", "label", F.size("v").alias("dim"), "weight", "v", "least"), "nodes")
    axes = spark.sparkContext.broadcast(principal_axes(nodes))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    found = scratch.write(blocks(nodes.drop("least"), axes, reach), "blocks")
    pairs = scratch.write(near_pairs(found, reach), "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, "tile"):
            for (ga, gb, _), at in by_values(held, ("ga", "gb", "dim")):  # tiles may share a hash
                yield from links_of(held.take(pa.array(at)).to_pylist(), ga, gb, axes.value, threshold, reach)

    tiles = tiles_of(pairs, found).repartition("tile").sortWithinPartitions("tile")
    links = scratch.write(tiles.mapInArrow(compare, "nid long, links long, root long"), "links", arrow_rows=16)
    classes = connected_components(links.select(F.col("nid").alias("u"), F.col("root").alias("v")), "embedding-components")
    counted = links.groupBy("nid").agg(F.sum("links").alias("links"))
    whole = nodes.select("nid", "weight", "least").join(classes, nodes["nid"] == classes["node"], "left").drop("node").join(counted, "nid", "left")
    whole = scratch.write(whole.select("nid", "least", F.coalesce("component", "nid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "whole")
    names = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(names, "component").select("nid", "component_id", "n_links")
    out = rows.select("vec_id", "nid").join(whole, "nid", "left")
    component = F.when(F.col("nid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
