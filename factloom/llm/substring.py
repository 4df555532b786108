"""Substring dedup by level-wise doubling.

A window of `window` words can only be repeated if the shorter windows in it are. The levels are the lengths that double up to
window (7 and 13 for 13). At each level every window that is still a candidate is stood for by the one of its sub-windows of that
length whose hash is least, which two equal windows choose alike; so a level counts a quarter of all places and not each. Only
what is repeated in two documents at one level is extended to the next, until no candidate survives or the full length is reached.

Survivors of a level are handed to the next pass as a bitmap of fixed size (2^filter_bits bits, 8 MB), whatever the size of the
input: it lets some others through as well, never holds one back, and the full length decides by a join on the windows' 64-bit
hashes. A second hash of 32 bits tells whether different windows share a first one; then the join is on both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table
from factloom.llm.jaccard import each_row, hashed_words, other_words, window_hashes

WINDOW = 13
FILTER_BITS = 26
SHORTEST = 6
#: Rows that go to and from Python workers together: texts, windows.
TEXTS, SENT = 1000, 200_000


def levels(window: int) -> list[int]:
    """Lengths that double up to window, none below SHORTEST but window itself."""
    out = [window]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def least_inside(hashes: np.ndarray, span: int) -> np.ndarray:
    """Least of each span consecutive hashes."""
    out, have = hashes, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def standing(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window, the hash of the sub-window of this length that stands for it."""
    return least_inside(window_hashes(words, length), window - length + 1)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(hashes: DataFrame, filter_bits: int) -> np.ndarray:
    """Bitmap of the column h, OR-ed on the cluster; at most 2^filter_bits / 64 rows come to the driver."""
    at = F.col("h").bitwiseAND(F.lit((1 << filter_bits) - 1))
    # shiftleft takes the low six bits of the count
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & {63} as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = words.toArrow()
    out = np.zeros(max(1, (1 << filter_bits) // 64), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k (hash of both), t. Rows that share both are alike and share their result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.select("doc_id", F.xxhash64("doc_id", "t").alias("k"), "t")


def second_hash(words: np.ndarray, window: int) -> np.ndarray:
    return (window_hashes(other_words(words), window) >> np.uint64(32)).astype(np.int64)


def candidates(rows: DataFrame, window: int, passed: list[tuple[int, object]], length: int, places: bool, second: bool = False) -> DataFrame:
    """h and doc_id of what stands, at this length, for the windows that all bitmaps of passed (length, broadcast) let through.

    places: one row for each window, with k and pos; else one for each hash and document. second: with g, the second hash.
    """

    def of_text(words: np.ndarray, maps: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        alive = np.arange(len(words) - window + 1)
        for n, bitmap in maps:
            alive = alive[in_bitmap(bitmap, standing(words, n, window)[alive])]
        h = standing(words, length, window)[alive]
        g = second_hash(words, window)[alive] if second else alive
        if not places:
            order = np.argsort(h)
            h, g = h[order], g[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) if second else h[1:] != h[:-1]
            return h[new], g[new], alive[:0]
        return h, g, alive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [(n, b.value) for n, b in passed]
        names = ["h", "doc_id", *["g"] * second, *["k", "pos"] * places]

        def sent(held: list[tuple]) -> pa.RecordBatch:
            ids, keys, parts = zip(*held, strict=True) if held else ((), (), ())
            counts = [len(x[0]) for x in parts]
            h, g, pos = (np.concatenate([np.zeros(0, t), *(x[k] for x in parts)]) for k, t in enumerate((np.uint64, np.int64, np.int64)))
            columns = {"h": h.view(np.int64), "doc_id": np.repeat(np.array(ids, np.int64), counts), "g": g, "k": np.repeat(np.array(keys, np.int64), counts), "pos": pos.astype(np.int32)}
            return pa.record_batch([pa.array(columns[n]) for n in names], names=names)

        for batch in batches:
            held, size = [], 0
            for doc_id, key, words in zip(batch.column("doc_id").to_numpy(), batch.column("k").to_numpy(), each_row(batch, "wh"), strict=True):
                if len(words) >= window:
                    held.append((doc_id, key, of_text(words, maps)))
                    size += len(held[-1][2][0])
                if size >= SENT:
                    yield sent(held)
                    held, size = [], 0
            yield sent(held)

    source = rows.where("doc_id is not null").select("doc_id", "k", hashed_words("t").alias("wh"))
    return source.mapInArrow(run, "h long, doc_id long" + ", g long" * second + ", k long, pos int" * places)


def repeated_places(docs: DataFrame, id_col: str, text_col: str, window: int, filter_bits: int, scratch: Scratch) -> DataFrame | None:
    """doc_id, k, places: starts of the windows that a smaller doc_id holds as well; None if a level has no survivor."""
    spark = docs.sparkSession
    rows, passed, keys = keyed(docs, id_col, text_col), [], ["h"]
    for length in levels(window):
        last = length == window
        found = candidates(rows, window, passed, length, False, last)
        # The least document is found before the shuffle as well: a passage of a third of all documents is one row a task.
        second = [F.min("g").alias("g0"), F.max("g").alias("g1")] if last else []
        # The number of rows stands for that of documents: it is small and so packs better than a greatest doc_id would, and
        # what rows of one doc_id alone let through is dropped in the end.
        least = found.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *second).where("n > 1").drop("n")
        least = scratch.write(least, f"level{length}", TEXTS)
        if last and least.where("g0 <> g1").head(1):
            keys = ["h", "g"]
            least = found.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            least = scratch.write(least, "both", TEXTS)
        if not least.head(1):
            return None
        passed.append((length, spark.sparkContext.broadcast(bitmap_of(least, filter_bits))))
    found = candidates(rows, window, passed, window, True, len(keys) == 2)
    found = found.join(least.select(*keys, "least"), keys).where(F.col("doc_id") > F.col("least"))
    return scratch.write(found.groupBy("k", "doc_id").agg(F.collect_set("pos").alias("places")), "places", TEXTS)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_text (the words left, one space apart).

    A word goes if a window that covers it also starts in a document with a smaller doc_id, as the texts came in. Null text:
    no words. Fewer words than window: nothing goes. Rows that share a doc_id do not remove each other's words; a row without
    doc_id neither removes nor loses any. Empty table: empty result. Further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    places = repeated_places(docs, id_col, text_col, window, filter_bits, scratch)
    rows = keyed(docs, id_col, text_col)
    if places is None:
        rows = rows.withColumn("places", F.lit(None).cast("array<int>"))
    else:
        rows = rows.join(places, ["k", "doc_id"], "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, max(1, whole.num_rows), 256)):
                n, gone, kept = [], [], []
                for text, places in zip(batch.column("t").to_pylist(), batch.column("places"), strict=True):
                    words = word.findall(text or "")
                    n.append(len(words))
                    if places.is_valid and len(places.values):
                        at = places.values.to_numpy()
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        gone.append(int(covered.sum()))
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    else:
                        gone.append(0)
                    kept.append(" ".join(words))
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.select("doc_id", "t", "places").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words removed from every document, and the hash of what is kept."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
