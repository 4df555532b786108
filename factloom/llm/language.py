"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams of one to three characters are summed for each language over all training texts. The matrix of log
probabilities (languages x buckets) is broadcast, in blocks of languages of checked size, and batches of texts are scored as
sparse products (texts x buckets by buckets x languages) with numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table
from factloom.llm.packing import worker_state

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Most cells of a broadcast matrix (float32): 256 MB. More languages than fit one are scored in several, one after the other.
MOST_CELLS = 1 << 26
UNKNOWN = "und"
#: Characters of a text and texts at a time, so that arrays stay small; languages whose products are worked out together.
SLICE, TEXTS, LANGS = 1 << 18, 64, 64
BORDER = 32


def letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark upon one."""
    return worker_state("letters", lambda: np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-case text, where a run of what is no letter is one border. Long texts go by slices;
    every n-gram counts once, wherever slices meet."""
    low, known, tail, ended = text.lower(), letters(), np.zeros(0, np.uint64), False
    for at in range(0, len(low), SLICE):
        part = np.frombuffer(low[at : at + SLICE].encode("utf-32-le", "replace"), "<u4")
        border = ~known[part]
        part = np.where(border, BORDER, part).astype(np.uint64)[~(border & np.concatenate([[ended], border[:-1]]))]
        ended = bool(border[-1])
        joined = np.concatenate([tail, part])
        for n in ORDERS:
            new = joined[max(0, len(tail) - n + 1) :]  # n-grams that end in this slice
            if len(new) >= n:
                h = np.zeros(len(new) - n + 1, np.uint64)
                for k in range(n):
                    h = (h * np.uint64(0x100000001B3)) ^ new[k : len(new) - n + 1 + k]
                h = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                yield (h >> np.uint64(64 - 14)).astype(np.int64)
        tail = joined[len(joined) - min(len(joined), max(ORDERS) - 1) :]


def counts_of(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for part in grams(text):
        total += np.bincount(part, minlength=BUCKETS)
    return total


def sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the n-grams of texts."""
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    for k, text in enumerate(texts):
        for part in grams(text):
            total[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at // BUCKETS, at % BUCKETS, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n over rows (lang, text): summed in each task, then by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in grams(text):
                    total += np.bincount(part, minlength=BUCKETS)
            if len(totals) > 256:
                yield from send()
        yield from send()

    return rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, most_cells: int = MOST_CELLS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Blocks of languages by code point, their log probabilities (buckets x languages) and log priors, from rows (lang, text).

    The driver holds one block at a time, and the names of the languages.
    """
    scratch = Scratch(rows.sparkSession, "language")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, whole = sorted(priors, key=lambda x: x.encode()), sum(priors.values())
    counts = scratch.write(gram_counts(rows), "counts") if langs else None
    size = max(1, most_cells // BUCKETS)
    for k in range(0, len(langs), size):
        block = langs[k : k + size]
        found = counts.where(F.col("lang").between(block[0], block[-1])).toArrow()  # at most languages x buckets rows
        matrix = np.ones((BUCKETS, len(block)))
        at = {lang: k for k, lang in enumerate(block)}
        matrix[found.column("bucket").to_numpy(), np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)] += found.column("n").to_numpy()
        yield block, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(np.array([priors[x] for x in block], np.float64) / whole)


def log_scores(texts: list[str], matrix: np.ndarray, prior: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Log of prior and likelihood (texts x languages) of some languages at a time, with the number of the first."""
    row, bucket, n = sparse(texts)
    first = np.searchsorted(row, np.arange(len(texts)))
    for k in range(0, len(prior), LANGS):
        products = matrix[:, k : k + LANGS][bucket].astype(np.float64) * n[:, None]
        yield k, prior[k : k + LANGS] + np.add.reduceat(products, first, axis=0)


def scored(rows: DataFrame, model) -> DataFrame:
    """rows (doc_id, held_out, text, lang_pred, best, total) with what a block of languages adds: the best language so far, its
    log score, and the log of the sum of all; ties stay with the first by code point."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                texts, pred = part.column("text").to_pylist(), part.column("lang_pred").to_pylist()
                best, total = (np.nan_to_num(part.column(c).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf) for c in ("best", "total"))
                rows_ = np.array([i for i, x in enumerate(texts) if has_letter(x)], np.int64)
                if len(rows_):
                    for first, sums in log_scores([texts[i] for i in rows_], matrix, prior):
                        top = sums.argmax(axis=1)
                        high = sums[np.arange(len(rows_)), top]
                        total[rows_] = np.logaddexp(total[rows_], np.logaddexp.reduce(sums, axis=1))
                        for i, t, h in zip(rows_.tolist(), top.tolist(), high.tolist(), strict=True):
                            if pred[i] is None or h > best[i]:
                                pred[i], best[i] = langs[first + t], h
                yield pa.record_batch([*part.columns[:3], pa.array(pred, pa.string()), pa.array(best), pa.array(total)], names=part.schema.names)

    return rows.mapInArrow(score, "doc_id long, held_out boolean, text string, lang_pred string, best double, total double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_cells: int = MOST_CELLS) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score (the posterior probability).

    Learns from the text and lang of rows that are not held out; only the text is used to predict. Null text or none with a
    letter: `und`, score 0; so with no row to learn from. Null lang: not learnt from. Null doc_id: not held out. Repeated rows:
    each by itself. Empty table: empty result. Further columns are not read. More languages than most_cells hold are scored in
    blocks, with the same result; the names of all languages come to the driver.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    none = F.lit(None)
    out = rows.select("doc_id", "held_out", "text", none.cast("string").alias("lang_pred"), none.cast("double").alias("best"), none.cast("double").alias("total"))
    for block in train(rows.where("not held_out and lang is not null and text is not null"), most_cells):
        out = scored(out, docs.sparkSession.sparkContext.broadcast(block))
    sure = F.least(F.lit(1.0), F.exp(F.col("best") - F.col("total")))
    found = F.col("lang_pred").isNotNull()
    return out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(found, sure).otherwise(F.lit(0.0)).alias("score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document."""
    return identify_languages(table(spark, sf_dir, "documents"))
