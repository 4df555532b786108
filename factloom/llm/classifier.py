"""Quality classifier by co-training.

Two separate views of a document: its text (hashed words, and how the text is made up: lines, symbols, capitals, digits, repeats),
and its page's metadata (source, language, length as the table gives it). Each view has a logistic classifier, calibrated on
labelled documents that no classifier is fitted on. In each round each view scores all documents without a label on the cluster,
and hands those it is sure of, by its calibrated probability, to the other as labels: a view that knows little is never sure. At
the end the calibrated views are weighed against each other on the documents kept out, and all documents are scored.

Counts of words go over all documents, and confident labels are drawn from the scores of all. Only what a classifier is fitted on
is bounded: `labelled` labelled documents, and `drawn` confident ones a round, view and class, the first by a hash; and of
those as many as have `cells` words together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table

BUCKETS = 1 << 15
LABELLED, DRAWN, ROUNDS = 4000, 250, 3
#: Most distinct words of all documents that a fit takes in: it bounds the driver's memory (some 200 MB).
CELLS = 4_000_000
#: Probability from which a view is sure of a document, and what a label that it guesses weighs.
SURE, GUESSED = 0.9, 0.3
#: Words that fewer documents hold weigh nothing.
LEAST_DOCS = 5
METRICS = 12
META = 1 << 10
VIEWS = ("content", "meta")


def metrics(text: Column, words: Column) -> Column:
    """How the text is made up: METRICS numbers between 0 and about 3, from the text and the buckets of its words."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    lines = F.split(text, "\n", -1)
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    return F.array(
        F.lit(1.0),
        F.log10(n) / 3,
        F.log10(count) / 3,
        n / count / 10,
        F.size(lines) / count * 5,
        (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines),
        F.size(F.array_distinct(words)) / count,
        share(r"[#*$%&|<>]") * 10,
        share(r"[!?]") * 10,
        share(r"[A-Z]") * 3,
        share(r"[0-9]") * 5,
        share(r"[.,;:]") * 10,
    )


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str | None) -> DataFrame:
    """doc_id, key (hash of the row), at and n (distinct buckets of the words and their counts: bounded by the buckets, however
    long a text), made (metrics), meta (buckets of source, language and length)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    bucket = lambda kind, c: F.pmod(F.xxhash64(F.lit(kind), c.cast("string"), c.isNull()), F.lit(META)).cast("int")
    source, lang = F.col(f"`{source_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    chars = F.col(f"`{chars_col}`") if chars_col in docs.columns else F.length(text)
    meta = F.array(bucket("source", source), bucket("lang", lang), bucket("chars", F.floor(F.log2(F.greatest(chars, F.lit(0)) + 1))))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t"), meta.alias("meta"))
    own = F.array_remove(F.split(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]+", " "), " ", -1), "")
    rows = rows.withColumn("words", F.transform(own, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    rows = rows.select("doc_id", F.xxhash64("t", F.col("meta")).alias("key"), "words", metrics(F.col("t"), F.col("words")).alias("made"), "meta")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
            both = [np.unique(x, return_counts=True) for x in np.split(words.flatten().to_numpy(), ends[:-1])] if batch.num_rows else []
            at, n = pa.array([a for a, _ in both], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in both], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), at, n, batch.column("made"), batch.column("meta")], names=["doc_id", "key", "at", "n", "made", "meta"])

    return rows.mapInArrow(count, "doc_id long, key long, at array<int>, n array<int>, made array<double>, meta array<int>")


def document_counts(rows: DataFrame) -> np.ndarray:
    """Documents that hold each bucket, over all rows; BUCKETS numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("at").flatten().to_numpy(), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select("at").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


class View:
    """Rows of one view as a sparse matrix: row, column and value, flat."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.row, self.column, self.value, self.rows, self.columns = row, column, value, rows, columns

    def times(self, w: np.ndarray) -> np.ndarray:
        """Logits under weights and bias (last)."""
        return np.bincount(self.row, self.value * w[self.column], self.rows) + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.columns)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def views_of(batch: pa.RecordBatch | pa.Table, rarity: np.ndarray) -> dict[str, View]:
    """content: 1 + log of the counts times the words' rarity, of length one, then the metrics; meta: its buckets."""
    size = batch.num_rows
    (at, row), (n, _), (made, _), (meta, meta_row) = (flat(batch.column(c)) for c in ("at", "n", "made", "meta"))
    x = (1 + np.log(n)) * rarity[at]
    x = x / np.maximum(np.sqrt(np.bincount(row, x * x, size)), 1e-12)[row]
    made_at, made_row = np.tile(BUCKETS + np.arange(METRICS), size), np.repeat(np.arange(size), METRICS)
    content = View(np.concatenate([row, made_row]), np.concatenate([at, made_at]).astype(np.int64), np.concatenate([x, made]), size, BUCKETS + METRICS)
    return {"content": content, "meta": View(meta_row, meta.astype(np.int64), np.ones(len(meta)), size, META)}


def fit(view: View, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = 250, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a logistic classifier with classes of equal weight, by Adam on the whole table."""
    w = np.zeros(view.columns + 1) if start is None else start.copy()
    m, v = np.zeros(len(w)), np.zeros(len(w))
    weight = weight * np.where(y > 0.5, 0.5 / max(weight[y > 0.5].sum(), 1e-9), 0.5 / max(weight[y <= 0.5].sum(), 1e-9))
    for t in range(1, steps + 1):
        r = weight * (sigmoid(view.times(w)) - y)
        g = np.append(view.back(r) + decay * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(columns: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights and bias (last) that turn scores into probabilities, by Newton's method."""
    x, w = np.column_stack([columns, np.ones(len(y))]), np.zeros(columns.shape[1] + 1)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * w)
    return w


def fetched(rows: DataFrame, chosen: DataFrame, cells: int) -> pa.Table:
    """The rows that chosen names (doc_id, key, y; a bounded number), by hash, as far as cells go; y with them."""
    found = rows.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key", "y"])
    size = F.sum(F.size("at")).over(Window.orderBy("o", "doc_id", "key"))
    found = found.withColumn("o", F.xxhash64("doc_id", "key", F.lit(11))).withColumn("upto", size).where(F.col("upto") <= cells)
    return found.orderBy("o", "doc_id", "key").drop("o", "upto").toArrow()


def labelled_rows(rows: DataFrame, marks: DataFrame, labelled: int, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, key and y of at most half of `labelled` rows of each class, the first by a hash; and how many rows each class has."""
    known = scratch.write(rows.select("doc_id", "key").join(marks, "doc_id").distinct(), "known")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "key", F.lit(7)), "doc_id", "key").limit(max(1, labelled // 2)) for y in (0, 1)]
    return scratch.write(first[0].union(first[1]), "chosen"), sizes


def confident(rows: DataFrame, model: dict) -> DataFrame:
    """doc_id, key, view (number of the one that is sure), y, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            views = views_of(batch, m["rarity"])
            for k, name in enumerate(VIEWS):
                p = sigmoid(views[name].times(m[name]) * m["each"][k][0] + m["each"][k][1])
                at = np.flatnonzero((p > SURE) | (p < 1 - SURE))
                yield pa.record_batch([batch.column("doc_id").take(pa.array(at)), batch.column("key").take(pa.array(at)), pa.array(np.full(len(at), k, np.int32)), pa.array((p[at] > 0.5).astype(np.int32))], names=["doc_id", "key", "view", "y"])

    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, key long, view int, y int")


def co_train(rows: DataFrame, marks: DataFrame, labelled: int, drawn: int, rounds: int, cells: int, scratch: Scratch) -> dict | None:
    """The model, from features and marks (doc_id, y); None if a class has no row."""
    chosen, sizes = labelled_rows(rows, marks, labelled, scratch)
    if len(sizes) < 2:
        return None
    sample = fetched(rows, chosen, cells // 2)
    y = sample.column("y").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:  # one class has only texts with more words than cells: their lengths are no reason to give up
        sample = fetched(rows, chosen, 1 << 62)
        y = sample.column("y").to_numpy().astype(np.float64)
    n_docs = rows.count()
    held = document_counts(rows)
    # Words that only a few documents hold cannot tell good from bad; the rest weigh more the rarer they are.
    rarity = np.where(held >= min(LEAST_DOCS, max(1, n_docs // 10)), np.log(n_docs / np.maximum(held, 1)) + 1, 0.0)
    kept_out = np.zeros(len(y), bool)
    for c in (0, 1):
        of = np.flatnonzero(y == c)
        kept_out[of[::4] if len(of) >= 8 else of[:0]] = True  # for calibration; rows come in hashed order
    few = [c for c in (0, 1) if not kept_out[y == c].any()]
    calibrating = kept_out | np.isin(y, few)  # a class of a handful of rows serves for both
    model, guesses = {"rarity": rarity}, {name: [] for name in VIEWS}
    weight = np.array([sizes[int(c)] / (y == c).sum() for c in y])[calibrating]
    weight, sample_views = weight / weight.mean(), views_of(sample.filter(pa.array(calibrating)), rarity)
    for r in range(rounds + 1):
        for name in VIEWS:
            tables, ys, weights = [sample.filter(pa.array(~kept_out)).drop_columns(["y"])], [y[~kept_out]], [np.ones((~kept_out).sum())]
            for t in guesses[name]:
                tables.append(t.drop_columns(["y"]))
                ys.append(t.column("y").to_numpy().astype(np.float64))
                weights.append(np.full(t.num_rows, GUESSED))
            view = views_of(pa.concat_tables(tables), rarity)[name]
            model[name] = fit(view, np.concatenate(ys), np.concatenate(weights), model.get(name), 60 if r else 250)
        raw = np.column_stack([sample_views[name].times(model[name]) for name in VIEWS])
        model["each"] = [calibrate(raw[:, [k]], y[calibrating], weight) for k in range(2)]
        if r == rounds:
            break
        sure = scratch.write(confident(rows, model).join(marks.select("doc_id"), "doc_id", "left_anti"), f"sure{r}")
        for k, name in enumerate(VIEWS):
            order = [F.xxhash64("doc_id", "key", F.lit(r)), "doc_id", "key"]
            picks = [sure.where((F.col("view") == k) & (F.col("y") == c)).orderBy(*order).limit(drawn) for c in (0, 1)]
            found = fetched(rows, scratch.write(picks[0].union(picks[1]).select("doc_id", "key", "y"), f"picks{r}{name}"), cells // (4 * rounds))
            if found.num_rows:
                guesses[VIEWS[1 - k]].append(found)
    logits = np.column_stack([raw[:, k] * model["each"][k][0] + model["each"][k][1] for k in range(2)])
    return model | {"both": calibrate(logits, y[calibrating], weight)}


def scored(rows: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, content_score, meta_score, score, kept."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.full((batch.num_rows, 3), 0.5)
            if m is not None and batch.num_rows:
                views = views_of(batch, m["rarity"])
                logits = np.column_stack([views[name].times(m[name]) * m["each"][k][0] + m["each"][k][1] for k, name in enumerate(VIEWS)])
                out = sigmoid(np.column_stack([logits, logits @ m["both"][:2] + m["both"][2]]))
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(out[:, k]) for k in range(3)], pa.array(out[:, 2] >= 0.5)], names=["doc_id", "content_score", "meta_score", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, content_score double, meta_score double, score double, kept boolean")


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id and y (1: of quality and not toxic) for every document that labels speak of."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str | None = "n_chars",
    labelled: int = LABELLED, drawn: int = DRAWN, rounds: int = ROUNDS, cells: int = CELLS,
) -> DataFrame:
    """Per row of docs: doc_id, content_score, meta_score, score (all 0 to 1), kept (score of a half or more).

    A document is good if a row of labels (doc_id, quality, toxic) calls it of quality and not toxic; several rows for one
    document must all agree on that, and null labels say nothing. Rows that share a labelled doc_id are all learnt from, equal
    ones once. Null text: an empty one. Null doc_id: scored, never learnt from. Without labels of both kinds nothing can be
    learnt: all scores are a half, and all is kept. A class with fewer than eight labelled rows is fitted and calibrated on the
    same rows. Without chars_col the text's length stands for it. Empty table: empty result. Further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    marks = scratch.write(marks_of(labels), "marks")
    rows = scratch.write(features(docs, id_col, text_col, source_col, lang_col, chars_col), "features")
    return scored(rows, co_train(rows, marks, labelled, drawn, rounds, cells, scratch))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the co-trained views."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
