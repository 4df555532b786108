"""Quality rules [native]: measures of each text and the frequency of its lines across the documents of a host.

Main path: DataFrame functions alone. Long work inside one text (words, windows, lines) is done with array functions in
its own row, so nothing but 8-byte line hashes is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, WORD_CHAR, Scratch, let, table, words_of

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def covered_by_repeats(grams: Column, window: int = WINDOW) -> Column:
    """Places covered by windows of which the array of window hashes holds two or more. Sorts the array, in its row."""

    def places(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, places), covered)


def joined_hashes(name: str, step: int) -> Column:
    """Hash of each element with the one `step` after it, for as long as there is one."""
    head = F.slice(F.col(name), F.lit(1), F.greatest(F.size(name) - step, F.lit(0)))
    return F.transform(head, lambda x, i: F.xxhash64(x, F.get(F.col(name), i + step)))


def with_measures(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with the struct _m: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. A null text counts as empty.

    Each step is a projection of its own that is named more than once above, which keeps Catalyst from merging it into
    (and repeating it in) the next; the row number stops filters from being pushed below, which would do the same.
    Windows of eight words are three doublings of 64-bit word hashes. A text whose four-word windows all differ, as in most,
    repeats no eight words and needs no more.
    """
    kept = rows.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.withColumn("_w", words_of(F.col(text_col)))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size("_w").cast("bigint").alias("_n"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("_chars"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    rows = rows.withColumn("_h", joined_hashes("_h", 1))
    rows = rows.withColumn("_h", joined_hashes("_h", 2))
    rows = rows.withColumn("_maybe", F.size(F.array_distinct("_h")) < F.size("_h"))
    repeat = F.when(F.col("_maybe"), let(joined_hashes("_h", 4), covered_by_repeats)).otherwise(F.lit(0).cast("bigint"))
    rows = rows.withColumn("_repeat", repeat)
    measures = F.struct(
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        ((F.col("_n") < MIN_WORDS) | (F.col("_repeat") * 100 > F.col("_n") * MAX_REPEAT_PERCENT)).alias("base_failed"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in kept], measures.alias("_m"), F.monotonically_increasing_id().alias("_at"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def content_key(text: Column) -> Column:
    """Equal for equal texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def host_key(host: Column) -> Column:
    """Equal for equal hosts; the null host is one of its own."""
    return F.xxhash64(host, host.isNull())


def normal_line(line: Column) -> Column:
    """Lower case, white space folded, digits folded to one zero."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")), "[0-9]+", "0")


def line_hash(line: Column, host: Column) -> Column:
    return F.xxhash64(host, host.isNull(), normal_line(line))


def line_table(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """One row for each distinct text of a host: hh, ck, copies (rows that hold it), lines (array of hash h and characters w)."""
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.col(host_col).cast("string")

    def entries(lines: Column) -> Column:
        return F.transform(
            lines,
            lambda x: F.struct(
                line_hash(x, host).alias("h"),
                F.length(x).cast("bigint").alias("w"),
            ),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    rows = docs.select(host_key(host).alias("hh"), content_key(text).alias("ck"), let(lines, entries).alias("lines"))
    return rows.groupBy("hh", "ck").agg(F.count(F.lit(1)).alias("copies"), F.min("lines").alias("lines"))


@dataclass(frozen=True)
class Limits:
    """When a line is above the limits, and a text depleted.

    Above: at least min_line_docs documents of its host hold it, and either line_share of all of the host's, or many_line_docs,
    so that a hot host is held to a count and not to a share of itself. Documents are counted as distinct texts, since a text
    must not sink because it was copied; with distinct_texts false every row counts. Depleted: a text whose other lines hold
    less than min_left of the characters in its lines with words.
    """

    min_line_docs: int = 20
    line_share: float = 0.05
    many_line_docs: int = 1000
    min_left: float = 0.5
    distinct_texts: bool = True


def lossy_texts(docs: DataFrame, scratch: Scratch, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """Of each text with lines above the limits: hh, ck, hashes (of those lines), depleted.

    Line counts are summed before the shuffle, so a line on a third of all documents is one row a task.
    """
    texts = scratch.write(line_table(docs, text_col, host_col), "texts")
    weight = F.lit(1) if limits.distinct_texts else F.col("copies")
    once = texts.select("hh", weight.alias("weight"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = once.groupBy("h", "hh").agg(F.sum("weight").alias("n")).where(F.col("n") >= limits.min_line_docs)
    hosts = texts.groupBy("hh").agg(F.sum(weight).alias("texts"))
    often = (F.col("n") >= F.col("texts") * F.lit(limits.line_share)) | (F.col("n") >= limits.many_line_docs)
    above = counts.join(hosts, "hh").where(often).select("h")
    above = scratch.write(above, "above")  # a table of known size: Spark broadcasts it if it is small, else it shuffles
    lines = texts.select("hh", "ck", F.posexplode("lines").alias("i", "line")).select("hh", "ck", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    lost = lines.join(above, "h").groupBy("hh", "ck").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("hashes"))
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    lossy = lost.join(texts.select("hh", "ck", total.alias("total")), ["hh", "ck"])
    depleted = F.col("total") - F.col("lost") < F.col("total") * F.lit(limits.min_left)
    return lossy.select("hh", "ck", "hashes", depleted.alias("depleted"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Per row of docs: doc_id, the base measures, depleted and kept.

    Null or empty text: no words, base_failed, not kept. Null host: a host of its own. Null or repeated doc_id: each row is
    judged by itself. Equal texts of a host are equally judged. Empty table: empty result. Further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sunk = scratch.write(lossy_texts(docs, scratch, text_col, host_col, limits).where("depleted").select("hh", "ck"), "depleted").withColumn("depleted", F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host_key(F.col(host_col).cast("string")).alias("hh"), content_key(F.col(text_col)).alias("ck"))
    rows = with_measures(rows, "text").select("doc_id", "_m.*", "hh", "ck")
    depleted = F.coalesce(F.col("depleted"), F.lit(False))
    return rows.join(sunk, ["hh", "ck"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", depleted.alias("depleted"), (~F.col("base_failed") & ~depleted).alias("kept")
    )


def keep_good_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that quality_rules keeps, their texts without the lines above the limits; chars_col, if there is one,
    follows. Other columns stay, whatever their names.

    Rows are judged by their whole texts, as by quality_rules, so null and empty texts go; a null host is a host of its own;
    repeated rows are judged alike and all stay; lines without words stay. Empty table: empty result. Base failures go in the scan.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    lossy = scratch.write(lossy_texts(docs, scratch, text_col, host_col, limits), "lossy")
    text, host = F.col(f"_row.`{text_col}`").cast("string"), F.col(f"_row.`{host_col}`").cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    good = with_measures(docs.select(whole, F.col(text_col).alias("_t"), host_key(F.col(host_col).cast("string")).alias("hh"), content_key(F.col(text_col)).alias("ck")), "_t")
    # The row number is named in the filter so that it stays: it keeps the filter above the measures.
    good = good.where(~F.col("_m.base_failed") & (F.col("_at") >= 0)).drop("_t").join(lossy, ["hh", "ck"], "left")
    good = good.where(~F.coalesce(F.col("depleted"), F.lit(False)))
    left = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(WORD_CHAR) & F.array_contains("hashes", line_hash(x, host))))
    good = good.withColumn("_left", F.when(F.col("hashes").isNotNull(), F.array_join(left, "\n")))
    new = {text_col: F.col("_left")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("_left").cast(docs.schema[chars_col].dataType)
    old = lambda c: F.col(f"_row.`{c}`")
    return good.select(*[F.when(F.col("_left").isNotNull(), new[c]).otherwise(old(c)).alias(c) if c in new else old(c).alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: quality_rules over all documents."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("depleted")
