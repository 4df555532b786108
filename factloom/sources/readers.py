"""Readers with explicit schemas: empty fields are null, a path that is not there is an empty table, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.stored import exists

PAGE = "page int, w double, h double, how string, w_pt double, h_pt double, blocks array<struct<box:array<double>,text:string,conf:double,field:string>>"
DEFINITION = "name string, kind string, type string, pins array<string>, params map<string,string>, parent string, line int, comment string, source string, file string, encrypted boolean, enc_kind string, mfg string"


def _csv(spark: SparkSession, schema: str, encoding: str = "UTF-8"):
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").option("multiLine", True).option("escape", '"').option("comment", "#").option("encoding", encoding)


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; an empty field is null, lines that begin with # are comments, no file is no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return _csv(spark, schema, encoding).csv(path)


def read_sources(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All CSV files of a folder under one another, with the source that each file is named for."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{schema}, source string")
    rows = _csv(spark, schema).option("pathGlobFilter", "*.csv").csv(folder)
    return rows.withColumn("source", F.regexp_extract(F.input_file_name(), "([^/]+)[.]csv$", 1))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records, a (compressed) JSON line each, with the file they came from; blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{PAGE}, file string")
    return spark.read.schema(PAGE).json(path).where("page is not null").withColumn("file", F.input_file_name())


def read_blocks(pages: DataFrame) -> DataFrame:
    """One row for each block that may be read: sure enough for its length, and not empty."""
    rows = pages.select("file", "page", "w", "h", F.posexplode("blocks").alias("at", "block")).select("file", "page", "w", "h", "at", "block.*")
    floor = F.when(F.length("text") <= 4, 0.90).otherwise(0.85)
    return rows.where((F.trim("text") != "") & (F.coalesce("conf", F.lit(1.0)) >= floor))


def read_definitions(spark: SparkSession, path: str, heads: DataFrame | None = None, columns: tuple[str, ...] = ("name", "kind", "type", "parent", "source", "file")) -> DataFrame:
    """Definitions, a JSON line each: only the asked columns are parsed, and with heads (head) only names whose normal form
    begins with one of them (three characters): a semi-join whose small side Spark broadcasts if it is small."""
    fields = {f.split()[0]: f for f in DEFINITION.split(", ")}
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(fields[c] for c in columns))
    rows = spark.read.schema(", ".join(fields[c] for c in columns)).json(path).where("name is not null")
    if heads is None:
        return rows
    head = F.substring(F.regexp_replace(F.upper("name"), "[^A-Z0-9]", ""), 1, 3)
    return rows.withColumn("head", head).join(heads, "head", "left_semi").drop("head")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Documents of configuration in JSON, one a file: name (of the file) and body (text). They are read by Spark, so any store
    will do; what a body means is up to from_json under the caller's schema."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return rows.select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1).alias("name"), F.col("value").alias("body"))


#: Endings and folders that a walk leaves out.
DENIED = r"(?i)([.](png|jpe?g|gif|exe|dll|so|pyc|zip|7z|mp4)$|/([.]git|node_modules|__pycache__)/)"


def walk(spark: SparkSession, folder: str, denied: str = DENIED) -> DataFrame:
    """path, length and content of the files under a folder, without those of the deny list; content is read only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.where(~F.col("path").rlike(denied)).select("path", "length", "content")


class Tables:
    """Tables by path, read again only when the file has changed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def stamp(self, path: str) -> int:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return system.getFileStatus(at).getModificationTime() if system.exists(at) else 0

    def csv(self, path: str, schema: str) -> DataFrame:
        stamp = self.stamp(path)
        known = self.held.get((path, schema))
        if not known or known[0] != stamp:
            if known:
                known[1].unpersist()
                self.spark.catalog.refreshByPath(path)
            known = self.held[path, schema] = (stamp, read_csv(self.spark, path, schema).cache())
        return known[1]


def kind_of_bytes(content: Column) -> Column:
    """What a file is by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.try_to_binary(F.lit(""), F.lit("utf-8")).cast("string")) if content is None else F.lower(F.substring(content, 1, 512).cast("string"))
    begins = lambda *marks: F.greatest(*[F.startswith(head, F.lit(m)) for m in marks], F.lit(False))
    return (
        F.when(F.length(content) == 0, "empty")
        .when(begins("25504446"), "pdf")
        .when(begins("504B0304"), "zip")
        .when(begins("1F8B"), "gzip")
        .when(begins("89504E47"), "png")
        .when(begins("FFD8FF"), "jpeg")
        .when(begins("474946"), "gif")
        .when(begins("41542654"), "djvu")
        .when(text.rlike(r"^\s*<(!doctype html|html)"), "html")
        .when(text.rlike(r"^\s*(<\?xml|<)"), "xml")
        .when(text.rlike(r"(?m)^\s*[.](subckt|model)\b"), "model")
        .when(text.rlike("\x00"), "binary")
        .otherwise("text")
    )


def reading_order(blocks: Column, row: float = 12.0) -> Column:
    """Blocks of a page (structs with y and x) as they are read: by rows of that height, then from left to right."""
    keyed = F.transform(blocks, lambda b: F.struct(F.round(b["y"] / row).alias("_r"), b["x"].alias("_x"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda k: k["b"])


def best_image(original: Column, srcset: Column, lazy: Column, src: Column) -> Column:
    """The best variant that an image's tag names: the file itself, the last of its set, a lazy one, the plain one."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    last = F.split_part(F.trim(F.split_part(srcset, F.lit(","), F.lit(-1))), F.lit(" "), F.lit(1))
    return F.coalesce(some(original), some(F.when(F.trim(srcset) != "", last)), some(lazy), some(src))


#: Months by the first three letters; a file's name as year and month, then issue and page.
MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def issue_of(name: Column) -> Column:
    """(year, month, page) of a scan's name: 1974-05_p12, may1974-12, 740512 (year, month, page); null where no form fits or the
    date cannot be."""
    low = F.lower(name)
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    g = lambda form, k: F.regexp_extract(low, form, k).try_cast("int")
    a, b, c = r"((?:19|20)[0-9]{2})-([0-9]{2})[_-]p?([0-9]{1,3})", r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[_ -]?((?:19|20)[0-9]{2})[_ -]p?([0-9]{1,3})", r"^([0-9]{2})([0-9]{2})([0-9]{2})[.]"
    pick = lambda year, month, page: F.struct(year.alias("year"), month.alias("month"), page.alias("page"))
    found = F.when(low.rlike(a), pick(g(a, 1), g(a, 2), g(a, 3))).when(low.rlike(b), pick(g(b, 2), F.try_element_at(month, F.regexp_extract(low, b, 1)), g(b, 3))).when(low.rlike(c), pick(g(c, 1) + 1900, g(c, 2), g(c, 3)))
    return F.when(found["month"].between(1, 12) & found["year"].between(1900, 2100), found)
