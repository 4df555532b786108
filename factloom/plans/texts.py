"""Texts: page features, advert score, guard patterns, hits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import core
from factloom.plans.registry import query

#: Patterns that both engines read alike (ASCII classes, no look-around).
UPPER, DIGITS, PRICE, ADDRESS = "[A-Z]", "[0-9]+", "[$] ?[0-9]+", "[a-z0-9._]+@[a-z0-9.]+[.][a-z]+"
NEAR_ADDRESS = "[a-z0-9._]@[a-z0-9.]+[.][a-z]+"
SECRET = "(token|password|secret|api_key) ?[=:]"
LOCAL_PATH = "/(home|Users)/[a-z]+"
URL = "https?://[^ ]+"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+'))::BIGINT AS words, len(string_split(text, chr(10)))::BIGINT AS lines,
 len(regexp_extract_all(text, '{UPPER}'))::BIGINT AS uppers, len(regexp_extract_all(text, '{PRICE}'))::BIGINT AS prices FROM documents""")
def text_features(t):
    many = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return t.documents.select("doc_id", many("[^ \\n]+").alias("words"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("lines"), many(UPPER).alias("uppers"), many(PRICE).alias("prices"))


@query(f"""SELECT doc_id, regexp_matches(x, '{SECRET}') AS secret, regexp_matches(x, '{LOCAL_PATH}') AS path, regexp_matches(x, '{ADDRESS}') AS address
 FROM (SELECT doc_id, regexp_replace(text, '{URL}', ' ', 'g') AS x FROM documents)""")
def guard_flags(t):
    """Each pattern is tried only where what it cannot do without is found by a plain search, most texts hold none of it."""
    rows = t.documents.select("doc_id", F.when(F.contains("text", F.lit("://")), F.regexp_replace("text", URL, " ")).otherwise(F.col("text")).alias("x"))
    has = lambda *marks: F.greatest(*[F.contains(F.col("x"), F.lit(m)) for m in marks], F.lit(False))
    flag = lambda pattern, *marks: F.when(F.col("x").isNotNull(), F.when(has(*marks), F.col("x").rlike(pattern)).otherwise(F.lit(False)))
    # An address needs a run of its characters before the sign, but only the last one of them decides: looking from the sign.
    return rows.select("doc_id", flag(SECRET, "token", "password", "secret", "api_key").alias("secret"), flag(LOCAL_PATH, "/home/", "/Users/").alias("path"), flag(NEAR_ADDRESS, "@").alias("address"))


@query(f"""SELECT doc_id, i::INTEGER AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(line, '{SECRET}')""")
def guard_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.col("line").rlike(SECRET)).select("doc_id", (F.col("i") + 1).alias("line_no"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&[a-z]+;', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'), ' -|') AS title,
 len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages""")
def titles_and_links(t):
    title = N.clean_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t.pages.select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("bigint").alias("links"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= 5")
def stratified_sample(t):
    rows = t.documents.select("doc_id", "source", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return core.first_n(rows, ["source"], 5, F.col("h"), F.col("doc_id")).drop("h")


@query("""SELECT l_partkey, count(*)::BIGINT AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey k, l_orderkey o FROM lineitem) b WHERE b.k = a.l_partkey AND b.o <> a.l_orderkey AND abs(b.o - a.l_orderkey) <= 300))::BIGINT AS near
 FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) a GROUP BY l_partkey""")
def numbers_in_runs(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_orderkey")
    rows = t.lineitem.select("l_partkey", "l_orderkey").distinct()
    gap = F.least(F.col("l_orderkey") - F.lag("l_orderkey").over(w), F.lead("l_orderkey").over(w) - F.col("l_orderkey"))
    return rows.withColumn("near", gap <= 300).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("near").alias("near"))


@query("""SELECT DISTINCT doc_id, w AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]*[0-9]+[A-Za-z0-9]*')) AS w FROM documents) WHERE length(w) BETWEEN 3 AND 16""")
def candidate_tokens(t):
    rows = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]*[0-9]+[A-Za-z0-9]*"), 0))).alias("token"))
    return rows.where(F.length("token").between(3, 16))
