"""Upserts and logs over the driver's tables; pages in HTML; names of scans; trees of repositories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources import files, readers, writers


@query("SELECT o_custkey, o_orderstatus, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1, 2")
def last_lines(t):
    """The last line of each key of a log."""
    log = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("n"))
    return writers.last_lines(log, ["o_custkey", "o_orderstatus"], "n").drop("n")


@query("""WITH a AS (SELECT p_partkey AS name, p_type AS verdict, CASE WHEN p_size % 3 = 0 THEN 'anna' ELSE 'gpt-x' END AS judged_by FROM part WHERE p_size > 10), b AS (SELECT p_partkey AS name, p_brand AS verdict, 'gpt-y' AS judged_by FROM part WHERE p_size < 40)
 SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL OR a.judged_by = 'anna' THEN a.verdict ELSE b.verdict END AS verdict, CASE WHEN b.name IS NULL OR a.judged_by = 'anna' THEN a.judged_by ELSE b.judged_by END AS judged_by FROM a FULL JOIN b ON a.name = b.name""")
def judged_by_hand(t):
    """Verdicts of a machine over older ones, but never over a person's."""
    old = t.part.where("p_size > 10").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("verdict"), F.when(F.col("p_size") % 3 == 0, "anna").otherwise("gpt-x").alias("judged_by"))
    new = t.part.where("p_size < 40").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("verdict"), F.lit("gpt-y").alias("judged_by"))
    return writers.upserted_by_hand(old, new, "name", "judged_by")


@query("""WITH a AS (SELECT url FROM pages WHERE page_id % 2 = 0), b AS (SELECT url || '#n' || page_id AS url FROM pages) SELECT url FROM a UNION ALL SELECT min(url) FROM b WHERE regexp_replace(url, '#.*$', '') NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM a) GROUP BY regexp_replace(url, '#.*$', '')""")
def appended_new(t):
    """A list of addresses with those of another that it does not hold, fragments aside."""
    old = t.pages.where("page_id % 2 = 0").select("url")  # the older list; the newer one holds all
    new = t.pages.select(F.concat("url", F.lit("#n"), "page_id").alias("url"))
    return writers.appended_new(old, new, F.regexp_replace("url", "#.*$", ""))


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS cards, CASE WHEN p_size > 30 THEN p_name END AS bench FROM part WHERE p_size < 45),
 b AS (SELECT p_partkey, p_size > 20 AS puts, CASE WHEN p_size < 25 THEN p_type END AS bench FROM part WHERE p_size % 2 = 0),
 m AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.p_partkey IS NULL AS fresh, cards, a.bench AS old, CASE WHEN b.puts THEN b.bench ELSE a.bench END AS bench FROM a FULL JOIN b ON a.p_partkey = b.p_partkey)
 SELECT p_partkey, cards, bench, CASE WHEN cards IS NULL AND bench IS NULL THEN 'gone' WHEN fresh THEN 'new' WHEN old IS NOT DISTINCT FROM bench THEN 'unchanged' ELSE 'changed' END AS state FROM m""")
def sections_upserted(t):
    """Records by sections: a batch puts some in and takes some out."""
    entry = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("key"), value.alias("value")))
    of = lambda *e: F.map_from_entries(F.array_compact(F.array(*e)))
    size = F.col("p_size")
    old = t.part.where("p_size < 45").select("p_partkey", of(entry("cards", F.col("p_brand"), size > 10), entry("bench", F.col("p_name"), size > 30)).alias("sections"))
    new = t.part.where("p_size % 2 = 0").select("p_partkey", of(entry("bench", F.when(size < 25, F.col("p_type")), size > 20)).alias("sections"))
    rows = writers.sections_upserted(old, new, ["p_partkey"])
    return rows.select("p_partkey", F.col("sections")["cards"].alias("cards"), F.col("sections")["bench"].alias("bench"), "state")


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href="[^"]+"'))::BIGINT AS links, regexp_extract(html, '<a href="([^"]+)"', 1) AS first FROM pages""")
def page_links(t):
    """Links of pages in HTML, read by a parser."""
    pages = t.pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    found = files.links(pages).where("kind = 'link'").groupBy("path").agg(F.count(F.lit(1)).alias("links"), F.min_by("url", "place").alias("first"))
    rows = t.pages.select("page_id").join(found, F.col("page_id") == F.col("path").cast("bigint"), "left")
    return rows.select("page_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", F.lit("")).alias("first"))


SCAN = "CASE p_size % 5 WHEN 0 THEN concat('ww_19', 50 + p_size, '-0', 1 + p_partkey % 9, '_p', p_partkey % 300, '.pdf') WHEN 1 THEN concat('May19', 50 + p_size, '-', p_partkey % 300, '.djvu') WHEN 2 THEN concat(50 + p_size % 40, '13', 10 + p_partkey % 80, '.tif') WHEN 3 THEN concat(50 + p_size % 40, '0', 1 + p_partkey % 9, 10 + p_partkey % 80, '.tif') ELSE p_name END"


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 1900 + 50 + p_size WHEN 1 THEN 1950 + p_size WHEN 3 THEN 1950 + p_size % 40 END::INTEGER AS year, CASE p_size % 5 WHEN 0 THEN 1 + p_partkey % 9 WHEN 1 THEN 5 WHEN 3 THEN 1 + p_partkey % 9 END::INTEGER AS month, CASE p_size % 5 WHEN 0 THEN p_partkey % 300 WHEN 1 THEN p_partkey % 300 WHEN 3 THEN 10 + p_partkey % 80 END::INTEGER AS page FROM part WHERE p_size < 50""")
def scans_named(t):
    """Year, month and page from the names of scans; none where no form fits or the month cannot be."""
    return t.part.where("p_size < 50").select("p_partkey", readers.issue_of(F.expr(SCAN)).alias("i")).select("p_partkey", "i.year", "i.month", "i.page")


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 40 THEN 'o' || p_size ELSE '' END, ''), CASE WHEN p_size > 20 THEN 'b' || p_size || '.png' END, CASE WHEN p_size > 10 THEN 'lazy' END, 's.png') AS image FROM part""")
def best_images(t):
    """The best variant of an image that its tag names."""
    size = F.col("p_size")
    original, sets = F.when(size > 40, F.concat(F.lit("o"), size)).otherwise(""), F.when(size > 20, F.concat(F.lit("a.png 1x, b"), size, F.lit(".png 2x")))
    return t.part.select("p_partkey", readers.best_image(original, sets, F.when(size > 10, "lazy"), F.lit("s.png")).alias("image"))


TREE = "concat('repo', l_suppkey, '/', CASE l_linenumber % 4 WHEN 0 THEN 'board' WHEN 1 THEN 'main' WHEN 2 THEN 'sim' ELSE 'doc' END, l_partkey % 20, CASE WHEN l_returnflag = 'R' THEN '.brd' WHEN l_returnflag = 'A' THEN '.sch' ELSE '.asc' END)"
KEPT = f"(SELECT DISTINCT l_suppkey AS repo, {TREE} AS path FROM lineitem WHERE l_quantity > 30)"


@query(f"""WITH f AS {KEPT}, g AS (SELECT repo, path, regexp_replace(path, '[.][a-z]+$', '') AS stem FROM f WHERE NOT contains(path, '/doc')),
 k AS (SELECT * FROM g WHERE NOT ends_with(path, '.brd') OR stem NOT IN (SELECT stem FROM g WHERE ends_with(path, '.sch'))) SELECT repo, path FROM k QUALIFY count(*) OVER (PARTITION BY repo) <= 120""")
def repository_files(t):
    """Design files of repositories: no documents, boards only where no schematic of their name is, no repository with too many."""
    rows = t.lineitem.where("l_quantity > 30").select(F.col("l_suppkey").alias("repo"), F.expr(TREE).alias("path")).distinct()
    rows = rows.where(~F.contains("path", F.lit("/doc"))).withColumn("stem", F.regexp_replace("path", "[.][a-z]+$", ""))
    sheets = rows.where(F.endswith("path", F.lit(".sch"))).select("stem").distinct()
    boards = rows.where(F.endswith("path", F.lit(".brd"))).join(sheets, "stem", "left_anti").select("repo", "path")
    rows = rows.where(~F.endswith("path", F.lit(".brd"))).select("repo", "path").union(boards)
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("repo"))).where("n <= 120").drop("n")


@query("""WITH s AS (SELECT p_name AS name, p_size AS source, p_partkey FROM part WHERE regexp_matches(p_name, '^(new|hot|red)') UNION ALL SELECT s_name, 99, s_suppkey FROM supplier WHERE s_acctbal > 7000) SELECT name, min_by(p_partkey, (source, p_partkey)) AS first FROM s GROUP BY name ORDER BY name LIMIT 40""")
def seeds(t):
    """Seeds of a search: names of a modern shape and extra ones, each once, the first forty by name."""
    a = t.part.where(F.col("p_name").rlike("^(new|hot|red)")).select(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("source"), F.col("p_partkey").alias("k"))
    b = t.supplier.where("s_acctbal > 7000").select(F.col("s_name"), F.lit(99).cast("long"), F.col("s_suppkey").cast("long"))
    return a.union(b).groupBy("name").agg(F.min_by("k", F.struct("source", "k")).alias("first")).orderBy("name").limit(40)  # the seeds' own number


@query("""SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN regexp_matches(lower(left(text, 512)), '^\\s*<(!doctype html|html)') THEN 'html' WHEN regexp_matches(left(text, 512), '^\\s*<') THEN 'xml' ELSE 'text' END AS kind FROM (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000 + page_id, html FROM pages)""")
def file_kinds(t):
    """What files are by their first bytes."""
    rows = t.documents.select("doc_id", "text").union(t.pages.select(F.lit(1000000) + F.col("page_id"), "html"))
    return rows.select("doc_id", readers.kind_of_bytes(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kind"))
