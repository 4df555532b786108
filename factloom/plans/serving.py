"""What a site shows: nested records, orders, pages of lists, facets, listings, and the tables that feed them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import core
from factloom.plans.registry import query

DOC = "l_orderkey"


@query("""SELECT o_orderkey, count(l_linenumber)::BIGINT AS pages, count(*) FILTER (WHERE text IS NULL)::BIGINT AS without_text, string_agg(l_linenumber || ':' || text, ' ' ORDER BY l_linenumber, text) AS texts
 FROM orders JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN l_returnflag END AS text FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1""")
def document_pages(t):
    """The pages of a document with their text; pages without one are counted and left out."""
    text = F.when(F.col("l_quantity") > 5, F.col("l_returnflag"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", text.alias("text")).join(t.orders.select("o_orderkey"), "o_orderkey")
    known = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("l_linenumber", "text"))))
    listed = F.array_join(F.transform(known, lambda x: F.concat_ws(":", x["l_linenumber"], x["text"])), " ")
    rows = rows.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("pages"), F.count_if(F.col("text").isNull()).alias("without_text"), listed.alias("texts"))
    return rows.withColumn("texts", F.when(F.col("texts") != "", F.col("texts")))


@query("""WITH g AS (SELECT p_partkey, p_name, p_size AS docs, p_retailprice AS models FROM part) SELECT p_partkey, row_number() OVER (ORDER BY docs DESC, models DESC, p_name, p_partkey) AS place FROM g""")
def sorted_parts(t):
    """Places in a list: the asked column first, then documents, models and name."""
    order = [-F.col("p_size"), -F.col("p_retailprice"), F.col("p_name"), F.col("p_partkey")]
    return core.ranked(t.part.select("p_partkey", "p_size", "p_retailprice", "p_name", F.lit(0).alias("_all")), ["_all"], order, "place").select("p_partkey", "place")


@query("SELECT p_partkey, p_type FROM part WHERE (1::BIGINT << (p_size % 32)::INTEGER) & ((1::BIGINT << 3) | (1::BIGINT << 7)) <> 0")
def facet_filter(t):
    """Parts with one of the asked bits."""
    bit = F.expr("shiftleft(1L, cast(p_size % 32 as int))")
    return t.part.where(bit.bitwiseAND(F.lit((1 << 3) | (1 << 7))) != 0).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 600 OFFSET 300")
def next_page(t):
    """The page after the first 300: 600 more."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(300).limit(600)  # the pages' own sizes


@query("""WITH d AS (SELECT l_partkey, l_orderkey, sum(l_quantity) AS times, bool_or(l_returnflag = 'R') AS drawing, bool_and(l_linestatus = 'O') AS mention FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY drawing DESC, mention, times DESC, l_orderkey) AS place FROM d""")
def ordered_documents(t):
    """Documents of a part: those with a drawing first, those that only mention it last, by use within."""
    rows = t.lineitem.groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("times"), F.bool_or(F.col("l_returnflag") == "R").alias("drawing"), F.bool_and(F.col("l_linestatus") == "O").alias("mention"))
    return core.ranked(rows, ["l_partkey"], [~F.col("drawing"), F.col("mention"), -F.col("times"), F.col("l_orderkey")], "place").select("l_partkey", "l_orderkey", "place")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey) AS place FROM orders""")
def by_date(t):
    """Documents by date, those without one last, otherwise as they came."""
    dated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return core.ranked(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], [dated.isNull(), dated, F.col("o_orderkey")], "place").select("o_custkey", "o_orderkey", "place")


@query("""WITH s AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN 'moved/' || c_name ELSE c_name END AS name, floor(c_acctbal)::INTEGER AS stars FROM customer WHERE c_mktsegment <> 'MACHINERY')
 SELECT c_nationkey, name, stars, row_number() OVER (PARTITION BY c_nationkey ORDER BY stars DESC, name) AS place FROM s QUALIFY place <= 20""")
def repositories(t):
    """Repositories of a topic by stars and name, at most twenty: gone ones left out, moved ones under their new name."""
    rows = t.customer.where("c_mktsegment <> 'MACHINERY'")
    name = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("moved/"), "c_name")).otherwise(F.col("c_name"))
    rows = rows.select("c_nationkey", name.alias("name"), F.floor("c_acctbal").cast("int").alias("stars"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("stars"), "name"))
    return rows.withColumn("place", place).where("place <= 20")


@query("""WITH g AS (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1) SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM g""")
def grouped_by_source(t):
    """Groups of documents by source, the largest first."""
    groups = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    return core.ranked(groups, ["_all"], [-F.col("n"), F.col("source")], "place").drop("_all")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages WHERE (ends_with(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.org') OR starts_with(url, 'https://')) AND regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) NOT IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages WHERE contains(html, '%%%'))""")
def shown_sources(t):
    """Pages of a kind of source that is shown, or at a trusted address; hosts that are gone are dropped."""
    rows = t.pages.select("page_id", N.host(F.col("url")).alias("host"), "url")
    gone = t.pages.where(F.contains("html", F.lit("%%%"))).select(N.host(F.col("url")).alias("host")).distinct()
    return rows.where(F.endswith("host", F.lit(".org")) | F.startswith("url", F.lit("https://"))).join(gone, "host", "left_anti").select("page_id", "host")


@query("""SELECT page_id, CASE WHEN contains(url, '#/') THEN split_part(url, '#', 1) || '#' || split_part(url, '/', -1) ELSE url END AS key FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '#/home/x/scans/' || page_id || '.pdf' ELSE '' END AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages))""")
def sanitised_keys(t):
    """Keys without the local path that a fragment holds: its file name is kept."""
    url = F.concat(N.without_fragment(F.col("url")), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("#/home/x/scans/"), F.col("page_id"), F.lit(".pdf"))).otherwise(F.lit("")))
    rows = t.pages.select("page_id", url.alias("url"))
    clean = F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("#"), F.split_part("url", F.lit("/"), F.lit(-1)))
    return rows.select("page_id", F.when(F.contains("url", F.lit("#/")), clean).otherwise(F.col("url")).alias("key"))


NEAR = "concat('V', p_size, ' ', p_name, ' R', p_partkey % 300, ' c', p_size, ' C12 IC', p_size, 'a Q4 ', p_brand, ' TR', p_partkey % 50)"


@query(f"SELECT p_partkey, array_to_string(list_filter(string_split({NEAR}, ' '), lambda x: regexp_matches(x, '^[A-Z]{{1,4}}[0-9]{{1,4}}[A-Za-z]?$'))[1:4], ' ') AS near FROM part")
def near_designators(t):
    """The first four designators of what stands near a name, in their order."""
    words = F.filter(F.split(F.expr(NEAR), " "), lambda x: x.rlike("^[A-Z]{1,4}[0-9]{1,4}[A-Za-z]?$"))
    return t.part.select("p_partkey", F.array_join(F.slice(words, 1, 4), " ").alias("near"))


@query("""SELECT l_partkey, string_agg(s_name || '=' || url, ';' ORDER BY s_name, url) AS listings, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_partkey, s_name, 'u' || l_suppkey || '/' || l_linenumber AS url FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 5000 AND l_quantity > 35) GROUP BY 1""")
def catalogue_listings(t):
    """Where publishers of a certain kind list a part."""
    makers = t.supplier.where("s_acctbal > 5000").select("s_suppkey", "s_name")
    rows = t.lineitem.where("l_quantity > 35").join(makers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select("l_partkey", "s_name", F.concat(F.lit("u"), "l_suppkey", F.lit("/"), "l_linenumber").alias("url")).distinct()
    listed = F.array_sort(F.collect_list(F.struct("s_name", "url")))
    return rows.groupBy("l_partkey").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["s_name"], x["url"])), ";").alias("listings"), F.count(F.lit(1)).alias("n"))


MENU = ("N", "A", "R")


@query(f"SELECT l_partkey, array_to_string(list_filter({list(MENU)}, lambda x: list_contains(f, x)), ' ') AS devices FROM (SELECT l_partkey, list(DISTINCT l_returnflag) AS f FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)")
def devices_in_menu_order(t):
    """Kinds that any library gives a part, in the order of the menu."""
    found = t.lineitem.where("l_discount > 0.05").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("f"))
    return found.select("l_partkey", F.array_join(F.filter(F.array(*map(F.lit, MENU)), lambda x: F.array_contains("f", x)), " ").alias("devices"))


@query("SELECT p_partkey, source, claim FROM (SELECT p_partkey, 'library' AS source, unnest(string_split(p_name, ' ')) AS claim FROM part UNION ALL SELECT p_partkey, 'sheet', unnest(string_split(lower(p_type) || ' ' || p_size, ' ')) FROM part WHERE p_size > 20)")
def claims_from_words(t):
    """One row for each word of a list of claims, from every table that makes some."""
    library = t.part.select("p_partkey", F.lit("library").alias("source"), F.explode(F.split("p_name", " ")).alias("claim"))
    sheet = t.part.where("p_size > 20").select("p_partkey", F.lit("sheet"), F.explode(F.split(F.concat(F.lower("p_type"), F.lit(" "), "p_size"), " ")))
    return library.union(sheet)


@query("SELECT 'register' AS source, p_name AS part, p_brand AS maker, NULL::VARCHAR AS stock FROM part WHERE p_size > 30 UNION ALL SELECT 'supplier', s_name, NULL, floor(s_acctbal)::INTEGER::VARCHAR FROM supplier")
def catalogue_facts(t):
    """Tables with different columns under one another."""
    register = t.part.where("p_size > 30").select(F.lit("register").alias("source"), F.col("p_name").alias("part"), F.col("p_brand").alias("maker"))
    return register.unionByName(t.supplier.select(F.lit("supplier").alias("source"), F.col("s_name").alias("part"), F.floor("s_acctbal").cast("int").cast("string").alias("stock")), allowMissingColumns=True)


@query("SELECT p_name AS part, p_partkey AS sheet, '' AS note FROM part UNION ALL SELECT a, p_partkey, 'also ' || p_name FROM (SELECT p_partkey, p_name, unnest(string_split(p_brand || ' ' || p_type, ' ')) AS a FROM part WHERE p_size < 15)")
def archive_sheets(t):
    """Sheets under their own name, and under each name that they are also filed under, with a note."""
    own = t.part.select(F.col("p_name").alias("part"), F.col("p_partkey").alias("sheet"), F.lit("").alias("note"))
    also = t.part.where("p_size < 15").select(F.explode(F.split(F.concat("p_brand", F.lit(" "), "p_type"), " ")), "p_partkey", F.concat(F.lit("also "), "p_name"))
    return own.union(also)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_totalprice > 250000 THEN o_orderpriority || ' rev ' || year(o_orderdate) ELSE o_orderpriority END AS title, CASE WHEN l_quantity > 40 THEN 'own sheet' WHEN l_quantity > 20 THEN 'named on its first page' ELSE 'named inside' END AS evidence
 FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""")
def harvested_covers(t):
    """What sheets cover, with the sheet's title and the words for the evidence; a sheet that nobody holds is unknown."""
    docs = t.orders.where("o_orderstatus <> 'P'")
    rows = t.lineitem.join(docs, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    title = F.when(F.col("o_orderkey").isNull(), "unknown").when(F.col("o_totalprice") > 250000, F.concat("o_orderpriority", F.lit(" rev "), F.year("o_orderdate"))).otherwise(F.col("o_orderpriority"))
    evidence = F.when(F.col("l_quantity") > 40, "own sheet").when(F.col("l_quantity") > 20, "named on its first page").otherwise("named inside")
    return rows.select("l_orderkey", "l_linenumber", title.alias("title"), evidence.alias("evidence"))


@query("SELECT p_name, string_agg(p_brand || '/' || p_size, ' ' ORDER BY p_size, p_brand) AS wanted FROM (SELECT DISTINCT p_name, p_brand, p_size FROM part WHERE p_type = 'PROMO') GROUP BY 1")
def wanted_by_part(t):
    rows = t.part.where("p_type = 'PROMO'").select("p_name", "p_brand", "p_size").distinct()
    listed = F.array_sort(F.collect_list(F.struct("p_size", "p_brand")))
    return rows.groupBy("p_name").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("/", x["p_brand"], x["p_size"])), " ").alias("wanted"))


@query("""SELECT p_partkey, '{' || array_to_string(list_filter([CASE WHEN p_size > 10 THEN '"brand":"' || p_brand || '"' END, CASE WHEN p_type <> 'SMALL' THEN '"kind":"' || p_type || '"' END, CASE WHEN p_size % 2 = 0 THEN '"size":' || p_size END], lambda x: x IS NOT NULL), ',') || '}' AS about FROM part""")
def about_parts(t):
    """What is known of a part as one record; what nothing says is absent."""
    known = F.struct(F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("kind"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    return t.part.select("p_partkey", F.to_json(known).alias("about"))


@query("""SELECT l_partkey, l_orderkey, max_by(l_comment, (l_linenumber, l_comment)) AS line FROM (SELECT *, l_returnflag || l_linestatus || l_linenumber AS l_comment FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1, 2""")
def current_summaries(t):
    """Answers of the current version alone; of several for one place the later one."""
    rows = t.lineitem.where("l_linestatus = 'O'").withColumn("line", F.concat("l_returnflag", "l_linestatus", "l_linenumber"))
    return rows.groupBy("l_partkey", "l_orderkey").agg(F.max_by("line", F.struct("l_linenumber", "line")).alias("line"))


@query("SELECT doc_id, coalesce(url, 'doc/' || doc_id) AS link FROM documents LEFT JOIN (SELECT page_id, min(url) AS url FROM pages GROUP BY 1) ON page_id = doc_id")
def answer_links(t):
    """Answers with the link of their page; without one, that of the document."""
    links = t.pages.groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    return t.documents.select("doc_id").join(links, "doc_id", "left").select("doc_id", F.coalesce("url", F.concat(F.lit("doc/"), "doc_id")).alias("link"))


@query("""SELECT page_id, CASE WHEN contains(url, '/fr/') OR contains(url, '/en/') THEN 'article' ELSE 'page' END AS role, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&[a-z]+;', ' ', 'g')) AS title, regexp_replace(url, '#.*$', '') || CASE WHEN starts_with(url, 'https') THEN '#page={n}' ELSE '' END AS template FROM pages""")
def document_rows(t):
    """A document's row: role, title, public link and the template of its pages' links."""
    role = F.when(F.contains("url", F.lit("/fr/")) | F.contains("url", F.lit("/en/")), "article").otherwise("page")
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "&[a-z]+;", " "))
    template = F.concat(N.without_fragment(F.col("url")), F.when(F.startswith("url", F.lit("https")), "#page={n}").otherwise(""))
    return t.pages.select("page_id", role.alias("role"), title.alias("title"), template.alias("template"))


@query("SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn, text) AS page FROM conversations GROUP BY 1")
def page_texts(t):
    """The text of a page from its blocks in order, each trimmed."""
    blocks = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(blocks, lambda b: F.trim(b["text"])), "\n").alias("page"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 25 THEN l_quantity END, d.w) AS width FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, max(l_quantity) AS w FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) d ON d.k = l_orderkey")
def back_filled_sizes(t):
    """Page sizes, from the document's own where a page has none."""
    own = t.lineitem.where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("w"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("q")).join(own, "l_orderkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("q", "w").alias("width"))


@query("""SELECT url, min(page_id) AS first, row_number() OVER (ORDER BY min(page_id)) AS place FROM (SELECT page_id, regexp_replace(split_part(url, '?', 1), '#.*$', '') AS url FROM pages) GROUP BY 1""")
def url_list(t):
    """A list of addresses without fragments, each once, in the order of their first place."""
    rows = t.pages.select("page_id", N.without_fragment(F.split_part("url", F.lit("?"), F.lit(1))).alias("url")).groupBy("url").agg(F.min("page_id").alias("first"))
    return core.ranked(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col("first")], "place").drop("_all")


@query("""WITH m AS (SELECT DISTINCT s_name AS label, n_name AS parent FROM supplier JOIN nation ON n_nationkey = s_nationkey), n AS (SELECT n_name AS label, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey)
 SELECT m.label, CASE WHEN count(*) = 1 THEN min(n.parent || ' > ' || m.parent || ' > ' || m.label) ELSE '' END AS path FROM m JOIN n ON n.label = m.parent GROUP BY m.label""")
def category_paths(t):
    """A menu's path to each entry; empty where an entry has several places."""
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("label"), F.concat_ws(" > ", "r_name", "n_name", "s_name").alias("p")).distinct()
    return rows.groupBy("label").agg(F.when(F.count(F.lit(1)) == 1, F.min("p")).otherwise("").alias("path"))


@query("""SELECT md5(text) AS digest, min_by(doc_id, (length(source), source, doc_id)) AS kept, array_to_string(list_sort(list(DISTINCT source)), ' ') AS also FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def archived_copies(t):
    """Copies of one file by digest: the one with the shortest address stays, the others are named."""
    rows = t.documents.where("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
    return rows.agg(F.min_by("doc_id", F.struct(F.length("source"), "source", "doc_id")).alias("kept"), F.array_join(F.sort_array(F.collect_set("source")), " ").alias("also"))


@query("""SELECT l_orderkey, min_by(why, (n, why)) AS why FROM (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_discount > 0.08 THEN 'value' WHEN l_tax > 0.07 THEN 'unit' WHEN l_quantity > 47 THEN 'name' END AS why FROM lineitem) WHERE why IS NOT NULL GROUP BY 1""")
def change_kinds(t):
    """Why a record changed: the first reason in its list."""
    why = F.when(F.col("l_discount") > 0.08, "value").when(F.col("l_tax") > 0.07, "unit").when(F.col("l_quantity") > 47, "name")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", why.alias("why")).where("why is not null")
    return rows.groupBy("l_orderkey").agg(F.min_by("why", F.struct("l_linenumber", "why")).alias("why"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS kept FROM orders GROUP BY 1")
def keep_last(t):
    """Of rows with one key the last."""
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("kept"))


@query("""WITH u AS (SELECT 0 AS tier, doc_id AS n, source AS url FROM documents UNION ALL SELECT 1, page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages UNION ALL SELECT 2, s_suppkey, s_name FROM supplier UNION ALL SELECT 3, n_nationkey, n_name FROM nation UNION ALL SELECT 4, p_partkey, p_name FROM part UNION ALL SELECT 5, c_custkey, c_mktsegment FROM customer)
 SELECT url, min(tier)::INTEGER AS tier, min_by(n, (tier, n)) AS first FROM u GROUP BY url""")
def sheet_links(t):
    """Links from six origins, each once: the first origin that names one wins, within it the first place."""
    origins = (t.documents.select("doc_id", "source"), t.pages.select("page_id", N.host(F.col("url"))), t.supplier.select("s_suppkey", "s_name"), t.nation.select("n_nationkey", "n_name"), t.part.select("p_partkey", "p_name"), t.customer.select("c_custkey", "c_mktsegment"))
    out = None
    for k, rows in enumerate(origins):
        rows = rows.toDF("n", "url").select(F.lit(k).alias("tier"), F.col("n").cast("bigint").alias("n"), "url")
        out = rows if out is None else out.union(rows)
    return out.groupBy("url").agg(F.min("tier").alias("tier"), F.min_by("n", F.struct("tier", "n")).alias("first"))


@query("""WITH g AS (SELECT l_suppkey AS holder, l_partkey AS sha, bool_or(l_returnflag = 'R') AS drawing, count(*) FILTER (WHERE l_tax > 0.05) AS deep, count(*) AS pages FROM lineitem GROUP BY 1, 2)
 SELECT sha, min_by(holder, (NOT drawing, -deep, -pages, holder)) AS survivor, (count(*) - 1)::BIGINT AS copies FROM g GROUP BY 1""")
def best_copies(t):
    """Of copies of one file, the one with a drawing, most deep links, most pages, and the least name."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("holder"), F.col("l_partkey").alias("sha")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("drawing"), F.count_if(F.col("l_tax") > 0.05).alias("deep"), F.count(F.lit(1)).alias("pages"))
    best = core.copies(rows, "sha", ~F.col("drawing"), -F.col("deep"), -F.col("pages"), F.col("holder"))
    return best.select("sha", F.col("holder").alias("survivor"), "copies")


@query("""WITH w AS (SELECT p_partkey, p_name, coalesce(u.docs, 0)::BIGINT AS docs FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS docs FROM lineitem WHERE l_quantity > 30 GROUP BY 1) u ON l_partkey = p_partkey WHERE p_name IN (SELECT p_name FROM part WHERE p_type = 'LARGE'))
 SELECT p_partkey, docs, row_number() OVER (ORDER BY docs DESC, p_partkey) AS place FROM w""")
def catalogue_by_usage(t):
    """Entries that an index knows, the most used first."""
    used = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("docs"))
    known = t.part.where("p_type = 'LARGE'").select("p_name").distinct()
    rows = t.part.join(known, "p_name", "left_semi").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("docs", F.lit(0)).alias("docs"), F.lit(0).alias("_all"))
    return core.ranked(rows, ["_all"], [-F.col("docs"), F.col("p_partkey")], "place").drop("_all")


@query("""WITH s AS (SELECT DISTINCT p_name FROM part WHERE p_type = 'ECONOMY' AND p_size > 45) SELECT l_partkey, count(DISTINCT l_orderkey)::BIGINT AS documents FROM lineitem JOIN part ON p_partkey = l_partkey
 WHERE p_name NOT IN (SELECT p_name FROM s) AND split_part(p_name, ' ', 2) NOT IN (SELECT split_part(p_name, ' ', 2) FROM s WHERE starts_with(p_name, 'new')) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5""")
def without_sheet_or_kin(t):
    """Parts of some use that have no sheet, nor kin with one."""
    sheets = t.part.where("p_type = 'ECONOMY' and p_size > 45").select("p_name").distinct()
    kin = sheets.where(F.startswith("p_name", F.lit("new"))).select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("stem")).distinct()
    left = t.part.join(sheets, "p_name", "left_anti").withColumn("stem", F.split_part("p_name", F.lit(" "), F.lit(2))).join(kin, "stem", "left_anti").select(F.col("p_partkey").alias("l_partkey"))
    used = t.lineitem.join(left, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("documents"))
    return used.where("documents >= 5")
