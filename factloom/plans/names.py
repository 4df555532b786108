"""Names: keys, ids, search, matching, links and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import core
from factloom.plans.registry import query

#: Names made like those of parts, since the parts table has none.
MADE = "concat('2N', 3000 + p_partkey, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'BU' ELSE '' END)"


def made(t):
    return t.part.select("p_partkey", "p_brand", "p_type", "p_size", F.expr(MADE).alias("name"))


@query("SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS key FROM customer")
def normal_names(t):
    return t.customer.select("c_custkey", N.norm(F.col("c_name")).alias("key"))


@query("SELECT p_partkey, lower(to_base(p_partkey, 36)) AS id FROM part")
def public_ids(t):
    return t.part.select("p_partkey", N.base36(F.col("p_partkey")).alias("id"))


@query("""SELECT name, tier FROM (SELECT s_name AS name, CASE WHEN k = q THEN 0 WHEN starts_with(k, q) THEN 1 WHEN contains(k, q) THEN 2 WHEN length(k) >= 4 AND starts_with(q, k) THEN 3 END AS tier
 FROM (SELECT s_name, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS k, 'SUPPLIER00000000' AS q FROM supplier)) WHERE tier IS NOT NULL""")
def search_tiers(t):
    return core.searched(t.supplier.select(F.col("s_name").alias("name")), "name", "Supplier#00000000").select("name", "tier")


@query(f"""SELECT base, array_to_string(list_sort(list(DISTINCT name)), ' ') AS variants, count(*)::BIGINT AS n
 FROM (SELECT {MADE} AS name, regexp_replace({MADE}, '([0-9])[A-Z]{{1,3}}$', '\\1') AS base FROM part) GROUP BY base""")
def variant_groups(t):
    rows = made(t).withColumn("base", N.base_part(F.col("name")))
    return rows.groupBy("base").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("variants"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT DISTINCT {MADE} AS key FROM part), w AS (SELECT DISTINCT regexp_replace({MADE}, '([0-9])[A-Z]{{1,3}}$', '\\1') AS part FROM part)
 SELECT part, key, CASE WHEN part = key THEN 0 ELSE 1 END AS how FROM w JOIN k ON starts_with(key, part) AND length(key) - length(part) BETWEEN 0 AND 4
 AND NOT regexp_matches(substr(key, length(part) + 1, 1), '[0-9]')
 UNION ALL SELECT part, key, 2 FROM w JOIN k ON starts_with(part, key) AND length(part) = length(key) + 1 AND length(key) >= 4 AND regexp_matches(right(part, 1), '[ABCGLRS]')""")
def prefix_matches(t):
    wanted = made(t).select(N.base_part(F.col("name")).alias("part")).distinct()
    return core.matched(wanted, made(t).select(F.col("name").alias("key")).distinct())


@query(f"""WITH k AS (SELECT {MADE} AS name, p_partkey FROM part), c AS (SELECT p_partkey, name, concat('2N', 3000 + (p_partkey * 7) % 2500) AS alias, concat('2N', 3000 + (p_partkey * 11) % 2500) AS stand_in FROM k),
 f AS (SELECT c.p_partkey, 1 AS tier, k.name AS found FROM c JOIN k ON k.name = c.alias UNION ALL SELECT c.p_partkey, 2, k.name FROM c JOIN k ON k.name = c.stand_in)
 SELECT p_partkey, tier, found FROM f QUALIFY tier = min(tier) OVER (PARTITION BY p_partkey)""")
def alias_or_stand_in(t):
    k = made(t).select(F.col("name").alias("found"))
    named = lambda m: F.concat(F.lit("2N"), F.lit(3000) + (F.col("p_partkey") * m) % 2500)
    alias = t.part.select("p_partkey", named(7).alias("found")).join(k, "found").withColumn("tier", F.lit(1))
    stand_in = t.part.select("p_partkey", named(11).alias("found")).join(k, "found").withColumn("tier", F.lit(2))
    stand_in = stand_in.join(alias.select("p_partkey"), "p_partkey", "left_anti")
    return alias.unionByName(stand_in).select("p_partkey", "tier", "found")


@query(f"""SELECT name, regexp_extract(name, '^([0-9])([A-Z])([0-9]+)([A-Z]*)$', 1) AS junctions, regexp_extract(name, '^([0-9])([A-Z])([0-9]+)([A-Z]*)$', 2) AS scheme,
 regexp_extract(name, '^([0-9])([A-Z])([0-9]+)([A-Z]*)$', 3)::INTEGER AS serial, regexp_extract(name, '^([0-9])([A-Z])([0-9]+)([A-Z]*)$', 4) AS suffix FROM (SELECT {MADE} AS name FROM part)""")
def scheme_decoded(t):
    piece = lambda k: F.regexp_extract("name", "^([0-9])([A-Z])([0-9]+)([A-Z]*)$", k)
    return made(t).select("name", piece(1).alias("junctions"), piece(2).alias("scheme"), piece(3).cast("int").alias("serial"), piece(4).alias("suffix"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '{url}#page={n}' ELSE '{url}/page/n{leaf}/' END AS tpl, 'http://x/' || l_orderkey AS url FROM lineitem),
 f AS (SELECT *, coalesce(replace(replace(replace(tpl, '{url}', url), '{n}', l_linenumber::VARCHAR), '{leaf}', (l_linenumber - 1 + 12)::VARCHAR), url) AS link FROM l)
 SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN contains(link, '#page=') THEN link || '&zoom=200,' || round_even(greatest(0.0, l_quantity * 15 / 1000 - 0.06) * 612, 0)::BIGINT || ',' || round_even(greatest(0.0, l_quantity * 9 / 1000 - 0.06) * 792, 0)::BIGINT || '&h=792' ELSE link END AS link FROM f""")
def page_links(t):
    template = F.when(F.col("l_linenumber") % 3 == 1, "{url}#page={n}").when(F.col("l_linenumber") % 3 == 2, "{url}/page/n{leaf}/")
    link = N.page_link(template, F.concat(F.lit("http://x/"), F.col("l_orderkey")), F.col("l_linenumber"), F.lit(12))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", N.zoomed(link, F.col("l_quantity") * 15, F.col("l_quantity") * 9, F.lit(612.0), F.lit(792.0)).alias("link"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages""")
def url_parts(t):
    return t.pages.select("page_id", N.host(F.col("url")).alias("host"), N.url_path(F.col("url")).alias("path"), F.regexp_extract("url", "\\?([^#]*)", 1).alias("query"))


@query("""SELECT page_id, len(list_filter(string_split(path, '/'), lambda x: x <> '')) - len(list_distinct(list_filter(string_split(path, '/'), lambda x: x <> ''))) >= 2 AS circles
 FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def path_circles(t):
    segments = F.filter(F.split(N.url_path(F.col("url")), "/"), lambda x: x != "")
    return t.pages.select("page_id", (F.size(segments) - F.size(F.array_distinct(segments)) >= 2).alias("circles"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, url FROM pages), d AS (SELECT DISTINCT host, 'http://' || host || '/' || s AS prefix FROM p, (SELECT unnest(['', 'fr', 'en', 'de', 'fr/8']) AS s))
 SELECT page_id, max_by(prefix, length(prefix)) AS credited FROM p JOIN d ON d.host = p.host AND starts_with(p.url, d.prefix) GROUP BY page_id""")
def longest_prefix(t):
    p = t.pages.select("page_id", "url", N.host(F.col("url")).alias("host"))
    d = p.select("host").distinct().select("host", F.explode(F.array(*map(F.lit, ("", "fr", "en", "de", "fr/8")))).alias("s")).select("host", F.concat(F.lit("http://"), "host", F.lit("/"), "s").alias("prefix"))
    return p.join(d, "host").where(F.startswith("url", F.col("prefix"))).groupBy("page_id").agg(F.max_by("prefix", F.length("prefix")).alias("credited"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'http://' || h) THEN substr(url, length('http://' || h) + 1) ELSE url END AS short FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)""")
def short_links(t):
    return t.pages.select("page_id", N.short_link(F.col("url"), F.concat(F.lit("http://"), N.host(F.col("url")))).alias("short"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(upper(trim(n)), '^-+', ''), '(-[A-Z]{2,3}|S)$', '') AS name FROM (SELECT p_partkey, '-' || p_name || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '-ND' ELSE '' END AS n FROM part)""")
def canonical_names(t):
    printed = F.concat(F.lit("-"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "-ND").otherwise(""))
    return t.part.select("p_partkey", N.canonical(printed).alias("name"))


@query("SELECT DISTINCT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer")
def vocabulary(t):
    return t.part.select(F.col("p_name").alias("name")).union(t.supplier.select("s_name")).union(t.customer.select("c_name")).distinct()


@query("SELECT DISTINCT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def known_parts(t):
    return t.lineitem.select("l_partkey").intersect(t.part.where("p_size < 10").select("p_partkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def uncredited_parts(t):
    return t.part.select("p_partkey").subtract(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("""SELECT min(doc) AS doc, url FROM (SELECT doc_id AS doc, source AS url FROM documents UNION ALL SELECT 100000 + page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages) GROUP BY url""")
def first_sheet_of_each_link(t):
    rows = t.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("url")).union(t.pages.select(F.lit(100000) + F.col("page_id"), N.host(F.col("url"))))
    return rows.groupBy("url").agg(F.min("doc").alias("doc"))
