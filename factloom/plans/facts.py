"""Facts fused from several sources: precedence, majority, unanimity, lineage, archives, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import core
from factloom.plans.registry import query


@query("""SELECT p_partkey, coalesce(h.v, d.v, f.v) AS kind, CASE WHEN h.v IS NOT NULL THEN 0 WHEN d.v IS NOT NULL THEN 1 ELSE 2 END AS tier FROM part
 LEFT JOIN (SELECT p_partkey k, 'recipe ' || p_brand v FROM part WHERE p_partkey % 10 = 0) h ON h.k = p_partkey
 LEFT JOIN (SELECT p_partkey k, 'dictionary ' || p_type v FROM part WHERE p_partkey % 3 = 0) d ON d.k = p_partkey
 LEFT JOIN (SELECT p_partkey k, 'family ' || p_size v FROM part) f ON f.k = p_partkey""")
def kind_by_precedence(t):
    tier = lambda where, word, c: t.part.where(where).select("p_partkey", F.concat(F.lit(word + " "), F.col(c).cast("string")).alias("value"))
    rows = core.by_precedence("p_partkey", tier("p_partkey % 10 = 0", "recipe", "p_brand"), tier("p_partkey % 3 = 0", "dictionary", "p_type"), tier("true", "family", "p_size"))
    return rows.select("p_partkey", F.col("value").alias("kind"), "tier")


@query("""WITH RECURSIVE e AS (SELECT 'nation ' || n_nationkey AS child, 'region ' || n_regionkey AS parent FROM nation UNION ALL SELECT 'region ' || r_regionkey, 'world' FROM region
 UNION ALL SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier),
 c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor) SELECT * FROM c""")
def family_lineage(t):
    named = lambda word, c: F.concat(F.lit(word + " "), F.col(c).cast("string"))
    edges = t.nation.select(named("nation", "n_nationkey").alias("child"), named("region", "n_regionkey").alias("parent"))
    edges = edges.union(t.region.select(named("region", "r_regionkey"), F.lit("world"))).union(t.supplier.select(named("supplier", "s_suppkey"), named("nation", "s_nationkey")))
    return core.closure(edges, "child", "parent")


DAYS = "(SELECT concat(user_id, '/', CAST(ts AS DATE)) AS item, event_type, hour(ts) AS voter FROM events)"


@query(f"""WITH v AS (SELECT item, event_type, count(DISTINCT voter)::BIGINT AS mine FROM {DAYS} GROUP BY ALL),
 o AS (SELECT *, (sum(mine) OVER (PARTITION BY item) - mine)::BIGINT AS others FROM v) SELECT * FROM o WHERE mine >= 3 * others""")
def majority_votes(t):
    """For each user and day: the type of event that hours name three times as often as all others."""
    rows = t.events.select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("item"), "event_type", F.hour("ts").alias("voter"))
    return core.voted(rows, "item", "event_type", "voter")


@query("SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def unanimous_status(t):
    return core.unanimous(t.orders, "o_custkey", "o_orderstatus")


@query("SELECT n_nationkey, min(s_suppkey) AS archive FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) = 1")
def only_archive(t):
    rows = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_nationkey")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("archive")).where("n = 1").drop("n")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderkey % 1000 AS s, o_orderkey % 1000 + 5 + o_orderkey % 40 AS e FROM orders), w AS (SELECT DISTINCT user_id AS u, event_id % 1050 AS page FROM events)
 SELECT u, page, min_by(o_orderkey, (e - s, o_orderkey)) AS article FROM w JOIN a ON o_custkey = u AND page BETWEEN s AND e GROUP BY u, page""")
def article_of_page(t):
    start = F.col("o_orderkey") % 1000
    a = t.orders.select("o_orderkey", F.col("o_custkey").alias("u"), start.alias("s"), (start + 5 + F.col("o_orderkey") % 40).alias("e"))
    w = t.events.select(F.col("user_id").alias("u"), (F.col("event_id") % 1050).alias("page")).distinct()
    rows = w.join(a, "u").where(F.col("page").between(F.col("s"), F.col("e")))
    return rows.groupBy("u", "page").agg(F.min_by("o_orderkey", F.struct(F.col("e") - F.col("s"), "o_orderkey")).alias("article"))


@query("""SELECT p_type, bit_or(1::BIGINT << (p_size % 32)::INTEGER) AS bits, count(*) FILTER (WHERE p_size % 32 = 3)::BIGINT AS third FROM part GROUP BY p_type""")
def facet_bits(t):
    bit = F.expr("shiftleft(1L, cast(p_size % 32 as int))")
    rows = t.part.withColumn("bit", bit)
    return rows.groupBy("p_type").agg(F.bit_or("bit").alias("bits"), F.sum(F.col("bit").bitwiseAND(F.lit(8)) / 8).cast("bigint").alias("third"))


@query("""SELECT a.p_partkey, count(b.p_partkey)::BIGINT AS kin FROM part a LEFT JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey GROUP BY 1""")
def kin_of_name(t):
    counts = t.part.groupBy("p_name").agg((F.count(F.lit(1)) - 1).alias("kin"))
    return t.part.join(counts, "p_name").select("p_partkey", "kin")


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*)::BIGINT AS documents, count(DISTINCT o_custkey)::BIGINT AS parents, count(DISTINCT (o_custkey, o_orderpriority))::BIGINT AS sets FROM orders GROUP BY 1")
def coverage_by_year(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("o_custkey").alias("parents"), F.countDistinct("o_custkey", "o_orderpriority").alias("sets"))


@query("""WITH g AS (SELECT p_brand, p_name, count(*)::BIGINT AS members, min(p_size) AS rank FROM part GROUP BY ALL)
 SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY rank, members DESC, p_name) = 1""")
def best_model_group(t):
    rows = t.part.groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("members"), F.min("p_size").alias("rank"))
    return core.first_by(rows, ["p_brand"], F.col("rank"), F.desc("members"), F.col("p_name"))


@query("""SELECT * FROM (SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n, bool_or(l_returnflag = 'N') AS strong FROM lineitem GROUP BY ALL) QUALIFY strong OR NOT bool_or(strong) OVER (PARTITION BY l_partkey)""")
def strong_matches(t):
    from pyspark.sql import Window

    rows = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "N").alias("strong"))
    return rows.withColumn("any", F.bool_or("strong").over(Window.partitionBy("l_partkey"))).where("strong or not any").drop("any")
