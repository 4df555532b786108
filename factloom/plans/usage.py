"""Uses, documents and parts: the gate, roll-ups, runs and copies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import core
from factloom.plans.registry import query

GATE = "l_returnflag <> 'R' AND l_quantity >= 10 AND (l_discount > 0.05 OR l_tax > 0.04 OR l_linestatus = 'O')"


def gate(rows):
    return core.gated(rows, F.col("l_quantity") >= 10, F.col("l_returnflag") == "R", F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_linestatus") == "O")


@query(f"""SELECT p.p_brand, count(DISTINCT o.o_orderkey)::BIGINT AS documents, count(DISTINCT (o.o_orderkey, l.l_linenumber))::BIGINT AS pages,
 count(*)::BIGINT AS uses, array_to_string(list_sort(list(DISTINCT o.o_orderpriority)), ' ') AS sources
 FROM (SELECT * FROM lineitem WHERE {GATE}) l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
 LEFT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY p.p_brand""")
def part_usage_summary(t):
    joined = gate(t.lineitem).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return core.rolled_up(joined, "p_brand", "o_orderkey", "l_linenumber", "o_orderpriority")


@query(f"SELECT ({GATE}) AS published, l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def gate_counts(t):
    return t.lineitem.groupBy(F.expr(GATE).alias("published"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)
 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def withdrawn_documents(t):
    own = t.orders.where("o_totalprice > 400000").select("o_orderkey")
    parents = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(own, "o_orderkey", "left_anti").join(parents, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_partkey, count(*)::BIGINT AS n, count(*) FILTER (WHERE l_quantity > 40)::BIGINT AS n_label,
 CASE max(CASE l_returnflag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS conf
 FROM lineitem GROUP BY ALL""")
def page_part_summary(t):
    rank = F.when(F.col("l_returnflag") == "N", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 40).alias("n_label"), F.max(rank).alias("r"))
    return rows.select("l_orderkey", "l_partkey", "n", "n_label", F.when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").otherwise("low").alias("conf"))


@query("SELECT l_orderkey, l_linenumber, min(p_name) AS first_part FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def first_part_per_page(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "l_linenumber").agg(F.min("p_name").alias("first_part"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem)
 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) <= 4""")
def first_four_places(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber").distinct()
    return core.first_n(rows, ["l_partkey"], 4, F.col("l_orderkey"), F.col("l_linenumber"))


@query("""SELECT sha256(text) AS sha, min(doc_id) AS survivor, (count(*) - 1)::BIGINT AS copies,
 array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def copy_groups(t):
    rows = t.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("sha"))
    rows = rows.agg(F.min("doc_id").alias("survivor"), (F.count(F.lit(1)) - 1).alias("copies"), F.array_join(F.sort_array(F.collect_set("source")), " ").alias("sources"))
    return rows.where("copies > 0")


@query("""SELECT doc_id, source, n_chars, copies FROM (SELECT doc_id, source, n_chars, (count(*) OVER (PARTITION BY sha256(text)) - 1)::BIGINT AS copies,
 row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1""")
def copy_survivors(t):
    rows = t.documents.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("sha"))
    return core.copies(rows, "sha", F.col("source"), F.col("doc_id")).drop("sha")


@query("SELECT sha256(text) AS sha, count(DISTINCT source)::BIGINT AS sources, count(*)::BIGINT AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def copies_across_sources(t):
    rows = t.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("documents"))
    return rows.where("sources > 1")


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_linenumber AS n FROM lineitem),
 r AS (SELECT *, n - row_number() OVER (PARTITION BY l_partkey ORDER BY n) AS g FROM d)
 SELECT l_partkey, min(n) AS first, max(n) AS last, count(*)::BIGINT AS length FROM r GROUP BY l_partkey, g""")
def page_runs(t):
    return core.islands(t.lineitem, ["l_partkey"], "l_linenumber")


@query("""SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), ' ') AS carried
 FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""")
def carried_turns(t):
    rows = t.conversations.select("conv_id", "turn", "role").distinct()
    carried = F.array_join(core.looked_back(rows, "conv_id", "turn", F.col("role"), 2), " ")
    frame = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, -1)
    return rows.select("conv_id", "turn", F.when(F.count(F.lit(1)).over(frame) > 0, carried).alias("carried"))


@query("SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role, ' ' ORDER BY turn, role) AS chain FROM conversations GROUP BY conv_id")
def chains(t):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(ordered, lambda x: x["role"]), " ").alias("chain"))


@query("SELECT l_partkey, min(year(o_orderdate))::INTEGER AS year, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_document FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey")
def first_seen(t):
    joined = t.lineitem.select("l_partkey", "l_orderkey").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_partkey").agg(F.min(F.year("o_orderdate")).alias("year"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_document"))


@query("""WITH n AS (SELECT o_custkey, count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS none,
 min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS example FROM orders GROUP BY o_custkey)
 SELECT o_custkey, total, round(none / total, 2) AS share, example FROM n WHERE total >= 3 AND none / total >= 0.6""")
def suspects(t):
    none = F.col("o_orderstatus") == "F"
    rows = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(none).alias("none"), F.min(F.when(none, F.col("o_orderkey"))).alias("example"))
    share = F.col("none") / F.col("total")
    return rows.where((F.col("total") >= 3) & (share >= 0.6)).select("o_custkey", "total", F.round(share, 2).alias("share"), "example")


@query("""SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) <= 6""")
def evidence_top_six(t):
    return core.first_n(t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), ["p_brand"], 6, F.desc("n"), F.col("p_type"))


@query("""SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'refused' ELSE 'shown' END AS state, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
 ORDER BY o_totalprice DESC, o_orderkey LIMIT 300""")
def document_page(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    state = F.when(F.col("c_acctbal") < 0, "refused").otherwise("shown")
    return rows.select("o_orderkey", state.alias("state"), "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(300)  # the page's own size


@query("""SELECT l_partkey, sum(l_quantity)::BIGINT AS times, count(DISTINCT l_orderkey)::BIGINT AS documents FROM lineitem
 WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1""")
def wanted_by_usage(t):
    wanted = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(wanted, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("times"), F.countDistinct("l_orderkey").alias("documents"))


@query("""SELECT l_partkey, count(DISTINCT l_orderkey)::BIGINT AS documents FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')
 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5""")
def unsheeted_parts(t):
    sheeted = t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(sheeted, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("documents")).where("documents >= 5")


#: Documents of a part in its record; the rest have further pages of it.
RECORD = 20


@query(f"""WITH g AS (SELECT l_partkey, l_orderkey, sum(l_quantity) AS times, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY ALL),
 r AS (SELECT l_partkey, l_orderkey, o_orderpriority, pages, (row_number() OVER (PARTITION BY l_partkey ORDER BY times DESC, l_orderkey) - 1) // {RECORD} AS sheet,
 row_number() OVER (PARTITION BY l_partkey ORDER BY times DESC, l_orderkey) AS n FROM g JOIN orders ON o_orderkey = l_orderkey)
 SELECT l_partkey AS p_partkey, sheet::INTEGER AS sheet, count(*)::BIGINT AS documents, p_name AS name,
 string_agg(l_orderkey || ':' || o_orderpriority || ':' || array_to_string(pages, ' '), ';' ORDER BY n) AS listed
 FROM r JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, sheet, p_name""")
def nested_part_pages(t):
    """Records of a part: its documents by use, each with its pages in order, RECORD documents a sheet. A hot part has more
    sheets, not a larger record; ranks come from a sort that a hot part's rows go through in partitions of their own size."""
    page = t.lineitem.groupBy("l_partkey", "l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("pages"), F.sum("l_quantity").alias("times"))
    docs = page.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    docs = core.ranked(docs, ["l_partkey"], [-F.col("times"), F.col("l_orderkey")], "n")
    docs = docs.withColumn("sheet", F.floor((F.col("n") - 1) / RECORD).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "l_orderkey", "o_orderpriority", F.array_join("pages", " ")).alias("x"))))
    docs = docs.groupBy("l_partkey", "sheet").agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.transform(listed, lambda x: x["x"]), ";").alias("listed"))
    return docs.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "sheet", "documents", F.col("p_name").alias("name"), "listed")


@query("""SELECT lower(coalesce(s.n, c.n)) AS name, coalesce(s.k, -1) AS supplier, coalesce(c.k, -1) AS customer, greatest(coalesce(s.b, -1e9), coalesce(c.b, -1e9)) AS best
 FROM (SELECT replace(s_name, 'Supplier', 'X') n, s_suppkey k, s_acctbal b FROM supplier) s
 FULL JOIN (SELECT replace(c_name, 'Customer', 'X') n, c_custkey k, c_acctbal b FROM customer) c ON lower(s.n) = lower(c.n)""")
def merged_origins(t):
    s = t.supplier.select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("X"))).alias("name"), F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("a"))
    c = t.customer.select(F.lower(F.replace("c_name", F.lit("Customer"), F.lit("X"))).alias("name"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("b"))
    none = F.lit(-1).cast("bigint")
    return s.join(c, "name", "full_outer").select("name", F.coalesce("supplier", none).alias("supplier"), F.coalesce("customer", none).alias("customer"), F.greatest(F.coalesce("a", F.lit(-1e9)), F.coalesce("b", F.lit(-1e9))).alias("best"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS rows FROM {n}" for n in TABLES))
def manifest(t):
    from factloom.sources.writers import manifest as counted

    return counted({n: getattr(t, n) for n in TABLES})


@query("""SELECT 'line without order' AS problem, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT 'line without part', count(*)::BIGINT FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 'order without customer', count(*)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'nation without region', count(*)::BIGINT FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
 UNION ALL SELECT 'name of two parts', count(*)::BIGINT FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)""")
def constraints(t):
    dangling = lambda what, a, x, b, y: a.select(F.col(x).alias("k")).join(b.select(F.col(y).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("problem"), "n")
    twice = t.part.groupBy("p_name").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("name of two parts").alias("problem"), "n")
    out = dangling("line without order", t.lineitem, "l_orderkey", t.orders, "o_orderkey").union(dangling("line without part", t.lineitem, "l_partkey", t.part, "p_partkey"))
    out = out.union(dangling("order without customer", t.orders, "o_custkey", t.customer, "c_custkey")).union(dangling("nation without region", t.nation, "n_regionkey", t.region, "r_regionkey"))
    return out.union(twice)
