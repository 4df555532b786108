"""Names against names: keys, fall-backs, kin, schemes, families; checks of a catalogue; counts of definitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import core
from factloom.plans.names import MADE, made
from factloom.plans.registry import query

#: Names of several schemes, since the parts table has none.
VARIED = """CASE p_size % 6 WHEN 0 THEN concat('2SC', 100 + p_partkey, '-GR') WHEN 1 THEN concat('BC', 100 + p_partkey % 900, 'BTA') WHEN 2 THEN concat('1N', 4000 + p_partkey, 'TR')
 WHEN 3 THEN concat(1 + p_partkey % 12, 'AX', p_partkey % 9) WHEN 4 THEN concat('78', lpad(CAST(p_partkey % 25 AS STRING), 2, '0')) ELSE concat('2SK', 10 + p_partkey) END"""
VARIED_SQL = VARIED.replace("CAST(p_partkey % 25 AS STRING)", "(p_partkey % 25)::VARCHAR")


def varied(t):
    return t.part.select("p_partkey", "p_brand", "p_type", F.expr(VARIED).alias("name"))


LIBRARY = f"CASE p_size % 4 WHEN 0 THEN concat('Q', {MADE}) WHEN 1 THEN concat('d', upper(p_type)) WHEN 2 THEN concat('z', {MADE}) ELSE {MADE} END"


@query(f"""WITH d AS (SELECT p_partkey, regexp_replace(upper({LIBRARY}), '[^A-Z0-9]', '', 'g') AS k, CASE WHEN p_size % 8 = 1 THEN 'D' ELSE 'Q' END AS e FROM part)
 SELECT p_partkey, k AS key FROM d UNION SELECT p_partkey, substr(k, 2) FROM d WHERE (regexp_matches(k, '^[QDJMXUTV][0-9]') AND length(k) > 2) OR (left(k, 1) = e AND regexp_matches(substr(k, 2, 1), '[A-Z]') AND length(k) > 3)""")
def library_keys(t):
    rows = t.part.select("p_partkey", F.expr(LIBRARY).alias("name"), F.when(F.col("p_size") % 8 == 1, "D").otherwise("Q").alias("element"))
    return core.expanded_keys(rows, "name", "element").select("p_partkey", "key")


@query(f"""WITH k AS (SELECT DISTINCT concat('2N', 3000 + s_suppkey * 3) AS known FROM supplier)
 SELECT p_partkey, coalesce(a.known, b.known) AS known, CASE WHEN a.known IS NOT NULL THEN 'exact' WHEN b.known IS NOT NULL THEN 'base' END AS how
 FROM part LEFT JOIN k a ON a.known = {MADE} LEFT JOIN k b ON b.known = regexp_replace({MADE}, '([0-9])[A-Z]{{1,3}}$', '\\1')""")
def exact_or_base(t):
    """The name itself if it is known, else the name without its suffix, else nothing."""
    known = t.supplier.select(F.concat(F.lit("2N"), F.lit(3000) + F.col("s_suppkey") * 3).alias("known")).distinct()
    a, b = known.select(F.col("known").alias("a")), known.select(F.col("known").alias("b"))
    rows = made(t).join(a, F.col("name") == F.col("a"), "left").join(b, N.base_part(F.col("name")) == F.col("b"), "left")
    return rows.select("p_partkey", F.coalesce("a", "b").alias("known"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "base").alias("how"))


@query(f"""WITH k AS (SELECT DISTINCT concat('2N', 3000 + s_suppkey * 3) AS known FROM supplier), v AS (SELECT name, max(verdict) AS verdict FROM (SELECT {MADE} AS name, CASE WHEN p_retailprice > 950 THEN 'component' ELSE 'not a component' END AS verdict FROM part WHERE p_size > 30) GROUP BY 1)
 SELECT p_partkey, k.known IS NOT NULL AS in_dictionary, v.verdict, (k.known IS NULL AND v.verdict IS NULL AND NOT regexp_matches(n.name, '^2N3[0-9]{{3}}$')) AS needs_judging
 FROM (SELECT p_partkey, {MADE} AS name FROM part) n LEFT JOIN k ON k.known = n.name LEFT JOIN v ON v.name = n.name""")
def needs_judging(t):
    """Names that no list knows, nobody has judged, and no strict scheme settles."""
    known = t.supplier.select(F.concat(F.lit("2N"), F.lit(3000) + F.col("s_suppkey") * 3).alias("name")).distinct().withColumn("known", F.lit(True))
    verdict = made(t).join(t.part.select("p_partkey", "p_retailprice"), "p_partkey").where("p_size > 30").groupBy("name").agg(F.max(F.when(F.col("p_retailprice") > 950, "component").otherwise("not a component")).alias("verdict"))
    rows = made(t).join(known, "name", "left").join(verdict, "name", "left")
    in_dictionary = F.coalesce("known", F.lit(False))
    return rows.select("p_partkey", in_dictionary.alias("in_dictionary"), "verdict", (~in_dictionary & F.col("verdict").isNull() & ~F.col("name").rlike("^2N3[0-9]{3}$")).alias("needs_judging"))


@query("""SELECT 'missing' AS problem, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)
 UNION ALL SELECT DISTINCT 'misfiled', o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 20 AND l_shipdate < o_orderdate""")
def manifest_against_ledger(t):
    lines = t.lineitem.where("l_quantity > 20").select("l_orderkey", "l_shipdate")
    missing = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("missing").alias("problem"), F.col("o_orderkey").alias("key"))
    wrong = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate").select(F.lit("misfiled"), "o_orderkey").distinct()
    return missing.union(wrong)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS rule, min(l_suppkey) AS folder FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) = 1)
 SELECT l_orderkey, min(rule) AS rule, min_by(folder, rule) AS folder FROM r GROUP BY 1""")
def folder_proposals(t):
    """The first rule that names one folder and no other."""
    rules = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("rule")).agg(F.min("l_suppkey").alias("folder"), F.max("l_suppkey").alias("_most")).where("folder = _most")
    return rules.groupBy("l_orderkey").agg(F.min("rule").alias("rule"), F.min_by("folder", "rule").alias("folder"))


@query("""WITH m AS (SELECT o_orderkey, o_custkey, l.s AS folder FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem WHERE l_quantity > 30 GROUP BY 1) l ON l_orderkey = o_orderkey),
 v AS (SELECT o_custkey, folder, count(*) AS n FROM m WHERE folder IS NOT NULL GROUP BY 1, 2), w AS (SELECT o_custkey, min_by(folder, (-n, folder)) AS voted FROM v GROUP BY 1)
 SELECT o_orderkey, coalesce(folder, voted) AS folder, CASE WHEN folder IS NOT NULL THEN 'file' WHEN voted IS NOT NULL THEN 'majority' END AS how FROM m LEFT JOIN w USING (o_custkey)""")
def delivered_folders(t):
    """A log row's folder from its own file, else from what most of its siblings' files say; of equal numbers the least."""
    files = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("folder"))
    rows = t.orders.select("o_orderkey", "o_custkey").join(files, "o_orderkey", "left")
    votes = rows.where("folder is not null").groupBy("o_custkey", "folder").count().groupBy("o_custkey").agg(F.min_by("folder", F.struct(-F.col("count"), "folder")).alias("voted"))
    how = F.when(F.col("folder").isNotNull(), "file").when(F.col("voted").isNotNull(), "majority")
    return rows.join(votes, "o_custkey", "left").select("o_orderkey", F.coalesce("folder", "voted").alias("folder"), how.alias("how"))


PEEL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN struct_pack(why := '{w}', name := regexp_extract(x, '{p}', 1))" for w, p in N.KIN_STEPS) + " END"
KIN_SQL = f"""WITH p AS (SELECT p_partkey, {VARIED_SQL} AS name FROM part), a AS (SELECT p_partkey, name, {PEEL.replace('x,', 'name,')} AS s1 FROM p),
 b AS (SELECT *, {PEEL.replace('x,', 's1.name,')} AS s2 FROM a), c AS (SELECT *, {PEEL.replace('x,', 's2.name,')} AS s3 FROM b),
 k AS (SELECT p_partkey, s1.why AS why, s1.name AS kin, 1 AS place FROM a WHERE s1 IS NOT NULL UNION ALL SELECT p_partkey, s2.why, s2.name, 2 FROM b WHERE s2 IS NOT NULL UNION ALL SELECT p_partkey, s3.why, s3.name, 3 FROM c WHERE s3 IS NOT NULL
 UNION ALL SELECT p_partkey, 'envelope', name || e, 10 + i FROM p, (SELECT unnest({list(N.ENVELOPES)}) AS e, unnest(range({len(N.ENVELOPES)})) AS i) WHERE regexp_matches(name, '^[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{1,2}}$')
 {' '.join(f'''UNION ALL SELECT p_partkey, 'maker''s name', m || name, 20 + i FROM p, (SELECT unnest({list(ms)}) AS m, unnest(range({len(ms)})) AS i) WHERE regexp_matches(name, '{p}')''' for p, ms in N.MAKERS)})"""


@query(f"{KIN_SQL} SELECT p_partkey, why, kin FROM k")
def kin_names(t):
    """Other names under which sheets of a part may be filed, and why."""
    return varied(t).select("p_partkey", F.explode(N.kin_names(F.col("name"))).alias("k")).select("p_partkey", "k.why", F.col("k.name").alias("kin"))


@query(f"""{KIN_SQL}, s AS (SELECT concat('BC', 100 + p_partkey % 900) AS name, 'u' || p_size AS url FROM part UNION SELECT concat('1N', 4000 + p_partkey), 'u' || p_size FROM part UNION SELECT concat('LM78', lpad((p_partkey % 25)::VARCHAR, 2, '0')), 'v' || p_size FROM part),
 own AS (SELECT p_partkey, url FROM p JOIN s USING (name))
 SELECT k.p_partkey, url, min_by(kin, place) AS kin FROM k JOIN s ON s.name = k.kin WHERE (k.p_partkey, url) NOT IN (SELECT p_partkey, url FROM own) GROUP BY 1, 2""")
def kin_sheets(t):
    """Sheets of kin that a part has not of its own; one that several kin have is the first's."""
    name = lambda head, number: F.concat(F.lit(head), number.cast("string"))
    url = F.concat(F.lit("u"), F.col("p_size"))
    sheets = t.part.select(name("BC", F.lit(100) + F.col("p_partkey") % 900).alias("sheet"), url.alias("url")).union(t.part.select(name("1N", F.lit(4000) + F.col("p_partkey")), url))
    sheets = sheets.union(t.part.select(F.concat(F.lit("LM78"), F.lpad((F.col("p_partkey") % 25).cast("string"), 2, "0")), F.concat(F.lit("v"), F.col("p_size")))).distinct()
    rows = varied(t).select("p_partkey", "name", F.posexplode(N.kin_names(F.col("name"))).alias("place", "k"))
    found = rows.join(sheets, F.col("k.name") == F.col("sheet")).select("p_partkey", "url", "place", F.col("k.name").alias("kin"))
    own = varied(t).join(sheets, F.col("name") == F.col("sheet")).select("p_partkey", "url")
    return found.join(own, ["p_partkey", "url"], "left_anti").groupBy("p_partkey", "url").agg(F.min_by("kin", "place").alias("kin"))


MEANT = lambda pairs: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
DECODED = " UNION ALL ".join(
    f"SELECT p_partkey, {k} AS o, '{s}' AS scheme, regexp_extract(name, '{f}', 1) AS letter, CASE regexp_extract(name, '{f}', 1) {MEANT(m)} END AS meaning, regexp_extract(name, '{f}', 2)::INTEGER AS serial, regexp_extract(name, '{f}', 3) AS suffix FROM p WHERE regexp_matches(name, '{f}')"
    for k, (s, f, m) in enumerate(N.SCHEMES)
)


@query(f"WITH p AS (SELECT p_partkey, split_part(CASE WHEN p_size % 6 = 1 THEN left({VARIED_SQL}, 6) ELSE {VARIED_SQL} END, '-', 1) AS name FROM part) SELECT p_partkey, scheme, letter, meaning, serial, suffix FROM ({DECODED}) WHERE meaning IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY o) = 1")
def schemes_decoded(t):
    """A name read under the standard that assigned it: its letter's meaning (polarity among it), its serial and suffix."""
    name = F.when(F.length("name") > 7, F.when(F.col("name").startswith("BC"), F.left("name", F.lit(6)))).otherwise(F.lit(None))
    rows = varied(t).withColumn("name", F.split_part(F.coalesce(name, "name"), F.lit("-"), F.lit(1)))
    return rows.select("p_partkey", N.scheme_decoded(F.col("name")).alias("d")).where("d is not null").select("p_partkey", "d.*")


@query(f"""WITH k AS (SELECT DISTINCT concat('2N', 3000 + s_suppkey * 3) AS known FROM supplier UNION SELECT DISTINCT concat('2N', 3000 + s_suppkey * 5, 'B') FROM supplier),
 c AS (SELECT p_partkey, k.known, length(name) - length(k.known) AS dropped FROM (SELECT p_partkey, {MADE} AS name FROM part) JOIN k ON starts_with(name, known) AND length(name) - length(known) <= 3 AND regexp_matches(substr(name, length(known) + 1), '^[A-Z]*$'))
 SELECT p_partkey, min_by(known, dropped) AS nearest, min(dropped)::INTEGER AS dropped FROM c GROUP BY 1""")
def nearest_known(t):
    """The known name that is left when the fewest letters go from a name's end."""
    known = t.supplier.select(F.concat(F.lit("2N"), F.lit(3000) + F.col("s_suppkey") * 3).alias("known")).union(t.supplier.select(F.concat(F.lit("2N"), F.lit(3000) + F.col("s_suppkey") * 5, F.lit("B")))).distinct()
    rows = made(t).select("p_partkey", F.length("name").alias("n"), F.explode(N.shorter_names(F.col("name"))).alias("known")).join(known, "known")
    dropped = F.col("n") - F.length("known")
    return rows.groupBy("p_partkey").agg(F.min_by("known", dropped).alias("nearest"), F.min(dropped).cast("int").alias("dropped"))


LINES = """e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
 c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor)"""


def lineage(t):
    named = lambda word, c: F.concat(F.lit(word), F.col(c).cast("string"))
    edges = t.nation.select(named("n", "n_nationkey").alias("child"), named("r", "n_regionkey").alias("parent"))
    edges = edges.union(t.region.select(named("r", "r_regionkey"), F.lit("world"))).union(t.supplier.select(named("s", "s_suppkey"), named("n", "s_nationkey")))
    return core.closure(edges, "child", "parent")


@query(f"""WITH RECURSIVE {LINES}, d AS (SELECT DISTINCT l_partkey, 's' || l_suppkey AS device FROM lineitem WHERE l_quantity > 48),
 n AS (SELECT l_partkey, count(*) AS devices FROM d GROUP BY 1),
 s AS (SELECT l_partkey, ancestor, count(*) AS held, max(depth) AS far FROM d JOIN c ON c.child = d.device GROUP BY 1, 2)
 SELECT l_partkey, min_by(ancestor, (far, ancestor)) AS family FROM s JOIN n USING (l_partkey) WHERE held = devices GROUP BY 1""")
def nearest_common_family(t):
    """Of the families that all devices of a part descend from, the nearest."""
    devices = t.lineitem.where("l_quantity > 48").select("l_partkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("child")).distinct()
    shared = devices.join(lineage(t), "child").groupBy("l_partkey", "ancestor").agg(F.count(F.lit(1)).alias("held"), F.max("depth").alias("far"))
    all_ = devices.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("devices"))
    return shared.join(all_, "l_partkey").where("held = devices").groupBy("l_partkey").agg(F.min_by("ancestor", F.struct("far", "ancestor")).alias("family"))


@query(f"""WITH RECURSIVE {LINES}, d AS (SELECT DISTINCT l_partkey, 's' || l_suppkey AS device FROM lineitem WHERE l_quantity > 44), f AS (SELECT p_partkey AS l_partkey, 'r' || p_size % 5 AS family FROM part),
 g AS (SELECT d.l_partkey, device, bool_or(coalesce(ancestor = family, false)) AS inside FROM d JOIN f USING (l_partkey) LEFT JOIN c ON c.child = device GROUP BY 1, 2)
 SELECT l_partkey, device FROM g QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY l_partkey)""")
def narrowed_devices(t):
    """Devices of a part that descend from its family; all of them if none does."""
    devices = t.lineitem.where("l_quantity > 44").select("l_partkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("device")).distinct()
    family = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("r"), (F.col("p_size") % 5).cast("string")).alias("family"))
    inside = devices.join(family, "l_partkey").join(lineage(t).select(F.col("child").alias("device"), F.col("ancestor").alias("family")), ["device", "family"], "left_semi").select("l_partkey", "device")
    none = devices.join(inside.select("l_partkey").distinct(), "l_partkey", "left_anti")
    return inside.union(none.select("l_partkey", "device"))


@query("""WITH k AS (SELECT p_partkey, p_type AS kind, CASE WHEN p_size > 40 THEN 'sheet ' || p_brand END AS documented, CASE WHEN p_retailprice > 930 THEN p_type || ' by name' WHEN p_size < 20 THEN 'other by name' END AS named FROM part)
 SELECT p_partkey, coalesce(documented, CASE WHEN starts_with(named, kind) THEN named END, kind) AS family, CASE WHEN documented IS NOT NULL THEN 'documented' WHEN starts_with(named, kind) THEN 'name' ELSE 'kind' END AS basis FROM k""")
def family_by_precedence(t):
    """What a sheet documents, else what the name says if it agrees with the kind, else the kind."""
    documented = F.when(F.col("p_size") > 40, F.concat(F.lit("sheet "), "p_brand"))
    named = F.when(F.col("p_retailprice") > 930, F.concat("p_type", F.lit(" by name"))).when(F.col("p_size") < 20, F.lit("other by name"))
    agrees = F.when(F.startswith(named, F.col("p_type")), named)
    basis = F.when(documented.isNotNull(), "documented").when(agrees.isNotNull(), "name").otherwise("kind")
    return t.part.select("p_partkey", F.coalesce(documented, agrees, "p_type").alias("family"), basis.alias("basis"))


@query("""WITH q AS (SELECT * FROM (VALUES ('SMALL', 'bipolar'), ('LARGE', 'bipolar'), ('PROMO', 'channel'), ('ECONOMY', 'channel'), ('ECONOMY', 'bipolar')) x(p_type, question)),
 c AS (SELECT DISTINCT l_partkey, CASE WHEN l_tax > 0.04 THEN 'bipolar' ELSE 'channel' END AS question, CASE WHEN l_discount > 0.09 THEN 'p' ELSE 'n' END AS answer FROM lineitem WHERE l_quantity > 40)
 SELECT p_partkey, q.question, CASE WHEN count(DISTINCT answer) = 1 THEN min(answer) END AS settled, count(answer)::BIGINT AS claims FROM part JOIN q USING (p_type) LEFT JOIN c ON c.l_partkey = p_partkey AND c.question = q.question GROUP BY 1, 2""")
def polarity_answers(t):
    """The questions that a part's class asks; a question is settled if all who answer it agree."""
    asked = t.spark.createDataFrame([("SMALL", "bipolar"), ("LARGE", "bipolar"), ("PROMO", "channel"), ("ECONOMY", "channel"), ("ECONOMY", "bipolar")], "p_type string, question string")
    claims = t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_tax") > 0.04, "bipolar").otherwise("channel").alias("question"), F.when(F.col("l_discount") > 0.09, "p").otherwise("n").alias("answer")).distinct()
    rows = t.part.join(asked, "p_type").join(claims, ["p_partkey", "question"], "left").groupBy("p_partkey", "question")
    return rows.agg(F.when(F.countDistinct("answer") == 1, F.min("answer")).alias("settled"), F.count("answer").alias("claims"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, (s_suppkey * 7 + 3) % 120 AS parent FROM supplier), up AS (SELECT child, parent AS ancestor FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON e.child = up.ancestor)
 SELECT 'dangling' AS problem, child::VARCHAR AS name FROM e WHERE parent NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT 'loop', child::VARCHAR FROM up WHERE child = ancestor
 UNION ALL SELECT 'two defaults', p_brand FROM part WHERE p_size = 50 GROUP BY p_brand HAVING count(*) > 1
 UNION ALL SELECT 'alias of two', p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 5
 UNION ALL SELECT 'no source', 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def catalogue_faults(t):
    """What a check of the catalogue complains of: broader families that do not exist, loops, two defaults, aliases of several
    things, entries that no source speaks of."""
    edges = t.supplier.select(F.col("s_suppkey").alias("child"), ((F.col("s_suppkey") * 7 + 3) % 120).alias("parent"))
    dangling = edges.join(t.supplier.select(F.col("s_suppkey").alias("parent")), "parent", "left_anti").select(F.lit("dangling").alias("problem"), F.col("child").cast("string").alias("name"))
    loops = core.closure(edges, "child", "parent").where("child = ancestor").select(F.lit("loop"), F.col("child").cast("string"))
    defaults = t.part.where("p_size = 50").groupBy("p_brand").count().where("count > 1").select(F.lit("two defaults"), "p_brand")
    aliases = t.part.groupBy("p_name").agg(F.countDistinct("p_type").alias("n")).where("n > 5").select(F.lit("alias of two"), "p_name")
    unused = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select(F.lit("no source"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return dangling.union(loops).union(defaults).union(aliases).union(unused)


@query("""WITH g AS (SELECT p_name, p_type, count(*)::BIGINT AS models FROM part GROUP BY ALL) SELECT p_name, array_to_string(list_sort(list(p_type)), ' ') AS kinds, min_by(p_type, (-models, p_type)) AS kept, max(models) AS models FROM g GROUP BY 1 HAVING count(*) > 1""")
def recipe_clashes(t):
    """Parts filed under several kinds; the kind with most models is kept."""
    rows = t.part.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("models")).groupBy("p_name")
    rows = rows.agg(F.array_join(F.sort_array(F.collect_set("p_type")), " ").alias("kinds"), F.min_by("p_type", F.struct(-F.col("models"), "p_type")).alias("kept"), F.max("models").alias("models"), F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1").drop("n")


@query("""SELECT p_partkey, u.n AS uses, s.s AS supplier, d.doc AS document, CASE WHEN u.n IS NULL AND s.s IS NULL THEN 'nothing knows it' WHEN u.n IS NULL THEN 'never printed' WHEN s.s IS NULL THEN 'no library has it' WHEN d.doc IS NULL THEN 'no sheet' ELSE 'complete' END AS why
 FROM part LEFT JOIN (SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) u ON u.l_partkey = p_partkey LEFT JOIN (SELECT s_suppkey, min(s_name) AS s FROM supplier GROUP BY 1) s ON s_suppkey = p_partkey % 130 LEFT JOIN (SELECT doc_id, min(doc_id) AS doc FROM documents GROUP BY 1) d ON d.doc_id = p_partkey""")
def explained(t):
    """Why a part yields nothing: what each of several tables has of it."""
    uses = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"))
    library = t.supplier.groupBy(F.col("s_suppkey").alias("k")).agg(F.min("s_name").alias("supplier"))
    sheets = t.documents.select(F.col("doc_id").alias("p_partkey"), F.col("doc_id").alias("document")).distinct()
    rows = t.part.join(uses, "p_partkey", "left").join(library, F.col("p_partkey") % 130 == F.col("k"), "left").join(sheets, "p_partkey", "left")
    no = lambda c: F.col(c).isNull()
    why = F.when(no("uses") & no("supplier"), "nothing knows it").when(no("uses"), "never printed").when(no("supplier"), "no library has it").when(no("document"), "no sheet").otherwise("complete")
    return rows.select("p_partkey", "uses", "supplier", "document", why.alias("why"))


@query("SELECT DISTINCT p_size AS source FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
def unknown_sources(t):
    return t.part.select(F.col("p_size").alias("source")).join(t.nation.select(F.col("n_nationkey").alias("source")), "source", "left_anti").distinct()


@query("""WITH m AS (SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS issue, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
 SELECT year, count(DISTINCT issue)::BIGINT AS issues, count(DISTINCT o_custkey)::BIGINT AS articles, sum(n - 1)::BIGINT AS duplicates, max(size)::BIGINT AS largest, min(size)::BIGINT AS smallest FROM m JOIN (SELECT year, issue, sum(n) AS size FROM m GROUP BY 1, 2) s USING (year, issue) GROUP BY year""")
def coverage_by_issue(t):
    """Coverage of each year from its issues: how many, how large, and what is there twice."""
    entries = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("issue"), "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    issues = entries.groupBy("year", "issue").agg(F.sum("n").alias("size"), F.sum(F.col("n") - 1).alias("again"))
    years = issues.groupBy("year").agg(F.count(F.lit(1)).alias("issues"), F.sum("again").alias("duplicates"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
    articles = entries.select("year", "o_custkey").distinct().groupBy("year").agg(F.count(F.lit(1)).alias("articles"))
    return years.join(articles, "year")


@query("""SELECT l_suppkey, count(*)::BIGINT AS files, sum(n)::BIGINT AS definitions, min(n)::BIGINT AS least, max(last) AS stamped FROM (SELECT l_suppkey, l_orderkey, count(DISTINCT l_partkey) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def definitions_per_source(t):
    """Definitions of each file, credited to the download that it came from."""
    files = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.countDistinct("l_partkey").alias("n"), F.max("l_shipdate").alias("last"))
    return files.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("definitions"), F.min("n").alias("least"), F.max("last").alias("stamped"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS files, sum(n)::BIGINT AS definitions FROM (SELECT o_orderkey, o_orderpriority, (o_orderkey % 7 + 1) AS n FROM orders) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def missing_files(t):
    """Files that the catalogue names and nobody has, by source."""
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("o_orderkey") % 7 + 1).alias("definitions"))


@query("SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS sheets FROM lineitem GROUP BY 1, 2")
def parts_by_source(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("sheets"))


@query(f"SELECT {MADE} AS name FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 30 UNION SELECT p_name FROM part WHERE p_size < 5 UNION SELECT concat('2N', 3000 + s_suppkey) FROM supplier")
def all_names(t):
    """Every name that is used, has a recipe, or is wanted."""
    used = made(t).join(t.lineitem.where("l_quantity > 30"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("name")
    return used.union(t.part.where("p_size < 5").select("p_name")).union(t.supplier.select(F.concat(F.lit("2N"), F.lit(3000) + F.col("s_suppkey")))).distinct()
