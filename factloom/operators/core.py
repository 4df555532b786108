"""Operators over any table with the right columns: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.stored import Steps


def gated(rows: DataFrame, sure: Column, refused: Column, *vouched: Column) -> DataFrame:
    """The publication gate: sure, not refused, and vouched for in one way at least. A plain filter, so it reaches the scan."""
    some = vouched[0]
    for v in vouched[1:]:
        some = some | v
    return rows.where(sure & ~refused & some)


def rolled_up(uses: DataFrame, key: str | list[str], document: str, page: str, source: str) -> DataFrame:
    """Per key: distinct documents and pages, uses, and its sources sorted in one string.

    Rows become one a page, then one a document, then one a key, so no row is expanded for a distinct count; sets of sources
    are as many as there are combinations of them.
    """
    keys = [key] if isinstance(key, str) else key
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    pages = uses.groupBy(*keys, F.col(document).alias("_d"), F.col(page).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(source).alias("s"))
    pages = pages.withColumn("known", (F.col("_d").isNotNull() & F.col("_p").isNotNull()).cast("int"))
    documents = pages.groupBy(*keys, "_d").agg(F.sum("known").alias("pages"), F.sum("n").alias("n"), union("s").alias("s"))
    return documents.groupBy(*keys).agg(
        F.count("_d").alias("documents"), F.sum("pages").alias("pages"), F.sum("n").alias("uses"), F.array_join(F.sort_array(union("s")), " ").alias("sources")
    )


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return first_n(rows, keys, 1, *order)


def first_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark limits each partition's groups before the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their place within the key, from 1, in the order. A range sort over key and order deals a hot key's rows over
    as many partitions as they need; places follow from the counts of the partitions before."""
    steps, ordered = Steps(rows.sparkSession, "ranked"), [f"_o{k}" for k in range(len(order))]
    rows = rows.select("*", *[o.alias(c) for o, c in zip(order, ordered, strict=True)])
    by = [*keys, *ordered]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = steps.next(rows).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # keys + partitions rows
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_part", "_first", before.alias("_before"))
    return rows.join(parts, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_before", *ordered)


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last, length. Numbers are made distinct first."""
    run = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    runs = rows.select(*keys, number).distinct().withColumn("_run", run)
    return runs.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def looked_back(rows: DataFrame, key: str, number: str, value: Column, gap: int) -> Column:
    """Values of the rows whose number is at most gap below, in order."""
    frame = Window.partitionBy(key).orderBy(number).rangeBetween(-gap, -1)
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), value.alias("v"))).over(frame)), lambda x: x["v"])


def copies(rows: DataFrame, checksum: str, *order: Column) -> DataFrame:
    """One row per known checksum: the first in the order, with the number of copies. Both are found before the shuffle, so a
    checksum that very many rows share is one row a task."""
    rest = [c for c in rows.columns if c != checksum]
    known = rows.where(F.col(checksum).isNotNull())
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return known.groupBy(checksum).agg(first.alias("_first"), (F.count(F.lit(1)) - 1).alias("copies")).select(checksum, "_first.*", "copies")


def voted(rows: DataFrame, key: str, value: str, voter: str, margin: int = 3) -> DataFrame:
    """key, value, mine, others: the value that margin times as many distinct voters name as all others."""
    votes = rows.groupBy(key, value).agg(F.countDistinct(voter).alias("mine"))
    votes = votes.withColumn("others", F.sum("mine").over(Window.partitionBy(key)) - F.col("mine"))
    return votes.where(F.col("mine") >= F.col("others") * margin)


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value where all rows of the key agree."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def by_precedence(key: str, *tables: DataFrame) -> DataFrame:
    """Union of (key, value) tables; the first table that names a key wins, within it the least value."""
    ranked = None
    for k, t in enumerate(tables):
        t = t.withColumn("tier", F.lit(k))
        ranked = t if ranked is None else ranked.unionByName(t)
    return ranked.groupBy(key).agg(F.min(F.struct("tier", "value")).alias("_first")).select(key, "_first.tier", "_first.value")


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """child, ancestor, depth (of the shortest way) over (child, parent), whatever the depth; loops end where nothing changes.

    Ways are doubled: after k rounds all of up to 2^k levels are known, so rounds grow with the logarithm of the depth.
    """
    steps = Steps(edges.sparkSession, "closure")
    known = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    known, seen = steps.next(known.withColumn("depth", F.lit(1))), None
    while True:
        state = tuple(known.agg(F.count(F.lit(1)), F.sum("depth")).first())
        if state == seen:
            return known
        seen = state
        up = known.select(F.col("child").alias("_c"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        longer = known.join(up, known["ancestor"] == up["_c"]).select("child", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        known = steps.next(known.union(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))


def searched(names: DataFrame, name: str, query: str) -> DataFrame:
    """names with tier: 0 equal to the query, 1 begins with it, 2 holds it, 3 is itself a beginning of it of four characters or more."""
    from factloom.functions.names import norm

    key, q = norm(F.col(name)), norm(F.lit(query))
    tier = F.when(key == q, 0).when(F.startswith(key, q), 1).when(F.contains(key, q), 2).when((F.length(key) >= 4) & F.startswith(q, key), 3)
    return names.withColumn("tier", tier).where((F.length(q) >= 2) & F.col("tier").isNotNull())


#: Grade letters that may end a name; letters that may stand before a name in a library.
GRADES, PREFIX_LETTERS = "ABCGLRS", "QDJMXUTV"
#: Tails with a digit that are reel codes of distributors.
REEL = "^([A-Z]{1,2}[0-9]{1,2}|T[0-9]{1,2}|[0-9]{0,2}K)$"


def expanded_keys(definitions: DataFrame, name: str, element: str | None = None) -> DataFrame:
    """definitions with key: the normal name, and the name without a letter that a library sets before it: one of the known
    letters where a digit follows (longer than two), or the letter of the definition's own element where a letter follows
    (longer than three)."""
    from factloom.functions.names import norm

    key = norm(F.col(name))
    bare, head, after = F.substring(key, 2, 255), F.substring(key, 1, 1), F.substring(key, 2, 1)
    known = head.rlike(f"[{PREFIX_LETTERS}]") & after.rlike("[0-9]") & (F.length(key) > 2)
    own = (head == F.upper(F.col(element))) & after.rlike("[A-Z]") & (F.length(key) > 3) if element else F.lit(False)
    keys = F.array_distinct(F.array_compact(F.array(key, F.when(known | own, bare))))
    return definitions.withColumn("key", F.explode(keys)).where("key <> ''")


def matched(wanted: DataFrame, keys: DataFrame, tag: str | None = None, least: int = 3) -> DataFrame:
    """part, key, how: 0 equal; 1 the key goes on for one to four characters, not with a digit, and with none at all unless
    they are a reel code or the condition tag (SQL, over key and tail) holds; 2 the part is the key and a grade letter.

    A key stands under itself and under what is left of it without its last one to four characters (least characters at least),
    a part under itself and without its grade; so both joins are equalities on whole names, and no beginning that many names
    share makes pairs that are then thrown away.
    """
    tail = lambda n: F.right("key", F.lit(n))
    plain = lambda t, n: (F.length("key") - n >= least) & ~t.rlike("^[0-9]") & (~t.rlike("[0-9]") | t.rlike(REEL) | (F.expr(tag.replace("tail", f"right(key, {n})")) if tag else F.lit(False)))
    under = [F.struct(F.col("key").alias("part"), F.lit(0).alias("how"))]
    under += [F.when(plain(tail(n), n), F.struct(F.substring(F.col("key"), F.lit(1), F.length("key") - n).alias("part"), F.lit(1).alias("how"))) for n in range(1, 5)]
    rows = keys.select("key", F.explode(F.array_compact(F.array(*under))).alias("u")).select("key", "u.*").where("part <> ''")
    found = wanted.select("part").join(rows, "part").select("part", "key", "how")
    graded = wanted.where(F.col("part").rlike(f"[{GRADES}]$") & (F.length("part") >= 5)).select("part", F.substring(F.col("part"), F.lit(1), F.length("part") - 1).alias("key"))
    return found.union(graded.join(keys.select("key"), "key").select("part", "key", F.lit(2).alias("how")))
