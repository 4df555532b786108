"""Pages of blocks, made of order lines (a part is a page, its lines are blocks): adverts, drawings, neighbours; texts of titles,
answers and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import pages as P
from factloom.plans.registry import query

TEXT = """CASE l_linenumber % 7 WHEN 0 THEN concat('2N', 3000 + l_suppkey, 'A') WHEN 1 THEN concat('R', l_suppkey % 40) WHEN 2 THEN CASE WHEN l_returnflag = 'R' THEN concat('£', l_suppkey % 9, '.50') ELSE concat(l_suppkey % 9, '.75 ea') END
 WHEN 3 THEN CASE WHEN l_returnflag = 'A' THEN 'The circuit is shown in fig 3 and the output is connected as shown' ELSE 'MAIL ORDER CATALOGUE 35p' END
 WHEN 4 THEN CASE WHEN l_quantity > 25 THEN '12.50' ELSE '4k7' END WHEN 5 THEN CASE WHEN l_tax > 0.05 THEN 'Tel: 57 High Street, London www.x.co.uk' ELSE concat('IC', l_suppkey % 9) END ELSE concat('BC', 100 + l_suppkey % 40, ' 2.30 each') END"""
BLOCKS = f"""(SELECT l_partkey AS page, l_orderkey * 10 + l_linenumber AS block, l_suppkey * 5.0 AS x0, l_suppkey * 5.0 + 10 + l_quantity AS x1, l_linenumber * 40.0 AS y0, l_linenumber * 40.0 + 12 AS y1, 0.75 + l_discount AS conf, {TEXT} AS text FROM lineitem)"""
NAME = "^(2N[0-9]+[A-Z]?|BC[0-9]+)"


def blocks(t):
    number = lambda c: F.col(c).cast("double")
    return t.lineitem.select(
        F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block"), (number("l_suppkey") * 5).alias("x0"), (number("l_suppkey") * 5 + 10 + F.col("l_quantity")).alias("x1"),
        (number("l_linenumber") * 40).alias("y0"), (number("l_linenumber") * 40 + 12).alias("y1"), (F.lit(0.75) + F.col("l_discount")).alias("conf"), F.expr(TEXT).alias("text"),
    )


def duck(p: str) -> str:
    return p.replace("'", "''")


MANY = lambda p: f"len(regexp_extract_all(text, '{duck(p)}'))"
WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
def features_sql(source: str) -> str:
    return f"""(SELECT page, count(*)::BIGINT AS blocks, greatest(sum({WORDS}), 1)::BIGINT AS words, (sum({MANY(P.PRICE)}) + CASE WHEN sum({MANY(P.MONEY_WORDS)}) > 0 THEN sum({MANY(P.WEAK_PRICE)}) ELSE 0 END)::BIGINT AS prices,
 count(*) FILTER (WHERE regexp_matches(trim(text), '{P.BARE_PRICE}'))::BIGINT AS bare_prices, sum({MANY(P.MONEY_WORDS)})::BIGINT AS money_words, sum({MANY(P.ADDRESS)})::BIGINT AS address, sum({MANY(P.CONTACT)})::BIGINT AS contacts, sum({MANY(P.ARTICLE_WORDS)})::BIGINT AS article_words,
 len(list_distinct(flatten(list(regexp_extract_all(text, '{P.DESIGNATOR}')))))::BIGINT AS ref_des, (sum(CASE WHEN {WORDS} >= 8 OR ({WORDS} >= 4 AND regexp_matches(trim(text), '{duck(P.PROSE)}')) THEN {WORDS} ELSE 0 END) / greatest(sum({WORDS}), 1))::DOUBLE AS prose,
 (count(*) FILTER (WHERE length(text) >= 6 AND upper(text) = text AND regexp_matches(text, '[A-Z]')) / count(*))::DOUBLE AS capitals, list_sort(list(x1 - x0))[(count(*) // 2 + 1)::BIGINT]::DOUBLE AS median_width FROM {source} WHERE conf >= {P.SURE} AND trim(text) <> '' GROUP BY page)"""


FEATURES = features_sql(BLOCKS)


@query(f"SELECT page, blocks, words, prices, bare_prices, money_words, address, contacts, article_words, ref_des, round(prose, 6) AS prose, round(capitals, 6) AS capitals, median_width FROM {FEATURES}")
def page_features(t):
    """What makes a page an advert, counted over its sure blocks."""
    return P.page_features(blocks(t)).withColumns({c: F.round(c, 6) for c in ("prose", "capitals")})


NAMED = f"regexp_matches(text, '{NAME}')"
PRICED = f"""(SELECT a.page, count(*)::BIGINT AS priced_rows FROM (SELECT *, regexp_matches(text, '{P.PRICE}') AS priced FROM {BLOCKS}) a WHERE {NAMED} AND (priced OR EXISTS (SELECT 1 FROM {BLOCKS} b WHERE b.page = a.page AND regexp_matches(b.text, '{P.PRICE}')
 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) < 0.6 * greatest(a.y1 - a.y0, 1) AND b.x0 - a.x1 >= 0 AND b.x0 - a.x1 < 180)) GROUP BY 1)"""


@query(f"SELECT * FROM {PRICED}")
def priced_rows(t):
    """Names with a price, in one block or right of it on the line."""
    return P.priced_rows(blocks(t), F.col("text").rlike(NAME), 600.0)


FORM = "^([^0-9]*[0-9]?[^0-9]+)([0-9]{2,5})[A-Z]{0,3}$"
PARTS = f"(SELECT DISTINCT page, regexp_extract(text, '{NAME}', 1) AS part FROM {BLOCKS} WHERE {NAMED})"
RUNS = f"""(WITH n AS (SELECT DISTINCT page, regexp_extract(part, '{FORM}', 1) AS stem, regexp_extract(part, '{FORM}', 2)::INTEGER AS n FROM {PARTS} WHERE regexp_matches(part, '{FORM}')),
 k AS (SELECT page, EXISTS (SELECT 1 FROM n b WHERE b.page = a.page AND b.stem = a.stem AND b.n <> a.n AND abs(b.n - a.n) <= 3) AS near FROM n a) SELECT page, CASE WHEN count(*) >= 6 THEN count(*) FILTER (WHERE near) / count(*) ELSE 0.0 END::DOUBLE AS seq_run FROM k GROUP BY 1)"""


def parts(t):
    return blocks(t).where(F.col("text").rlike(NAME)).select("page", F.regexp_extract("text", NAME, 1).alias("part")).distinct()


@query(f"SELECT page, round(seq_run, 6) AS seq_run FROM {RUNS}")
def catalogue_runs(t):
    """Share of a page's numbered names whose neighbours in number are on it too."""
    return P.catalogue_run(parts(t)).withColumn("seq_run", F.round("seq_run", 6))


LABELS = f"(SELECT page, count(DISTINCT trim(text)) FILTER (WHERE regexp_matches(trim(text), '{P.SHORT_LABEL}'))::BIGINT AS n_desig, count(*) FILTER (WHERE regexp_matches(trim(text), '{P.VALUE_LABEL}'))::BIGINT AS n_values FROM {BLOCKS} GROUP BY 1)"


@query(f"SELECT * FROM {LABELS}")
def label_counts(t):
    """Distinct designators and labels that are values: what a drawing is full of."""
    return P.labels(blocks(t))


JUDGED = f"""(SELECT *, ({P.score_text()})::INTEGER AS score FROM (SELECT f.*, coalesce(p.parts, 0) AS parts, coalesce(priced_rows, 0) AS priced_rows, coalesce(seq_run, 0) AS seq_run, coalesce(n_desig, 0) AS n_desig, coalesce(n_values, 0) AS n_values
 FROM {FEATURES} f LEFT JOIN (SELECT page, count(*) AS parts FROM {PARTS} GROUP BY 1) p USING (page) LEFT JOIN {PRICED} USING (page) LEFT JOIN {RUNS} USING (page) LEFT JOIN {LABELS} USING (page)))"""


def judged(t):
    b = blocks(t)
    counts = parts(t).groupBy("page").agg(F.count(F.lit(1)).alias("parts"))
    return P.scored(P.page_features(b), counts, P.priced_rows(b, F.col("text").rlike(NAME), 600.0), P.catalogue_run(parts(t)), P.labels(b))


@query(f"SELECT page, score, score >= {P.ADVERT} AS advert, (n_desig + n_values >= {P.DRAWING} AND score < {P.ADVERT}) AS drawing FROM {JUDGED}")
def judged_pages(t):
    """Score of every page: an advert, a drawing, or neither."""
    return judged(t).select("page", "score", "advert", "drawing")


@query(f"SELECT (n_desig + n_values >= {P.DRAWING}) AS circuit, count(*)::BIGINT AS pages, count(*) FILTER (WHERE score >= {P.ADVERT})::BIGINT AS adverts, max(score) AS highest, min(score) AS lowest FROM {JUDGED} GROUP BY 1")
def advert_confusion(t):
    """How the score stands to what the labels on a page say."""
    rows = judged(t).groupBy((F.col("n_desig") + F.col("n_values") >= P.DRAWING).alias("circuit"))
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.count_if("advert").alias("adverts"), F.max("score").alias("highest"), F.min("score").alias("lowest"))


#: Documents as pages: every line is a block as wide as it is long.
LINES = "(SELECT doc_id AS page, 0.0 AS x0, length(l)::DOUBLE AS x1, 1.0 AS conf, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))"
DOCUMENTS = f"(SELECT *, ({P.score_text()})::INTEGER AS score FROM (SELECT *, 0 AS parts, 0 AS priced_rows, 0.0 AS seq_run FROM {features_sql(LINES)}))"


def judged_documents(t):
    none = lambda c: F.lit(0).alias(c)
    lines = t.documents.select(F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("text"))
    lines = lines.select("page", "text", F.lit(0.0).alias("x0"), F.length("text").cast("double").alias("x1"), F.lit(1.0).alias("conf"))
    return P.scored(P.page_features(lines).select("*", none("parts"), none("priced_rows"), none("seq_run")))


@query(f"SELECT page AS doc_id, score, score >= {P.ADVERT} AS advert FROM {DOCUMENTS}")
def advert_scores(t):
    """The advert's score of every document."""
    return judged_documents(t).select(F.col("page").alias("doc_id"), "score", "advert")


@query(f"""SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE a AND quality = 0)::BIGINT AS caught, count(*) FILTER (WHERE a AND quality = 1)::BIGINT AS lost,
 round(count(*) FILTER (WHERE a AND quality = 0) / greatest(count(*) FILTER (WHERE a), 1), 4) AS precision, round(count(*) FILTER (WHERE a AND quality = 0) / greatest(count(*) FILTER (WHERE quality = 0), 1), 4) AS recall
 FROM (SELECT page AS doc_id, score >= {P.ADVERT} AS a FROM {DOCUMENTS}) JOIN labels USING (doc_id)""")
def score_against_labels(t):
    """Precision and recall of the score, as if documents of no quality were adverts."""
    rows = judged_documents(t).select(F.col("page").alias("doc_id"), F.col("advert").alias("a")).join(t.labels, "doc_id")
    a, bad = F.col("a"), F.col("quality") == 0
    ratio = lambda x, y: F.round(F.count_if(x) / F.greatest(F.count_if(y), F.lit(1)), 4)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & bad).alias("caught"), F.count_if(a & ~bad).alias("lost"), ratio(a & bad, a).alias("precision"), ratio(a & bad, bad).alias("recall"))


@query(f"""WITH b AS (SELECT page, block, trim(text) AS text, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {BLOCKS}),
 n AS (SELECT a.page, a.block, c.text AS label, c.block AS other, round(sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2), 6) AS d FROM b a JOIN b c ON a.page = c.page AND a.block <> c.block WHERE regexp_matches(a.text, '{NAME}') AND regexp_matches(c.text, '{P.SHORT_LABEL}')),
 k AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY d, label, other) AS place FROM n WHERE d <= 96.0)
 SELECT page, block, string_agg(label, ' ' ORDER BY place) AS near FROM k WHERE place <= 3 GROUP BY 1, 2""")
def near_labels(t):
    """The three nearest designators of every name."""
    return P.near_labels(blocks(t), F.col("text").rlike(NAME), 600.0, 800.0)


@query("""SELECT page_id, regexp_replace(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[-1], '[.][a-z0-9]{1,5}$', '') AS name, regexp_replace(url, '#.*$', '') AS bare,
 concat_ws('|', url, page_id::VARCHAR) || '|' || substr(sha256(concat_ws('|', url, page_id::VARCHAR)), 1, 8) AS key FROM pages""")
def url_names(t):
    """A page's name from its address, the address without its fragment, and a key for caches."""
    return t.pages.select("page_id", N.url_name(F.col("url")).alias("name"), N.without_fragment(F.col("url")).alias("bare"), N.excerpt_key(F.col("url"), F.col("page_id").cast("string")).alias("key"))


@query("SELECT key, split_part(key, '|', 1) AS task, split_part(key, '|', 2) AS model, array_to_string(string_split(key, '|')[3:-2], '|') AS name FROM (SELECT 'read|m' || p_size || '|' || p_name || CASE WHEN p_size % 3 = 0 THEN '|x' ELSE '' END || '|' || p_partkey AS key FROM part)")
def cache_keys(t):
    """A cache key read from both ends: what is between them may hold the sign that parts it."""
    key = F.concat(F.lit("read|m"), "p_size", F.lit("|"), "p_name", F.when(F.col("p_size") % 3 == 0, "|x").otherwise(""), F.lit("|"), "p_partkey")
    pieces = F.split("key", "[|]")
    return t.part.select(key.alias("key")).select("key", pieces[0].alias("task"), pieces[1].alias("model"), F.array_join(F.slice(pieces, F.lit(3), F.size(pieces) - 3), "|").alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN p_name END AS part, CASE WHEN p_size % 4 < 3 AND p_type IN ('SMALL', 'LARGE', 'PROMO') THEN lower(p_type) WHEN p_size % 4 < 3 THEN 'none' END AS kind FROM part""")
def lenient_answers(t):
    """Answers in JSON: one comma too many is forgiven, a kind that is not known is none, what is no JSON is nothing."""
    ending = F.when(F.col("p_size") % 4 == 1, ",}").when(F.col("p_size") % 4 == 3, "").otherwise("}")
    answer = F.concat(F.lit('{"part": "'), "p_name", F.lit('", "kind": "'), F.lower("p_type"), F.lit('"'), ending)
    read = F.from_json(F.regexp_replace("answer", r",\s*([}\]])", "$1"), "part string, kind string")
    rows = t.part.select("p_partkey", answer.alias("answer")).withColumn("whole", F.col("answer").rlike(r"[}]\s*$")).withColumn("read", read)
    kind = F.when(F.col("read.kind").isin("small", "large", "promo"), F.col("read.kind")).otherwise("none")
    return rows.select("p_partkey", F.when(F.col("whole"), F.col("read.part")).alias("part"), F.when(F.col("whole"), kind).alias("kind"))


SIGNED = "concat(p_name, CASE p_size % 3 WHEN 0 THEN ' (drawn by J. Smith)' WHEN 1 THEN ' - thanks to Anna B.' ELSE '' END, ' rev ', p_size)"


@query("SELECT p_partkey, p_name || ' rev ' || p_size AS note FROM part")
def unsigned_notes(t):
    """Notes without the names of persons."""
    return t.part.select("p_partkey", F.regexp_replace(F.expr(SIGNED), r" (\((drawn|made|sent) by [^)]*\)|- thanks to [A-Z][a-z]+( [A-Z][.])?)", "").alias("note"))


@query("""SELECT p_partkey, (CASE p_size % 5 WHEN 0 THEN '4k7' WHEN 1 THEN '100nF' WHEN 2 THEN 'BC' || (100 + p_partkey) WHEN 3 THEN '+12V' ELSE 'CONN-2' END) AS value, (CASE p_size % 5 WHEN 0 THEN 'value' WHEN 1 THEN 'value' WHEN 2 THEN 'part' WHEN 3 THEN 'rail' ELSE 'header' END) AS what FROM part""")
def design_values(t):
    """What a value field of a design says: a value, a rail, a header, or a part. The first shape that fits counts."""
    value = F.expr("CASE p_size % 5 WHEN 0 THEN '4k7' WHEN 1 THEN '100nF' WHEN 2 THEN concat('BC', 100 + p_partkey) WHEN 3 THEN '+12V' ELSE 'CONN-2' END")
    what = F.when(F.col("value").rlike(P.VALUE_LABEL), "value").when(F.col("value").rlike("^[+-]?[0-9]+(V[0-9]?|V)$|^(GND|VCC|VDD)$"), "rail").when(F.col("value").rlike("^(CONN|HDR|PIN)"), "header").when(F.col("value").rlike("^[A-Z]{2,4}[0-9]{2,}[A-Z]?$"), "part").otherwise("none")
    return t.part.select("p_partkey", value.alias("value")).select("p_partkey", "value", what.alias("what"))


@query("""SELECT doc_id, bool_or(words BETWEEN 2 AND 12 AND n <= 110 AND NOT ends AND NOT file) AS title_found, count(*) FILTER (WHERE words BETWEEN 2 AND 12 AND n <= 110 AND NOT ends AND NOT file)::BIGINT AS titles FROM
 (SELECT doc_id, len(list_filter(string_split(l, ' '), lambda w: w <> '')) AS words, length(l) AS n, regexp_matches(l, '[.!?]$') AS ends, regexp_matches(l, '[.](pdf|txt|doc)$') AS file FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1""")
def sheet_titles(t):
    """Lines that may be a sheet's title: some words, not many characters, no sentence and no file's name."""
    line = t.documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    words = F.size(F.filter(F.split("l", " "), lambda w: w != ""))
    good = words.between(2, 12) & (F.length("l") <= 110) & ~F.col("l").rlike("[.!?]$") & ~F.col("l").rlike("[.](pdf|txt|doc)$")
    return line.select("doc_id", good.alias("good")).groupBy("doc_id").agg(F.bool_or("good").alias("title_found"), F.count_if("good").alias("titles"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 IN (1, 4) THEN 'npn' WHEN p_size % 6 = 2 THEN 'pnp' END AS polarity FROM part""")
def polarity_words(t):
    """The polarity that words beside a name give it: exactly one kind, and not of its complement."""
    text = F.expr("concat(p_name, CASE p_size % 6 WHEN 0 THEN ' NPN and PNP pair' WHEN 1 THEN ' silicon NPN' WHEN 2 THEN ' germanium p-n-p' WHEN 3 THEN ' diode' WHEN 4 THEN ' NPN, complement of the PNP type' ELSE ' valve' END)")
    rows = t.part.select("p_partkey", F.regexp_replace(text, "(?i)(complement(ary)? (of|to)|replaces)[^,;.]*", "").alias("x"))
    n, p = F.col("x").rlike(r"(?i)\bn-?p-?n\b"), F.col("x").rlike(r"(?i)\bp-?n-?p\b")
    return rows.select("p_partkey", F.when(n & ~p, "npn").when(p & ~n, "pnp").alias("polarity"))


@query(f"""WITH n AS (SELECT page, (CASE WHEN regexp_matches(text, '^2N') THEN regexp_extract(text, '^(2N[0-9]+A)$', 1) ELSE regexp_extract(text, '^(BC[0-9]+)', 1) END) AS part FROM {BLOCKS} WHERE {NAMED})
 SELECT page, part, 'transistor' AS kind, 'high' AS conf, count(*)::BIGINT AS n FROM n GROUP BY page, part
 UNION ALL SELECT page, 'NE' || f AS part, 'ic' AS kind, 'high' AS conf, count(*)::BIGINT AS n FROM (SELECT page, 5500 + page % 90 AS f FROM {BLOCKS}) WHERE page % 4 = 0 GROUP BY page, f""")
def page_hits(t):
    """Names printed on pages of blocks, by dictionary, census and shape; and an amplifier that the dictionary alone makes sure."""
    from factloom.operators import hits

    known = t.part.where("p_partkey % 4 = 0").select(F.concat(F.lit("NE"), F.lit(5500) + F.col("p_partkey") % 90).alias("name")).distinct()
    known = known.select("name", F.col("name").alias("part"), F.lit("ic").alias("kind"))
    pages = blocks(t).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("b"), F.count(F.lit(1)).alias("k"))
    more = F.when(F.col("page") % 4 == 0, F.transform(F.sequence(F.lit(1), F.col("k")), lambda _: F.concat(F.lit("uses NE"), F.lit(5500) + F.col("page") % 90, F.lit(" inside the unit")))).otherwise(F.array().cast("array<string>"))
    pages = pages.select("page", F.concat(F.transform("b", lambda x: x["text"]), more).alias("texts"))
    found = hits.page_hits(pages, "page", "texts", hits.load(known, None, None))
    return found.select(F.col("id").alias("page"), "part", "kind", "conf", "n")
