"""Pages made of blocks (page, block, x0, y0, x1, y1, text, conf): what makes a page an advert, a circuit, or a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices as a reader of old print sees them; a price that only counts where money is spoken of; a price alone.
PRICE = r"(?i)([£$€LEf]\s?[0-9]{1,4}[.,][0-9]{2}\b|\b[0-9]{1,4}[.,][0-9]{2}\s*(ea\b|each\b|p\.?p\.?\b|\+\s*vat\b|inc\b)|\b[0-9]{1,3}\s?¢)"
WEAK_PRICE = r"(?i)(\b[0-9]{1,2}/(-|[0-9]{1,2})d?\b|\b[0-9]{1,3}p\b|\b[0-9]{1,3}c\b)"
BARE_PRICE = r"^[£$]?[0-9]{1,3}[.,][0-9]{2}p?$"
#: Words of trade and words of articles.
MONEY = ("p ?& ?p", "post(age| free| paid)", "cash with order", "v[.]?a[.]?t", "mail order", "catalogu?e", "price list", "per (100|10|doz|dozen|pair)", "discount", "callers? welcome", "money back", "bargain", "surplus", "special offer", "clearance", "cheque", "postal order", "credit card", "order form")
ARTICLE = ("fig(ure)?s?[.]? *[0-9]", "circuit (diagram|of|is|shown|operation)", "waveform", "the (circuit|output|input|signal|supply|amplifier|oscillator)", "components? list", "construction", "veroboard", "table [0-9]", "is connected", "in series with", "in parallel with", "feedback", "see fig", "as shown", "next month", "part [0-9]+")
MONEY_WORDS, ARTICLE_WORDS = (r"(?i)\b(" + "|".join(words) + r")\b" for words in (MONEY, ARTICLE))
#: Addresses and telephones; other ways to get in touch; designators of a drawing; values beside them.
ADDRESS = r"(?i)(\btel(ephone)?[.:]\s*[0-9]|\bphone\s*[:(]?\s*[0-9]|\bfax\b|\b(street|road|avenue|lane|estate|works|house)\b,?\s+[A-Z])"
CONTACT = r"(?i)(\b(tel|fax|phone)\b|www\.|\.co\.uk|\.com\b)"
DESIGNATOR = r"\b(R|C|IC|TR|Q|D|VR|SW|L|T)[0-9]{1,3}\b"
SHORT_LABEL = "^([RCLQDVTUPJX][0-9]{1,3}[ABab]?|IC[0-9]{1,3}[A-Da-d]?|TR[0-9]{1,3}|VR[0-9]{1,2}|LED[0-9]{1,2})$"
VALUE_LABEL = "^([0-9]+([.,][0-9]+)? ?(k|K|M|R|u|uF|n|nF|p|pF|mH|uH)|[0-9]+[kKMRunp][0-9]+)$"
PROSE = r"^[A-Za-z(\"'][A-Za-z ,;:'\"()\-]{14,}[a-z.,;:)]$"
#: Confidence from which a block is read for these features.
SURE = 0.8

#: Points of the score: (condition on the features, points); within a group of conditions the first that holds counts.
SCORE = (
    (("prices >= 6", 3), ("prices >= 2", 1)),
    (("money_words >= 3", 3), ("money_words >= 1", 1)),
    (("address >= 1", 1),),
    (("prose < 0.25 AND blocks >= 25", 2),),
    (("article_words >= 4", -3), ("article_words >= 2", -1)),
    (("ref_des >= 5 AND parts <= 40", -3),),
    (("priced_rows >= 5", 3), ("priced_rows >= 2", 1)),
    (("seq_run >= 0.4 AND parts >= 15 AND ref_des < 5", 3),),
    (("bare_prices >= 15 AND parts >= 10", 4),),
    (("bare_prices >= 25 AND ref_des < 5", 3),),
    (("address >= 3 AND contacts >= 4 AND ref_des < 5", 2),),
    (("parts > 40", 3),),
    (("parts BETWEEN 12 AND 25 AND ref_des < 3", 2),),
    (("parts > 25 AND ref_des < 5", 3),),
)
ADVERT, DRAWING = 3, 8


def score_text() -> str:
    """The score as SQL over the features."""
    return " + ".join("CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p in group) + " ELSE 0 END" for group in SCORE)


def page_features(blocks: DataFrame) -> DataFrame:
    """One row a page: counts of its sure blocks. Patterns are counted block by block, in one pass and one aggregation."""
    sure = blocks.where((F.coalesce("conf", F.lit(1.0)) >= SURE) & (F.trim("text") != ""))
    many = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    text = F.trim("text")
    rows = sure.select(
        "page", words.alias("w"), many(PRICE).alias("p"), many(WEAK_PRICE).alias("weak"), text.rlike(BARE_PRICE).alias("bare"), many(MONEY_WORDS).alias("m"), many(ADDRESS).alias("a"), many(CONTACT).alias("k"), many(ARTICLE_WORDS).alias("art"),
        F.regexp_extract_all("text", F.lit(DESIGNATOR), 0).alias("des"), ((words >= 8) | ((words >= 4) & text.rlike(PROSE))).alias("running"), ((F.length("text") >= 6) & (F.upper("text") == F.col("text")) & F.col("text").rlike("[A-Z]")).alias("upper"),
        (F.col("x1") - F.col("x0")).alias("width"),
    )
    rows = rows.groupBy("page").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("w").alias("words"), F.sum("p").alias("p"), F.sum("weak").alias("weak"), F.count_if("bare").alias("bare_prices"), F.sum("m").alias("money_words"), F.sum("a").alias("address"), F.sum("k").alias("contacts"),
        F.sum("art").alias("article_words"), F.size(F.array_distinct(F.flatten(F.collect_set("des")))).cast("bigint").alias("ref_des"), F.sum(F.when(F.col("running"), F.col("w")).otherwise(0)).alias("running"), F.count_if("upper").alias("upper"),
        F.sort_array(F.collect_list("width")).alias("widths"),
    )
    words = F.greatest("words", F.lit(1))
    return rows.select(
        "page", "blocks", words.alias("words"), (F.col("p") + F.when(F.col("money_words") > 0, F.col("weak")).otherwise(0)).alias("prices"), "bare_prices", "money_words", "address", "contacts", "article_words", "ref_des",
        (F.col("running") / words).alias("prose"), (F.col("upper") / F.col("blocks")).alias("capitals"), F.get("widths", F.floor(F.col("blocks") / 2).cast("int")).alias("median_width"),
    )


def priced_rows(blocks: DataFrame, named: Column, page_width: float) -> DataFrame:
    """page, priced_rows: blocks with a part's name (the condition named) and a price in them, or in a block that begins up to
    three tenths of the page's width right of their end, on the same line."""
    rows = blocks.where(F.trim("text") != "").withColumn("priced", F.col("text").rlike(PRICE)).withColumn("named", named)
    a, b = rows.where("named").alias("a"), rows.where("priced").alias("b")
    middle = lambda x: (F.col(f"{x}.y0") + F.col(f"{x}.y1")) / 2
    height = F.greatest(F.col("a.y1") - F.col("a.y0"), F.lit(1.0))
    gap = F.col("b.x0") - F.col("a.x1")
    near = (F.abs(middle("a") - middle("b")) < 0.6 * height) & (gap >= 0) & (gap < 0.3 * page_width)
    own = F.col("a.priced")
    found = a.join(b, (F.col("a.page") == F.col("b.page")) & ((F.col("a.block") == F.col("b.block")) & own | (~own & near)), "left_semi")
    return found.groupBy("page").agg(F.count(F.lit(1)).alias("priced_rows"))


def catalogue_run(names: DataFrame) -> DataFrame:
    """page, seq_run over (page, part): of the distinct numbered parts the share with a neighbour at one to three numbers of the
    same stem; 0 below six of them. Neighbours are the next ones in order, so no pairs are made."""
    form = r"^([^0-9]*[0-9]?[^0-9]+)([0-9]{2,5})[A-Z]{0,3}$"
    rows = names.select("page", F.regexp_extract("part", form, 1).alias("stem"), F.regexp_extract("part", form, 2).try_cast("int").alias("n")).where("n is not null").distinct()
    w = Window.partitionBy("page", "stem").orderBy("n")
    gap = F.least(F.col("n") - F.lag("n").over(w), F.lead("n").over(w) - F.col("n"))
    rows = rows.withColumn("near", gap <= 3).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if("near").alias("k"))
    return rows.select("page", F.when(F.col("n") >= 6, F.col("k") / F.col("n")).otherwise(0.0).alias("seq_run"))


def labels(blocks: DataFrame) -> DataFrame:
    """page, n_desig (distinct short labels that are designators), n_values (labels that are values)."""
    text = F.trim("text")
    return blocks.groupBy("page").agg(F.countDistinct(F.when(text.rlike(SHORT_LABEL), text)).alias("n_desig"), F.count_if(text.rlike(VALUE_LABEL)).alias("n_values"))


def scored(features: DataFrame, *more: DataFrame) -> DataFrame:
    """features and what else is known of the pages, with score, advert and (where labels are known) drawing."""
    rows = reduce(lambda a, b: a.join(b, "page", "left"), more, features)
    rows = rows.fillna(0, subset=[c for c in ("parts", "priced_rows", "seq_run", "n_desig", "n_values") if c in rows.columns])
    rows = rows.withColumn("score", F.expr(score_text())).withColumn("advert", F.col("score") >= ADVERT)
    if "n_desig" in rows.columns:
        rows = rows.withColumn("drawing", (F.col("n_desig") + F.col("n_values") >= DRAWING) & (F.col("score") < ADVERT))
    return rows


def near_labels(blocks: DataFrame, named: Column, width: float, height: float, most: int = 3, reach: float = 0.12) -> DataFrame:
    """page, block, near: the `most` nearest designators of each named block, within reach of the page's larger side."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    rows = blocks.select("page", "block", F.trim("text").alias("text"), middle("x0", "x1").alias("x"), middle("y0", "y1").alias("y"), named.alias("named"))
    a = rows.where("named").select("page", "block", "x", "y")
    b = rows.where(F.col("text").rlike(SHORT_LABEL)).select("page", F.col("block").alias("other"), F.col("text").alias("label"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    distance = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    pairs = a.join(b, "page").where("block <> other").withColumn("d", F.round(distance, 6)).where(F.col("d") <= reach * max(width, height))
    place = F.row_number().over(Window.partitionBy("page", "block").orderBy("d", "label", "other"))
    pairs = pairs.withColumn("place", place).where(F.col("place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("place", "label")))
    return pairs.groupBy("page", "block").agg(F.array_join(F.transform(listed, lambda x: x["label"]), " ").alias("near"))
