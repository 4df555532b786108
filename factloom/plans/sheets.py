"""Rows of data sheets: units, symbols, conditions, limits, verdicts; how a reading compares with a reference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import measures as M
from factloom.operators import core
from factloom.plans.registry import query

UNITS = "CASE p_size % 13 WHEN 0 THEN 'mAdc' WHEN 1 THEN 'kΩ' WHEN 2 THEN 'µmhos' WHEN 3 THEN 'nV/√Hz' WHEN 4 THEN 'dB' WHEN 5 THEN '' WHEN 6 THEN 'm V' WHEN 7 THEN 'pF' WHEN 8 THEN 'furlong' WHEN 9 THEN 'KHz' WHEN 10 THEN 'X10-4' WHEN 11 THEN 'us' ELSE 'GHz' END"


@query("SELECT p_partkey, (CASE p_size % 13 WHEN 0 THEN 1e-3 WHEN 1 THEN 1e3 WHEN 2 THEN 1e-6 WHEN 3 THEN 1e-9 WHEN 4 THEN 1.0 WHEN 5 THEN 1.0 WHEN 6 THEN 1e-3 WHEN 7 THEN 1e-12 WHEN 9 THEN 1e3 WHEN 10 THEN 1e-4 WHEN 11 THEN 1e-6 WHEN 12 THEN 1e9 END)::DOUBLE AS factor FROM part")
def printed_units(t):
    """Units as sheets print them; one that is not known has no factor."""
    return t.part.select("p_partkey", M.printed_factor(F.expr(UNITS)).alias("factor"))


SYMBOL_CASES = (("V(BR)CEO", "", "vbrceo"), ("Cobo", "", "cob"), ("hFE1", "", "hFE"), ("hfe", "gain", "hfe"), ("|Yfs|", "", "gfs"), ("VDS", "Drain Breakdown Voltage", "vbrdss"), ("F", "Noise Figure", "nf"), ("VR", "breakdown", "vbr"), ("BV_DSS", "", "vbrdss"), ("tr", "", "tr"), ("NF2", "", "nf"), ("I[CBO](1)", "", "icbo"))


def case_of(k: int, quote: str = "'") -> str:
    return "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{c[k]}'" for i, c in enumerate(SYMBOL_CASES)) + " END"


@query(f"SELECT p_partkey, {case_of(2)} AS quantity FROM part")
def quantities(t):
    return t.part.select("p_partkey", M.quantity(F.expr(case_of(0)), F.expr(case_of(1))).alias("quantity"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN '{"VCE":' || p_size::DOUBLE || ',"IC":' || ((p_partkey % 7) / 1000.0)::DOUBLE || ',"TA":' || (-p_size)::DOUBLE || '}' ELSE '{"VCE":' || p_size::DOUBLE || ',"TA":' || (-p_size)::DOUBLE || ',"IC":9.0}' END AS conditions FROM part""")
def row_conditions(t):
    """Test conditions as a map: magnitudes in SI units, temperatures with their sign, zeros and bands left out, the first counts."""
    text = F.concat(F.lit("V(CE) = −"), "p_size", F.lit(" V, IC="), F.col("p_partkey") % 7, F.lit(" mA; f = 1 kHz to 3 kHz, TA = −"), "p_size", F.lit(" °C, TJ=25 °C, IC = 9 A, RS=0"))
    return t.part.select("p_partkey", F.to_json(M.conditions(text)).alias("conditions"))


LIMITS = "CASE WHEN p_partkey % 4 IN (0, 1) THEN p_size / 2.0 END AS lo, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_size * 1.0 END AS hi, p_size AS typ"
VERDICT = """CASE WHEN v IS NULL THEN 'not measured' WHEN lo IS NOT NULL AND v < lo - abs(lo) * 0.001 THEN 'below' WHEN hi IS NOT NULL AND v > hi + abs(hi) * 0.001 THEN 'above' WHEN lo IS NOT NULL OR hi IS NOT NULL THEN 'inside' WHEN typ <> 0 THEN 'typical' ELSE 'no limit' END"""


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, p_partkey, CASE WHEN l_quantity > 3 THEN l_quantity END AS v, {LIMITS} FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT l_orderkey, l_linenumber, p_partkey, CASE WHEN v > 49 THEN 'suspect' WHEN p_partkey % 11 = 0 AND v IS NOT NULL THEN 'grade' ELSE {VERDICT} END AS verdict, CASE WHEN v IS NOT NULL AND lo IS NULL AND hi IS NULL THEN round(v / typ, 6) END AS ratio FROM r""")
def published_verdicts(t):
    """Verdict and, where a sheet prints only a typical value, the ratio to it; rows of another grade, and values out of all
    reason, are named as such."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    v = F.when(F.col("l_quantity") > 3, F.col("l_quantity"))
    low, high = F.when((F.col("p_partkey") % 4).isin(0, 1), F.col("p_size") / 2.0), F.when((F.col("p_partkey") % 4).isin(1, 2), F.col("p_size") * 1.0)
    verdict = F.when(v > 49, "suspect").when((F.col("p_partkey") % 11 == 0) & v.isNotNull(), "grade").otherwise(M.verdict(v, low, F.col("p_size"), high))
    return rows.select("l_orderkey", "l_linenumber", "p_partkey", verdict.alias("verdict"), F.when(low.isNull() & high.isNull(), F.round(v / F.col("p_size"), 6)).alias("ratio"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 'card' WHEN l_quantity > 10 THEN 'measured' WHEN l_tax > 0.06 THEN 'error' WHEN l_linestatus = 'O' THEN 'declared not' ELSE 'none' END AS cell FROM lineitem""")
def page_cells(t):
    value, error = F.when(F.col("l_quantity") > 10, F.col("l_quantity")), F.when(F.col("l_tax") > 0.06, F.lit("no convergence"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", M.cell((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), value, error, F.col("l_linestatus") == "O").alias("cell"))


@query("SELECT p_partkey, format('{:.3e}', p_retailprice / CASE p_size % 3 WHEN 0 THEN 1e-3 WHEN 1 THEN 1.0 ELSE 1e3 END * CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END)::DOUBLE AS shown FROM part")
def shown_values(t):
    factor = F.when(F.col("p_size") % 3 == 0, 1e-3).when(F.col("p_size") % 3 == 1, 1.0).otherwise(1e3)
    return t.part.select("p_partkey", M.shown(F.col("p_retailprice"), factor, F.col("p_size") % 2 == 0).alias("shown"))


@query("""WITH e AS (SELECT l_partkey AS part, l_returnflag AS engine, count(*) AS runs, count(*) FILTER (WHERE l_quantity < 3) AS failed, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY 1, 2)
 SELECT part, sum(runs - failed)::BIGINT AS ok, sum(failed)::BIGINT AS failed, max(v) FILTER (WHERE engine = 'A') AS a, max(v) FILTER (WHERE engine = 'N') AS n, coalesce(abs(max(v) FILTER (WHERE engine = 'A') - max(v) FILTER (WHERE engine = 'N')) > 5, false) AS differ FROM e GROUP BY 1""")
def model_facts(t):
    """Runs of a model that went well and that failed, and whether two engines differ."""
    e = t.lineitem.groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("engine")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("l_quantity") < 3).alias("failed"), F.round(F.avg("l_quantity"), 4).alias("v"))
    of = lambda x: F.max(F.when(F.col("engine") == x, F.col("v")))
    rows = e.groupBy("part").agg(F.sum(F.col("runs") - F.col("failed")).alias("ok"), F.sum("failed").alias("failed"), of("A").alias("a"), of("N").alias("n"))
    return rows.withColumn("differ", F.coalesce(F.abs(F.col("a") - F.col("n")) > 5, F.lit(False)))


READ = """r AS (SELECT l_orderkey AS sheet, l_linenumber AS id, l_returnflag AS symbol, l_suppkey % 5 AS c1, l_suppkey % 3 AS c2, l_quantity AS v FROM lineitem WHERE l_linestatus = 'O'),
 x AS (SELECT l_orderkey AS sheet, l_partkey AS id, l_returnflag AS symbol, l_partkey % 5 AS c1, l_partkey % 3 AS c2, CASE WHEN l_tax > 0.04 THEN l_quantity ELSE l_quantity + 1 END AS v FROM lineitem WHERE l_linestatus = 'F')"""
SCORE = "((r.c1 = x.c1)::INTEGER + (r.c2 = x.c2)::INTEGER + 0.01 * (abs(r.v - x.v) <= 0.002 * greatest(abs(r.v), abs(x.v)))::INTEGER)"


def readings(t):
    """Reference and extraction rows."""
    line = lambda status, key, own: t.lineitem.where(F.col("l_linestatus") == status).select(F.col("l_orderkey").alias("sheet"), F.col(key).cast("bigint").alias(f"id_{own}"), F.col("l_returnflag").alias("symbol"), (F.col("l_suppkey" if own == "r" else "l_partkey") % 5).alias(f"c1_{own}"), (F.col("l_suppkey" if own == "r" else "l_partkey") % 3).alias(f"c2_{own}"), (F.col("l_quantity") if own == "r" else F.when(F.col("l_tax") > 0.04, F.col("l_quantity")).otherwise(F.col("l_quantity") + 1)).alias(f"v_{own}"))
    return line("O", "l_linenumber", "r"), line("F", "l_partkey", "x")


def same_value(a, b):
    """Equal within two thousandths."""
    return F.abs(a - b) <= 0.002 * F.greatest(F.abs(a), F.abs(b))


def best_matches(t):
    r, x = readings(t)
    both = r.join(x, ["sheet", "symbol"])
    agree = lambda c: (F.col(f"{c}_r") == F.col(f"{c}_x")).cast("int")
    right = same_value(F.col("v_r"), F.col("v_x"))
    both = both.withColumn("score", agree("c1") + agree("c2") + 0.01 * right.cast("int")).withColumn("right", right)
    best = F.max_by(F.struct("id_x", "score", "right"), F.struct("score", -F.col("id_x")))
    return both.groupBy("sheet", "symbol", "id_r", "c1_r", "c2_r", "v_r").agg(best.alias("b")).select("sheet", "symbol", "id_r", "b.id_x", "b.score", "b.right")


@query(f"WITH {READ} SELECT r.sheet, r.symbol, r.id AS id_r, max_by(x.id, ({SCORE}, -x.id))::BIGINT AS id_x, round(max({SCORE}), 2)::DOUBLE AS score FROM r JOIN x ON x.sheet = r.sheet AND x.symbol = r.symbol GROUP BY r.sheet, r.symbol, r.id, r.c1, r.c2, r.v")
def matched_rows(t):
    """Each reference row's best extracted row of its symbol: most conditions in common, then an equal value."""
    return best_matches(t).select("sheet", "symbol", "id_r", "id_x", F.round("score", 2).alias("score"))


@query(f"""WITH {READ}, m AS (SELECT r.sheet, max_by(struct_pack(s := {SCORE}, ok := abs(r.v - x.v) <= 0.002 * greatest(abs(r.v), abs(x.v))), ({SCORE}, -x.id)) AS b FROM r JOIN x ON x.sheet = r.sheet AND x.symbol = r.symbol GROUP BY r.sheet, r.symbol, r.id, r.c1, r.c2, r.v)
 SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM r))::BIGINT AS rows, count(*)::BIGINT AS found, count(*) FILTER (WHERE b.s >= 2)::BIGINT AS complete, count(*) FILTER (WHERE b.ok)::BIGINT AS exact, round(count(*) FILTER (WHERE b.ok) / count(*), 4) AS share FROM m""")
def scorecard(t):
    """How an extraction does against a reference: rows found, with all conditions, with the right value."""
    total = readings(t)[0].distinct().agg(F.count(F.lit(1)).alias("rows"))
    m = best_matches(t).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("score") >= 2).alias("complete"), F.count_if("right").alias("exact"))
    return total.join(m).withColumn("share", F.round(F.col("exact") / F.col("found"), 4))  # one row each


@query("""WITH v AS (SELECT l_partkey, l_returnflag AS symbol, round(l_quantity / 5) AS cond, l_linestatus AS reader, min(CASE WHEN l_tax > 0.03 THEN 'inside' ELSE 'above' END) AS verdict FROM lineitem GROUP BY 1, 2, 3, 4)
 SELECT a.symbol, count(*)::BIGINT AS paired, count(*) FILTER (WHERE a.verdict = b.verdict)::BIGINT AS equal FROM v a JOIN v b ON a.l_partkey = b.l_partkey AND a.symbol = b.symbol AND a.cond = b.cond AND a.reader = 'O' AND b.reader = 'F' GROUP BY 1""")
def paired_verdicts(t):
    """Verdicts of two readings of the same rows, paired by symbol and rounded conditions."""
    v = t.lineitem.groupBy("l_partkey", F.col("l_returnflag").alias("symbol"), F.round(F.col("l_quantity") / 5).alias("cond")).agg(
        *[F.min(F.when(F.col("l_linestatus") == s, F.when(F.col("l_tax") > 0.03, "inside").otherwise("above"))).alias(s) for s in "OF"]
    )
    return v.where("O is not null and F is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("paired"), F.count_if(F.col("O") == F.col("F")).alias("equal"))


@query("""WITH v AS (SELECT l_partkey, l_suppkey, max(CASE WHEN l_tax > 0.07 THEN 2 WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS worst, min(l_linenumber) AS g FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, count(*)::BIGINT AS models, count(*) FILTER (WHERE worst = 0)::BIGINT AS inside, count(*) FILTER (WHERE worst = 2)::BIGINT AS outside, min_by(l_suppkey, (worst, g, l_suppkey)) AS best FROM v GROUP BY 1""")
def verdicts_per_part(t):
    """Models of a part by their worst row, and the best of them."""
    worst = F.max(F.when(F.col("l_tax") > 0.07, 2).when(F.col("l_tax") > 0.04, 1).otherwise(0))
    v = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(worst.alias("worst"), F.min("l_linenumber").alias("g"))
    return v.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("worst") == 0).alias("inside"), F.count_if(F.col("worst") == 2).alias("outside"), F.min_by("l_suppkey", F.struct("worst", "g", "l_suppkey")).alias("best"))


@query("SELECT DISTINCT lower(p_type) AS kind, array_to_string(list_sort(string_split(lower(p_name || ' ' || p_brand), ' ')), ',') AS params FROM part")
def distinct_cards(t):
    """Cards that differ in type or in their parameters, whatever the order and case these are written in."""
    return t.part.select(F.lower("p_type").alias("kind"), F.array_join(F.sort_array(F.split(F.lower(F.concat("p_name", F.lit(" "), "p_brand")), " ")), ",").alias("params")).distinct()


CARD = "concat('.MODEL Q', p_partkey, ' NPN (IS=', p_size, 'f BF = ', p_partkey % 400, ' Vaf=', p_size, '.5 is=', p_size, 'p RB=1', CASE p_size % 4 WHEN 0 THEN 'meg' WHEN 1 THEN 'k' WHEN 2 THEN 'mOhm' ELSE '' END, ')')"


@query(f"""SELECT p_partkey, p_size || 'p' AS saturation, round(p_size * 1e-12 * 1e12, 6) AS pico, (1.0 * CASE p_size % 4 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1e-3 ELSE 1 END)::DOUBLE AS base, true AS complete FROM part""")
def cards_read(t):
    """Parameters of a card: the last of a name counts; numbers with their scale; whether it holds what a bench needs."""
    rows = t.part.select("p_partkey", M.card_parameters(F.expr(CARD)).alias("p"))
    needs = F.array(*map(F.lit, ("is", "bf", "vaf")))
    return rows.select("p_partkey", F.col("p")["is"].alias("saturation"), F.round(M.netlist_number(F.col("p")["is"]) * 1e12, 6).alias("pico"), M.netlist_number(F.col("p")["rb"]).alias("base"), (F.size(F.array_except(needs, F.map_keys("p"))) == 0).alias("complete"))


@query("SELECT p_partkey, substr(sha256(concat_ws(chr(31), p_brand, p_name, p_size::VARCHAR)), 1, 16) AS digest FROM part")
def record_digests(t):
    return t.part.select("p_partkey", M.digest(F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string")).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 11 * 1000 / 612)::DOUBLE AS exact, floor(l_quantity * 11 * 1000 / 612)::INTEGER AS x, least(450 + 105 * l_linenumber, 1000)::INTEGER AS budget FROM lineitem")
def box_thousandths(t):
    x = F.col("l_quantity") * 11
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (x * 1000 / 612).alias("exact"), M.thousandths(x, F.lit(612.0)).alias("x"), F.least(F.lit(450) + 105 * F.col("l_linenumber"), F.lit(1000)).alias("budget"))


@query("""WITH s AS (SELECT l_partkey, l_returnflag, md5(array_to_string(list_sort(list(round(l_quantity, 2)::INTEGER::VARCHAR)), ',')) AS digest, round((max(l_quantity) - min(l_quantity)) / avg(l_quantity), 6) AS spread FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, count(*)::BIGINT AS runs, count(DISTINCT digest) = 1 AS repeated, max(spread) AS spread FROM s GROUP BY 1""")
def repeated_runs(t):
    """Whether all runs of a model gave the same series, and the widest spread of one."""
    listed = F.array_join(F.array_sort(F.collect_list(F.round("l_quantity", 2).cast("int").cast("string"))), ",")
    s = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.md5(listed.cast("binary")).alias("digest"), F.round((F.max("l_quantity") - F.min("l_quantity")) / F.avg("l_quantity"), 6).alias("spread"))
    return s.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("runs"), (F.countDistinct("digest") == 1).alias("repeated"), F.max("spread").alias("spread"))


# Series of measured points: x (event number), y (value), a series for each user.


def series(t):
    return t.events.select("user_id", F.col("event_id").alias("x"), F.col("value").alias("y"))


STEP = "SELECT user_id, event_id AS x, value AS y, lag(event_id) OVER w AS x0, lag(value) OVER w AS y0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT user_id, round(exp(ln(y0) + (ln(y) - ln(y0)) * (ln(500) - ln(greatest(x0, 0.5))) / (ln(x) - ln(greatest(x0, 0.5)))), 6) AS y FROM ({STEP}) WHERE x0 < 500 AND x >= 500")
def log_interpolated(t):
    """The series at one x, by a straight line between neighbours on logarithmic axes."""
    w = Window.partitionBy("user_id").orderBy("x")
    rows = series(t).withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).where("x0 < 500 and x >= 500")
    x0 = F.greatest("x0", F.lit(0.5))
    share = (F.log(F.lit(500.0)) - F.log(x0)) / (F.log("x") - F.log(x0))
    return rows.select("user_id", F.round(F.exp(F.log("y0") + (F.log("y") - F.log("y0")) * share), 6).alias("y"))


def crossing_sql(up: str) -> str:
    return f"SELECT user_id, round(x0 + (x - x0) * (80 - y0) / (y - y0), 6) AS at FROM ({STEP}) WHERE x > 300 AND {up} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x) = 1"


@query(f"SELECT r.user_id, r.at AS rising, f.at AS falling FROM ({crossing_sql('y0 < 80 AND y >= 80')}) r FULL JOIN ({crossing_sql('y0 > 80 AND y <= 80')}) f USING (user_id)".replace("SELECT r.user_id,", "SELECT user_id,"))
def threshold_crossings(t):
    """Where a series first passes a threshold after some x, upwards and downwards, between its points."""
    w = Window.partitionBy("user_id").orderBy("x")
    rows = series(t).withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).where("x > 300")
    at = F.round(F.col("x0") + (F.col("x") - F.col("x0")) * (80 - F.col("y0")) / (F.col("y") - F.col("y0")), 6)
    first = lambda c: F.min_by(F.when(c, at), F.when(c, F.col("x")))
    up, down = (F.col("y0") < 80) & (F.col("y") >= 80), (F.col("y0") > 80) & (F.col("y") <= 80)
    return rows.groupBy("user_id").agg(first(up).alias("rising"), first(down).alias("falling")).where("rising is not null or falling is not null")


@query("""WITH m AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS highest FROM events) SELECT user_id, event_id, highest, first_value(event_id) OVER (PARTITION BY user_id, highest ORDER BY event_id) AS since FROM m""")
def highest_since(t):
    """The highest value so far and where it was reached."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    best = F.max(F.struct("value", (-F.col("event_id")).alias("n"))).over(w)
    return t.events.select("user_id", "event_id", best.alias("b")).select("user_id", "event_id", F.col("b.value").alias("highest"), (-F.col("b.n")).alias("since"))


@query("""WITH g AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT user_id, k::INTEGER AS k, round(lo + (hi - lo) * k / 8, 6) AS linear, round(lo * pow(hi / lo, k / 8), 6) AS logarithmic FROM g, range(0, 9) t(k)""")
def sampling_grid(t):
    """Nine places between the ends of a series, evenly spaced and evenly spaced in the logarithm; a series that begins at zero has
    no places of the latter kind but its beginning, the others are NaN."""
    g = t.events.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = g.select("user_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    ratio = F.when(F.col("lo") == 0, F.lit(float("nan"))).otherwise(F.col("hi") / F.col("lo"))  # a division by zero would end the query
    return rows.select("user_id", "k", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / 8, 6).alias("linear"), F.round(F.col("lo") * F.pow(ratio, F.col("k") / 8), 6).alias("logarithmic"))


@query("""WITH a AS (SELECT user_id, min(value) AS lo, quantile_disc(value, 0.9) AS hi FROM events GROUP BY 1)
 SELECT user_id, count(*) FILTER (WHERE value > hi)::BIGINT AS off_scale, round(avg(least(greatest((value - lo) / (hi - lo), 0), 1)), 6) AS mean_place, pow(10, floor(log10((any_value(hi) - any_value(lo)) / 4)))::DOUBLE AS tick FROM events JOIN a USING (user_id) WHERE hi > lo GROUP BY 1""")
def axis_places(t):
    """Points on an axis: how many lie beyond it, where the others stand, and the step of its ticks."""
    a = t.events.groupBy("user_id").agg(F.min("value").alias("lo"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("hi"))
    place = F.least(F.greatest((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    rows = t.events.join(a, "user_id").where("hi > lo").groupBy("user_id")
    return rows.agg(F.count_if(F.col("value") > F.col("hi")).alias("off_scale"), F.round(F.avg(place), 6).alias("mean_place"), F.pow(F.lit(10.0), F.floor(F.log10((F.first("hi") - F.first("lo")) / 4))).alias("tick"))


@query("SELECT event_id, round(10 * log10(1 + value / 100), 6) AS noise_figure, round(value * 1e-3 / (2 * pi() * (event_id + 1)) * 1e9, 6) AS capacitance FROM events")
def derived_measures(t):
    """Noise figure from excess noise; capacitance from the imaginary part of a current at a frequency (in nF)."""
    return t.events.select("event_id", F.round(10 * F.log10(1 + F.col("value") / 100), 6).alias("noise_figure"), F.round(F.col("value") * 1e-3 / (2 * F.pi() * (F.col("event_id") + 1)) * 1e9, 6).alias("capacitance"))


@query("""SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey, lower(l_returnflag)) AS largest FROM lineitem) WHERE l_quantity = largest""")
def largest_of_each(t):
    """Of variants of one drawing those of the largest size, found before anything is shuffled back."""
    largest = t.lineitem.groupBy("l_orderkey", F.lower("l_returnflag").alias("name")).agg(F.max("l_quantity").alias("l_quantity"))
    rows = t.lineitem.select("l_partkey", "l_orderkey", F.lower("l_returnflag").alias("name"), "l_quantity")
    return rows.join(largest, ["l_orderkey", "name", "l_quantity"], "left_semi").select("l_partkey", "l_orderkey", "l_quantity")
