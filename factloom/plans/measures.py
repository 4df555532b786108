"""Measured series, limits, verdicts and agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import measures as M
from factloom.operators import core
from factloom.plans.registry import query


@query("""WITH s AS (SELECT user_id, event_id AS x, value AS y, lag(event_id) OVER w AS x0, lag(value) OVER w AS y0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 c AS (SELECT user_id, x, round(x0 + (x - x0) * (50 - y0) / (y - y0), 6) AS crossed FROM s WHERE y0 < 50 AND y >= 50) SELECT user_id, crossed FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x) = 1""")
def first_crossing(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = t.events.select("user_id", F.col("event_id").alias("x"), F.col("value").alias("y"), F.lag("event_id").over(w).alias("x0"), F.lag("value").over(w).alias("y0"))
    at = F.round(F.col("x0") + (F.col("x") - F.col("x0")) * (50 - F.col("y0")) / (F.col("y") - F.col("y0")), 6)
    return s.where("y0 < 50 and y >= 50").groupBy("user_id").agg(F.min_by(at, "x").alias("crossed"))


@query("""SELECT l_partkey, min_by(l_orderkey, (round(abs(log10(l_extendedprice / 10000)), 9), l_orderkey)) AS nearest FROM lineitem GROUP BY 1""")
def nearest_in_log(t):
    distance = F.round(F.abs(F.log10(F.col("l_extendedprice") / 10000)), 9)
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct(distance, "l_orderkey")).alias("nearest"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE (r - 1) % 5 = 0")
def thinned_points(t):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", "event_id", r.alias("r")).where("(r - 1) % 5 = 0").drop("r")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN lo IS NOT NULL AND l_quantity < lo - abs(lo) * 0.001 THEN 'below' WHEN hi IS NOT NULL AND l_quantity > hi + abs(hi) * 0.001 THEN 'above'
 WHEN lo IS NOT NULL OR hi IS NOT NULL THEN 'inside' WHEN typ IS NOT NULL AND typ <> 0 THEN 'typical' ELSE 'no limit' END AS verdict
 FROM (SELECT *, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_size / 2.0 END AS lo, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_size * 1.0 END AS hi, p_size AS typ FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def row_verdicts(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    low, high = F.when((F.col("p_partkey") % 4).isin(0, 1), F.col("p_size") / 2.0), F.when((F.col("p_partkey") % 4).isin(1, 2), F.col("p_size") * 1.0)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", M.verdict(F.col("l_quantity"), low, F.col("p_size"), high).alias("verdict"))


@query("""WITH e AS (SELECT l_partkey, l_returnflag AS engine, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL),
 s AS (SELECT l_partkey, count(*) AS engines, (max(v) - min(v)) / abs(avg(v)) AS spread FROM e GROUP BY 1)
 SELECT engines::BIGINT AS engines, count(*)::BIGINT AS compared, count(*) FILTER (WHERE spread <= 0.1)::BIGINT AS within, count(*) FILTER (WHERE spread <= 0.5)::BIGINT AS within_five FROM s GROUP BY engines""")
def engine_agreement(t):
    e = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    s = e.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("engines"), ((F.max("v") - F.min("v")) / F.abs(F.avg("v"))).alias("spread"))
    return s.groupBy("engines").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("spread") <= 0.1).alias("within"), F.count_if(F.col("spread") <= 0.5).alias("within_five"))


PRINTED = "(SELECT p_partkey, p_retailprice, CASE p_size % 5 WHEN 0 THEN 'mV' WHEN 1 THEN 'kOhm' WHEN 2 THEN 'uF' WHEN 3 THEN 'Hz' ELSE 'bogus' END AS unit FROM part)"


@query(f"SELECT p_partkey, unit, CASE unit WHEN 'mV' THEN 1e-3 WHEN 'kOhm' THEN 1e3 WHEN 'uF' THEN 1e-6 WHEN 'Hz' THEN 1.0 END::DOUBLE AS factor FROM {PRINTED}")
def unit_factors(t):
    unit = F.expr("CASE p_size % 5 WHEN 0 THEN 'mV' WHEN 1 THEN 'kOhm' WHEN 2 THEN 'uF' WHEN 3 THEN 'Hz' ELSE 'bogus' END")
    return t.part.select("p_partkey", unit.alias("unit")).select("p_partkey", "unit", M.unit_factor(F.col("unit")).alias("factor"))


@query("SELECT c_custkey, format('{:.3e}', c_custkey * 1.2345678::DOUBLE)::DOUBLE AS printed FROM customer")
def significant_digits(t):
    return t.customer.select("c_custkey", M.significant(F.col("c_custkey") * F.lit(1.2345678)).alias("printed"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS n, round(max(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS highest FROM events""")
def running_highest(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_id", F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("n"), F.round(F.max("value").over(w), 4).alias("highest"))


@query("SELECT user_id, min(event_id) FILTER (WHERE value < 1) AS first_below FROM events GROUP BY 1")
def first_below_one(t):
    return t.events.groupBy("user_id").agg(F.min(F.when(F.col("value") < 1, F.col("event_id"))).alias("first_below"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def largest_variant(t):
    return core.first_by(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"))
