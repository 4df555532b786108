"""The ledger of stages, on events: a user is an item, a type of event a stage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import ledger as L
from factloom.plans.registry import query

STAGES = ("view", "click", "purchase")
#: A stage is done by an event of some value; its version is the last digit of its last event's property.
WORTH, CURRENT = 60, {"click": "3", "purchase": "5"}
FIELDS = ", ".join(
    f"max(CAST(ts AS DATE)) FILTER (WHERE event_type = '{s}' AND value >= {WORTH})::VARCHAR AS {s}_at, right(regexp_replace(max_by(props, event_id) FILTER (WHERE event_type = '{s}'), '[^0-9]', '', 'g'), 1) AS {s}_v, "
    f"substr(md5(max(props) FILTER (WHERE event_type = '{s}')), 1, 8) AS {s}_in"
    for s in STAGES
)


def ledger_sql(where: str = "true") -> str:
    return f"""(SELECT user_id::VARCHAR AS key, substr(md5(max(props)), 1, 16) AS sha, CASE WHEN max(value) FILTER (WHERE event_type = 'error') > 250 THEN 'refused' WHEN max(value) FILTER (WHERE event_type = 'error') > 200 THEN 'gone' END AS skip_reason,
 {FIELDS}, coalesce(max(value) FILTER (WHERE event_type = 'signup'), 0) > 70 AS sells FROM events WHERE {where} GROUP BY user_id)"""


def ledger(t, where: str = "true"):
    kind = F.col("event_type")
    of = lambda s, c: F.when(kind == s, c)
    columns = []
    for s in STAGES:
        columns += [
            F.max(F.when((kind == s) & (F.col("value") >= WORTH), F.to_date("ts"))).cast("string").alias(f"{s}_at"),
            F.right(F.regexp_replace(F.max_by("props", of(s, F.col("event_id"))), "[^0-9]", ""), F.lit(1)).alias(f"{s}_v"),
            F.substring(F.md5(F.max(of(s, F.col("props"))).cast("binary")), 1, 8).alias(f"{s}_in"),
        ]
    worst = F.max(of("error", F.col("value")))
    return t.events.where(where).groupBy(F.col("user_id").cast("string").alias("key")).agg(
        F.substring(F.md5(F.max("props").cast("binary")), 1, 16).alias("sha"), F.when(worst > 250, "refused").when(worst > 200, "gone").alias("skip_reason"), *columns, (F.coalesce(F.max(of("signup", F.col("value"))), F.lit(0)) > 70).alias("sells")
    )


PILLAR = L.Pillar("key", "sha", STAGES, CURRENT, {"purchase": "sells"})
PLAIN = L.Pillar("key", "sha", STAGES)
SKIPPED = "coalesce(skip_reason, '') <> ''"


def done_sql(s: str) -> str:
    return f"({SKIPPED} OR ({s}_at IS NOT NULL" + (f" AND {s}_v IS NOT DISTINCT FROM '{CURRENT[s]}'" if s in CURRENT else "") + "))"


def pending_sql(s: str) -> str:
    earlier = "".join(f" AND {e}_at IS NOT NULL" for e in STAGES[: STAGES.index(s)])
    return f"(NOT {SKIPPED} AND NOT {done_sql(s)}{earlier}" + (" AND sells" if s == "purchase" else "") + ")"


ROWS = "key, sha, skip_reason, " + ", ".join(f"{s}_{f}" for s in STAGES for f in L.FIELDS)


@query(f"SELECT key, {', '.join(f'{done_sql(s)} AS {s}_done' for s in STAGES)} FROM {ledger_sql()}")
def ledger_done(t):
    return ledger(t).select("key", *[PILLAR.done(s).alias(f"{s}_done") for s in STAGES])


@query(f"SELECT key, {', '.join(f'({done_sql(s)} AND ({SKIPPED} OR {s}_in IS NOT DISTINCT FROM left(sha, 8))) AS {s}_fresh' for s in STAGES)} FROM {ledger_sql()}")
def ledger_fresh(t):
    return ledger(t).select("key", *[PILLAR.fresh(s, F.substring("sha", 1, 8)).alias(f"{s}_fresh") for s in STAGES])


@query(" UNION ALL ".join(f"SELECT key, '{s}' AS stage FROM {ledger_sql()} WHERE {pending_sql(s)}" for s in STAGES))
def ledger_pending(t):
    """Every open stage of every item, in one pass."""
    open_ = F.array_compact(F.array(*[F.when(PILLAR.pending(s), F.lit(s)) for s in STAGES]))
    return ledger(t).select("key", F.explode(open_).alias("stage"))


@query(f"""SELECT count(*)::BIGINT AS items, count(*) FILTER (WHERE {SKIPPED})::BIGINT AS skipped, {', '.join(f'count(*) FILTER (WHERE {done_sql(s)})::BIGINT AS {s}_done' for s in STAGES)},
 {', '.join(f'count(*) FILTER (WHERE {pending_sql(s)})::BIGINT AS {s}_open' for s in STAGES)} FROM {ledger_sql()}""")
def ledger_summary(t):
    counts = [F.count_if(PILLAR.done(s)).alias(f"{s}_done") for s in STAGES] + [F.count_if(PILLAR.pending(s)).alias(f"{s}_open") for s in STAGES]
    return ledger(t).agg(F.count(F.lit(1)).alias("items"), F.count_if(PILLAR.skipped()).alias("skipped"), *counts)


@query(f"""WITH l AS {ledger_sql()} SELECT stage, count(*) FILTER (WHERE day IS NOT NULL)::BIGINT AS dated, min(day) AS first, max(day) AS last, count(DISTINCT v)::BIGINT AS versions FROM (
 {' UNION ALL '.join(f"SELECT '{s}' AS stage, {s}_at AS day, {s}_v AS v FROM l" for s in STAGES)}) GROUP BY stage""")
def stage_status(t):
    """The table of a status page: what each stage has done, and when last."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_at").alias("at"), F.col(f"{s}_v").alias("v")) for s in STAGES])
    rows = ledger(t).select(F.inline(stages)).groupBy("stage")
    return rows.agg(F.count("at").alias("dated"), F.min("at").alias("first"), F.max("at").alias("last"), F.countDistinct("v").alias("versions"))


@query(f"SELECT key, CASE {' '.join(f'''WHEN {pending_sql(s)} THEN '{s}' ''' for s in STAGES)} ELSE 'nothing' END AS next FROM {ledger_sql()}")
def next_action(t):
    return ledger(t).select("key", PILLAR.next_action().alias("next"))


@query("SELECT user_id, max(ts) AS last_activity, count(*)::BIGINT AS n FROM events GROUP BY 1")
def last_activity(t):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (ts < TIMESTAMP '2024-01-15 00:00:00' OR ts IS NULL) AS stale FROM events")
def stale_rows(t):
    return t.events.select("event_id", F.coalesce(F.col("ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00'"), F.lit(True)).alias("stale"))


BEFORE, AFTER = "ts < TIMESTAMP '2024-01-16 00:00:00'", "ts >= TIMESTAMP '2024-01-16 00:00:00'"
STAMPED = f"""SELECT coalesce(a.key, b.key) AS key, coalesce(b.sha, a.sha) AS sha, coalesce(b.skip_reason, a.skip_reason) AS skip_reason,
 {', '.join(f'coalesce(b.{s}_{f}, CASE WHEN NOT coalesce(a.sha <> b.sha, false) THEN a.{s}_{f} END) AS {s}_{f}' for s in STAGES for f in L.FIELDS)} FROM {{a}} a FULL JOIN {{b}} b ON a.key = b.key"""


@query(STAMPED.format(a=ledger_sql(BEFORE), b=ledger_sql(AFTER)))
def ledger_stamped(t):
    """The first half of the month as the ledger, the second as stamps."""
    return PLAIN.stamped(ledger(t, BEFORE), ledger(t, AFTER).drop("sells"))


@query(f"SELECT l.key, sha, coalesce(s.skip_reason, l.skip_reason) AS skip_reason, {', '.join(f'{s}_{f}' for s in STAGES for f in L.FIELDS)} FROM {ledger_sql()} l LEFT JOIN (SELECT user_id::VARCHAR AS key, 'too many errors' AS skip_reason FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 18) s ON s.key = l.key")
def ledger_skipped(t):
    reasons = t.events.where("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("key")).count().where("count >= 18").select("key", F.lit("too many errors").alias("skip_reason"))
    return PLAIN.skip(ledger(t), reasons)


@query(f"SELECT key, sha, CASE WHEN skip_reason <> 'gone' THEN skip_reason END AS skip_reason FROM {ledger_sql()}")
def refusals_cleared(t):
    return PLAIN.refusals_cleared(ledger(t), "gone").select("key", "sha", "skip_reason")


SEEN = "(SELECT user_id::VARCHAR AS key, substr(md5(max(props)), 1, 16) AS sha FROM events WHERE value < 45 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 90) GROUP BY 1 UNION ALL SELECT 's' || s_suppkey, 'x' FROM supplier)"


@query(f"""SELECT coalesce(l.key, f.key) AS key, CASE WHEN l.key IS NULL THEN 'unknown' WHEN f.key IS NOT NULL AND l.sha IS NOT DISTINCT FROM f.sha THEN 'held' WHEN f.key IS NOT NULL AND l.sha IS NOT NULL THEN 'changed'
 WHEN f.key IS NOT NULL THEN 'unrecorded' WHEN {SKIPPED} THEN 'skipped' WHEN l.sha IS NULL THEN 'open' WHEN coalesce(purchase_at > '2024-01-27', false) THEN 'released' ELSE 'lost' END AS state FROM {ledger_sql()} l FULL JOIN {SEEN} f ON f.key = l.key""")
def file_states(t):
    """What became of every item's file, and files that no item knows."""
    keen = t.events.where("event_type = 'view' and value > 90").select("user_id").distinct()
    seen = t.events.where("value < 45").join(keen, "user_id", "left_semi").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.substring(F.md5(F.max("props").cast("binary")), 1, 16).alias("sha"))
    seen = seen.union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.lit("x")))
    return L.file_states(ledger(t).withColumn("released", F.col("purchase_at") > "2024-01-27"), seen, "key", "sha")


@query(f"SELECT count(*)::BIGINT AS items, sum(length(sha))::BIGINT AS bytes FROM {ledger_sql()} WHERE NOT {SKIPPED} AND sha IS NOT NULL AND view_at IS NOT NULL AND NOT sells")
def release_set(t):
    """What is held, was read and is not of the kind that stays."""
    rows = ledger(t).where(~PLAIN.skipped() & F.col("sha").isNotNull() & PLAIN.dated("view") & ~F.col("sells"))
    return rows.agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("sha")).alias("bytes"))


@query(f"SELECT key, click_v FROM {ledger_sql()} WHERE NOT {SKIPPED} AND view_at IS NOT NULL AND (click_at IS NULL OR click_v IS DISTINCT FROM '{CURRENT['click']}')")
def to_do_again(t):
    """Items that a new version of a stage has to go over."""
    return ledger(t).where(PILLAR.pending("click")).select("key", "click_v")


STAMPS = "(SELECT user_id::VARCHAR AS key, event_id AS seq, CASE WHEN event_type IN ('signup', 'view') THEN substr(props, 7, 1) END AS sha, NULL::VARCHAR AS skip_reason, CASE WHEN event_type = 'click' THEN CAST(ts AS DATE)::VARCHAR END AS click_at, CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE)::VARCHAR END AS purchase_at FROM events)"


@query(f"""WITH s AS {STAMPS}, f AS (SELECT key, max_by(sha, seq) FILTER (WHERE sha IS NOT NULL) AS sha FROM s GROUP BY key),
 c AS (SELECT s.key, max(seq) FILTER (WHERE s.sha <> f.sha) AS cut FROM s JOIN f USING (key) GROUP BY 1)
 SELECT key, any_value(f.sha) AS sha, max_by(click_at, seq) FILTER (WHERE click_at IS NOT NULL AND (cut IS NULL OR seq > cut)) AS click_at, max_by(purchase_at, seq) FILTER (WHERE purchase_at IS NOT NULL AND (cut IS NULL OR seq > cut)) AS purchase_at
 FROM s JOIN f USING (key) JOIN c USING (key) GROUP BY key""")
def merged_stamps(t):
    """Stamps of many writers on an empty ledger: the last word on each field, stages only from after the last change."""
    kind, day = F.col("event_type"), F.to_date("ts").cast("string")
    stamps = t.events.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(kind.isin("signup", "view"), F.substring("props", 7, 1)).alias("sha"), F.lit(None).cast("string").alias("skip_reason"),
        F.when(kind == "click", day).alias("click_at"), F.when(kind == "purchase", day).alias("purchase_at"),
    )
    empty = t.spark.createDataFrame([], ", ".join(f"{c} string" for c in PLAIN.columns))
    return PLAIN.merged(empty, stamps, "seq").select("key", "sha", "click_at", "purchase_at")


@query("SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 4 AS worker FROM events")
def shared_work(t):
    out = None
    for k in range(4):
        rows = L.shared_work(t.events, "event_id", k, 4).select("event_id", F.lit(k).cast("bigint").alias("worker"))
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INTEGER AS k FROM events")
def json_properties(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT user_id, count(*)::BIGINT AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
 WHERE p IS NULL OR ts > p + INTERVAL 6 HOUR GROUP BY 1""")
def sessions(t):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.withColumn("p", before).where(F.col("p").isNull() | (F.col("ts") > F.col("p") + F.expr("interval 6 hours")))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
