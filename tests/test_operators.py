"""Operators on small tables of their own."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import measures as M
from factloom.functions import names as N
from factloom.operators import core
from factloom.operators.ledger import Pillar
from factloom.sources import readers, writers
from factloom.streaming.ledger import activity, keep_ledger, read_ledger


def test_names(spark):
    row = spark.range(1).select(
        N.norm(F.lit("bc-107 b")).alias("a"), N.base_part(F.lit("2N3055BU")).alias("b"), N.from_base36(N.base36(F.lit(123456))).alias("c"), N.canonical(F.lit("-bc107-ND")).alias("d"),
        N.zoomed(F.lit("u#page=2"), F.lit(150.0), F.lit(720.0), F.lit(612.0), F.lit(792.0)).alias("e"), N.page_link(F.lit(None).cast("string"), F.lit("u"), F.lit(5), F.lit(12)).alias("f"),
        N.page_link(F.lit("{url}/page/n{leaf}/"), F.lit("u"), F.lit(5), F.lit(12)).alias("g"), M.unit_factor(F.lit("mV")).alias("h"), M.unit_factor(F.lit("zz")).alias("i"),
    ).first()
    assert tuple(row) == ("BC107B", "2N3055", 123456, "BC107", "u#page=2&zoom=200,55,523&h=792", "u", "u/page/n16/", 1e-3, None)


def test_lineage_ends_at_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "child string, parent string")
    assert {(r.child, r.ancestor) for r in core.closure(edges, "child", "parent").collect()} == {(x, y) for x in "abc" for y in "abc"}


def test_lineage_of_any_depth(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(100)], "child string, parent string")
    found = core.closure(edges, "child", "parent")
    assert found.count() == 5050 and found.where("child = 'n0' and ancestor = 'n100'").first().depth == 100


def test_short_names_match(spark):
    wanted = spark.createDataFrame([("2N30A",), ("BC",), ("BC1",), ("LM317",), ("2N3055",)], "part string")
    keys = spark.createDataFrame([("2N30",), ("BC",), ("BC1A",), ("LM317T",), ("LM3171",), ("2N3055TR7",), ("2N3055_12",)], "key string")
    assert {tuple(r) for r in core.matched(wanted, keys).collect()} == {("2N30A", "2N30", 2), ("BC", "BC", 0), ("BC1", "BC1A", 1), ("LM317", "LM317T", 1), ("2N3055", "2N3055TR7", 1)}


def test_ranks_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", k % 7, k) for k in range(500)] + [("cold", 1, 1), (None, 1, 1)], "k string, a int, b int").repartition(6)
    got = core.ranked(rows, ["k"], [-F.col("a"), F.col("b")], "n").where("k = 'hot'").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(((k % 7, k) for k in range(500)), key=lambda x: (-x[0], x[1])) and [r.n for r in got] == list(range(1, 501))


PILLAR = Pillar("key", "sha", ("download", "ocr", "index"), {"ocr": "2"}, {"ocr": "kind = 'scan'"})


def test_ledger_questions(spark):
    rows = [
        ("a", "1", None, "d", None, None, None, None, None, None, None, None, "scan"), ("b", "1", None, "d", None, None, "o", "1", "x", None, None, None, "scan"), ("c", "1", None, "d", None, None, "o", "2", "x", None, None, None, "scan"),
        ("d", None, "broken", None, None, None, None, None, None, None, None, None, "scan"), ("e", "1", None, "d", None, None, None, None, None, None, None, None, "text"), ("f", None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    ledger = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PILLAR.columns) + ", kind string")
    keys = lambda c: {r.key for r in ledger.where(c).collect()}
    assert keys(PILLAR.done("ocr")) == {"c", "d"} and keys(PILLAR.fresh("ocr", F.lit("x"))) == {"c", "d"} and keys(PILLAR.fresh("ocr", F.lit("y"))) == {"d"}
    assert keys(PILLAR.pending("download")) == {"f"} and keys(PILLAR.pending("ocr")) == {"a", "b"} and keys(PILLAR.pending("index")) == {"b", "c", "e"}
    assert {r.key: r.n for r in ledger.select("key", PILLAR.next_action().alias("n")).collect()} == {"a": "ocr", "b": "ocr", "c": "index", "d": "nothing", "e": "index", "f": "download"}
    skipped = PILLAR.skip(ledger, spark.createDataFrame([("a", "gone"), ("z", "gone")], "key string, skip_reason string"))
    assert {r.key for r in skipped.where("skip_reason = 'gone'").collect()} == {"a", "z"} and PILLAR.refusals_cleared(skipped, "gone").where("skip_reason is not null").count() == 1
    with pytest.raises(ValueError, match="colour"):
        PILLAR.stamped(ledger, spark.createDataFrame([("a", "red")], "key string, colour string"))


def test_a_changed_checksum_clears_later_stages(spark):
    ledger = spark.createDataFrame([("a", "1", "d1", "o1"), ("b", "1", "d1", "o1")], "key string, sha string, download_at string, ocr_at string")
    stamps = spark.createDataFrame([("a", "2", "d2", None), ("b", None, None, "o2"), ("c", "9", "d3", None)], "key string, sha string, download_at string, ocr_at string")
    full = PILLAR.checked(ledger)
    got = sorted(tuple(r) for r in PILLAR.stamped(full, stamps).select("key", "sha", "download_at", "ocr_at").collect())
    assert got == [("a", "2", "d2", None), ("b", "1", "d1", "o2"), ("c", "9", "d3", None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('part,note\nBC107,""\n"x ""y""",ok\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "part string, note string").collect()] == [("BC107", None), ('x "y"', "ok")]
    page = {"page": 1, "w": 100.0, "h": 100.0, "how": "ocr", "blocks": [{"box": [0, 0, 1, 1], "text": "R12", "conf": 0.88}, {"text": "a long label", "conf": 0.88}, {"text": " ", "conf": 1.0}]}
    (tmp_path / "p.jsonl").write_text(json.dumps(page) + "\n")
    assert [r.text for r in readers.read_blocks(readers.read_pages(spark, str(tmp_path / "p.jsonl"))).collect()] == ["a long label"]
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "k string, n int")
    writers.write_ordered_csv(rows, str(tmp_path / "out"), "k")
    assert sorted(r.line for r in readers.read_lines(spark, str(tmp_path / "out")).collect())[:2] == ["a,1", "b,2"]
    writers.replace_partitions(rows, str(tmp_path / "parts"), "k")
    writers.replace_partitions(spark.createDataFrame([("a", 7)], "k string, n int"), str(tmp_path / "parts"), "k")
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "parts")).where("n is not null").collect()) == [("a", 7), ("b", 2)]


def test_the_stream_keeps_what_is_known(spark, tmp_path):
    """Stamps in two batches: a null checksum says nothing, a new one clears what stood before it, untouched buckets stay."""
    schema = "key string, sha string, download_at string, ocr_at string, seq int"
    batches = [
        [("a", "1", "d1", None, 1), ("b", "1", None, None, 2), ("a", None, None, "o1", 3), ("q", "7", "d7", "o7", 4)],
        [("b", None, "d2", None, 5), ("a", "2", None, None, 6), ("a", None, "d9", None, 7), ("c", "1", "dx", None, 8), ("c", "2", None, "oy", 9)],
        [("a", None, None, "o9", 10)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep_ledger(spark, stream, str(tmp_path / "ledger"), str(tmp_path / "check"), PILLAR, buckets=8).awaitTermination()
        got = {r.key: (r.sha, r.download_at, r.ocr_at) for r in read_ledger(spark, str(tmp_path / "ledger"), PILLAR, n).collect()}
        if n == 0:
            assert got == {"a": ("1", "d1", "o1"), "b": ("1", None, None), "q": ("7", "d7", "o7")}
    assert got == {"a": ("2", "d9", "o9"), "b": ("1", "d2", None), "c": ("2", None, "oy"), "q": ("7", "d7", "o7")}


def test_activity_stream(spark):
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet("/root/testdata/sf0.001/events.parquet*")
    q = activity(events).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
