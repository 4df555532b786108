"""Readers and writers on small files."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from factloom.sources import files, readers, writers


def table(spark, **content):
    return spark.createDataFrame([(k.replace("__", "."), v if isinstance(v, bytes) else v.encode()) for k, v in content.items()], "path string, content binary")


def test_absent_paths_are_empty_tables(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert readers.read_csv(spark, gone, "a string").count() == readers.read_sources(spark, gone, "a string").count() == readers.read_pages(spark, gone).count() == readers.read_definitions(spark, gone).count() == 0


def test_sources_and_definitions(spark, tmp_path):
    (tmp_path / "ti.csv").write_text("# notes\npart,kind\nTL072,ic\nX,\n")
    (tmp_path / "st.csv").write_text("part,kind\nL7805,\n")
    assert sorted(map(tuple, readers.read_sources(spark, str(tmp_path), "part string, kind string").collect())) == [("L7805", None, "st"), ("TL072", "ic", "ti"), ("X", None, "ti")]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"name": n, "kind": "model", "comment": "x" * 50}) for n in ("2N3055", "BC-107", "bc109")) + "\n\n")
    heads = spark.createDataFrame([("BC1",)], "head string")
    rows = readers.read_definitions(spark, str(tmp_path / "d.jsonl"), heads, ("name", "kind"))
    assert sorted(r.name for r in rows.collect()) == ["BC-107", "bc109"] and rows.columns == ["name", "kind"]
    (tmp_path / "maker.json").write_text('{"a": 1}')
    assert [tuple(r) for r in readers.read_config(spark, str(tmp_path)).collect()] == [("maker", '{"a": 1}')]


def test_cached_tables_follow_the_file(spark, tmp_path):
    path, tables = tmp_path / "a.csv", readers.Tables(spark)
    path.write_text("k\n1\n")
    first = tables.csv(str(path), "k string")
    assert first is tables.csv(str(path), "k string") and first.count() == 1
    import os

    path.write_text("k\n1\n2\n")
    os.utime(path, (1, 1))
    assert tables.csv(str(path), "k string").count() == 2


def test_kinds_and_order(spark, tmp_path):
    kinds = {"a": b"%PDF-1.4", "b": b"PK\x03\x04xx", "c": b"\x1f\x8b..", "d": b"<!DOCTYPE html><html>", "e": b"", "f": b"* lib\n.model x npn\n", "g": b"plain", "h": b"\x00\x01\x02"}
    got = {r.path: r.k for r in table(spark, **kinds).select("path", readers.kind_of_bytes(F.col("content")).alias("k")).collect()}
    assert got == {"a": "pdf", "b": "zip", "c": "gzip", "d": "html", "e": "empty", "f": "model", "g": "text", "h": "binary"}
    blocks = spark.sql("SELECT array(named_struct('x', 5.0, 'y', 11.0, 't', 'b'), named_struct('x', 9.0, 'y', 30.0, 't', 'c'), named_struct('x', 1.0, 'y', 13.0, 't', 'a')) AS b")
    assert [x.t for x in blocks.select(readers.reading_order(F.col("b")).alias("o")).first().o] == ["a", "b", "c"]
    for name in ("x.txt", "y.png", "s.txt"):
        (tmp_path / name).write_text("z")
    assert sorted(r.path[-5:] for r in readers.walk(spark, str(tmp_path)).collect()) == ["s.txt", "x.txt"]


def test_encodings(spark):
    rows = files.texts(table(spark, a="é".encode("utf-16"), b="é", c="日本".encode("cp932"), d=b"\xff\xfa\x80", e="ab cd".encode("utf-16-le"), f=b"", g="﻿x")).collect()
    got = {r.path: r.text for r in rows}
    assert (got["a"], got["b"], got["c"], got["e"], got["f"], got["g"]) == ("é", "é", "日本", "ab cd", "", "x") and len(got["d"]) > 0


LIB = """* general purpose
* second line
.SUBCKT AMP in out PARAMS: g=2
R1 in out
+ 10k
.model inner D(IS=1f)
.ends AMP
.MODEL Q2N3904 NPN(IS=6.734f BF = 416
+ VAF=74)
"""


def test_definitions(spark):
    rows = {r.name: r for r in files.definitions(table(spark, a=LIB, b="** encrypted by x\n$ENCRYPT\nabc", c="")).collect()}
    assert rows["AMP"].pins == ["in", "out"] and rows["AMP"].comment == "general purpose | second line" and rows["AMP"].params == {"g": "2"}
    assert rows["inner"].parent == "AMP" and rows["inner"].type == "d" and rows["Q2N3904"].params == {"is": "6.734f", "bf": "416", "vaf": "74"} and rows["Q2N3904"].line == 8
    assert rows[None].encrypted


def test_equal_models_have_equal_hashes(spark):
    a = ".model QX NPN(IS=1f BF=100)\n.subckt S a b\nQ1 a b 0 QX\n.ends\n"
    b = "* note\n.SUBCKT other a b ; said\nq1   a b 0 qy\n.ENDS\n.MODEL qy npn ( bf = 100\n+ is=1F  rb=0 )\n"
    c = b.replace("100", "101")
    found = {(r.path, r.name): r.hash for r in files.identities(table(spark, a=a, b=b, c=c)).collect()}
    assert found["a", "qx"] == found["b", "qy"] != found["c", "qy"] and found["a", "s"] == found["b", "other"] != found["c", "other"]
    assert {r.needs for r in files.identities(table(spark, a=a)).collect()} == {1, 2}


def archive(**content):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in content.items():
            z.writestr(k.replace("__", "/").replace("DOTS", ".."), v)
    return out.getvalue()


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 100)
    inner = archive(x="deep")
    rows = files.members(table(spark, a=archive(one="1", DOTS__two="2", big="x" * 101, more=inner[:]) if len(inner) <= 100 else archive(one="1", DOTS__two="2", big="x" * 101), b=b"no")).collect()
    got = {(r.path, r.member): (r.state, r.content and bytes(r.content)) for r in rows}
    assert got["a", "one"] == ("ok", b"1") and got["a", "../two"] == ("outside", None) and got["a", "big"] == ("too large", None) and got["b", ""] == ("no archive", None)
    monkeypatch.setattr(files, "MOST_BYTES", 1 << 20)
    assert {(r.member, r.state) for r in files.members(table(spark, a=archive(z=inner))).collect()} == {("z!x", "ok")}


def test_pages_in_html(spark):
    page = "<html><title> A  &amp; B </title><a href='/x'>one <b>two</b></a><img src=s data-src=l srcset='a 1x, b 2x'><img src='q' data-orig-file='o'><a>no</a>"
    got = [(r.kind, r.url, r.text) for r in sorted(files.links(table(spark, p=page, q="")).collect(), key=lambda r: r.place)]
    assert got == [("title", "", "A & B"), ("link", "/x", "one two"), ("image", "b", ""), ("image", "o", "")]


def test_waveforms(spark):
    head = "Title: t\nPlotname: AC\nFlags: {}\nNo. Variables: 2\nNo. Points: {}\nVariables:\n\t0\ttime\ttime\n\t1\tv(out)\tvoltage\n"
    ascii_ = head.format("real", 2) + "Values:\n0\t1.0\n\t2.0\n1\t3.0\n\t4.0\n"
    packed = head.format("complex", 3).encode() + b"Binary:\n" + struct.pack("<8d", 1, 0, 2, -1, 3, 0, 4, 1) + b"\x00" * 5
    rows = files.waveforms(table(spark, a=ascii_ + ascii_, b=packed)).collect()
    a = [(r.plot, r.point, r.vector, r.re) for r in rows if r.path == "a"]
    assert a == [(p, k, n, v) for p in (0, 1) for k, n, v in ((0, "time", 1.0), (0, "v(out)", 2.0), (1, "time", 3.0), (1, "v(out)", 4.0))]
    assert [(r.point, r.vector, r.re, r.im) for r in rows if r.path == "b"] == [(0, "time", 1.0, 0.0), (0, "v(out)", 2.0, -1.0), (1, "time", 3.0, 0.0), (1, "v(out)", 4.0, 1.0)]


def test_designs_and_scans(spark):
    kicad = '(kicad_sch (symbol (lib_id "x") (property "Reference" "R1" (at 0)) (property "Value" "10k")) (symbol (property "Reference" "U1") (property "Value" "TL072")))'
    rows = files.designs(table(spark, a__kicad_sch=kicad, b__sch='<?xml?><eagle><part name="Q1" library="l" value="BC547"/></eagle>', c__asc="SYMBOL npn\nSYMATTR InstName Q2\nSYMATTR Value 2N3904\n", d__cir="* t\nR1 a b 10k\nQ1 c b e BC109\n", e__txt="x")).collect()
    assert sorted((r.format, r.ref, r.value) for r in rows) == [("eagle", "Q1", "BC547"), ("kicad", "R1", "10k"), ("kicad", "U1", "TL072"), ("ltspice", "Q2", "2N3904"), ("spice", "Q1", "BC109"), ("spice", "R1", "10k")]
    xml = "<OBJECT><LINE><WORD coords='1'>a</WORD><WORD>b</WORD></LINE></OBJECT><OBJECT><LINE><WORD>c</WORD></LINE></OBJECT>"
    assert [(r.page, r.line, r.text) for r in files.djvu_lines(table(spark, a=xml)).collect()] == [(1, 0, "a b"), (2, 0, "c")]
    assert [(r.url, r.further) for r in files.sitemap(table(spark, a="<sitemapindex><loc> u </loc></sitemapindex>")).collect()] == [("u", True)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a/x", 1)], "k string, n int")
    assert writers.write_ordered_csv(rows, str(tmp_path / "o"), "k") == 2
    for k in (1, 2):
        writers.replace_atomically(rows.withColumn("n", F.lit(k)), str(tmp_path / "t"))
    assert {r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {2} and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    writers.write_entities(rows, str(tmp_path / "e"), "k")
    assert sorted(p.name for p in (tmp_path / "e").iterdir() if p.is_dir()) == ["entity=a%2Fx", "entity=b"]
    report = writers.markdown(rows.orderBy("k"), "Report")
    assert report.splitlines() == ["# Report", "", "| k | n |", "|-|-|", "| a/x | 1 |", "| b | 2 |"]
    writers.append(rows, str(tmp_path / "log"))
    writers.append(rows.withColumn("n", F.col("n") + 5), str(tmp_path / "log"))
    assert sorted(map(tuple, writers.last_lines(spark.read.parquet(str(tmp_path / "log")).withColumn("seq", F.col("n")), ["k"], "seq").select("k", "n").collect())) == [("a/x", 6), ("b", 7)]
