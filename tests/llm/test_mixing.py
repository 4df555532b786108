"""Mixing: targets against a plain water level, and what is taken against them."""

import re

from pyspark.sql import functions as F

from factloom.llm.mixing import SLOPES, due, mix, mixed_rows


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    left, open_, out = share * sum(sizes.values()), dict(zip(names, [weights[k % 3] for k in range(len(names))], strict=True)), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * level >= most * sizes[s]]
        if not full:
            return out | {s: w * level for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


ROWS = [(k, " ".join(["w"] * (k * 7 % 23)), f"s{k % 7}" if k % 11 else None) for k in range(400)] + [(5, None, "s1"), (5, "a b", "s1"), (5, "a b", "s1"), (None, "c", "z"), (9, "\t\n", "empty"), (8, "é", "é"), (7, "é x", "Z")]


def test_plan(spark):
    df = spark.createDataFrame([(*r, 3.0, 1) for r in ROWS], "doc_id long, text string, source string, target double, rank int")
    rows = mix(df).collect()
    sizes = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + size(text)
    want, taken = targets(sizes), {}
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in want)
    key = lambda rows: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rows)
    assert key(rows) == key(mix(df.repartition(5)).collect())
    assert mix(df.limit(0)).count() == 0


def test_due_is_the_integral_turned_around(spark):
    """By sums of the weight 1 + (slope - 1) x over small steps of training."""
    steps = 20_000
    for slope in (2.0, 0.5, 1.0, 5.0):
        spent = [k / 7 for k in range(8)]
        got = [r[0] for r in spark.createDataFrame([(x,) for x in spent], "spent double").select(due(F.col("spent"), F.lit(slope))).collect()]
        for x, share in zip(got, spent, strict=True):
            upto = sum(1 + (slope - 1) * (k + 0.5) / steps for k in range(round(x * steps))) / steps
            assert abs(upto - share * (1 + slope) / 2) < 1e-3


def test_queues_and_order_of_training(spark):
    """before: a plain running sum in hashed order; the rows of the mix: every round of every row, sorted by its position."""
    df = spark.createDataFrame([(k, " ".join(["w"] * (1 + k * 7 % 23)), f"s{k % 5}") for k in range(300)], "doc_id long, text string, source string").repartition(7)
    plan = mix(df).collect()
    rounds = []
    for source in {r.source for r in plan}:
        at = 0
        for r in sorted((r for r in plan if r.source == source), key=lambda r: r.h1):
            assert r.before == at
            at += r.size
            slope = SLOPES[r.rank % 3] - 1
            for k in range(r.passes + (r.rest > 0)):
                spent = min(1.0, (r.before + k * r.source_size) / r.target)
                x = spent if not slope else ((1 + slope * spent * (2 + slope)) ** 0.5 - 1) / slope
                assert k or abs(x - r.position) < 1e-9
                rounds.append((round(x, 9), r["rank"], r.doc_id))
    got = [r.doc_id for r in mixed_rows(df).collect()]
    assert got == [d for _, _, d in sorted(rounds)]
    assert {r.doc_id: r.position for r in mix(df.repartition(3)).collect()} == {r.doc_id: r.position for r in plan}


def test_rows_that_differ_in_another_column_stay_apart(spark):
    rows = [(1, "a b c", "s", {"x": 1}, ["p"]), (1, "a b c", "s", {"x": 2}, ["p"]), (1, "a b c", "s", {"x": 2}, ["q"])] + [(1, "a b c", "s", {"x": 3}, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row map<string,int>, _k1 array<string>")
    got = mixed_rows(df, share=1.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))


def test_very_long_and_empty(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x", "a"), (3, None, "b")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mix(df).collect()}
    assert rows[1].size == 300_000 and rows[3].target == 0 and rows[3].taken == 0
    assert {r.doc_id for r in mixed_rows(df).collect()} == {1, 2}
    assert mixed_rows(df.limit(0)).count() == 0


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, source string, _row string")
    plan = {}
    for r in mix(df).collect():
        plan[(r.doc_id, r.source)] = plan.get((r.doc_id, r.source), 0) + r.taken
    got = {}
    for r in mixed_rows(df).collect():
        assert r._row == "x"
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + size(r.text)
    assert got == {k: v for k, v in plan.items() if v}
