"""Substring dedup against a dictionary of all windows."""

import random
import re

from factloom.llm.substring import dedup_substrings, levels


def brute(rows, window=13):
    least, split = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (doc_id, _), w in zip(rows, split, strict=True):
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                x = tuple(w[i : i + window])
                least[x] = min(doc_id, least.get(x, doc_id))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and least.get(tuple(w[i : i + window]), doc_id) < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(df, **settings):
    return sorted(map(tuple, dedup_substrings(df, **settings).collect()), key=str)


def test_levels_double():
    assert levels(13) == [7, 13] and levels(50) == [7, 13, 25, 50] and levels(4) == [4]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 60]))] for _ in range(6)]
    rows = [(None, " ".join(passages[3])), (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "x " * 40), (6, "x " * 13)]
    for k in range(60):
        parts = [[rng.choice(words) for _ in range(rng.randrange(30))] for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((10 + k // 2, " \n".join(" ".join(p) for p in parts)))
    rows += [rows[-1], rows[-1], (500, rows[-1][1])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, k long, h string")
    assert got(df) == brute(rows)
    assert got(df, filter_bits=8) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(df.where("doc_id < 5")) == brute([r for r in rows if r[0] and r[0] < 5])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With first hashes of five bits nearly all windows clash; the second hash keeps words that are not repeated."""
    from factloom.llm import substring

    real = substring.standing
    monkeypatch.setattr(substring, "standing", lambda words, length, window: real(words, length, window) & substring.np.uint64(31))
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(40))) for k in range(30)]
    rows += [(40, rows[3][1] + " tail"), (41, "head " + rows[7][1][:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows) and sum(r[2] for r in brute(rows)) > 0


def test_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, text), (2, "x " + text[500_000:600_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
