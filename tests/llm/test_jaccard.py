"""The Jaccard join against all pairs."""

import random
import re

import pytest

from factloom.llm.graph import connected_components
from factloom.llm.jaccard import jaccard_classes, keep_one


def brute(rows, threshold=0.8):
    """(doc_id, class_id, n_links) of rows (doc_id, text), by all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **settings):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df, **settings).collect()), key=str)


def made(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 25])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("settings", [{}, {"bucket": 8, "depth": 2}])
def test_equals_all_pairs(spark, settings):
    rows = made()
    rows += [(1000, None), (1001, ""), (1002, " \n"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (2000, "a b"), (2001, "a b")]
    df = spark.createDataFrame([(*r, 1, "s", "x") for r in rows], "doc_id long, text string, sid long, cell string, tk string")
    assert got(df, **settings) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (None, "q r s t u")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _k1 string")
    assert sorted(keep_one(df).collect(), key=str) == sorted([r for r in df.distinct().collect() if r.doc_id != 3], key=str)
    assert keep_one(df.limit(0)).count() == 0 and jaccard_classes(df.limit(0)).count() == 0


def test_null_and_repeated_ids_are_classes_of_their_own(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r"), (7, "s t u v w x"), (7, "y z a1 b1 c1 d1"), (None, ""), (None, None), (8, " ")]
    df = spark.createDataFrame(rows + [(None, "a b c d e f"), (9, "s t u v w x")], "doc_id long, text string")
    assert sorted(map(tuple, keep_one(df).collect()), key=str) == sorted(rows, key=str)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (None, 3), (7, 7), (200, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 200: 200}


def test_recall_of_a_group_that_no_step_splits(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(124)]
    rows = []
    for k in range(120):  # one word changed in each: any two texts have about 0.85, and every bucket stays above 8
        at = rng.randrange(4, 120)
        rows.append((k, " ".join([*base[:at], f"own{k}", *base[at + 1 :]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, bucket=8) == brute(rows)


def test_target_recall():
    from factloom.llm import jaccard

    for threshold, depth in ((0.8, 2), (0.8, 6), (0.5, 2)):
        assert (1 - threshold**depth) ** jaccard.runs_for(threshold, depth) <= 5e-6
    assert (jaccard.runs_for(0.8, jaccard.DEPTH), jaccard.runs_for(0.8, 6)) == (12, 41)


def test_sets_that_share_a_key_are_told_apart(spark, monkeypatch):
    from factloom.llm import jaccard

    real = jaccard.set_key
    monkeypatch.setattr(jaccard, "set_key", lambda tokens: real(tokens) & 7)
    rows = made(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[2000:])), (3, " ".join(words[:40_000])), (4, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
