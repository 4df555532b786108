"""Language identification by its accuracy on held-out documents."""

import math
import unicodedata
from collections import Counter

from factloom.llm import language
from factloom.llm.language import BUCKETS, counts_of, held_out, identify_languages, op2_language_id, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_edge_cases(spark):
    rows = [(k, "the cat and the dog" if k % 2 else "der hund und die katze", "en" if k % 2 else "de") for k in range(40)]
    rows += [(None, "the dog", None), (100, None, "en"), (101, "12 !!", "fr"), (102, "", None), (103, "x" * 600_000, None), (5, "the cat", "en")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, bucket int, held_out boolean")
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (100, 101, 102))
    assert {r.lang_pred for r in got if r.doc_id is None} == {"en"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in identify_languages(df.withColumn("lang", df["lang"].substr(9, 1)).where("lang = 'x'")).collect()} == set()
    assert identify_languages(df.limit(0)).count() == 0


def plain_counts(text):
    """n-grams of the text's letters, each border one blank, hashed one by one."""
    low, seq = text.lower(), []
    for c in low:
        x = ord(c) if unicodedata.category(c)[0] in "LM" else 32
        if x != 32 or not seq or seq[-1] != 32:
            seq.append(x)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(seq) - n + 1):
            h = 0
            for x in seq[i : i + n]:
                h = (h * 0x100000001B3 & (1 << 64) - 1) ^ x
            out[((h ^ n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50] += 1
    return out


TEXTS = ["", "a", "ab c", "“Quoted” text … ¿qué? 12", "é" * 7, "हिन्दी भाषा", " lead and trail ", "a1b2c3" * 9, "x\ny\tz!"]


def test_counts_equal_plain_ones(monkeypatch):
    for size in (1 << 18, 1, 2, 3, 7):
        monkeypatch.setattr(language, "SLICE", size)
        for text in TEXTS:
            assert {k: n for k, n in enumerate(counts_of(text).tolist()) if n} == plain_counts(text)


def test_scores_equal_plain_bayes(spark):
    """Every score from counts in a dictionary; in one block of languages and in several."""
    langs = ["de", "en", "es", "fr", "it", "nl", "pl"]
    rows = [(k, f"{langs[k % 7] * 2} {chr(97 + k % 7) * 3} {TEXTS[k % len(TEXTS)]} the word {k % 5}", langs[k % 7] if k % 10 else None) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in df.where(held_out(df["doc_id"])).collect()}
    counts, docs = {x: Counter() for x in langs}, Counter()
    for k, text, lang in rows:
        if lang and k not in held:
            counts[lang].update(plain_counts(text))
            docs[lang] += 1
    whole = {x: sum(counts[x].values()) + BUCKETS for x in langs}
    want = {}
    for k, text, _ in rows:
        sums = [math.log(docs[x] / sum(docs.values())) + sum(n * math.log((counts[x][b] + 1) / whole[x]) for b, n in plain_counts(text).items()) for x in langs]
        best = max(range(7), key=lambda i: (sums[i], -i))
        want[k] = (langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums))
    for cells in (language.MOST_CELLS, 3 * BUCKETS, BUCKETS):
        got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(df, most_cells=cells).collect()}
        assert all(got[k][0] == w[0] and abs(got[k][1] - w[1]) < 1e-4 for k, w in want.items())
    assert [len(names) for names, _, _ in train(df.where("lang is not null").select("lang", "text"), 3 * BUCKETS)] == [3, 3, 1]
