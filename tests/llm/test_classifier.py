"""The quality classifier: accuracy on documents whose labels it does not see, and each step against plain loops."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import classifier as C
from factloom.llm.classifier import quality_scores
from factloom.llm.common import Scratch


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = quality_scores(docs, seen).join(unseen.withColumn("good", F.expr("quality = 1 and toxic = 0")), "doc_id").collect()
    right = sum(r.kept == r.good for r in rows) / len(rows)
    clean = [r.kept for r in rows if r.good]
    assert right > 0.85 and sum(clean) / len(clean) > 0.95
    assert all(0 <= x <= 1 for r in rows for x in (r.content_score, r.meta_score, r.score))


GOOD, BAD = "river stone meadow harvest lantern orchard".split(), "winbig casino pills cheap jackpot viagra".split()


def made(n=240):
    """Texts of good or bad words; sources that lean one way; labels for a third."""
    out = []
    for k in range(n):
        good = k % 3 > 0
        words = [(GOOD if good else BAD)[(k * 7 + i * i) % 6] for i in range(12 + k % 5)] + [f"n{k % 11}", "the", "of"]
        out.append((k, " ".join(words) + ("!" * 3 if not good else "."), ("press" if good else "spam") + str(k % 2), "en", 3.0, good))
    return out


@pytest.fixture(scope="module")
def small(spark):
    rows = made()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(None, "winbig casino", "spam1", "en", 1.0), (5, None, None, None, None)], "doc_id long, text string, source string, lang string, _chosen double").repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[5]), 0) for r in rows if r[0] % 4 == 1], "doc_id long, quality int, toxic int")
    scratch = Scratch(spark, "test")
    features = scratch.write(C.features(docs, "doc_id", "text", "source", "lang", "n_chars"), "f")
    return docs, labels, features, scratch


def test_counts_of_documents_cover_all(spark, small):
    docs, _, features, _ = small
    want = {}
    for r in docs.collect():
        for w in set(re.findall(r"\w+", (r.text or "").lower())):
            want[w] = want.get(w, 0) + 1
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(C.BUCKETS)).alias("b")).collect()}
    held = C.document_counts(features)
    total = np.zeros(C.BUCKETS, np.int64)
    for w, n in want.items():
        total[bucket[w]] += n
    assert held.tolist() == total.tolist()


def plain_logit(row, model, name):
    if name == "meta":
        return sum(model["meta"][b] for b in row.meta) + model["meta"][-1]
    values = [(1 + math.log(n)) * model["rarity"][a] for a, n in zip(row["at"], row["n"], strict=True)]
    length = max(math.sqrt(sum(v * v for v in values)), 1e-12)
    words = sum(v / length * model["content"][a] for v, a in zip(values, row["at"], strict=True))
    return words + sum(x * model["content"][C.BUCKETS + j] for j, x in enumerate(row.made)) + model["content"][-1]


def test_rounds_and_scores_equal_plain_loops(spark, small):
    """A round's sure documents are those of all unlabelled ones whose plain score says so; final scores are the plain formula's."""
    docs, labels, features, scratch = small
    marks = C.marks_of(labels)
    model = C.co_train(features, marks, 4000, 20, 2, C.CELLS, scratch)
    rows, chance = features.collect(), lambda z: 1 / (1 + math.exp(-z))
    sure = {(r.doc_id, r.key, r["view"], r.y) for r in C.confident(features, model).collect()}
    want = set()
    for r in rows:
        for k, name in enumerate(C.VIEWS):
            p = chance(plain_logit(r, model, name) * model["each"][k][0] + model["each"][k][1])
            if r.doc_id is not None and not 1 - C.SURE <= p <= C.SURE:
                want.add((r.doc_id, r.key, k, int(p > 0.5)))
    assert sure == want and {v for _, _, v, _ in sure} == {0, 1}
    plain = []
    for r in rows:
        z = [plain_logit(r, model, name) * model["each"][k][0] + model["each"][k][1] for k, name in enumerate(C.VIEWS)]
        plain.append((str(r.doc_id), round(chance(z[0] * model["both"][0] + z[1] * model["both"][1] + model["both"][2]), 9)))
    got = C.scored(features, model).collect()
    assert sorted(plain) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    truth = {r[0]: r[5] for r in made()}
    unseen = [r for r in got if r.doc_id is not None and r.doc_id % 4 != 1 and r.doc_id != 5]
    assert sum(r.kept == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97


def test_views_are_separate(small):
    """A view sees nothing of what the other does: other metadata leave the text's view as it is, other texts the page's."""
    docs, _, _, _ = small
    seen = lambda d: C.features(d, "doc_id", "text", "source", "lang", "n_chars").where("doc_id <> 5").orderBy("doc_id").toArrow()
    docs = docs.withColumn("n_chars", F.lit(9))
    a, b, c = (C.views_of(seen(d), np.ones(C.BUCKETS)) for d in (docs, docs.withColumn("source", F.lit("x")), docs.withColumn("text", F.reverse("text"))))
    same = lambda v, w: all(np.array_equal(getattr(v, k), getattr(w, k)) for k in ("row", "column", "value"))
    assert same(a["content"], b["content"]) and not same(a["meta"], b["meta"])
    assert same(a["meta"], c["meta"]) and not same(a["content"], c["content"])


def test_one_bad_label_in_forty(spark):
    """The rarer class may have a handful of rows."""
    rows = made()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[5]), 0) for r in rows if r[0] in (0, 9) or (r[5] and r[0] < 120)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len({r.score for r in got}) > 10
    assert quality_scores(docs, labels, labelled=20, cells=30).count() == len(rows)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, None, None, 2.0), (1, "", "s", "en", 2.0), (None, "a b", "s", "en", 2.0)], "doc_id long, text string, source string, lang string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert [(r.score, r.kept) for r in rows] == [(0.5, True)] * 3
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_very_long_text_and_repeated_labels(spark):
    rows = [(k, ("good words here " if k % 2 else "cheap pills now ") * 5, "s", "en") for k in range(30)] + [(31, "cheap pills " * 100_000, "s", "en"), (1, "good words here " * 5, "s", "en"), (1, "good again", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] * 2, "doc_id long, quality int, toxic int")
    a, b = ({(r.doc_id, round(r.score, 9)) for r in quality_scores(d, labels).collect()} for d in (docs, docs.repartition(5)))
    assert a == b and [s < 0.5 for d, s in a if d == 31] == [True]
