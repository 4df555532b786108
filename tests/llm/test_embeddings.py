"""Embedding near-dedup against all pairs."""

import math

import numpy as np

from factloom.llm import embeddings
from factloom.llm.embeddings import linked_pairs, near_vectors


def brute(rows, threshold=0.98):
    def usable(label, v):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            (_, la, a), (_, lb, b) = rows[i], rows[j]
            if usable(la, a) and usable(lb, b) and la == lb and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, links[i], least.get(root(i)), k == least.get(root(i))) for i, (k, _, _) in enumerate(rows)), key=str)


def made():
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        for _ in range(12):
            base = rng.normal(size=40)
            for k in range(rng.choice([1, 2, 9])):
                rows.append((len(rows), label, [float(x) for x in base + rng.normal(size=40) * 0.12 * k / 4]))
    rows += [(900 + k, 1, list(rows[3][2])) for k in range(5)] + [(950, 1, [2 * x for x in rows[3][2]]), (951, None, rows[3][2]), (952, 2, rows[3][2])]
    rows += [(960, 1, None), (961, 1, []), (962, 1, [0.0] * 40), (963, 1, [float("nan")] * 40), (964, 1, [None, 1.0]), (965, 1, [1.0, 2.0]), (966, 1, [2.0, 4.0])]
    rows += [(967, 1, [float("inf"), 1.0]), rows[3], rows[3], (None, 1, rows[0][2]), (968, 1, [-0.0, 1.0]), (969, 1, [0.0, 1.0])]
    return rows


def test_equals_all_pairs(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, nid string, dim int")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_tiles_equal_products():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 64))
    rows = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.2, 0.3)])
    cos = rows @ rows.T / np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(rows, axis=1))
    axes = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cos >= 0.98, 1)), strict=True)}
    for a in (axes, None):
        assert {(int(i), int(j)) for i, j in zip(*linked_pairs(rows, rows, a, 0.98, True), strict=True)} == want
    assert len(want) > 20 and embeddings.BLOCK == 1024


def test_documents_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == brute(rows)


def test_more_axes_and_small_groups(spark, monkeypatch):
    """Cells of three axes and groups of one, two and eight blocks find the same links."""
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    monkeypatch.setattr(embeddings, "MORE_AXES", (2, 4))
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for size in (1, 2 * 2 * 4 * 8 * 40, 64 << 20):
        monkeypatch.setattr(embeddings, "GROUP_BYTES", size)
        assert sorted(map(tuple, near_vectors(df).collect()), key=str) == brute(rows)


def test_axes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_NUMBERS", 100)
    rows = made()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == brute(rows)


def test_components_from_links():
    rng = np.random.default_rng(3)
    component = np.arange(500)
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in ((np.arange(0, 200), np.arange(1, 201)), (rng.integers(0, 500, 60), rng.integers(0, 500, 60)), (np.array([], int), np.array([], int))):
        component = embeddings.joined(component, i, j)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    assert component.tolist() == [root(x) for x in range(500)]
