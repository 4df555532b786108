"""Sharding against splitting one bucket at a time."""

import hashlib

from factloom.llm.sharding import shards


def plain(rows, limit):
    out, todo = {}, [("", rows)]
    while todo:
        prefix, held = todo.pop()
        if sum(n for _, n, _ in held) <= limit or len(held) == 1:
            for k, _, _ in held:
                out[k] = (prefix, sum(n for _, n, _ in held), len(held))
        else:
            for bit in "01":
                part = [r for r in held if r[2][len(prefix)] == bit]
                if part:
                    todo.append((prefix + bit, part))
    return out


def test_equals_plain_splitting(spark):
    rows = [(k, "é" * (k * 13 % 70)) for k in range(300)] + [(400, "x" * 5000), (401, None)]
    bits = [(k, len(t.encode()) if t else 0, f"{int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16):060b}") for k, t in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bits string, depth int")
    got = {r.doc_id: (r.shard_id, r.shard_bytes, r.shard_docs) for r in shards(df, limit=600).collect()}
    assert got == plain(bits, 600)
    assert all(len(p) == 0 for p, _, _ in {r.doc_id: (r.shard_id, 0, 0) for r in shards(df).collect()}.values())


def test_a_hot_key_splits_on(spark):
    rows = [(7, "x" * 100)] * 60 + [(None, "y" * 10)] * 3 + [(8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = shards(df, limit=1000).collect()
    sizes = {}
    for r in found:
        sizes[r.shard_id] = sizes.get(r.shard_id, 0) + r.n_bytes
    assert len(found) == len(rows) and max(sizes.values()) <= 1000 and all(sizes[r.shard_id] == r.shard_bytes for r in found)
    assert shards(df.limit(0)).count() == 0


def test_equals_sql_under_a_limit_that_splits(spark):
    """The query's own SQL, with a limit of 64 kB in place of 64 MB, so that 2.4 MB of documents make some fifty shards."""
    import duckdb

    from factloom.llm.sharding import LIMIT, ORACLE, oracle

    path = "/root/testdata/sf0.01/documents.parquet"
    want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'").execute(oracle(1 << 16)).fetchall()
    got = [tuple(r) for r in shards(spark.read.parquet(path), limit=1 << 16).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r[2] for r in got}) > 30
    assert oracle(LIMIT) == ORACLE
