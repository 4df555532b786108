"""Packing: an exact round trip against the tokenizer on whole texts."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from factloom.llm.packing import TextEncoder, pack, tokenizer_file

TEXTS = [
    "Plain words, one space apart.\nNext line's word.", "", " lead", "trail ", "two  spaces", "blank\n\nline", "\n", " \n ", "tab\there \tand\r\nmore", "it's we'll 'tis ''s x's",
    "<|endoftext|> is a token of its own", "é à ü ñ 日本語 текст   nbsp x", "12 345 6a7 ½²", "a b  c", "\x1c x\x85y z", "emoji 😀 ok 👩‍👩‍👧", "line \nend", "line\n start", "!!! ??? ... \"q\"",
    "x " * 3000, "word" * 2000, "a\n" * 50 + "b",
]


def whole(text):
    """The plain call: an added token's own string is that token."""
    return Tokenizer.from_str(tokenizer_file()).encode(text or "", add_special_tokens=False).ids


def encoded(encoder, texts, end_id=0):
    ids, ends = encoder.encode(pa.array(texts), end_id)
    rows = np.split(ids, ends[:-1])
    assert all(x[-1] == end_id for x in rows)
    return [x[:-1].tolist() for x in rows]


def test_encoder_equals_whole_texts():
    assert 50256 in whole(TEXTS[10])
    want = [whole(t) for t in TEXTS]
    for remembered in (0, 5, 10_000):
        encoder = TextEncoder(tokenizer_file(), remembered)
        for _ in range(2):
            assert encoded(encoder, TEXTS) == want
    assert encoded(TextEncoder(tokenizer_file()), [TEXTS[0]] * 3) == [want[0]] * 3


def test_very_long_text():
    text = " ".join(f"w{k % 977}x{k % 13}," for k in range(400_000))
    assert encoded(TextEncoder(tokenizer_file()), ["a", text, "b"]) == [whole(t) for t in ("a", text, "b")]


def test_other_tokenizers_encode_whole():
    spec = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_str(spec)
    assert encoded(TextEncoder(spec), TEXTS[:4]) == [t.encode(x, add_special_tokens=False).ids for x in TEXTS[:4]]


def test_round_trip(spark):
    rows = [*enumerate(TEXTS), (3, "again 3"), (None, "no id"), (99, None)]
    df = spark.createDataFrame([(*r, b"x", 5) for r in rows], "doc_id long, text string, ids binary, pid int").repartition(3)
    pieces = [r for r in pack(df, tokenizer_file(), length=64).collect()]
    by_sequence, docs = {}, {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.length > 0 and r.offset + r.length <= 64
        by_sequence.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or k == max(by_sequence)
    want = sorted((str(d), [*whole(t), 0]) for d, t in rows)
    got = []
    for (d, n), parts in docs.items():
        by_start = {}
        for r in parts:
            by_start.setdefault(r.start, []).append(r)
        if len(by_start[0]) == 1:  # one document of this id and length
            ids = np.concatenate([np.frombuffer(by_start[s][0].ids, "<u4") for s in sorted(by_start)]).tolist()
            assert len(ids) == n
            got.append((str(d), ids))
    assert sorted(got) == want
    assert pack(df.limit(0), tokenizer_file()).count() == 0
