"""Packing by concatenation and cutting.

Pass one turns each text into token ids and counts them as the partition goes by: a row gets its offset within the partition,
and the partition a total. Prefix sums over the partition totals (one number a partition) then make every offset global, and
pass two cuts the rows at the multiples of the sequence length. No token row is shuffled. The token rows rest between the
passes in a table in the shared folder, so a lost executor costs the tasks it ran and no more.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, table

#: Words that a Python worker remembers with their ids; beyond it words are encoded anew each time.
REMEMBERED = 300_000
#: Texts that go to a Python worker together.
TEXTS = 2000
#: Characters of texts that are worked on together; one longer text is worked on by itself.
TOGETHER = 1 << 21
TOKENS = "pid int, at long, doc_id long, doc_tokens long, starts long, ids binary"
#: White space other than single blanks and line ends between words: such texts are encoded whole.
UNEVEN = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def worker_state(key: str, make):
    """make() once for each Python worker and key: tasks of a worker share it."""
    state = sys.modules.setdefault("_factloom_worker", types.ModuleType("_factloom_worker"))
    if key not in state.__dict__:
        state.__dict__[key] = make()
    return state.__dict__[key]


def byte_rows(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Rows of unsigned 32-bit values, each up to its end, over one buffer."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data, "<u4"))]).cast(pa.binary())


class TextEncoder:
    """Ids of texts by a tokenizer of the `tokenizers` library, as it gives them for whole texts without special tokens added.

    A byte-level tokenizer with the usual word pattern never joins a word to what stands before the space or line end in
    front of it. For such a tokenizer, texts whose words stand one space or line end apart are put together from the ids of
    their distinct words, which are remembered: a batch is split and its words numbered by Arrow, only words that are new are
    encoded, and the ids are gathered by offset. All other texts, those that hold a token added to the vocabulary, and
    other tokenizers are encoded whole.
    """

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads; more would hold memory of their own
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        parts = json.loads(spec)
        before = parts.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in parts.get("added_tokens") or []]
        self.by_word = not parts.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        # Every text is read as if a line end stood before it, so that its first word is like any line's; that id goes again.
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_word = self.by_word and len(self.line_end) == 1 and self.tokenizer.encode("\na", add_special_tokens=False).ids[:1] == self.line_end
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids whose bytes begin with a blank
        self.blank[[x for token, x in vocabulary.items() if token[:1] == "\u0120"]] = True
        # Slot 0 is the empty word, which has no ids.
        self.most, self.known, self.slots, self.used = remembered, {"": 0}, 1, 0
        self.begins, self.counts, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Ids of the words one after the other and how many there are of each: a blank stands before a word, unless a line
        end opens it. Words are encoded many together: each begins with the one id that is a blank's or the line end."""
        parts = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 1 << 13):
            together = ["".join(words[k : k + 256]) for k in range(at, min(at + (1 << 13), len(words)), 256)]
            parts.append(np.fromiter(chain.from_iterable(self.whole(together)), np.uint32))
        ids = np.concatenate(parts)
        first = np.flatnonzero(ids == self.line_end[0] if words[0][0] == "\n" else self.blank[ids])
        return ids, np.diff(np.append(first, len(ids)))

    def slots_of(self, words: list[str]) -> np.ndarray:
        """Slot of each of the distinct words; those not remembered have theirs until the next call."""
        slot = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        if not len(new):
            return slot
        line = np.fromiter((words[k][0] == "\n" for k in new), bool, len(new))
        at = np.concatenate([new[line], new[~line]])
        parts = [self.learn(x) for x in ([words[k] for k in new[line]], [" " + words[k] for k in new[~line]]) if x]
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends, slots = self.used + np.cumsum(counts), self.slots + len(at)
        if ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(int(ends[-1]), np.uint32)])
        if slots > len(self.counts):
            self.begins, self.counts = (np.concatenate([x, np.zeros(slots, np.int64)]) for x in (self.begins, self.counts))
        self.pool[self.used : ends[-1]] = ids
        self.begins[self.slots : slots], self.counts[self.slots : slots] = ends - counts, counts
        slot[at] = np.arange(self.slots, slots)
        if len(self.known) < self.most:
            self.known.update(zip([words[k] for k in at], range(self.slots, slots), strict=True))
            self.slots, self.used = slots, int(ends[-1])
        return slot

    def plain(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of evenly spaced texts one after the other, end_id after each, and where each ends."""
        pieces = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", texts, "\n"), "\n", " \n"), " ")
        sizes = pieces.value_lengths().to_numpy().astype(np.int64)
        numbered = pieces.flatten().dictionary_encode()
        slot, at = self.slots_of(numbered.dictionary.to_pylist()), numbered.indices.to_numpy()
        begins, counts = self.begins[slot][at], self.counts[slot][at]
        ends = np.cumsum(counts)
        total = int(ends[-1])
        ids = self.pool[np.repeat(begins - (ends - counts), counts) + np.arange(total)]
        text_ends = ends[np.cumsum(sizes) - 1]
        out = np.empty(total, np.uint32)
        out[:-1] = ids[1:]
        out[text_ends - 1] = end_id  # in the place of the line end that stood before the next text
        return out, text_ends

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (no nulls) one after the other, end_id after each, and where each ends."""
        even = np.zeros(len(texts), bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, UNEVEN)
            for content in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, content))
            even = ~odd.to_numpy(zero_copy_only=False)
        if even.all() and len(even):
            return self.plain(texts, end_id)
        rows: list[np.ndarray | None] = [None] * len(texts)
        if even.any():
            out, ends = self.plain(texts.filter(pa.array(even)), end_id)
            for k, ids in zip(np.flatnonzero(even).tolist(), np.split(out, ends[:-1]), strict=True):
                rows[k] = ids
        rest = np.flatnonzero(~even).tolist()
        for k, ids in zip(rest, self.whole(texts.filter(pa.array(~even)).to_pylist()), strict=True):
            rows[k] = np.array([*ids, end_id], np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([len(x) for x in rows], dtype=np.int64)


def in_portions(batch: pa.RecordBatch, column: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, some together as long as their texts have no more than `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096], dtype=np.int64), most, side="right")))
        yield batch.slice(at, end - at)
        at = min(end, batch.num_rows)


def token_rows(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Pass one: ids of each row with end_id after them, and where they start among the partition's."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_state("encoder" + str(hash(spec.value)), lambda: TextEncoder(spec.value))
        pid, at, starts = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in in_portions(batch, 1):
                rows = part.num_rows
                ids, ends = encoder.encode(pc.fill_null(part.column(1), ""), end_id)
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.record_batch(
                    [pa.array(np.full(rows, pid, np.int32)), pa.array(np.arange(at, at + rows)), part.column(0), pa.array(ends - begins), pa.array(starts + begins), byte_rows(ids, ends)],
                    names=["pid", "at", "doc_id", "doc_tokens", "starts", "ids"],
                )
                at, starts = at + rows, starts + int(ends[-1])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, TOKENS)


def cut(rows: DataFrame, length: int) -> DataFrame:
    """Pass two: rows of doc_id, doc_tokens, begins (global offset) and ids, cut at the multiples of length, in the JVM."""
    first, last = F.expr(f"begins div {length}"), F.expr(f"(begins + doc_tokens - 1) div {length}")
    rows = rows.select("doc_id", "doc_tokens", "begins", "ids", F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.lit(0).cast("bigint"), F.col("sequence_id") * length - F.col("begins"))
    rows = rows.withColumn("start", start)
    rows = rows.withColumn("length", F.least("doc_tokens", (F.col("sequence_id") + 1) * length - F.col("begins")) - F.col("start"))
    ids = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return rows.select("doc_id", "start", "length", "doc_tokens", "sequence_id", ((F.col("begins") + F.col("start")) % length).alias("offset"), ids.alias("ids"))


def pack(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    Sequences are filled one after the other in the order of the rows, so only the last one needs padding. Null or empty
    text: end_id alone. Null or repeated doc_id: each row is a document of its own. Empty table: no piece. Further columns
    are not read. A text that holds a token of the vocabulary that was added to it gets that token's id, as from a plain
    call of the tokenizer. Only the tokenizer's own file and one total for each partition go to the driver or to all executors.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.write(token_rows(docs, tokenizer_json, id_col, text_col, end_id), "tokens", TEXTS)
    totals = rows.groupBy("pid").agg(F.sum("doc_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("pid", before.alias("base"))  # as many rows as the input has partitions
    return cut(rows.join(F.broadcast(bases), "pid").withColumn("begins", F.col("base") + F.col("starts")), length)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Content of a public tokenizer's file."""
    import public_tokenizers
    from pathlib import Path

    return Path(public_tokenizers.path(name)).read_text()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every piece of all documents with the CRC-32 of its ids."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
