"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

A secret cannot be foretold from what stands around it. For each string in a sensitive context the scan compresses its
surroundings with and without it, both primed with a dictionary of identifiers of code and of common words; the bytes that it
adds are measured against what random strings of its own alphabet and length add in its place. Names, paths and words compress
against the dictionary or their surroundings; keys cost as much as chance does. Before that a string must be mixed as keys are:
dates, versions and words joined by signs are not. All work is within one text, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.packing import worker_state

#: The kinds of spans, in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

#: A string that may be a key: letters, digits and signs that passwords hold, between letters and digits.
CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9+/_=.!@$%^&*~#-]{10,}[A-Za-z0-9=]"
CANDIDATE_CHARS, WORDY_CHARS = 12, 20
#: Characters of a candidate that must stand in pieces mixed of letters and digits, or of small and capital letters.
MIXED_CHARS = 10
#: Words that make a context sensitive; humps of mixed case count as words.
SENSITIVE = r"(?<![a-z])(?:pass(?:word|wd|phrase|code)?s?|pwd|secrets?|tokens?|(?:api)?keys?|auth(?:orization|entication)?|creds?|credentials?|bearer|private|signature|sessions?|cert(?:ificate)?s?|login)(?![a-z])"
BEFORE, AFTER = 64, 32
#: Added bytes, over those of random strings of the same alphabet, from which a string counts as incompressible.
NOVELTY, DRAWN = 0.85, 4
#: Identifiers common in code and configuration: the dictionary.
IDENTIFIERS = (
    "access_key account address api_key application argument array assert async attribute auth_token authorization await backend base64 "
    "boolean bucket buffer bytes callback certificate channel class client client_id client_secret cluster column commit config "
    "configuration connection const container content context controller cookie counter credentials database datetime debug decode "
    "default delete description destination development directory document element enabled encode encoding encryption endpoint "
    "environment error event example exception execute export extends false filename filter float format function generate github "
    "global handler hash header headers host hostname http https identifier implements import include index initialize input instance "
    "integer interface internal iterator javascript json key label length library listener local localhost logger login manager "
    "message metadata method middleware model module namespace network null number object operation option output package parameter "
    "parent parse password path pattern permission pipeline platform plugin port prefix private process production profile project "
    "property protected protocol provider proxy public python query queue random readonly record redirect region registry release "
    "render repository request require resource response result return root route runtime schema scope script secret secret_key select "
    "sequence server service session settings sha256 signature size socket source stack standard state static status storage stream "
    "string struct subscription success suffix system table target template terminal test thread timeout timestamp token transaction "
    "transform true type undefined unique update upload url user username utils uuid value variable vendor verify version virtual "
    "webhook window workspace www.example.com xml yaml 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def code_dictionary(vocabulary: str | None = None) -> bytes:
    """The dictionary: words of a public tokenizer's vocabulary (path of its file; by default the dealt one), names of Python's
    own modules, and IDENTIFIERS, which stand last, where references to them are shortest."""
    import builtins
    import importlib
    import json
    from pathlib import Path

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    tokens = json.loads(Path(vocabulary).read_text())["model"]["vocab"]
    words = {w for t in tokens if re.fullmatch("[A-Za-z]{4,}", w := t.lstrip("\u0120"))}
    modules = [builtins, *map(importlib.import_module, "os sys re json socket ssl logging threading subprocess http.client urllib.request hashlib unittest datetime email.message".split())]
    names = {n for m in modules for n in dir(m) if not n.startswith("_") and len(n) > 3}
    return f"{' '.join(sorted(words))} {' '.join(sorted(names))} {IDENTIFIERS}".encode()


def mixed_chars(candidate: str) -> int:
    """Characters in pieces (between signs) whose kind of character changes often: twice, and at every seventh place, or more.
    Of a piece with small and capital letters, words (four small letters and more, and a capital before them) do not count."""
    total = 0
    for piece in re.split("[^A-Za-z0-9]+", candidate):
        kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in piece]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
        # Letters alone are mixed only if small and capital ones change as in a key, not as at the humps of words.
        if changes >= max(2, 0.15 * len(piece)) and (0 in kinds or changes >= 0.35 * len(piece)):
            total += len(re.sub("[A-Z]?[a-z]{4,}", "", piece)) if {1, 2} <= set(kinds) else len(piece)
    return total


def drawn_like(candidate: str, count: int = DRAWN) -> list[str]:
    """Random strings with the signs of candidate where it has them, the rest from its own alphabet; always the same ones."""
    letters = [c for c in candidate if c.isalpha()]
    digits = "0123456789" if any(map(str.isdigit, candidate)) else ""
    kinds = [k for k, some in (("abcdef", str.islower), ("ABCDEF", str.isupper)) if any(map(some, letters))]
    if not (digits and all(c in "abcdefABCDEF" for c in letters)):
        kinds = ["abcdefghijklmnopqrstuvwxyz" if k.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for k in kinds]
    alphabet, chance = digits + "".join(kinds), random.Random(candidate)
    return ["".join(chance.choice(alphabet) if c.isalnum() else c for c in candidate) for _ in range(count)]


class Scanner:
    """Finds the spans of secrets in a text: (start, index of the kind, end), sorted; code points, end exclusive."""

    def __init__(self, dictionary: bytes, novelty: float = NOVELTY):
        import zstandard

        self.novelty = novelty
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=12)
        self.compress = zstandard.ZstdCompressor(level=12, dict_data=primed, write_checksum=False, write_content_size=False).compress
        self.assign, self.access, self.hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        self.candidate, self.sensitive, self.hump = re.compile(CANDIDATE), re.compile(SENSITIVE), re.compile("([a-z0-9])([A-Z])")
        self.hex_bytes = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
        inside = re.compile("[A-Za-z+/_=.!@$%^&*~#-]")
        self.candidate_bytes = bytes(48 if 48 <= b < 58 else 120 if b < 128 and inside.match(chr(b)) else 32 for b in range(256))
        self.likely = re.compile(b"(?=[x0]{%d})x*0|x{%d}" % (CANDIDATE_CHARS, WORDY_CHARS))

    def base(self, text: str, raw: bytes) -> list[tuple[int, int, int]]:
        """The fixed patterns. Cheap searches first: most texts hold none of what a pattern needs."""
        found = []
        low = text.lower()
        if "passw" in low or "secret" in low or "token" in low or "api" in low:
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
        if b"x" * HEX_CHARS in raw.translate(self.hex_bytes):
            found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text) if m.end() - m.start() >= HEX_CHARS]
        return sorted(found)

    def in_context(self, text: str, start: int, end: int) -> bool:
        return any(self.sensitive.search(self.hump.sub(r"\1 \2", part).lower()) for part in (text[max(0, start - BEFORE) : start], text[end : end + AFTER]))

    def incompressible(self, text: str, start: int, end: int) -> bool:
        """Whether the string adds as many bytes to its compressed surroundings as chance would."""
        before, after, own = text[max(0, start - BEFORE) : start], text[end : end + AFTER], text[start:end]
        size = lambda middle: len(self.compress((before + middle + after).encode("utf-8", "replace")))
        bare = size("")
        chance = [size(x) - bare for x in drawn_like(own)]
        return (size(own) - bare) * len(chance) >= self.novelty * sum(chance)

    def novel(self, text: str, raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Mixed, incompressible strings in a sensitive context, clear of the base spans."""
        if not self.likely.search(raw.translate(self.candidate_bytes)):
            return []
        found, ends = [], []
        for start, _, end in base:  # starts ascend; ends[i]: how far the spans up to i reach
            ends.append(max(end, ends[-1] if ends else 0))
        starts = [x[0] for x in base]
        for m in self.candidate.finditer(text):
            start, end = m.span()
            if mixed_chars(m[0]) < MIXED_CHARS:
                continue
            k = bisect.bisect_left(starts, end)
            if k and ends[k - 1] > start:
                continue
            if self.in_context(text, start, end) and self.incompressible(text, start, end):
                found.append((start, 3, end))
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        raw = text.encode("utf-8", "replace")
        base = self.base(text, raw)
        return base, self.novel(text, raw, base)


def scanner_on(docs: DataFrame, dictionary: bytes | None, novelty: float):
    """A function that gives a worker's scanner; the dictionary (some 400 kB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(code_dictionary() if dictionary is None else dictionary)
    return lambda: worker_state(f"scanner{novelty}-{hash(shared.value)}", lambda: Scanner(shared.value, novelty))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY, dictionary: bytes | None = None) -> DataFrame:
    """Per row of docs: doc_id, base and novel, arrays of (kind, start, end) by start, then kind.

    Null or empty text: no spans. Null or repeated doc_id: each row by itself. Empty table: empty result. Further columns are
    not read. Texts are scanned whole, in batches of 64.
    """
    scanner_of = scanner_on(docs, dictionary, novelty)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of()
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                both = [scanner.scan(x or "") for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([named(b) for b, _ in both], span), pa.array([named(n) for _, n in both], span)], names=["doc_id", "base", "novel"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(scan, f"doc_id bigint, base {kind}, novel {kind}")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with every span, overlapping ones together, as mask."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[SECRET]", novelty: float = NOVELTY, dictionary: bytes | None = None) -> DataFrame:
    """docs with the secrets in its texts masked; chars_col, if there is one, follows the new text. Other columns stay.

    Null and empty texts stay as they are; repeated rows and null ids are rows like others. Empty table: empty result.
    """
    scanner_of = scanner_on(docs, dictionary, novelty)
    names = docs.columns
    at = names.index(text_col)
    chars = names.index(chars_col) if chars_col in names else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                columns, texts, changed = list(part.columns), part.column(at).to_pylist(), {}
                for i, text in enumerate(texts):
                    if text and (spans := sum(scanner.scan(text), [])):
                        changed[i] = masked(text, spans, mask)
                if changed:
                    columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(texts)], columns[at].type)
                    if chars is not None:
                        old = columns[chars].to_pylist()
                        columns[chars] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], columns[chars].type)
                yield pa.record_batch(columns, names=part.schema.names)

    return docs.mapInArrow(scan, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts of the base kinds, hash of the base spans, and all spans, for all documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    every = F.array_sort(F.transform(F.concat("base", "novel"), order))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans")
    )
