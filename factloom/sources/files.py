"""Readers of whole files (path, content) that keep a state from line to line: one file is one row, files are read side by side."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of an archive's member that are unpacked, and how deep archives may lie in archives.
MOST_BYTES, MOST_DEPTH = 64 << 20, 3


def decoded(content: bytes | None) -> str:
    """Text of bytes: UTF-16 where a mark or many zeros say so, else UTF-8, else CP932, else Latin-1."""
    content = content or b""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    if content[:3] == b"\xef\xbb\xbf":
        content = content[3:]
    if len(content) > 3 and content[1:64:2].count(0) > len(content[1:64:2]) // 2:
        return content.decode("utf-16-le", "replace")
    for name in ("utf-8", "cp932"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def per_file(files: DataFrame, read: Callable[[str, bytes], list[tuple]], schema: pa.Schema) -> DataFrame:
    """Rows that read gives for each (path, content); the path comes first in them."""
    whole = pa.schema([("path", pa.string()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, *r) for r in read(path, content.as_py() or b"")]
                columns = list(zip(*rows, strict=True)) or [()] * len(whole)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, whole.types, strict=True)], schema=whole)

    from pyspark.sql.pandas.types import from_arrow_schema

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, from_arrow_schema(whole))


def texts(files: DataFrame) -> DataFrame:
    """path and text, whatever the encoding."""
    return per_file(files, lambda _, c: [(decoded(c),)], pa.schema([("text", pa.string())]))


def _definitions(_: str, content: bytes) -> list[tuple]:
    """Models and subcircuits of a netlist library: lines that go on are joined, up to eight lines of comment before a definition
    are kept, a definition inside a subcircuit has it as parent, a file that is encrypted says so once."""
    text = decoded(content)
    if re.search(r"(?im)^\s*[*$]*\s*(encrypt|cdnenc|begin_protected)", text):
        return [(None, "file", None, [], {}, None, 1, "", True)]
    lines: list[list] = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.lstrip().startswith("+") and lines and not lines[-1][1].startswith("*"):
            lines[-1][1] += " " + line.lstrip()[1:].strip()
        else:
            lines.append([n, line.strip()])
    out, stack, comment = [], [], []
    for n, line in lines:
        if line.startswith("*"):
            comment = [*comment, line[1:].strip()][-8:]
            continue
        words = re.sub(r"\s*=\s*", "=", line.replace("(", " ").replace(")", " ")).split()
        head = words[0].lower() if words else ""
        params = dict(w.lower().split("=", 1) for w in words if "=" in w)
        if head == ".subckt" and len(words) > 1:
            pins = [w for w in words[2:] if "=" not in w and w.lower() != "params:"]
            out.append((words[1], "subckt", "subckt", pins, params, stack[-1] if stack else None, n, " | ".join(comment), False))
            stack.append(words[1])
        elif head == ".model" and len(words) > 2:
            out.append((words[1], "model", words[2].split("=")[0].lower(), [], params, stack[-1] if stack else None, n, " | ".join(comment), False))
        elif head == ".ends" and stack:
            stack.pop()
        if line:
            comment = []
    return out


def definitions(files: DataFrame) -> DataFrame:
    """path, name, kind, type, pins, params, parent, line, comment, encrypted of every definition."""
    schema = [("name", pa.string()), ("kind", pa.string()), ("type", pa.string()), ("pins", pa.list_(pa.string())), ("params", pa.map_(pa.string(), pa.string())), ("parent", pa.string()), ("line", pa.int32()), ("comment", pa.string()), ("encrypted", pa.bool_())]
    return per_file(files, _definitions, pa.schema(schema))


def _canonical_code(text: str, names: dict[str, str]) -> str:
    """Code without comments, case and spacing, its own names by their place; a model's card with sorted parameters."""
    text = re.sub(r"\n\s*\+", " ", re.sub(r"(?m)^\s*\*.*$|[;$].*$", "", text)).lower()
    out = []
    for line in filter(None, (re.sub(r"\s*([=,()])\s*", r"\1", " ".join(x.split())) for x in text.splitlines())):
        line = " ".join(names.get(w, w) for w in line.split())
        if line.startswith(".model"):
            _, name, rest = (line.replace("(", " ").replace(")", " ").split(None, 2) + [""])[:3]
            kind, *params = rest.split()
            line = " ".join([name, kind, *sorted(p for p in params if not p.endswith("=0"))])
        out.append(line)
    return "\n".join(out)


def _blocks(text: str) -> dict[str, str]:
    """Text of each definition of a file by lower-case name."""
    out: dict[str, str] = {}
    for m in re.finditer(r"(?ims)^\s*\.subckt\s+(\S+).*?^\s*\.ends[^\n]*|^\s*\.model\s+(\S+)[^\n]*(?:\n\s*\+[^\n]*)*", text):
        out.setdefault((m[1] or m[2]).lower(), m[0])
    return out


def _identities(_: str, content: bytes) -> list[tuple]:
    import hashlib

    blocks = _blocks(decoded(content))

    def closure(name: str, seen: list[str]) -> list[str]:
        """What a definition needs, dependencies first, in the order of their names."""
        if name in seen:
            return seen
        path = [*seen]
        for word in sorted(set(re.findall(r"[\w.]+", blocks[name].lower())) - {name}):
            if word in blocks:
                path = closure(word, path) if word not in path else path
        return path if name in path else [*path, name]

    out = []
    for name in blocks:
        try:
            order = closure(name, [])
        except RecursionError:  # definitions that need each other stand alone
            order = [name]
        names = {n: f"@{i}" for i, n in enumerate(order)}
        code = "\n".join(_canonical_code(blocks[n], names) for n in order)
        out.append((name, hashlib.sha1(code.encode()).hexdigest(), len(order)))
    return out


def identities(files: DataFrame) -> DataFrame:
    """path, name, hash and size of the closure of every definition: equal hashes are the same model, whatever it is called and
    however it is set."""
    return per_file(files, _identities, pa.schema([("name", pa.string()), ("hash", pa.string()), ("needs", pa.int32())]))


def _members(path: str, content: bytes, depth: int = 0) -> list[tuple]:
    out = []
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return [("", "no archive", None)]
    for info in archive.infolist():
        name = info.filename.replace("\\", "/")
        if info.is_dir():
            continue
        if name.startswith("/") or ".." in name.split("/") or ":" in name.split("/")[0]:
            out.append((name, "outside", None))
        elif info.file_size > MOST_BYTES:
            out.append((name, "too large", None))
        else:
            with archive.open(info) as f:
                data = f.read(MOST_BYTES + 1)
            if len(data) > MOST_BYTES:
                out.append((name, "too large", None))
            elif data[:4] == b"PK\x03\x04" and depth < MOST_DEPTH:
                out += [(f"{name}!{n}", s, d) for n, s, d in _members(name, data, depth + 1)]
            else:
                out.append((name, "ok", data))
    return out


def members(files: DataFrame) -> DataFrame:
    """path, member, state (ok, outside: would leave its folder, too large, no archive) and content of zip archives, and of
    archives in them."""
    return per_file(files, _members, pa.schema([("member", pa.string()), ("state", pa.string()), ("content", pa.binary())]))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.open = ["link", a["href"].strip(), ""]
            self.out.append(self.open)
        elif tag == "img":
            best = a.get("data-orig-file") or ((a.get("srcset") or "").split(",")[-1].split() or [""])[0] or a.get("data-src") or a.get("data-lazy-src") or a.get("src")
            if best:
                self.out.append(["image", best.strip(), a.get("alt") or ""])
        elif tag == "title":
            self.open = ["title", "", ""]
            self.out.append(self.open)

    def handle_endtag(self, tag):
        if tag in ("a", "title"):
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open[2] += data


def _links(_: str, content: bytes) -> list[tuple]:
    parser = _Links()
    parser.feed(decoded(content))
    return [(k, kind, url, " ".join(text.split())) for k, (kind, url, text) in enumerate(parser.out)]


def links(files: DataFrame) -> DataFrame:
    """path, place, kind (link, image, title), url and text of what a page in HTML holds, in order; of an image its best variant."""
    return per_file(files, _links, pa.schema([("place", pa.int32()), ("kind", pa.string()), ("url", pa.string()), ("text", pa.string())]))


def _waveform(_: str, content: bytes) -> list[tuple]:
    """Plots of a simulator's raw file: in ASCII or packed, real or complex; a last point that is cut off is dropped."""
    out, at, plot = [], 0, 0
    while True:
        m = re.compile(rb"(?s)Title:.*?\n(Binary|Values):\r?\n").search(content, at)
        if not m:
            return out
        head = decoded(m[0])
        field = lambda k: (re.search(rf"(?im)^{k}:\s*(.*)$", head) or ["", ""])[1].strip()  # noqa: B023, E731
        n, points, wide = int(field("No. Variables")), int(field("No. Points") or 0), "complex" in field("Flags").lower()
        names = [x.split()[1] for x in head[head.lower().index("variables:\n") + 11 :].splitlines()[:n]] if "variables:\n" in head.lower() else [str(k) for k in range(n)]
        at = m.end()
        if m[1] == b"Binary":
            size = n * (16 if wide else 8)
            have = min(points, (len(content) - at) // size) if size else 0
            values = struct.unpack(f"<{have * size // 8}d", content[at : at + have * size])
            at += have * size
            numbers = [complex(*values[2 * k : 2 * k + 2]) for k in range(len(values) // 2)] if wide else list(values)
        else:
            end = content.find(b"Title:", at)
            body = content[at : end if end >= 0 else len(content)].decode("latin-1")
            at = end if end >= 0 else len(content)
            number = lambda x: complex(*map(float, x.split(","))) if wide else float(x)  # noqa: B023, E731
            tokens = body.split()
            tokens = [x for k, x in enumerate(tokens) if k % (n + 1)]  # a point's number stands before its values
            numbers = [number(x) for x in tokens]
        for p in range(len(numbers) // n if n else 0):
            for k in range(n):
                x = complex(numbers[p * n + k])
                out.append((plot, p, names[k], x.real, x.imag))
        plot += 1


def waveforms(files: DataFrame) -> DataFrame:
    """path, plot, point, vector, re and im of raw files: long form, so that measuring is aggregation."""
    return per_file(files, _waveform, pa.schema([("plot", pa.int32()), ("point", pa.int32()), ("vector", pa.string()), ("re", pa.float64()), ("im", pa.float64())]))


#: How the formats of design files say what a part is: a part's block, its name and its value in it.
DESIGNS = {
    "kicad": (r'(?s)\(symbol\s.*?\(property "Reference" "([^"]+)".*?\(property "Value" "([^"]*)"', None),
    "kicad legacy": (r"(?ms)^\$Comp$.*?^F 0 \"([^\"]+)\".*?^F 1 \"([^\"]*)\"", None),
    "eagle": (r'<part name="([^"]+)"[^>]*?value="([^"]*)"', None),
    "geda": (r"(?ms)^\{\n(?:(?!^\}).)*?refdes=([^\n]+)(?:(?!^\}).)*?value=([^\n]+)", None),
    "ltspice": (r"(?m)^SYMATTR InstName (\S+)\n(?:SYMATTR (?!Value)[^\n]*\n)*SYMATTR Value ([^\n]+)", None),
    "spice": (r"(?mi)^([RCLDQJMX]\w+)\s+.*?(\S+)\s*$", None),
}


def design_kind(path: str, text: str) -> str | None:
    """The format of a design file by its ending and its first lines."""
    low = path.lower()
    if low.endswith(".kicad_sch") or text.startswith("(kicad_sch"):
        return "kicad"
    if low.endswith(".sch"):
        return "eagle" if "<eagle" in text[:400] else "kicad legacy" if text.startswith("EESchema") else "geda" if text.startswith("v 2") else None
    if low.endswith(".asc"):
        return "ltspice"
    return "spice" if low.endswith((".cir", ".net", ".sp")) and re.search(r"(?mi)^[RCLDQJMX]\w+\s+\S+\s+\S+", text) else None


def _design(path: str, content: bytes) -> list[tuple]:
    text = decoded(content).replace("\r\n", "\n")
    kind = design_kind(path, text)
    return [(kind, k, m[1].strip(), m[2].strip()) for k, m in enumerate(re.finditer(DESIGNS[kind][0], text))] if kind else []


def designs(files: DataFrame) -> DataFrame:
    """path, format, place, ref and value of the parts of design files in six formats; other files give nothing."""
    return per_file(files, _design, pa.schema([("format", pa.string()), ("place", pa.int32()), ("ref", pa.string()), ("value", pa.string())]))


def _djvu(_: str, content: bytes) -> list[tuple]:
    out = []
    for page, body in enumerate(re.findall(r"(?s)<OBJECT\b.*?</OBJECT>", decoded(content)), 1):
        for k, line in enumerate(re.findall(r"(?s)<LINE\b.*?</LINE>", body)):
            out.append((page, k, " ".join(w.strip() for w in re.findall(r"(?s)<WORD\b[^>]*>(.*?)</WORD>", line))))
    return out


def djvu_lines(files: DataFrame) -> DataFrame:
    """path, page, line and text of scans' text layers in XML."""
    return per_file(files, _djvu, pa.schema([("page", pa.int32()), ("line", pa.int32()), ("text", pa.string())]))


def sitemap(files: DataFrame) -> DataFrame:
    """path, url and whether it is a further map, of sitemaps."""
    read = lambda _, c: [(u.strip(), "<sitemapindex" in decoded(c)[:2000]) for u in re.findall(r"(?s)<loc>(.*?)</loc>", decoded(c))]
    return per_file(files, read, pa.schema([("url", pa.string()), ("further", pa.bool_())]))
