"""Pages of PDF files as rows: (path, page_num, text, error), read by tasks from whatever store Spark reads.

Read are files with a text layer: objects in the file or in object streams, contents as they are or deflated, simple fonts, and fonts
whose characters are named by a ToUnicode map. A file that cannot be read is one row that says why; pages without text have an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"^(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = rb"(\d+)\s+\d+\s+R"
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}
PAGES = "path string, page_num int, text string, error string"


class Document:
    """Objects by number, and the pages' texts in their order."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        if b"%%EOF" not in data[-2048:]:
            raise ValueError("the file is cut short")
        self.objects = {int(m[1]): m[3].strip() for m in OBJECT.finditer(data)}
        for body in [x for x in self.objects.values() if b"/ObjStm" in x[:400]]:
            head, packed = self.stream(body)
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"N", b"First"))
            places = list(map(int, packed[:first].split()))[: 2 * n]
            ends = [first + x for x in places[3::2]] + [len(packed)]
            for number, at, end in zip(places[::2], places[1::2], ends, strict=False):
                self.objects.setdefault(number, packed[first + at : end].strip())
        if b"/Encrypt" in data and re.search(rb"/Encrypt\s+" + REFERENCE, data):
            raise ValueError("encrypted")

    def stream(self, body: bytes) -> tuple[bytes, bytes]:
        found = STREAM.match(body)
        if not found:
            return body, b""
        return found[1], zlib.decompressobj().decompress(found[2]) if b"/FlateDecode" in found[1] else found[2]

    def value(self, body: bytes, key: bytes) -> bytes:
        """The object or text that a key of a dictionary leads to; empty if there is none."""
        found = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(?:" + REFERENCE + rb"|(\[.*?\]|<<.*|/?[^\s/<>\[\]]+))", body, re.S)
        return b"" if not found else self.objects.get(int(found[1]), b"") if found[1] else found[2]

    def pages(self) -> list[bytes]:
        roots = [x for x in self.objects.values() if re.search(rb"/Type\s*/Catalog", x)]
        out: list[bytes] = []
        todo, seen = [(0, self.value(x, b"Pages")) for x in roots[-1:]], set()
        while todo:
            number, body = todo.pop()
            if number in seen:
                continue
            seen.add(number)
            if re.search(rb"/Type\s*/Pages", body):
                kids = [int(k) for k in re.findall(REFERENCE, self.value(body, b"Kids"))]
                resources = re.search(rb"/Resources\s*(?:" + REFERENCE + rb"|<<.*)", body, re.S)
                inherit = lambda x: x if not resources or b"/Resources" in x else x + b" " + resources[0]  # noqa: E731, B023
                todo += [(k, inherit(self.objects.get(k, b""))) for k in reversed(kids)]
            else:
                out.append(body)
        return out

    def maps(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]] | None]:
        """For each font's name the bytes of a character and what characters stand for; None for fonts whose bytes are characters."""
        fonts = self.value(self.value(page, b"Resources") or page, b"Font")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>]+)\s+" + REFERENCE, fonts):
            body = self.objects.get(int(number), b"")
            _, cmap = self.stream(self.value(body, b"ToUnicode")) if b"/ToUnicode" in body else (b"", b"")
            out[name] = character_map(cmap, 2 if b"/Type0" in body else 1) if cmap else None
        return out

    def text(self, page: bytes) -> str:
        contents = re.search(rb"/Contents\s*(\[.*?\]|" + REFERENCE + rb")", page, re.S)
        parts = [self.stream(self.objects.get(int(n), b""))[1] for n in re.findall(REFERENCE, contents[1])] if contents else []
        return shown(b"\n".join(parts), self.maps(page))


def character_map(cmap: bytes, width: int) -> tuple[int, dict[int, str]]:
    spaces = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    width, out = len(spaces[1]) // 2 if spaces else width, {}
    said = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = said(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, z, b, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            names = re.findall(rb"<([0-9A-Fa-f]+)>", many) if many else [b"%0*x" % (len(b), int(b, 16) + i) for i in range(int(z, 16) - int(a, 16) + 1)]
            out.update({int(a, 16) + i: said(x) for i, x in enumerate(names)})
    return width, out


def shown(content: bytes, maps: dict) -> str:
    """What a content stream shows, a line for each that it begins."""
    out: list[str] = []
    held: list[bytes] = []
    font = None
    for token in TOKEN.findall(content):
        if token[:1] in b"(</[]-+.0123456789" and token not in (b"'", b'"'):
            held.append(token)
            continue
        if token == b"Tf" and len(held) > 1:
            font = maps.get(held[-2][1:])
        elif token in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0 or token in (b"T*", b"Tm", b"ET", b"'", b'"'):
            out.append("\n")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for x in held:
                if x[:1] in b"(<":
                    out.append(said(x, font))
                elif token == b"TJ" and x[:1] in b"-" and float(x) < -200:  # a gap that is drawn as one
                    out.append(" ")
        held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def said(token: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if token[:1] == b"(":
        raw = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else NAMED.get(m[1], m[1]), token[1:-1])
    else:
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if font is None:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width, names = font
    return "".join(names.get(int.from_bytes(raw[i : i + width]), "") for i in range(0, len(raw), width))


def read_pages(data: bytes) -> list[str]:
    document = Document(data)
    pages = [document.text(p) for p in document.pages()]
    if not pages:
        raise ValueError("no pages")
    return pages


def pages(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """PAGES of all files below folder with this suffix (any case); of a file that cannot be read one row, with its error alone.

    Files of no bytes give no row, as in all of Spark's readers. A file is one task's at a time, and one Arrow batch's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.lower("path").endswith(suffix)).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(path, i + 1, t, None) for i, t in enumerate(read_pages(content.as_py()))]
                except Exception as e:  # a damaged file is a row, not the end of the run
                    rows = [(path, None, None, str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "page_num", "text", "error"])

    return files.mapInArrow(read, PAGES)


def documents(rows: DataFrame) -> DataFrame:
    """path, pages (page_num, text), full_text: of files that were read, the pages in order, and those that are not blank joined by line ends."""
    listed = rows.filter(F.col("error").isNull()).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("pages"))
    solid = F.filter(F.transform("pages", lambda p: p["text"]), lambda t: trim_ws(t) != "")
    return listed.withColumn("full_text", trim_ws(F.array_join(solid, "\n")))
