"""Texts of PDF files, page by page.

Files are read by Spark as bytes, so any path that Spark reads will do, and each is taken apart in a task: objects (also those in
object streams), the tree of pages, their content streams (plain or Flate), and the operators that show text. Codes become
characters by the font's ToUnicode map, else as Windows-1252. What a page draws as an image has no text here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
REF = rb"\s*(\d{1,10})\s+\d{1,5}\s+R\b"
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*+\))*+\))*+\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s<>\[\](){}/%]*|%[^\r\n]*|[-+.\d]+|[A-Za-z'\"*][A-Za-z0-9'\"*]*", re.S)
ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|.)", re.S)
SIMPLE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A shift to the left of more than this many thousandths of the font size, within a shown array, is a space.
SPACE = -200


class Pdf:
    """The objects of a file: number to (body, stream or None). Of several with one number the last counts."""

    def __init__(self, data: bytes) -> None:
        if re.search(rb"/Encrypt\b" + REF, data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        at = 0
        while m := OBJECT.search(data, at):
            end = data.find(b"endobj", m.end())
            body = data[m.end() : end if end >= 0 else len(data)]
            at = m.end() + len(body)
            s = re.search(rb"\bstream\r?\n", body)
            if s:
                begin = m.end() + s.end()
                stop = data.find(b"endstream", begin)
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: s.start()])
                if size and data[(given := begin + int(size[1])) : given + 16].lstrip().startswith(b"endstream"):
                    stop = given
                stop = stop if stop >= 0 else len(data)
                self.objects[int(m[1])] = (body[: s.start()], data[begin:stop])
                at = max(at, stop)
            else:
                self.objects[int(m[1])] = (body, None)
        for body, stream in list(self.objects.values()):
            if stream is not None and re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body, stream)

    def _unpack(self, body: bytes, stream: bytes) -> None:
        raw, first = self._decoded(body, stream), re.search(rb"/First\s+(\d+)", body)
        if not first:
            return
        head = [int(x) for x in raw[: int(first[1])].split()]
        places = [*head[1::2], len(raw) - int(first[1])]
        for number, a, b in zip(head[::2], places, places[1:], strict=False):
            self.objects.setdefault(number, (raw[int(first[1]) + a : int(first[1]) + b], None))

    @staticmethod
    def _decoded(body: bytes, stream: bytes) -> bytes:
        if re.search(rb"/(?:FlateDecode|Fl)\b", body):
            return zlib.decompressobj().decompress(stream)  # what follows the data, such as a line end, is left alone
        if b"/Filter" in body:
            raise ValueError("a stream has an unknown filter")
        return stream

    def stream(self, number: int) -> bytes:
        body, stream = self.objects.get(number, (b"", None))
        return self._decoded(body, stream) if stream is not None else b""

    def value(self, body: bytes, key: bytes) -> bytes:
        """What follows a key: the body of the object that it refers to, else the rest of the body."""
        m = re.search(rb"/" + key + rb"\b", body)
        if not m:
            return b""
        rest = body[m.end() :]
        r = re.match(REF, rest)
        return self.objects.get(int(r[1]), (b"", None))[0] if r else rest

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key refers to: one, or those of its array (in place or an object)."""
        m = re.search(rb"/" + key + rb"\b", body)
        if not m:
            return []
        rest = body[m.end() :]
        r = re.match(REF, rest)
        if r and not self.objects.get(int(r[1]), (b"", b""))[0].lstrip().startswith(b"["):
            return [int(r[1])]
        array = re.match(rb"\s*\[([^\]]*)\]", self.objects[int(r[1])][0] if r else rest)
        return [int(x) for x in re.findall(REF, array[1])] if array else []

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in reading order; resources may come from above."""
        out: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()
        roots = [n for body, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", body) for n in self.refs(body, b"Pages")]
        todo = [(n, b"") for n in reversed(roots)]
        while todo:
            n, above = todo.pop()
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            body = self.objects[n][0]
            own = self.value(body, b"Resources") or above
            kids = self.refs(body, b"Kids")
            if kids:
                todo += [(k, own) for k in reversed(kids)]
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append((body, own))
        return out

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Bytes of a code, and characters by code, of each font with a ToUnicode map."""
        out = {}
        for name, number in re.findall(rb"/([^\s<>\[\](){}/%]+)" + REF, self.value(resources, b"Font").partition(b">>")[0]):
            for n in self.refs(self.objects.get(int(number), (b"", None))[0], b"ToUnicode"):
                out[name] = unicode_map(self.stream(n))
        return out


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    clean = re.sub(rb"<([0-9A-Fa-f\s]*)>", lambda m: b"<" + b"".join(m[1].split()) + b">", cmap)
    codes, size = {}, 1
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", clean, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", part):
            codes[int(a, 16)], size = text(b), max(size, len(a) // 2)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", clean, re.S):
        for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            low, high, size = int(a, 16), int(b, 16), max(size, len(a) // 2)
            if many:
                codes.update(zip(range(low, high + 1), map(text, re.findall(rb"<([0-9A-Fa-f]*)>", many)), strict=False))
            else:
                last = int(c[-4:], 16)
                codes.update({low + i: text(c[:-4] + b"%04X" % ((last + i) & 0xFFFF)) for i in range(min(high - low, 0xFFFF) + 1)})
    return size, codes


def shown(token: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if token[:1] == b"(":
        code = lambda m: SIMPLE[m[1]] if m[1] in SIMPLE else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][0] < 56 else m[1]
        raw = ESCAPE.sub(code, token[1:-1])
    else:
        digits = b"".join(token[1:-1].split())
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if font:
        size, codes = font
        return "".join(codes.get(int.from_bytes(raw[i : i + size]), "") for i in range(0, len(raw), size))
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def content_text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """Shown text; moves to another line are line ends, other moves spaces."""
    out: list[str] = []
    operands: list[bytes] = []
    font, line = None, None
    for token in TOKEN.findall(content):
        first = token[:1]
        if first == b"%":
            continue
        if first in (b"(", b"/", b"[", b"]", b"<", b">") or first in b"+-.0123456789":
            operands.append(token)
            continue
        strings = [t for t in operands if t[:1] == b"(" or t[:1] == b"<" and t[:2] != b"<<"]
        if token == b"Tf" and len(operands) > 1:
            font = fonts.get(operands[-2][1:])
        elif token in (b"T*", b"'", b'"') or token in (b"Td", b"TD") and len(operands) > 1 and operands[-1].strip(b"+-0.") != b"":
            out.append("\n")
        elif token in (b"Td", b"TD", b"ET"):
            out.append(" ")
        elif token == b"Tm" and len(operands) > 5:
            out.append(" " if operands[-1] == line else "\n")
            line = operands[-1]
        if token in (b"Tj", b"'", b'"') and strings:
            out.append(shown(strings[-1], font))
        elif token == b"TJ":
            for t in operands:
                if t in strings:
                    out.append(shown(t, font))
                elif t[:1] in b"+-.0123456789" and _number(t) < SPACE:
                    out.append(" ")
        operands = []
    rows = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in rows if x)


def _number(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        return 0.0


def pages_of(data: bytes) -> list[str]:
    pdf = Pdf(data)
    return [content_text(b"\n".join(pdf.stream(n) for n in pdf.refs(page, b"Contents")), pdf.fonts(resources)) for page, resources in pdf.pages()]


def read_pdf_pages(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, page_num, text, error): the pages of each file from 1 on. A file that can't be read, or has no pages, is one row with the
    reason and no page; others go on. Files of no bytes have no row. A file is one row of bytes in a task, up to the two gigabytes that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    texts, error = pages_of(data), None
                    error = None if texts else "no pages"
                except (ValueError, zlib.error, RecursionError) as e:
                    texts, error = [], str(e)[:200]
                n = max(1, len(texts))
                columns = [pa.array([name] * n), pa.array(range(1, n + 1) if texts else [None], pa.int32()), pa.array(texts or [None], pa.string()), pa.array([error] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "page_num", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("content"))
    return files.mapInArrow(run, "path string, page_num int, text string, error string")
