"""Pages of PDF files made here come back."""

import time
import zlib

import pytest

from kgloom.sources import pdf
from kgloom.sources.pdf import read_pdf_pages


def made(pages, flate=False, packed=False, resources=b"", extra=()):
    """A file of content streams, one page each; packed: all objects without a stream in one object stream."""
    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << %s >> >>" % (b" ".join(b"%d 0 R" % (10 + i) for i in range(n)), n, resources)}
    objects |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (1000 + i) for i in range(n)} | dict(extra)
    streams = {1000 + i: c for i, c in enumerate(pages)}
    out = b"%PDF-1.5\n%\xe2\xe3\n"
    if packed:
        body, head = b"", b""
        for k, v in objects.items():
            head += b"%d %d " % (k, len(body))
            body += v + b" "
        raw = zlib.compress(head + body)
        out += b"5 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(objects), len(head), len(raw), raw)
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items())
    for k, c in streams.items():
        raw, how = (zlib.compress(c), b"/Filter /FlateDecode ") if flate else (c, b"")
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (k, how, len(raw), raw)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Hello \\(World\\)) Tj 0 -14 Td (second\\040line \\351) Tj T* [(ker) -20 (ned) -300 (words)] TJ ET",
    b"% a comment (not shown)\nBT 1 0 0 1 72 700 Tm <48 65786> Tj 1 0 0 1 90 700 Tm (same row) Tj 1 0 0 1 72 680 Tm (nested (one (two)) end) Tj (moved) ' ET",
    b"",
]
TEXTS = ["Hello (World)\nsecond line é\nkerned words", "Hex` same row\nnested (one (two)) end\nmoved", ""]


@pytest.mark.parametrize("flate,packed", [(False, False), (True, False), (True, True)])
def test_pages(flate, packed):
    assert pdf.pages_of(made(PAGES, flate, packed)) == TEXTS
    assert len(pdf.pages_of(made(PAGES * 40, flate, packed))) == 120


def test_unicode_map():
    cmap = b"1 beginbfchar <0041> <03B1> endbfchar 2 beginbfrange <0042> <0044> <4E00> <0050> <0051> [<0066 0069> <D83DDE42>] endbfrange"
    extra = {20: b"<< /Type /Font /ToUnicode 21 0 R >>", 21: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)}
    page = b"BT /F1 9 Tf <0041 0042 0043> Tj /F2 9 Tf (plain) Tj /F1 9 Tf <00500051> Tj ET"
    assert pdf.pages_of(made([page], resources=b"/Font << /F1 20 0 R /F2 22 0 R >>", extra=extra)) == ["α一丁plainfi🙂"]


def test_broken_files(spark, tmp_path):
    good = made(PAGES, True)
    files = {"good.pdf": good, "cut.pdf": good[: len(good) // 2], "empty.pdf": b"", "text.pdf": b"no pdf at all", "locked.pdf": good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), "loop.pdf": made([]).replace(b"/Kids []", b"/Kids [2 0 R]"), "note.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = read_pdf_pages(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[2], []).append((r["page_num"], r["text"], r["error"]))
    assert by.keys() == files.keys() - {"note.txt", "empty.pdf"}
    assert sorted(by["good.pdf"]) == [(i + 1, t, None) for i, t in enumerate(TEXTS)]
    assert by["locked.pdf"] == [(None, None, "the file is encrypted")] and by["text.pdf"] == by["loop.pdf"] == [(None, None, "no pages")]


def test_long_pages():
    """Work follows the size of a page."""
    page = b"BT " + b"(word) Tj 0 -1 Td " * 50_000 + b"ET " + b"(" * 20_000
    began = time.perf_counter()
    assert pdf.pages_of(made([page], True))[0].count("word") == 50_000
    assert time.perf_counter() - began < 20
