"""PDF files made here are read back page by page; damaged ones say why."""

import zlib

from graphloom.sources import files, pdf


def stream(body, extra=b"", deflate=True):
    body = zlib.compress(body) if deflate else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if deflate else b"", extra, body)


CMAP = b"""begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <9F7F> <0002> <8F6E> endbfchar
2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<7BB1> <6CB9>] endbfrange"""


def made(pages, deflate=True, packed=False):
    """A file of these content streams, in a tree of two levels; packed: its dictionaries are in an object stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count %d /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>" % len(pages)}
    half, kids = len(pages) // 2, [20 + 2 * i for i in range(len(pages))]
    for n, part in ((3, kids[:half]), (4, kids[half:])):
        objects[n] = b"<< /Type /Pages /Parent 2 0 R /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in part)
    objects |= {5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", 7: stream(CMAP, deflate=deflate)}
    for k, content in zip(kids, pages, strict=True):
        objects[k], objects[k + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (k + 1), stream(content, deflate=deflate)
    if packed:
        inside = {n: x for n, x in objects.items() if b"stream" not in x}
        places, body = b"", b""
        for n, x in inside.items():
            places, body = places + b"%d %d " % (n, len(body)), body + x + b" "
            del objects[n]
        objects[90] = stream(places + body, b"/Type /ObjStm /N %d /First %d" % (len(inside), len(places)))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


CONTENTS = [
    rb"BT /F1 12 Tf 72 700 Td (Page \(one\)) Tj 0 -14 Td [(spa) -300 (ced) 20 (!)] TJ T* (third \101) Tj ET",
    b"BT /F2 12 Tf <00010002> Tj 0 -14 Td <002000210010 0012> Tj ET",
    b"",
    b"BT /F1 9 Tf (line) ' (next) ' ET",
]
TEXTS = ["Page (one)\nspa ced!\nthird A", "齿轮\n箱油AC", "", "line\nnext"]


def test_pages_are_read_in_order():
    for deflate in (True, False):
        for packed in (True, False):
            assert pdf.read_pages(made(CONTENTS, deflate, packed)) == TEXTS


def test_files_become_rows_and_damaged_ones_say_why(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    whole = made(CONTENTS)
    for name, data in (("a.pdf", whole), ("deep/B.PDF", made([b"BT /F1 9 Tf (x) Tj ET"] * 2, packed=True)), ("cut.pdf", whole[: len(whole) // 3]), ("empty.pdf", b""), ("no.pdf", b"text"), ("other.txt", whole)):
        (tmp_path / name).write_bytes(data)
    rows = pdf.pages(spark, str(tmp_path))
    got = {}
    for r in rows.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["page_num"], r["text"], r["error"]))
    assert sorted(got["a.pdf"]) == [(i + 1, t, None) for i, t in enumerate(TEXTS)] and sorted(got["B.PDF"]) == [(1, "x", None), (2, "x", None)]
    assert set(got) == {"a.pdf", "B.PDF", "cut.pdf", "no.pdf"} and all(len(got[x]) == 1 and got[x][0][2] for x in ("cut.pdf", "no.pdf"))
    probed = {r["path"].rsplit("/", 1)[1]: r for r in files.probe(rows, ["path"]).collect()}
    assert probed["a.pdf"]["page_count"] == 4 and probed["a.pdf"]["detect_status"] == "success" and probed["no.pdf"]["detect_status"] == "failed: not a PDF file"
    docs = {r["path"].rsplit("/", 1)[1]: r["full_text"] for r in pdf.documents(rows).collect()}
    assert docs == {"a.pdf": "Page (one)\nspa ced!\nthird A\n齿轮\n箱油AC\nline\nnext", "B.PDF": "x\nx"}
