"""A small writer makes files whose content is known; the scan must find it again."""

import zlib

import pytest

from foliospark.operators import furniture, probes
from foliospark.sources import pdf


def make(contents, compress=True, font=b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", annots=b"", packed=False):
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: font}
    kids = []
    for i, c in enumerate(contents):
        body = zlib.compress(c) if compress else c
        objects[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (11 + 2 * i, annots)
        objects[11 + 2 * i] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(body), b"/Filter/FlateDecode" if compress else b"", body)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 600 800]/Resources<</Font<</F1 3 0 R>>>>>>" % (b" ".join(kids), len(kids))
    if packed:
        inner = {n: objects.pop(n) for n in (1, 2, 3)}
        head, body = b"", b""
        for n, o in inner.items():
            head += b"%d %d " % (n, len(body))
            body += o + b" "
        raw = zlib.compress(head + body)
        objects[90] = b"<</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(inner), len(head), len(raw), raw)
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return out + b"trailer\n<</Root 1 0 R>>\n%%EOF"


PAGE = rb"""BT /F1 12 Tf 1 0 0 1 50 700 Tm (Hello \(PDF\)) Tj 0 -20 Td [(W) -100 (orld)] TJ ET
q 2 0 0 2 10 10 cm 0.5 w 0 0 m 100 0 l S Q 10 10 100 50 re f BT /F1 10 Tf 0 1 -1 0 30 300 Tm (up) Tj ET"""


@pytest.mark.parametrize("options", [{}, {"compress": False}, {"packed": True}])
def test_runs_rules_and_drawings(options):
    rows = list(pdf.read_file(make([PAGE, PAGE], **options)))
    first = [r for r in rows if r.get("page") == 1 and r["row"] == "object"]
    texts = [(r["text"], r["x0"], r["y1"]) for r in first if r["kind"] == "text"]
    assert texts[0] == ("Hello (PDF)", 50.0, 100.0)
    assert [t[0] for t in texts[1:]] == ["W", "orld", "up"] and texts[1][2] == 120.0
    (rule,) = [r for r in first if r["kind"] == "rule"]
    assert (rule["orientation"], rule["x0"], rule["x1"], rule["thickness"]) == ("h", 10.0, 210.0, 1.0)
    assert [r["obj_id"] for r in first if r["kind"] == "graphic"] == ["p1_g0000"]
    assert (first[-1]["ta"], first[-1]["tb"]) == (0.0, 1.0)
    assert [(r["page"], r["width"], r["height"]) for r in rows if r["row"] == "page"] == [(1, 600.0, 800.0), (2, 600.0, 800.0)]


def test_unicode_map_and_link():
    cmap = b"1 beginbfchar <41> <00E9> endbfchar 1 beginbfrange <42> <43> <4E2D> endbfrange"
    data = make([b"BT /F1 10 Tf 50 50 Td (ABC) Tj ET"], font=b"<</Type/Font/Subtype/TrueType/BaseFont/AB+Song/ToUnicode 80 0 R/FirstChar 65/Widths[600 700 800]>>", annots=b"/Annots[<</Subtype/Link/Rect[10 10 60 20]/A<</URI(https://a.b)>>>>]")
    data = data.replace(b"trailer", b"80 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(cmap), cmap))
    rows = [r for r in pdf.read_file(data) if r["row"] == "object"]
    assert (rows[0]["text"], rows[0]["font"], rows[0]["x1"]) == ("é中丮", "AB+Song", 71.0)
    assert (rows[1]["kind"], rows[1]["text"], rows[1]["y0"]) == ("annotation", "https://a.b", 780.0)


@pytest.mark.parametrize("data", [b"", b"no file", b"%PDF-1.4\n", make([PAGE])[:300], b"%PDF-1.4\n1 0 obj\n<</Pages 1 0 R/Kids[1 0 R]>>\nendobj\ntrailer<</Root 1 0 R>>"])
def test_broken_files_become_rows(data):
    assert all(r["row"] in ("warning", "page", "object") for r in pdf.read_file(data))


def test_broken_and_encrypted_are_reported():
    assert next(pdf.read_file(b"junk"))["code"] == "LOCAL_PARSE_FAILED"
    assert next(pdf.read_file(make([PAGE]).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R")))["code"] == "ENCRYPTED_PDF_PASSWORD_REQUIRED"
    bad = make([b"x", PAGE], compress=False).replace(b"/Contents 11 0 R", b"/Contents 99 0 R")
    assert [(r["row"], r["page"]) for r in pdf.read_file(bad) if r["row"] != "object"] == [("page", 1), ("warning", 1), ("page", 2)]


def test_scan_feeds_the_operators(spark, tmp_path):
    line = rb"BT /F1 10 Tf 50 780 Td (Running head) Tj 0 -400 Td (body %d of it) Tj 200 -370 Td (%d) Tj ET"
    (tmp_path / "a.pdf").write_bytes(make([line % (k, k) for k in range(1, 5)]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    scanned = pdf.scan(spark, str(tmp_path)).cache()
    objects, pages = pdf.objects(scanned), pdf.pages(scanned)
    assert objects.count() == 12 and pages.count() == 4 and pdf.warnings(scanned).first().code == "LOCAL_PARSE_FAILED"
    assert {(r.type, r.key, r.pages) for r in furniture.clusters(objects, pages).collect()} == {("header", "running head", 4), ("page_number", "#", 4)}
    assert {r.verdict for r in probes.text_layer(objects).collect()} == {"trusted"}
