"""Extractors over files made here."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest

from fathomline.sources import extract as X
from fathomline.sources.formats import html, office, pdf, plain
from fathomline.sources.formats.document import Asset, Document, ExtractionError, Page

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(entries: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word():
    body = p("Hello") + f"<w:p><w:hyperlink><w:r><w:t>World</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    data = package({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/media/image2.jpeg": b"j", "word/media/image1.png": b"p", "word/media/empty.png": b""})
    d = office.word(data)
    assert d.full_text == "Hello\nWorld\na\tb\t\n\n"
    assert [(a.label, a.content_type) for a in d.all_assets()] == [("image1.png", "image/png"), ("image2.jpeg", "image/jpeg")]
    assert d.all_assets()[0].page_number == 0


def test_slides_are_in_the_order_of_their_numbers():
    d = office.slides(package({"ppt/slides/slide10.xml": "<a:t>third</a:t>", "ppt/slides/slide2.xml": "<a:t>sec</a:t><a:t>ond &amp;lt;</a:t>", "ppt/slides/slide1.xml": "<a:t>first</a:t>", "ppt/slides/_rels/slide1.xml.rels": "x"}))
    assert d.full_text == "first\nsecond <\nthird"
    assert [x.page_number for x in d.pages] == [1, 2, 10]


@pytest.mark.parametrize("f", [office.word, office.slides])
def test_no_package(f):
    with pytest.raises(ExtractionError) as e:
        f(b"nothing")
    assert e.value.code == "corrupted_file"


def test_plain_is_strict():
    assert plain.extract("café, 北京".encode()).full_text == "café, 北京"
    with pytest.raises(ExtractionError):
        plain.extract(b"\xff\xfe")


def test_html():
    text = html.to_text("<html><head><title>t</title><style>x</style></head><body><h1>Head</h1><p>One <b>two</b></p><ul><li>a<li>b</ul><a href='u'>link</a><script>no</script></body></html>")
    assert text == "# Head\n\nOne two\n\n* a\n\n* b\n\n[link][1]\n\n[1]: u\n"
    assert max(map(len, html.to_text("<p>" + "word " * 100 + "</p>", 40).split("\n"))) <= 40


def make_pdf(pages: list[bytes], image: bytes | None = None) -> bytes:
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", None, "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids, xobject = [], ""
    bodies: list[bytes] = []
    if image is not None:
        raw = zlib.compress(image)
        bodies.append(f"4 0 obj\n<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n")
        xobject = "/XObject << /I 4 0 R >>"
    for k, content in enumerate(pages):
        raw = zlib.compress(content)
        page, stream = 10 + 2 * k, 11 + 2 * k
        kids.append(f"{page} 0 R")
        bodies.append(f"{page} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {stream} 0 R /Resources << /Font << /F1 3 0 R >> {xobject} >> >>\nendobj\n{stream} 0 obj\n<< /Length {len(raw)} /Filter /FlateDecode >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    return b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n{o}\nendobj\n".encode() for k, o in enumerate(objects, 1)) + b"".join(bodies) + b"%%EOF"


def test_pdf_text_pages_and_images():
    data = make_pdf([b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET", b"q Q"], b"\x01" * 12)
    d = pdf.extract(data)
    assert d.pages[0].text == "Hello (PDF)\nsecond line"
    assert d.pages[1].text.startswith("[Page 2: No extractable text")
    assert [a.label for a in d.all_assets()] == ["page1-image1.png", "page2-image1.png"]
    assert d.all_assets()[0].bytes.startswith(b"\x89PNG")
    assert pdf.extract(data, 1).full_text == "Hello (PDF)\nsecond line"


def test_png_only_of_known_samples():
    assert pdf.png(b"\0" * 12, 2, 2, "DeviceRGB", 8) and pdf.png(b"\0" * 16, 4, 4, "DeviceGray", 8)
    assert pdf.png(b"\0" * 24, 2, 2, "DeviceRGB", 16) is None
    assert pdf.png(b"\0" * 16, 2, 2, "DeviceCMYK", 8) is None
    assert pdf.png(b"\0" * 8, 4, 4, "DeviceGray", 8) is None


def test_bad_pdfs():
    for data in (b"", b"x", b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>"):
        with pytest.raises(ExtractionError):
            pdf.extract(data)


def test_page_assets_inherit_the_page():
    d = Document("", [Page(3, "", [Asset(b"x", "image/png"), Asset(b"y", "image/png", 9)])], [Asset(b"z", "image/png")])
    assert [a.page_number for a in d.all_assets()] == [None, 3, 9]


def test_errors_are_rows(spark):
    rows = [("a", "text/plain", b"ok"), ("b", "application/zip", b"x"), ("c", "application/pdf", b"bad"), ("d", None, b"x"), ("e", "text/html", None)]
    got = {r["id"]: r for r in X.extract(spark.createDataFrame(rows, "id string, file_type string, content binary")).collect()}
    assert got["a"]["full_text"] == "ok" and got["a"]["error_code"] is None
    assert got["b"]["error_code"] == got["d"]["error_code"] == "unsupported_format"
    assert got["c"]["error_code"] == got["e"]["error_code"] == "corrupted_file"


def test_transcripts_prefer_english(spark):
    rows = [("v", "de", 0.0, 1.0, "hallo"), ("v", "en", 2.0, 1.5, "b"), ("v", "en", 0.0, 1.0, "a"), ("w", "fr", 0.0, 1.0, "x"), ("u", "en", 0.0, 1.0, " ")]
    got = {r["video_id"]: r for r in X.transcripts(spark.createDataFrame(rows, "video_id string, lang string, start double, duration double, text string")).collect()}
    assert got["v"]["text"] == "[0.0-1.0s] a\n[2.0-3.5s] b" and got["w"]["lang"] == "fr"
    assert got["u"]["text"] is None and got["u"]["error"] == "no_transcript"
