"""Word and PowerPoint packages, with the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from fathomline.functions.text import ENTITIES, MEDIA_TYPES, NO_NUMBER
from fathomline.sources.formats.document import Asset, Document, ExtractionError, Page

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A package whose entry would unpack to more than this is refused.
MOST_BYTES = 512 << 20


def package(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractionError("corrupted_file", f"not a package: {e}") from e
    if any(i.file_size > MOST_BYTES for i in z.infolist()):
        raise ExtractionError("corrupted_file", f"an entry unpacks to more than {MOST_BYTES} bytes")
    return z


def content_type(name: str) -> str:
    return MEDIA_TYPES.get(name.rpartition(".")[2].lower(), "application/octet-stream")


def media(z: zipfile.ZipFile, folder: str) -> list[Asset]:
    """The non-empty files under folder by name."""
    names = sorted(n for n in z.namelist() if n.startswith(folder) and not n.endswith("/"))
    found = ((n.rpartition("/")[2], z.read(n)) for n in names)
    return [Asset(data, content_type(label), None, label) for label, data in found if data]


def _paragraph(p: ElementTree.Element) -> str:
    """The text of a paragraph's runs, those in hyperlinks included."""
    out = []
    for child in p:
        for run in [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []:
            out += [t.text or "" for t in run.findall(f"{_W}t")]
    return "".join(out)


def _table(table: ElementTree.Element) -> str:
    rows = []
    for row in table.findall(f"{_W}tr"):
        cells = (p for cell in row.findall(f"{_W}tc") for p in cell.findall(f"{_W}p"))
        rows.append("".join(f"{_paragraph(p)}\t" for p in cells) + "\n")
    return "".join(rows)


def word(data: bytes) -> Document:
    """One page, number 0: each paragraph and table ends a line, cells end with a tab."""
    with package(data) as z:
        try:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        except (KeyError, ElementTree.ParseError) as e:
            raise ExtractionError("extraction_failed", f"invalid document: {e}") from e
        parts = [(_paragraph if x.tag == f"{_W}p" else _table)(x) + "\n" for x in (body if body is not None else ()) if x.tag in (f"{_W}p", f"{_W}tbl")]
        text = "".join(parts)
        return Document(text, [Page(0, text, media(z, "word/media/"))])


def slide_number(name: str) -> int:
    digits = re.fullmatch(r"(?:ppt/slides/slide)+\+?(\d+)(?:\.xml)+", name)
    return int(digits[1]) if digits and int(digits[1]) <= NO_NUMBER else NO_NUMBER


def unescape(text: str) -> str:
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return text


def slides(data: bytes) -> Document:
    """One page a slide in order of the slides' numbers; a slide's text runs follow one another without a separator."""
    with package(data) as z:
        names = [n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml") and "_rels" not in n]
        pages = []
        for name in sorted(names, key=slide_number):
            runs = re.findall(r"<a:t[^>]*>(.*?)</a:t>", z.read(name).decode("utf-8", "replace"), re.DOTALL)
            pages.append(Page(slide_number(name), "".join(map(unescape, runs))))
        return Document("\n".join(p.text for p in pages), pages, media(z, "ppt/media/"))
