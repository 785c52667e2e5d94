"""PDF text and images, with the standard library: objects, object streams, Flate, and the text operators.

Fonts with a ToUnicode map are decoded by it, others as Latin-1. Encrypted files are an error. Pages without text get a
sentence that says so, and so does a document without any.
"""

from __future__ import annotations

import re
import struct
import zlib

from fathomline.sources.formats.document import Asset, Document, ExtractionError, Page

NO_TEXT = "No text could be extracted from this PDF. This might be an image-based PDF (scanned document) that requires OCR processing."
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s/<>\[\](){}%]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))*\)|<[0-9A-Fa-f\s]*>|[^\s/<>\[\](){}%]+", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Name(str):
    """A PDF name."""


class Ref(int):
    """A reference to an object."""


def _string(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _ESCAPES.get(m[1], m[1]), raw[1:-1])


def parse(data: bytes) -> list:
    """The values of a piece of PDF in order; operators as bytes."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(data):
        t = m[0]
        top = stack[-1]
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
        elif t in (b">>", b"]"):
            if len(stack) > 1:
                items = stack.pop()
                stack[-1].append(dict(zip(map(str, items[::2]), items[1::2], strict=False)) if t == b">>" else items)
        elif t[:1] == b"/":
            top.append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1")))
        elif t[:1] == b"(":
            top.append(_string(t))
        elif t[:1] == b"<":
            h = re.sub(rb"\s", b"", t[1:-1])
            top.append(bytes.fromhex((h + b"0" * (len(h) % 2)).decode()))
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            top.append(float(t) if b"." in t else int(t))
        elif t == b"R" and len(top) >= 2:
            del top[-1]
            top[-1] = Ref(top[-1])
        else:
            top.append({b"true": True, b"false": False, b"null": None}.get(t, t))
    return stack[0]


class Stream(dict):
    """A stream's dictionary with its raw bytes."""

    raw = b""


class File:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ExtractionError("corrupted_file", "not a PDF")
        self.objects: dict[int, object] = {}
        for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b(.*?)(?=\bendobj\b|\Z)", data, re.DOTALL):
            self._add(int(m[1]), m[3])
        for s in [x for x in self.objects.values() if isinstance(x, Stream) and x.get("Type") == "ObjStm"]:
            body = self.decoded(s)
            n, first = self.at(s.get("N", 0)), self.at(s.get("First", 0))
            heads = parse(body[:first])[: 2 * n]
            starts = [*heads[1::2], len(body) - first]
            for number, a, b in zip(heads[::2], starts, starts[1:], strict=False):
                values = parse(body[first + a : first + b])
                if values:
                    self.objects.setdefault(number, values[0])
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ExtractionError("extraction_failed", "the PDF is encrypted")

    def _add(self, number: int, body: bytes) -> None:
        head, sep, rest = body.partition(b"stream")
        values = parse(head)
        value = values[0] if values else None
        if sep and isinstance(value, dict):
            s = Stream(value)
            raw = rest[2:] if rest[:2] == b"\r\n" else rest[1:]
            length = value.get("Length")
            end = raw.rfind(b"endstream")
            s.raw = raw[:length] if isinstance(length, int) and not isinstance(length, Ref) and length <= len(raw) else raw[:end].rstrip(b"\r\n") if end >= 0 else raw
            value = s
        self.objects[number] = value

    def at(self, value):
        for _ in range(8):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value))
        return value

    def filters(self, s: Stream) -> list[str]:
        f = self.at(s.get("Filter"))
        return [str(self.at(x)) for x in (f if isinstance(f, list) else [f] if f else [])]

    def decoded(self, s: Stream) -> bytes:
        out = s.raw
        for f in self.filters(s):
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                try:
                    out = d.decompress(out)
                except zlib.error:
                    return b""
            elif f in ("ASCIIHexDecode", "AHx"):
                h = re.sub(rb"[^0-9A-Fa-f]", b"", out)
                out = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
            else:
                return b""
        p = self.at(s.get("DecodeParms"))
        return _unpredict(out, p, self) if isinstance(p, dict) else out

    def pages(self) -> list[dict]:
        """The pages in order, with inherited resources."""
        root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        out: list[dict] = []

        def walk(node, inherited: dict, depth: int) -> None:
            node = self.at(node)
            if not isinstance(node, dict) or depth > 64:
                return
            own = inherited | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                for kid in self.at(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        if root:
            walk(root.get("Pages"), {}, 0)
        return out or [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Page"]


def _unpredict(data: bytes, parms: dict, file: File) -> bytes:
    """PNG predictors undone."""
    if file.at(parms.get("Predictor", 1)) < 10:
        return data
    bpp = max(1, file.at(parms.get("Colors", 1)) * file.at(parms.get("BitsPerComponent", 8)) // 8)
    width = (file.at(parms.get("Columns", 1)) * file.at(parms.get("Colors", 1)) * file.at(parms.get("BitsPerComponent", 8)) + 7) // 8
    out, last = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left = row[i - bpp] if i >= bpp else 0
            up, corner = last[i], last[i - bpp] if i >= bpp else 0
            if kind == 1:
                row[i] = (row[i] + left) & 255
            elif kind == 2:
                row[i] = (row[i] + up) & 255
            elif kind == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif kind == 4:
                p = left + up - corner
                best = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + best) & 255
        out += row
        last = row + bytearray(width - len(row))
    return bytes(out)


def _unicode_map(file: File, font: dict) -> tuple[dict[bytes, str], int] | None:
    s = file.at(font.get("ToUnicode"))
    if not isinstance(s, Stream):
        return None
    body, table, width = file.decoded(s), {}, 1
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, block in re.findall(rb"begin(bfchar|bfrange)(.*?)end\1", body, re.DOTALL):
        v = parse(block)
        if kind == b"bfchar":
            for a, b in zip(v[::2], v[1::2], strict=False):
                table[a], width = text(b), len(a)
        else:
            for a, b, c in zip(v[::3], v[1::3], v[2::3], strict=False):
                width, low = len(a), int.from_bytes(a)
                for k in range(min(int.from_bytes(b) - low + 1, 65536)):
                    code = (low + k).to_bytes(width)
                    if isinstance(c, list):
                        table[code] = text(c[k]) if k < len(c) else ""
                    else:
                        table[code] = text(c[:-2] + struct.pack(">H", (int.from_bytes(c[-2:]) + k) & 0xFFFF))
    return table, width


def page_text(file: File, page: dict) -> str:
    """The strings that a page shows, with a new line where the position moves to another line."""
    contents = file.at(page.get("Contents"))
    streams = [file.at(x) for x in (contents if isinstance(contents, list) else [contents])]
    body = b"\n".join(file.decoded(s) for s in streams if isinstance(s, Stream))
    resources = file.at(page.get("Resources")) or {}
    fonts = file.at(resources.get("Font")) or {}
    maps = {name: _unicode_map(file, f) if isinstance(f := file.at(ref), dict) else None for name, ref in fonts.items()}
    current, out = None, []

    def show(raw: bytes) -> None:
        if current is None:
            out.append(raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace"))
        else:
            table, width = current
            out.append("".join(table.get(raw[k : k + width], "") for k in range(0, len(raw), width)))

    args: list = []
    for v in parse(body):
        if not isinstance(v, bytes) or (v[:1] and not re.fullmatch(rb"[A-Za-z'\"*]{1,3}\d?", v)) or v not in _OPERATORS:
            args.append(v)
            continue
        if v == b"Tf" and args and len(args) >= 2:
            current = maps.get(str(args[-2]))
        elif v in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            if v != b"Tj":
                out.append("\n")
            show(args[-1])
        elif v == b"TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, (int, float)) and x < -200:
                    out.append(" ")
        elif v in (b"T*", b"ET") or v in (b"Td", b"TD") and len(args) >= 2 and args[-1] != 0:
            out.append("\n")
        args = []
    return "".join(out)


_OPERATORS = set(b"Tf Tj TJ ' \" T* Td TD Tm BT ET q Q cm gs Do re f S s W n rg RG g G k K Tc Tw Tz TL Ts Tr BMC BDC EMC m l c v y h W* f* B B* b b* w J j M d ri i cs CS sc SC scn SCN sh EI ID BI".split())


def printable(text: str) -> str:
    return "".join(c for c in text if c != "\0" and (c.isalnum() or c.isspace() or "!" <= c <= "~" or "\xa1" <= c <= "\xff"))


def png(samples: bytes, width: int, height: int, space: str | None, bits: int | None) -> bytes | None:
    """Raw 8-bit RGB or grey samples as a PNG; null for anything else or too few samples."""
    colours = {"DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceGray": 1, "CalGray": 1, "G": 1}.get(space or "")
    if bits != 8 or width <= 0 or height <= 0 or not colours or len(samples) < width * height * colours:
        return None
    row = width * colours
    raw = b"".join(b"\0" + samples[k * row : (k + 1) * row] for k in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if colours == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def images(file: File, page: dict, number: int) -> list[Asset]:
    """The images of a page; those that can't be read are left out and keep their ordinal."""
    resources = file.at(page.get("Resources")) or {}
    out = []
    objects = file.at(resources.get("XObject")) or {}
    found = [s for ref in objects.values() if isinstance(s := file.at(ref), Stream) and s.get("Subtype") == "Image"]
    for k, s in enumerate(found, 1):
        filters = file.filters(s)
        space = file.at(s.get("ColorSpace"))
        if "DCTDecode" in filters:
            data, ext, kind = s.raw, "jpg", "image/jpeg"
        elif "JPXDecode" in filters:
            data, ext, kind = s.raw, "jp2", "image/jp2"
        else:
            data, ext, kind = png(file.decoded(s), file.at(s.get("Width", 0)), file.at(s.get("Height", 0)), str(space[0] if isinstance(space, list) and space else space), file.at(s.get("BitsPerComponent"))), "png", "image/png"
        if data:
            out.append(Asset(data, kind, number, f"page{number}-image{k}.{ext}"))
    return out


def extract(data: bytes, max_pages: int | None = None) -> Document:
    """The document of the first max_pages pages; images of all."""
    file = File(data)
    pages: list[Page] = []
    later: list[Asset] = []
    for number, page in enumerate(file.pages(), 1):
        assets = images(file, page, number)
        if max_pages is not None and number > max_pages:
            later += assets
            continue
        clean = printable(page_text(file, page))
        if not clean.strip():
            clean = f"[Page {number}: No extractable text found - may contain images or corrupted text]"
        lines = [x for x in (y.rstrip() for y in clean.split("\n")) if x]
        pages.append(Page(number, "\n".join(lines), assets))
    text = "\n".join(p.text for p in pages)
    return Document(text if text.strip() else NO_TEXT, pages, later)
