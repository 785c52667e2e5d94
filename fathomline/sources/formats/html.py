"""HTML as text of a given width, with the standard library's parser."""

from __future__ import annotations

import textwrap
from html.parser import HTMLParser

from fathomline.sources.formats.document import Document
from fathomline.sources.formats.plain import extract as decode

WIDTH = 80
_BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tr ul".split())
_SILENT = {"script", "style", "head", "title", "template", "noscript"}
#: What may stand in a head; any other tag ends it, as its end tag may be left out.
_IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title", "head", "html"}


class _Text(HTMLParser):
    def __init__(self, width: int) -> None:
        super().__init__(convert_charrefs=True)
        self.width = width
        self.blocks: list[str] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        self.lists: list[int | None] = []
        self.lead, self.quote, self.pre = "", 0, 0
        self.links: list[str] = []
        self.hrefs: list[str] = []

    def flush(self) -> None:
        text = "".join(self.run)
        self.run = []
        if self.pre:
            lines = text.strip("\n").split("\n") if text.strip() else []
        else:
            lines = []
            for part in text.split("\n"):
                lines += textwrap.wrap(" ".join(part.split()), max(self.width - 2 * self.quote - len(self.lead), 8), break_on_hyphens=False)
        if lines:
            lead = "> " * self.quote
            self.blocks.append("\n".join(lead + (self.lead if k == 0 else " " * len(self.lead)) + x for k, x in enumerate(lines)))
            self.lead = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent == ["head"] and tag not in _IN_HEAD:
            self.silent.pop()
        if tag in _SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "br":
            self.run.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            self.lead = "* " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "blockquote":
            self.quote += 1
        elif tag == "pre":
            self.pre += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.lead = "#" * int(tag[1]) + " "
        elif tag in ("td", "th") and self.run:
            self.run.append(" | ")
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.hrefs.append(href)
            self.run.append("[")
        elif tag == "img" and (alt := dict(attrs).get("alt")):
            self.run.append(f"[{alt}]")

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag in _BLOCKS:
            self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "blockquote":
            self.quote = max(0, self.quote - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
        elif tag == "a" and self.hrefs:
            self.links.append(self.hrefs.pop())
            self.run.append(f"][{len(self.links)}]")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data if self.pre else data.replace("\n", " "))


def to_text(html: str, width: int = WIDTH) -> str:
    """Blocks wrapped at width with a blank line between them, links as numbers with a list of addresses at the end."""
    parser = _Text(width)
    parser.feed(html)
    parser.close()
    parser.flush()
    out = "\n\n".join(parser.blocks)
    notes = "\n".join(f"[{k}]: {x}" for k, x in enumerate(parser.links, 1))
    return f"{out}\n\n{notes}\n" if notes else (out + "\n" if out else "")


def extract(data: bytes, width: int = WIDTH) -> Document:
    return Document(to_text(decode(data).full_text, width))
