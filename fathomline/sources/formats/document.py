"""What an extractor gives."""

from __future__ import annotations

from dataclasses import dataclass, field


class ExtractionError(Exception):
    """code: unsupported_format, corrupted_file, extraction_failed or no_transcript."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Asset:
    bytes: bytes
    content_type: str
    page_number: int | None = None
    label: str | None = None


@dataclass
class Page:
    page_number: int
    text: str
    assets: list[Asset] = field(default_factory=list)


@dataclass
class Document:
    full_text: str
    pages: list[Page] = field(default_factory=list)
    assets: list[Asset] = field(default_factory=list)

    def all_assets(self) -> list[Asset]:
        """Assets of the document, then of its pages, which give their number to those that have none."""
        own = [Asset(a.bytes, a.content_type, p.page_number if a.page_number is None else a.page_number, a.label) for p in self.pages for a in p.assets]
        return [*self.assets, *own]
