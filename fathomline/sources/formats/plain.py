"""Plain text."""

from __future__ import annotations

from fathomline.sources.formats.document import Document, ExtractionError


def extract(data: bytes) -> Document:
    """The text as it is; anything but UTF-8 is an error."""
    try:
        return Document(data.decode())
    except UnicodeDecodeError as e:
        raise ExtractionError("extraction_failed", f"invalid UTF-8: {e}") from e
