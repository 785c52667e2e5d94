"""Text functions as column expressions. Sizes are bytes of UTF-8 where the name says so, and words are separated by Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the property White_Space. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A slide name whose number can't be read sorts last.
NO_NUMBER = 4294967295
MOST_BLOB_BYTES = 1 << 20
# The named entities in the order in which they are replaced, and media types by extension.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "emf": "image/emf", "wmf": "image/wmf"}


def sanitize(text: Column) -> Column:
    """Without U+0000."""
    return F.translate(text, "\x00", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """The words, none for blank text; null for null. No regular expression and no lambda: this stays in generated code."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def is_empty(text: Column) -> Column:
    return F.length(strip(text)) == 0


def is_meaningful(text: Column) -> Column:
    """At least three words."""
    return word_count(text) >= 3


def unescape_xml(text: Column) -> Column:
    """The five named entities, &amp; first: a doubly escaped one is unescaped twice."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def slide_number(name: Column) -> Column:
    """The number of ppt/slides/slideN.xml, NO_NUMBER if there is none that fits 32 bits."""
    bare = F.regexp_replace(F.regexp_replace(name, "^(?:ppt/slides/slide)+", ""), r"(?:\.xml)+$", "")
    n = bare.try_cast("bigint")
    return F.when(bare.rlike(r"^\+?[0-9]+$") & (n <= NO_NUMBER), n).otherwise(F.lit(NO_NUMBER))


def printable(text: Column) -> Column:
    """Letters and numbers, white space, printable ASCII and U+00A1 to U+00FF; nothing else."""
    return F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}!-~\x{A1}-\x{FF}]", "")


def tidy_lines(text: Column) -> Column:
    """Lines without white space at their end, and without empty ones."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "\n")


def page_text(text: Column, page: Column) -> Column:
    """The text of a PDF's page, or a sentence that says there is none."""
    clean = printable(sanitize(text))
    none = F.concat(F.lit("[Page "), page.cast("string"), F.lit(": No extractable text found - may contain images or corrupted text]"))
    return tidy_lines(F.when(is_empty(clean), none).otherwise(clean))


def html_title(html: Column) -> Column:
    """The trimmed text of the first title element, null if there is none."""
    title = F.regexp_extract(html, "<title[^>]*>([^<]+)</title>", 1)
    return F.when(F.length(title) > 0, strip(title))


def transcript_line(start: Column, duration: Column, text: Column) -> Column:
    return F.format_string("[%.1f-%.1fs] %s", start, start + duration, text)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def valid_hash(digest: Column) -> Column:
    """A SHA-256 digest in lower case, null if it isn't 64 hex digits."""
    return F.when(digest.rlike("^[0-9a-fA-F]{64}$"), F.lower(digest))


def key_prefix(raw: Column) -> Column:
    return F.substring(raw, 1, 16)


def signature(params: Column, secret: Column) -> Column:
    """SHA-1 of the map's k=v joined with & in key order, and the secret."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha1(F.concat(F.array_join(pairs, "&"), secret).cast("binary"))


def fits_blob(text: Column) -> Column:
    """Not blank and at most MOST_BLOB_BYTES."""
    return ~is_empty(text) & (byte_length(text) <= MOST_BLOB_BYTES)


def content_type(name: Column) -> Column:
    """The type of a media file by what follows the last dot of its name."""
    table = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(name, r"\."), -1))), F.lit("application/octet-stream"))
