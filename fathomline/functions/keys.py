"""Keys that are UUIDs written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import WHITE

#: White space, the zero-width space and the byte-order mark.
BLANKS = WHITE + "​﻿"


def trimmed(key: Column) -> Column:
    return F.btrim(key, F.lit(BLANKS))


def is_blank(key: Column) -> Column:
    """True for null and for values of blanks only."""
    return F.coalesce(F.length(trimmed(key)) == 0, F.lit(True))


def uuid_key(key: Column) -> Column:
    """32 lower-case hex digits, or null if the value is no UUID. Case, dashes, braces and outer blanks don't matter."""
    bare = F.lower(F.translate(trimmed(key), "-{}", ""))
    return F.nullif(F.regexp_extract(bare, "^[0-9a-f]{32}$", 0), F.lit(""))


def dashed(key: Column) -> Column:
    """A key of 32 digits in the usual groups."""
    return F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
