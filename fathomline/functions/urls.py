"""URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, name: str, key: str | None = None) -> Column:
    """A part of a URL (HOST, PATH, QUERY), null where the URL can't be parsed."""
    return F.try_parse_url(url, F.lit(name), F.lit(key)) if key else F.try_parse_url(url, F.lit(name))


def file_name(url: Column, epoch: Column) -> Column:
    """The last segment of the path, or {host}_webpage_{epoch} if that is empty."""
    last = F.element_at(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(F.concat(part(url, "HOST"), F.lit("_webpage_"), epoch.cast("string")))


def is_video_host(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, "HOST")).isin("www.youtube.com", "youtube.com", "youtu.be"), F.lit(False))


def looks_like_video(url: Column) -> Column:
    """The first, cheap test of a request: one of the hosts' names occurs in the text. is_video_host decides."""
    return F.coalesce(F.lower(url).contains("youtube.com") | F.lower(url).contains("youtu.be"), F.lit(False))


def redacted(url: Column) -> Column:
    """Host, port and path of a store's address, without user, password and parameters; null stays null, and what is no address is hidden whole."""
    shown = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^?#@]*)", 1)
    return F.when(url.isNotNull(), F.when(F.length(shown) > 0, shown).otherwise(F.lit("hidden")))


def bearer(header: Column) -> Column:
    """The token of an Authorization header 'Bearer ...', null if it is none or blank."""
    token = F.trim(F.regexp_extract(header, r"(?i)^\s*bearer\s+(.*)$", 1))
    return F.when(F.length(token) > 0, token)


def video_id(url: Column) -> Column:
    """The id of a video's URL, null for other hosts or if it is missing."""
    host = F.lower(part(url, "HOST"))
    watch = F.url_decode(part(url, "QUERY", "v"))
    short = F.element_at(F.split(part(url, "PATH"), "/"), -1)
    found = F.when(host.isin("www.youtube.com", "youtube.com"), watch).when(host == "youtu.be", short)
    return F.when(F.length(found) > 0, found)


def is_safe_name(name: Column) -> Column:
    """Not blank, no slash and no two dots in a row."""
    return F.coalesce((F.length(F.regexp_replace(name, r"(?U)\s", "")) > 0) & ~name.contains("/") & ~name.contains(".."), F.lit(False))


def storage_key(tenant: Column, file: Column) -> Column:
    return F.concat_ws("/", tenant, file)


def asset_url(file: Column, asset: Column) -> Column:
    return F.format_string("/files/%s/assets/%s/content", file, asset)
