"""Processing states, and small closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ("pending", "processing", "completed", "failed")
#: Allowed steps.
STEPS = (("pending", "processing"), ("processing", "completed"), ("processing", "failed"), ("failed", "pending"))
SCOPES = ("read", "write", "admin")


def normal(status: Column) -> Column:
    """The state in lower case, also of the older form 'failed: message'; null if it is none."""
    low = F.lower(F.trim(status))
    return F.when(low.isin(*STATES), low).when(low.startswith("failed:"), F.lit("failed"))


def message(status: Column) -> Column:
    """What follows 'failed:', else null."""
    return F.when(F.lower(F.trim(status)).startswith("failed:"), F.trim(F.regexp_replace(F.trim(status), "^[^:]*:", "")))


def may_step(old: Column, new: Column) -> Column:
    return F.coalesce(F.concat_ws(">", old, new).isin(*(f"{a}>{b}" for a, b in STEPS)), F.lit(False))


def is_terminal(status: Column) -> Column:
    return status.isin("completed", "failed")


def percentage(status: Column) -> Column:
    return F.when(status == "processing", 50).when(status == "completed", 100).otherwise(0)


def job_type(written: Column) -> Column:
    low = F.lower(F.trim(written))
    return F.when(low.isin("file_processing", "url_extraction", "youtube_extraction"), low)


def asset_type(written: Column) -> Column:
    return F.when(F.lower(F.trim(written)) == "image", F.lit("image")).otherwise(F.lit("other"))


def unknown_scopes(scopes: Column) -> Column:
    return F.array_except(scopes, F.array(*map(F.lit, SCOPES)))


def transcript_error(code: Column) -> Column:
    """Which error a transcript's failure is reported as."""
    return F.when(code.isin("transcripts_disabled", "no_transcript_found", "unparsable"), F.lit("no_transcript")).otherwise(F.lit("extraction_failed"))


def extractor(mime: Column) -> Column:
    """The extractor that takes a type, in the order html, pdf, youtube, docx, pptx, text; null if none does."""
    # Fixed values.
    takes = {
        "html": ("text/html", "application/html", "text/htm"),
        "pdf": ("application/pdf",),
        "youtube": ("text/youtube-url", "text/youtube-transcript", "application/youtube"),
        "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
        "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",),
        "text": ("text/plain", "text/txt", "txt", "plain"),
    }
    low, out = F.lower(mime), F.lit(None).cast("string")
    for name, mimes in reversed(takes.items()):
        out = F.when(low.isin(*mimes), F.lit(name)).otherwise(out)
    return out
