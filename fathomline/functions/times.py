"""Times. What depends on the present takes it as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(time: Column) -> Column:
    """In UTC with six digits, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def micros(time: Column) -> Column:
    return F.unix_micros(time)


def duration_ms(started: Column, completed: Column, status: Column, now: Column) -> Column:
    """From start to end, or to now while processing; null otherwise."""
    end = F.when(completed.isNotNull(), completed).when(status == "processing", now)
    return F.when(started.isNotNull(), F.floor((micros(end) - micros(started)) / 1000).cast("bigint"))


def eta_micros(started: Column, status: Column, progress: Column, now: Column) -> Column:
    """When work that is past a tenth will be done at the pace so far: microseconds of the epoch, to whole milliseconds."""
    elapsed = F.floor((micros(now) - micros(started)) / 1000)
    left = F.floor(elapsed / progress.cast("double")) - elapsed
    known = (status == "processing") & started.isNotNull() & (progress.cast("double") > 0.1)
    return F.when(known, micros(now) + left * 1000).cast("bigint")
