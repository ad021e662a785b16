"""Column functions on an integer timeline of samples, and on half-open spans of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLES_PER_SECOND = 16_000


def samples(milliseconds: Column) -> Column:
    """Exact for whole milliseconds."""
    return (milliseconds * (SAMPLES_PER_SECOND // 1000)).cast("long")


def milliseconds(sample: Column) -> Column:
    """Rounded half up."""
    return F.floor((sample * 2 + 16) / 32).cast("long")


def clock(sample: Column) -> Column:
    """HH:MM:SS.mmm, rounded half up to a millisecond."""
    ms = milliseconds(sample)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(hours, F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of what two spans share, 0 if nothing."""
    return F.greatest(F.lit(0).cast("long"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def parts(start: Column, end: Column, count: int) -> Column:
    """A span in `count` even whole parts, an array of (start, end)."""
    cut = lambda i: start + F.floor((end - start) * i / count).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("part"), cut(i).alias("start"), cut(i + 1).alias("end")))
