"""Time expressions that give the same text under any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Kolkata"


def epoch_millis(text: Column) -> Column:
    """Epoch milliseconds held as text; missing, empty or not a number is null."""
    return text.try_cast("bigint")


def utc_moment(millis: Column) -> Column:
    """UTC wall clock; the session time zone plays no part."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = millis.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")
    return start + F.make_dt_interval(secs=seconds)


def local_iso(millis: Column, zone: str = DEFAULT_ZONE) -> Column:
    """Local ISO-8601 text with seconds and the offset in force then; null becomes ''."""
    utc = utc_moment(millis)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    clock = F.substring(F.replace(local.cast("string"), F.lit(" "), F.lit("T")), 1, 19)
    shift = F.timestamp_diff("SECOND", utc, local)
    size = F.abs(shift)

    def two(n: Column) -> Column:
        return F.lpad(F.floor(n).cast("string"), 2, "0")

    offset = F.concat(
        F.when(shift < 0, "-").otherwise("+"),
        two(size / 3600), F.lit(":"), two(size % 3600 / 60),
        F.when(size % 60 != 0, F.concat(F.lit(":"), two(size % 60))).otherwise(""),
    )
    return F.coalesce(F.concat(clock, offset), F.lit(""))


def day_stamp(day: Column) -> Column:
    """19Mar2026."""
    return F.date_format(day, "ddMMMyyyy")
