"""Points in time that operators take as parameters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(at: datetime) -> Column:
    """A timestamp literal: a naive time is in the session's zone, whatever the driver's own zone is."""
    if at.tzinfo is not None:
        return F.lit(at.astimezone(timezone.utc).isoformat(sep=" ")).cast("timestamp")
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def is_stale(last: Column, every_minutes: Column, as_of: datetime) -> Column:
    """Whether a crawl is due: the period has passed since the last one, or there was none."""
    return F.coalesce(moment(as_of) - last >= F.make_dt_interval(mins=every_minutes.cast("int")), F.lit(True))


def parse_date(text: Column, zone: Column | str | None = None) -> Column:
    """ISO 8601 or RFC 822 text as a timestamp.

    A time without an offset counts only where a ``zone`` is declared and the local time exists there and
    is not repeated; anything else is null.
    """
    trimmed = F.trim(text)
    iso = F.when(trimmed.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.regexp_replace(trimmed, "Z$", "+00:00"))
    mail = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)\A(?:mon|tue|wed|thu|fri|sat|sun),\s*", ""), r"(?i)\s(?:GMT|UTC|UT|Z)\z", " +0000")
    mail = F.when(mail.rlike(r"\A\d{1,2} [A-Za-z]{3} \d{4} "), mail)
    with_offset = F.coalesce(F.when(iso.rlike(r"[+-]\d{2}:?\d{2}\z") & iso.rlike(r"\d{2}:\d{2}"), F.try_to_timestamp(iso)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    if zone is None:
        return with_offset
    local = F.when(iso.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\z"), F.try_to_timestamp(iso))
    first = F.to_utc_timestamp(local, zone)
    again = lambda n: F.from_utc_timestamp(first + F.expr(f"interval {n} minutes"), zone) == local
    fits = (F.from_utc_timestamp(first, zone) == local) & ~again(30) & ~again(60)
    return F.coalesce(with_offset, F.when(fits, first))
