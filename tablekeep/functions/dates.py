"""Date and time expressions. Sessions run in UTC; site-local display takes an
IANA zone name."""

from __future__ import annotations

import zoneinfo
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .literals import utc_text


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_instant(c) -> Column:
    """A timestamp (local time-zone type) from a timestamp or NTZ column."""
    return _col(c).cast("timestamp")


def iso_text(c) -> Column:
    """``yyyy-MM-ddTHH:mm:ss+00:00`` (offset as ``+00:00``, never ``Z``),
    in the session zone."""
    return F.date_format(as_instant(c), K.ISO_PATTERN)


def parse_time(c) -> Column:
    """A timestamp from a timestamp column or parseable text, else null.
    Text with an offset gives the right instant."""
    c = _col(c)
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                      F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def epoch_seconds(c) -> Column:
    """Whole epoch seconds (the sub-second part is dropped)."""
    return F.unix_seconds(as_instant(c))


def display_time(ts, tz: str) -> Column:
    """``yyyy-MM-dd HH:mm <zone abbreviation>`` of an instant in zone ``tz``."""
    utc = utc_wall(as_instant(ts))
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    return F.concat(F.date_format(local, K.DISPLAY_PATTERN), F.lit(" "), zone_abbreviation(utc, local, tz))


def utc_wall(instant) -> Column:
    """The UTC wall-clock time of an instant, whatever the session zone."""
    return utc_text(instant).cast("timestamp_ntz")


def zone_abbreviation(utc, local, tz: str) -> Column:
    """``CET`` or ``CEST``: the zone's own abbreviation for the offset it has
    at that time (the latest one the zone uses for the offset), or the
    offset's text for a zone without a name."""
    try:
        zone = zoneinfo.ZoneInfo(tz)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return F.lit("UTC" if tz.upper() in ("Z", "+00:00") else tz)
    names: dict[int, str] = {}
    for year in range(1970, 2038):  # the abbreviation of each offset the zone has had
        for month in range(1, 13):
            at = datetime(year, month, 1, tzinfo=timezone.utc).astimezone(zone)
            names[int(at.utcoffset().total_seconds())] = at.tzname()
    gap = F.timestamp_diff("SECOND", utc, local)
    out = None
    for offset, name in sorted(names.items()):
        out = F.when(gap == offset, F.lit(name)) if out is None else out.when(gap == offset, F.lit(name))
    return out.otherwise(F.lit(tz))


def history_date(text, tz: str = "UTC", unparsed: str = "raw") -> Column:
    """D3: ISO text shown in zone ``tz``; empty or null gives ``-``; text that
    does not parse gives the raw text (``unparsed='raw'``, history table) or
    ``Unknown`` (``unparsed='unknown'``, status line)."""
    text = _col(text)
    parsed = parse_time(text)
    fallback = text if unparsed == "raw" else F.lit(K.LABEL_UNKNOWN)
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit(K.LABEL_MISSING))
            .when(parsed.isNull(), fallback)
            .otherwise(display_time(parsed, tz)))


def next_daily_run(now, tz: str = "UTC", hour: int = K.DAILY_RUN_HOUR) -> Column:
    """Today at ``hour``:00 site-local, or tomorrow when that is not after
    ``now``. Computed on the local calendar, so a DST change keeps 03:00."""
    local_now = F.from_utc_timestamp(as_instant(now), tz)
    today = F.date_trunc("DAY", local_now) + F.make_interval(hours=F.lit(hour))
    nxt = F.when(today <= local_now, today + F.expr("INTERVAL 1 DAY")).otherwise(today)
    return F.to_utc_timestamp(nxt, tz)


def epoch_display(epoch, tz: str = "UTC") -> Column:
    """Epoch seconds shown in zone ``tz``; none gives ``None``."""
    e = _col(epoch)
    return F.when(e.isNull(), F.lit(K.LABEL_NONE)).otherwise(display_time(F.timestamp_seconds(e), tz))
