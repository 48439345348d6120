"""Event times. Both are wall-clock times without a zone (``timestamp_ntz``),
so no session time zone can shift them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_wall_time(instant: Column) -> Column:
    """What a clock in UTC shows at an instant, whatever the session's time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(instant))


def as_instant(wall_time: Column) -> Column:
    """The instant at which a clock in UTC shows a wall time."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_seconds(F.timestamp_diff("SECOND", start, wall_time))


def _wall_time(text: Column, pattern: str) -> Column:
    """Text to a zone-free time; null if it does not fit.

    It is read as if it stood in UTC, because only the reader with a zone has a
    form that yields null on bad input.
    """
    return as_wall_time(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " Z")))


def request_time(raw: Column) -> Column:
    """``08/Aug/2025:03:33:33 -0300`` -> 03:33:33 on that day; the offset is dropped."""
    return _wall_time(F.substring_index(raw, " ", 1), "d/MMM/yyyy:H:m:s")


def request_instant(raw: Column) -> Column:
    """The same text read with its offset, as an instant."""
    return F.try_to_timestamp(raw, F.lit("d/MMM/yyyy:H:m:s Z"))


def _request_year(syslog: Column, request: Column) -> Column:
    """Year of the request text, moved by one where the two stand on either side of New Year."""
    pieces = F.split(F.substring_index(request, ":", 1), "/")
    sent, logged = F.lower(F.get(pieces, F.lit(1))), F.lower(F.substring(syslog, 1, 3))
    turn = F.when((logged == "dec") & (sent == "jan"), -1).when((logged == "jan") & (sent == "dec"), 1).otherwise(0)
    return F.get(pieces, F.lit(2)).try_cast("int") + turn


def syslog_time(raw: Column, base_year: int | None = None, request: Column | None = None) -> Column:
    """``Aug  8 03:33:33`` in a given year.

    The text has no year. It is ``base_year`` if given, else the year of the
    request text, else the current year.
    """
    if base_year is not None:
        year = F.lit(base_year)
    elif request is not None:
        year = F.coalesce(_request_year(raw, request), F.year(F.current_date()))
    else:
        year = F.year(F.current_date())
    return _wall_time(
        F.concat_ws(" ", year.cast("string"), F.regexp_replace(raw, r"\s+", " ")), "yyyy MMM d H:m:s"
    )


def date_parts(time: Column) -> dict[str, Column]:
    return {
        "year": F.year(time),
        "month": F.month(time),
        "day": F.dayofmonth(time),
        "hour": F.hour(time),
    }
