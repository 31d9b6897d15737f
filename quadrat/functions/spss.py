"""Column functions on numbers as system files hold them. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.sources.sav_format import EPOCH_DAYS, EPOCH_SECONDS, HIGHEST

MISSING = -HIGHEST


def _whole(x: Column) -> Column:
    """Towards zero; null for what isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < 9.0e18), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def system_missing(x: Column) -> Column:
    """Null for the system-missing value."""
    return F.when(x != F.lit(MISSING), x)


def spss_date(x: Column) -> Column:
    """Seconds since 14 October 1582 as a date; the time of day is cut off towards 1970."""
    return F.date_from_unix_date(_whole(x / 86400 - EPOCH_DAYS).cast("int"))


def spss_timestamp(x: Column) -> Column:
    """Seconds since 14 October 1582 as a timestamp without time zone, to the microsecond."""
    micros = _whole((x - EPOCH_SECONDS) * 1e6).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def spss_seconds(x: Column) -> Column:
    """A date or timestamp without time zone as seconds since 14 October 1582."""
    days = F.datediff(F.to_date(x), F.lit("1970-01-01").cast("date"))
    stamp = x.cast("timestamp_ntz")
    day = F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.extract(F.lit("SECOND"), stamp).cast("double")
    return days * 86400.0 + day + EPOCH_SECONDS


def trim_padding(s: Column) -> Column:
    """A string without the blanks and NULs at its end; null becomes empty."""
    return F.coalesce(F.regexp_replace(s, "[ \\x00]+$", ""), F.lit(""))
