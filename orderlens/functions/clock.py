"""Time helpers that never depend on the session time zone.

A naive timestamp means UTC everywhere, so instants are measured from the NTZ
epoch and only turned into TIMESTAMP where a watermark needs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal such as ``2024-01-01 12:00:00``."""
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch from the calendar fields, so no time zone
    and no daylight-saving gap can enter."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    micros = (F.date_part(F.lit("SECOND"), ts) * MICROS).cast("bigint")
    return (days * 1440 + minutes) * (60 * MICROS) + micros


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down also before 1970."""
    return F.floor(epoch_micros(ts) / F.lit(MICROS)).cast("bigint")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ntz("1970-01-01 00:00:00"))


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ntz("1970-01-01 00:00:00"))


def as_instant(ts: Column) -> Column:
    """NTZ (UTC) to TIMESTAMP, the same instant whatever the session zone is."""
    return F.timestamp_micros(epoch_micros(ts))


def add_seconds(ts: Column, seconds: int | Column) -> Column:
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", amount, ts)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Signed difference in seconds as a double."""
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(float(MICROS))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with microseconds and a ``Z`` suffix, from the text of the NTZ
    value, as date formatting would go through the session time zone."""
    text = ts.cast("string")
    whole = F.translate(F.substring(text, 1, 19), " ", "T")
    return F.concat(whole, F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z"))


def parse_iso_utc(text: Column) -> Column:
    """``Z``, ``+00:00`` and naive forms become a UTC NTZ value, other offsets
    are shifted to UTC, anything unreadable becomes null."""
    zoned = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    naive = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    shift = F.when(
        F.length(zoned) > 0,
        F.when(F.substring(zoned, 1, 1) == "-", 1).otherwise(-1)
        * (
            F.regexp_extract(text, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int") * 60
            + F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
        ),
    ).otherwise(0)
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shape, F.timestamp_add("MINUTE", shift, naive.try_cast("timestamp_ntz")))


def age_seconds(ts: Column, now: Column) -> Column:
    """Seconds since ``ts``; a missing time has age zero."""
    return F.coalesce(seconds_between(ts, now), F.lit(0.0))
