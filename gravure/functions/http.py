"""HTTP header values: dates, ETags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column; no session zone involved."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def http_date_us(header: Column) -> Column:
    """RFC 1123 GMT date -> microseconds since 1970, NULL where it does not parse."""
    inner = F.regexp_extract(header, "^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8}) GMT$", 1)
    parsed = F.try_to_timestamp(inner, F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), parsed)


def http_date(us: Column) -> Column:
    """Microseconds since 1970 -> RFC 1123 GMT date."""
    seconds = F.floor(us / F.lit(1_000_000))
    days = F.timestamp_add("DAY", F.floor(seconds / F.lit(86_400)).cast("int"), F.expr(EPOCH))
    stamp = F.timestamp_add("SECOND", F.pmod(seconds, F.lit(86_400)).cast("int"), days)
    return F.concat(F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def unquote_etag(etag: Column) -> Column:
    """Without the weak mark and the surrounding quotes."""
    return F.regexp_replace(F.regexp_replace(etag, "^W/", ""), '^"+|"+$', "")
