"""Column functions for bars, quotes and timestamps. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEW_YORK = "America/New_York"


def instant(ts: Column) -> Column:
    """A zone-less timestamp as an instant; the session zone is UTC."""
    return ts.cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(instant(ts))


def ny_minute(ts: Column) -> Column:
    """Minute of the New York day."""
    local = F.from_utc_timestamp(instant(ts), NEW_YORK)
    return F.hour(local) * 60 + F.minute(local)


def ny_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant(ts), NEW_YORK))


def regular_session(ts: Column, timespan: Column | None = None) -> Column:
    """Within 09:30-16:00 New York, both ends included; a daily bar always."""
    inside = ny_minute(ts).between(570, 960)
    return inside if timespan is None else F.when(timespan == "day", True).otherwise(inside)


def ny_close_available(day: Column, clock: str = "16:00:00", buffer_minutes: int = 30) -> Column:
    """The instant a daily value is known: its date's New York clock time, plus a buffer."""
    local = F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock)))
    return F.to_utc_timestamp(local, NEW_YORK) + F.expr(f"INTERVAL {buffer_minutes} MINUTES")


def bar_available(ts: Column, timespan: Column) -> Column:
    """Bar start plus its interval; null for an unknown timespan."""
    plus = lambda text: instant(ts) + F.expr(f"INTERVAL {text}")
    return F.when(timespan == "minute", plus("1 MINUTE")).when(timespan == "hour", plus("1 HOUR")).when(timespan == "day", plus("1 DAY"))


def option_right(right: Column, style: str = "letter", other: bool = False) -> Column:
    """C/P (letter) or CALL/PUT (word) from any spelling; anything else is null, or with `other` the
    upper-cased text."""
    first = F.upper(F.trim(right))
    call, put = ("C", "P") if style == "letter" else ("CALL", "PUT")
    found = F.when(first.isin("C", "CALL", "CALLS"), call).when(first.isin("P", "PUT", "PUTS"), put)
    return found.otherwise(F.upper(right)) if other else found


def normalized_symbol(symbol: Column) -> Column:
    return F.nullif(F.upper(F.trim(symbol)), F.lit(""))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0).cast("double"))


def positive_log(x: Column) -> Column:
    """ln(x), null where x is not positive."""
    return F.when(x > 0, F.log(x))


def dedup_hash(*parts: Column, separator: str = "|") -> Column:
    return F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256)


def canonical_id(*parts: Column) -> Column:
    """SHA-256 of length-delimited parts, so no two tuples run together; null is its own mark."""
    coded = [F.when(p.isNull(), F.lit("-;")).otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";"))) for p in parts]
    return F.sha2(F.concat(*coded), 256)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
