"""Media time stamps: parsing, formatting, and arithmetic on offsets in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """H:MM:SS, MM:SS or SS in whole seconds, with an optional leading day part; anything else is null.

    Characters that are neither digits nor ``: . ,`` are dropped first. Minutes or seconds of 60 and more are null.
    """
    days = F.coalesce(F.regexp_extract(text, r"(\d+)\s*days?\s*,", 1).try_cast("long"), F.lit(0))
    t = F.regexp_replace(F.regexp_replace(text, r"^\s*\d+\s*days?\s*,", ""), r"[^\d:.,]", "")
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("long")
    hms, ms = r"^(\d+):(\d{1,2}):(\d{1,2})$", r"^(\d+):(\d{1,2})$"
    long_form = F.when((part(hms, 2) < 60) & (part(hms, 3) < 60), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3))
    short_form = F.when((part(ms, 1) < 60) & (part(ms, 2) < 60), part(ms, 1) * 60 + part(ms, 2))
    value = F.when(t.rlike(hms), long_form).when(t.rlike(ms), short_form).when(t.rlike(r"^\d+$"), t.try_cast("long"))
    return (value + days * 86400).cast("double")


def parse_time_ms(text: Column) -> Column:
    """H:MM:SS, MM:SS or SS with a fraction after ``,`` or ``.``, read as milliseconds (right-padded), in seconds."""
    parts = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    seconds = F.split(F.element_at(parts, -1), r"\.")
    fraction = F.rpad(F.coalesce(F.get(seconds, F.lit(1)), F.lit("0")), 3, "0")
    fraction = F.coalesce(F.get(seconds, F.lit(1)), F.lit("0"))
    fraction = F.when(F.length(fraction) < 3, F.rpad(fraction, 3, "0")).otherwise(fraction)
    whole = lambda c: F.trim(c).try_cast("long")
    total = F.when(F.size(parts) == 3, whole(F.get(parts, F.lit(0))) * 3600 + whole(F.get(parts, F.lit(1))) * 60 + whole(F.get(seconds, F.lit(0)))).when(F.size(parts) == 2, whole(F.get(parts, F.lit(0))) * 60 + whole(F.get(seconds, F.lit(0)))).when(F.size(parts) == 1, whole(F.get(seconds, F.lit(0))))
    return F.round(total + whole(fraction) / 1000.0, 3)


def to_seconds_lenient(text: Column) -> Column:
    """h:m:s, m:s or s as fractions; empty or bad text is 0."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), ":")
    values = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s * 60 + v)
    return F.when(F.size(parts) <= 3, F.coalesce(total, F.lit(0.0))).otherwise(F.lit(0.0))


def strict_seconds(text: Column) -> Column:
    """Sum of parts times powers of 60, as a fraction; null if a part is no number."""
    return F.aggregate(F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p).try_cast("double")), F.lit(0.0), lambda s, v: s * 60 + v)


def format_time(seconds: Column) -> Column:
    """HH:MM:SS, floored; null and negative are 00:00:00. Hours are not wrapped."""
    s = F.when(seconds >= 0, F.floor(seconds)).otherwise(F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def max_chars_for_duration(seconds: Column, per_second: int = 20, least: int = 20) -> Column:
    """Characters that can be read in the time."""
    return F.greatest((seconds * per_second).cast("long"), F.lit(least).cast("long"))


#: The slowest and the fastest speed a clip may be played at.
SLOWEST, FASTEST = 0.9, 1.3


def capped_speed(actual: Column, target: Column, slowest: float = SLOWEST, fastest: float = FASTEST) -> Column:
    """struct(speed, capped): actual/target kept between the limits; 1 unless both exceed 0.01 s."""
    raw = F.when((actual > 0.01) & (target > 0.01), actual / target).otherwise(F.lit(1.0))
    kept = F.greatest(F.lit(slowest), F.least(F.lit(fastest), raw))
    return F.struct(kept.alias("speed"), (F.abs(kept - raw) > 0.01).alias("capped"))


def tempo_chain(factor: Column) -> Column:
    """The factor as a chain of tempo filters of 0.5 to 2.0 each; 1.0 and below 0 are one filter of 1.0."""
    up = F.greatest(F.ceil(F.log2(factor) - 1e-12) - 1, F.lit(0)).cast("int")
    down = F.greatest(F.ceil(-F.log2(factor) - 1e-12) - 1, F.lit(0)).cast("int")
    rest = factor / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    last = F.when(F.abs(rest - 1) > 0.001, F.array(F.format_string("atempo=%.6f", rest))).otherwise(F.array().cast("array<string>"))
    chain = F.concat(F.array_repeat(F.lit("atempo=0.5"), down), F.array_repeat(F.lit("atempo=2.0"), up), last)
    return F.when(factor.isNull() | (factor <= 0), F.lit("atempo=1.0")).when(factor.between(0.5, 2.0), F.format_string("atempo=%.6f", factor)).otherwise(F.array_join(chain, ","))
