"""Times, text keys, colours and array positions as Column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_seconds(ts: Column) -> Column:
    """Seconds since 1970 with fractions; null stays null."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def parse_time(text: Column) -> Column:
    """ISO with or without fractions, or day.month.year; null where none fits."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")), F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm:ss")))


def cyclic_time(ts: Column) -> tuple[Column, Column]:
    """(sin, cos) of the time of day."""
    angle = 2 * math.pi * (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400
    return F.sin(angle), F.cos(angle)


def period_micros(period: str) -> int:
    """Microseconds of '<number>T', a number of minutes."""
    if not isinstance(period, str) or not (m := re.fullmatch(r"(\d+(?:\.\d+)?)T", period)):
        raise ValueError("a time period is '<minutes>T'")
    return round(float(m[1]) * 60_000_000)


def queue_key(namespace: Column | str, user: Column, name: Column | str) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (namespace, user, name)]
    return F.concat_ws(":", *parts)


def is_number(text: Column) -> Column:
    return F.try_to_number(text, F.lit("S9999999999.9999999999")).isNotNull() | text.try_cast("double").isNotNull()


def colour_hex(number: Column) -> Column:
    """24-bit number -> '#rrggbb'."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(number)), 6, "0"))


def colour_number(text: Column) -> Column:
    return F.conv(F.ltrim(text, F.lit("#")), 16, 10).cast("long")


def colour_rgb(number: Column) -> Column:
    return F.array(*[F.shiftright(number, s).bitwiseAND(255) for s in (16, 8, 0)])


def range_slice(items: Column, start: Column, end: Column) -> Column:
    """Items from start to end, both included; negative positions count from the end, positions beyond are pulled in."""
    n = F.size(items)
    lo = F.greatest(F.lit(0), F.when(start < 0, start + n).otherwise(start))
    hi = F.least(n - 1, F.when(end < 0, end + n).otherwise(end))
    return F.slice(items, lo + 1, F.greatest(F.lit(0), hi - lo + 1))


def push_right(items: Column, *new: Column) -> Column:
    return F.concat(items, F.array(*new))


def pop_left(items: Column) -> tuple[Column, Column]:
    """(the first item or null, the others)."""
    return F.get(items, 0), F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def pop_right(items: Column) -> tuple[Column, Column]:
    """(the last item or null, the others)."""
    return F.get(items, F.size(items) - 1), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def item_at(items: Column, at: Column) -> Column:
    """The item at a position; negative ones count from the end, null outside."""
    return F.get(items, F.when(at < 0, at + F.size(items)).otherwise(at))


def set_at(items: Column, at: Column, value: Column) -> Column:
    """items with one replaced; a position outside leaves them as they are."""
    k = F.when(at < 0, at + F.size(items)).otherwise(at)
    return F.transform(items, lambda x, i: F.when(i == k, value).otherwise(x))
