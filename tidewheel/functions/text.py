"""Scalar helpers on names, errors, durations and backoff."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS_US = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def error_type(error: Column) -> Column:
    """The text before the first colon, if there is one after the first character."""
    return F.when(F.instr(error, ":") > 1, F.substring_index(error, ":", 1)).otherwise(error)


def sanitize(name: Column) -> Column:
    """Every byte outside a-z, A-Z, 0-9 becomes an underscore; a code point of n bytes gives n of them."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    kept = F.transform(chars, lambda c: F.when(c.rlike("^[a-zA-Z0-9]$"), c).otherwise(F.repeat(F.lit("_"), F.octet_length(c))))
    return F.array_join(kept, "")


def full_name(name: Column) -> Column:
    """struct(bus, topic, valid) of `bus://topic`."""
    bus, topic = F.regexp_extract(name, r"^(.*?)://(.*)$", 1), F.regexp_extract(name, r"^(.*?)://(.*)$", 2)
    return F.struct(bus.alias("bus"), topic.alias("topic"), ((bus != "") & (topic != "")).alias("valid"))


def backoff_ms(attempt: Column, base: int = 100, cap: int = 5_000, jitter: float = 0.3) -> Column:
    """struct(delay, low, high): base doubled by attempt, capped, with the bounds of the jitter."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(62))), F.lit(float(cap)))
    return F.struct(delay.alias("delay"), (delay * (1 - jitter)).alias("low"), (delay * (1 + jitter)).alias("high"))


def parse_duration(text: str) -> int:
    """Microseconds of a duration such as 1h30m or 250ms; raises ValueError if it isn't one."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text.lstrip("+-"))
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(a) * _UNITS_US[b] for a, b in parts)
    return int(-total if text.startswith("-") else total)


def worst_status(status: Column) -> Column:
    """Aggregate: the most severe of healthy, degraded and unhealthy."""
    rank = F.when(status == "unhealthy", 2).when(status == "degraded", 1).otherwise(0)
    worst = F.max(rank)
    return F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy")


def rfc3339(text: Column) -> Column:
    """The UTC time of an RFC 3339 text, null for what is none."""
    fits = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(fits, F.try_to_timestamp(F.upper(F.regexp_replace(text, " ", "T"))))
