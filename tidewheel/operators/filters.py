"""Filters of the stores: dataclasses whose unset fields match everything, compiled to one predicate each."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _at(value: str | datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def effective_limit(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


@dataclass(frozen=True)
class MonitorFilter:
    event_id: str | None = None
    subscription_id: str | None = None
    event_name: str | None = None
    bus_id: str | None = None
    delivery_mode: str | None = None
    status: tuple[str, ...] = ()
    has_error: bool | None = None
    start_time: str | datetime | None = None
    end_time: str | datetime | None = None
    min_duration_ms: int | None = None
    min_retries: int | None = None
    cursor: str | None = None
    limit: int = 0
    descending: bool = False

    def predicate(self) -> Column:
        """Equalities, status in, started_at in [start, end), duration and retries at least."""
        parts = [F.col(c) == v for c in ("event_id", "subscription_id", "event_name", "bus_id", "delivery_mode") if (v := getattr(self, c))]
        if self.status:
            parts.append(F.col("status").isin(*self.status))
        if self.has_error is not None:
            blank = F.coalesce(F.col("error"), F.lit("")) == ""
            parts.append(~blank if self.has_error else blank)
        if self.start_time:
            parts.append(F.col("started_at") >= _at(self.start_time))
        if self.end_time:
            parts.append(F.col("started_at") < _at(self.end_time))
        if self.min_duration_ms:
            parts.append(F.col("duration_ms") >= self.min_duration_ms)
        if self.min_retries:
            parts.append(F.col("retry_count") >= self.min_retries)
        return _all(parts)


@dataclass(frozen=True)
class DlqFilter:
    event_name: str | None = None
    start_time: str | datetime | None = None
    end_time: str | datetime | None = None
    error: str | None = None
    case_sensitive: bool = False
    error_is_pattern: bool = False
    max_retries: int = 0
    source: str | None = None
    exclude_retried: bool = False
    limit: int = 0
    offset: int = 0

    def predicate(self) -> Column:
        """created_at in [start, end], both ends included; error holds a literal text, or matches
        a pattern."""
        parts = [F.col(c) == v for c in ("event_name", "source") if (v := getattr(self, c))]
        if self.start_time:
            parts.append(F.col("created_at") >= _at(self.start_time))
        if self.end_time:
            parts.append(F.col("created_at") <= _at(self.end_time))
        if self.error and self.error_is_pattern:
            parts.append(F.col("error").rlike(self.error if self.case_sensitive else f"(?i){self.error}"))
        elif self.error:
            column, want = (F.col("error"), self.error) if self.case_sensitive else (F.lower("error"), self.error.lower())
            parts.append(column.contains(want))
        if self.max_retries:
            parts.append(F.col("retry_count") <= self.max_retries)
        if self.exclude_retried:
            parts.append(F.col("retried_at").isNull())
        return _all(parts)


@dataclass(frozen=True)
class ScheduleFilter:
    event_name: str | None = None
    after: str | datetime | None = None
    before: str | datetime | None = None
    limit: int = 0

    def predicate(self) -> Column:
        parts = [F.col("event_name") == self.event_name] if self.event_name else []
        if self.after:
            parts.append(F.col("scheduled_at") >= _at(self.after))
        if self.before:
            parts.append(F.col("scheduled_at") <= _at(self.before))
        return _all(parts)


@dataclass(frozen=True)
class SagaFilter:
    name: str | None = None
    status: tuple[str, ...] = ()
    limit: int = 0

    def predicate(self) -> Column:
        parts = [F.col("name") == self.name] if self.name else []
        return _all(parts + ([F.col("status").isin(*self.status)] if self.status else []))


def encode_cursor(started_at: datetime, event_id: str, subscription_id: str) -> str:
    return base64.b64encode(json.dumps({"s": started_at.isoformat(), "e": event_id, "u": subscription_id}).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str, str]:
    got = json.loads(base64.b64decode(cursor))
    return got["s"], got["e"], got["u"]


def monitor_filter_from_query(query: dict[str, str]) -> MonitorFilter:
    """A filter from HTTP query parameters; values that don't parse are ignored."""
    from ..functions.text import parse_duration

    def tried(key, make):
        try:
            return make(query[key])
        except (KeyError, ValueError):
            return None

    when = lambda v: datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
    flag = lambda v: {"true": True, "1": True, "false": False, "0": False}[v.lower()] if v.lower() in ("true", "1", "false", "0") else None
    duration = tried("min_duration", parse_duration)
    return MonitorFilter(
        event_id=query.get("event_id"),
        subscription_id=query.get("subscription_id"),
        event_name=query.get("event_name"),
        bus_id=query.get("bus_id"),
        delivery_mode=query.get("delivery_mode"),
        status=tuple(x for x in query.get("status", "").split(",") if x),
        has_error=tried("has_error", flag),
        start_time=tried("start_time", when),
        end_time=tried("end_time", when),
        min_duration_ms=None if duration is None else duration // 1000,
        min_retries=tried("min_retries", int),
        cursor=query.get("cursor"),
        limit=tried("limit", int) or 0,
        descending=query.get("order", "").lower() == "desc",
    )


def delete_age(older_than: str | None, force: bool = False) -> timedelta:
    """The guarded age of a delete request: 24 h by default, less only with force."""
    from ..functions.text import parse_duration

    age = timedelta(hours=24) if not older_than else timedelta(microseconds=parse_duration(older_than))
    if age <= timedelta(0):
        raise ValueError("older_than must be positive")
    if age < timedelta(hours=24) and not force:
        raise ValueError("older_than under 24h needs force")
    return age
