"""The ordered fold: per key, in order, `state, outcome = step(state, row)`.

Whether a row is accepted depends on which earlier ones were, so neither lag nor a frame can tell. A fold is defined once
(a Fold) and has two forms. Batch: rows are dealt by key and sorted within tasks, and each task streams through its rows
with one state at a time, so a key of any length takes constant memory and no group is gathered. Streaming:
`streaming.stateful` keeps the same state per key in the state store.

Folds with a reset gap (a pause after which the state is as good as new) can have their keys split at such pauses:
`split_gap` finds them by spans of time, so that no task holds all of a key, and the fold then runs on (key, session). It is
exact for the folds that set `gap_us`.

Times are microseconds. Rows are ordered by (ts, seq); rows without a time come first, change nothing and have no outcome.
A null key is a key of its own, and so is NaN. Keys of any type keep their value; extra columns are ignored. A null `ok`
counts as a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import column, free_name

Step = Callable[[tuple, int, bool], tuple[tuple, Any]]
HOUR = 3_600_000_000
#: Gaps in a span of split_gap.
SPAN = 64
#: What `ok` is for a row that isn't a delivery but an operator's release of the key.
RELEASE = 2


@dataclass(frozen=True)
class Fold:
    """init: a tuple of numbers (or lists of them); step(state, t_us, ok) gives the next state and the outcome."""

    init: tuple
    step: Step
    out_type: str = "string"
    gap_us: int | None = None


def dedup_ttl(ttl_us: int, inclusive: bool = True, claim_on_check: bool = False) -> Fold:
    """duplicate while a mark holds, else ok or fail. A success marks for ttl; with claim_on_check the check itself does.
    inclusive: a row exactly at the expiry is still a duplicate."""

    def step(state, t, ok):
        (until,) = state
        if until is not None and (t <= until if inclusive else t < until):
            return state, "duplicate"
        if ok or claim_on_check:
            state = (t + ttl_us,)
        return state, "ok" if ok else "fail"

    return Fold((None,), step, gap_us=ttl_us)


def poison(threshold: int = 5, quarantine_us: int = HOUR, inclusive: bool = True) -> Fold:
    """skip while quarantined; a failure counts and quarantines from the threshold on; a success clears the count. The
    count outlives the quarantine, so the first failure after it quarantines again. A release clears both."""

    def step(state, t, ok):
        if ok == RELEASE:
            return (0, None), "released"
        failures, until = state
        if until is not None and (t <= until if inclusive else t < until):
            return state, "skip"
        if ok:
            return (0, until), "ok"
        failures += 1
        return (failures, t + quarantine_us if failures >= threshold else until), "fail"

    return Fold((0, None), step)


def poison_until(threshold: int = 5, quarantine_us: int = HOUR, inclusive: bool = True) -> Fold:
    """The end of the quarantine that the key is in after each row, in microseconds; null without one."""
    inner = poison(threshold, quarantine_us, inclusive)

    def step(state, t, ok):
        state, _ = inner.step(state, t, ok)
        return state, state[1]

    return Fold(inner.init, step, "bigint")


def circuit_breaker(failures: int = 5, successes: int = 2, timeout_us: int = 30_000_000) -> Fold:
    """closed opens at so many failures in a row; open rejects until more than timeout has passed, then one is let
    through half-open; so many successes there close it, a failure opens it again."""

    def step(state, t, ok):
        mode, failed, good, since = state
        if mode == 1:
            if t - since <= timeout_us:
                return state, "rejected"
            mode, good = 2, 0
        if ok:
            if mode == 2:
                good += 1
                return ((0, 0, 0, since) if good >= successes else (2, failed, good, since)), "ok"
            return (0, 0, 0, since), "ok"
        failed += 1
        return ((1, failed, 0, t) if mode == 2 or failed >= failures else (0, failed, 0, t)), "fail"

    return Fold((0, 0, 0, 0), step)


def fixed_window(limit: int, window_us: int) -> Fold:
    """A window starts with the first row after the last one's end; denied rows count too."""

    def step(state, t, ok):
        start, n = state
        start, n = (t, 1) if start is None or t >= start + window_us else (start, n + 1)
        return (start, n), "allow" if n <= limit else "deny"

    return Fold((None, 0), step, gap_us=window_us)


def fixed_window_remaining(limit: int, window_us: int) -> Fold:
    """What the window allows after each row, 0 at least."""
    inner = fixed_window(limit, window_us)

    def step(state, t, ok):
        state, _ = inner.step(state, t, ok)
        return state, max(0, limit - state[1])

    return Fold(inner.init, step, "bigint")


def sliding_window(limit: int, window_us: int) -> Fold:
    """At most limit accepted rows in any window; only accepted ones are held."""

    def step(state, t, ok):
        kept = [x for x in state[0] if x > t - window_us]
        if len(kept) >= limit:
            return (kept,), "deny"
        return (kept + [t],), "allow"

    return Fold(([],), step, gap_us=window_us)


def sliding_window_remaining(limit: int, window_us: int) -> Fold:
    """What the window allows after each row, 0 at least."""
    inner = sliding_window(limit, window_us)

    def step(state, t, ok):
        state, _ = inner.step(state, t, ok)
        return state, max(0, limit - len(state[0]))

    return Fold(inner.init, step, "bigint", inner.gap_us)


def sliding_window_delay(limit: int, window_us: int) -> Fold:
    """What a reservation waits: nothing while the window allows it, else the window's share of one row."""
    inner = sliding_window(limit, window_us)

    def step(state, t, ok):
        state, outcome = inner.step(state, t, ok)
        return state, 0 if outcome == "allow" else window_us // limit

    return Fold(inner.init, step, "bigint", inner.gap_us)


def token_bucket_delay(burst: int, us_per_token: int) -> Fold:
    """How long after each row the bucket has a whole token again."""
    inner = token_bucket(burst, us_per_token)

    def step(state, t, ok):
        state, _ = inner.step(state, t, ok)
        return state, max(0, us_per_token - state[0])

    return Fold(inner.init, step, "bigint", inner.gap_us)


def token_bucket(burst: int, us_per_token: int) -> Fold:
    """A full bucket at first; whole microseconds of credit, so no rounding enters."""

    def step(state, t, ok):
        level, last = state
        level = burst * us_per_token if last is None else min(burst * us_per_token, level + t - last)
        if level >= us_per_token:
            return (level - us_per_token, t), "allow"
        return (level, t), "deny"

    return Fold((0, None), step, gap_us=burst * us_per_token)


def micro_batches(size: int, timeout_us: int) -> Fold:
    """The batch number of each row. A batch is flushed when it has `size` rows, or at the first tick after the last flush
    that finds rows; ticks lie timeout apart from the last flush on, at first from the first row."""

    def step(state, t, ok):
        number, n, anchor = state
        if anchor is None:
            anchor = t
        ticks = (t - anchor) // timeout_us
        if ticks > 0:
            anchor += ticks * timeout_us
            number, n = number + (n > 0), 0
        n += 1
        return ((number + 1, 0, t) if n >= size else (number, n, anchor)), number

    return Fold((0, 0, None), step, "bigint")


def split_gap(rows: DataFrame, key: str, ts: str, seq: str, gap_us: int, out: str = "session") -> DataFrame:
    """rows with the start (microseconds) of the key's session: a pause of more than the gap starts a new one.

    A key's time is cut in spans of SPAN gaps. Within a span, a window finds pauses and session starts; what a span must know
    of the ones before (their last time, the session then open) comes from a table with a row per key and span. A span
    without rows is longer than the gap, so only the span just before can hold the last row of the same session."""
    names = {n: free_name(n, rows.columns) for n in ("us", "span", "open", "fresh", "k", "s", "last", "carry")}
    us, span, open_, fresh = (column(names[n]) for n in ("us", "span", "open", "fresh"))
    spanned = rows.withColumn(names["us"], F.unix_micros(column(ts).cast("timestamp")))
    spanned = spanned.withColumn(names["span"], F.floor(us / (SPAN * gap_us)).cast("bigint"))
    within = Window.partitionBy(column(key), span).orderBy(us, column(seq))
    ends = spanned.groupBy(column(key).alias(names["k"]), (span + 1).alias(names["s"])).agg(F.max(us).alias(names["last"]))
    same = (column(key).eqNullSafe(column(names["k"]))) & (span == column(names["s"]))
    known = spanned.join(ends, same, "left").drop(names["k"], names["s"])
    before = F.coalesce(F.lag(us).over(within), column(names["last"]))
    marked = known.withColumn(names["fresh"], F.when(before.isNull() | (us - before > gap_us), us))
    marked = marked.withColumn(names["open"], F.last(fresh, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(column(key).alias(names["k"]), span.alias(names["s"])).agg(F.max(fresh).alias(names["last"]))
    carried = F.last(column(names["last"]), ignorenulls=True).over(
        Window.partitionBy(column(names["k"])).orderBy(column(names["s"])).rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = spans.select(names["k"], names["s"], carried.alias(names["carry"]))
    joined = marked.drop(names["last"]).join(spans, same, "left")
    return joined.select(*[column(c) for c in rows.columns if c != out], F.coalesce(open_, column(names["carry"])).alias(out))


def fold(
    rows: DataFrame,
    key: str,
    definition: Fold,
    ts: str = "ts",
    seq: str = "seq",
    ok: str | None = "ok",
    out: str = "outcome",
    by_session: bool = False,
    release: str | None = None,
    final: bool = False,
) -> DataFrame:
    """rows' key, seq and outcome. by_session: split keys at the fold's reset gap first. release: a boolean column that marks
    rows which release their key instead of being delivered. final: only each key's last row (not with by_session)."""
    session = free_name("session", rows.columns)
    if by_session and definition.gap_us is not None:
        rows = split_gap(rows, key, ts, seq, definition.gap_us, session)
        keys = [key, session]
    else:
        keys = [key]
    code = F.coalesce(column(ok).cast("int"), F.lit(0)) if ok else F.lit(1)
    if release:
        code = F.when(column(release), RELEASE).otherwise(code)
    named = [column(k).alias(f"k{i}") for i, k in enumerate(keys)]
    slim = rows.select(*named, column(seq).alias("seq"), F.unix_micros(column(ts).cast("timestamp")).alias("t"), code.alias("ok"))
    slim = slim.repartition(*[f"k{i}" for i in range(len(keys))]).sortWithinPartitions(*[f"k{i}" for i in range(len(keys))], "t", "seq")
    kind = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([kind[key], kind[seq], T.StructField(out, T._parse_datatype_string(definition.out_type))])
    init, step, width = definition.init, definition.step, len(keys)
    outcome_type = pa.int64() if definition.out_type == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, kept, kinds = None, init, None, ()
        for batch in batches:
            kinds = (batch.column(0).type, batch.column(width).type, outcome_type)
            results, ends = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for *now, at, t, good in zip(*columns):
                plain = ["nan" if x != x else x for x in now]
                if plain != last:
                    if kept is not None:
                        ends.append(kept)
                    last, state = plain, init
                outcome = None
                if t is not None:
                    state, outcome = step(state, t, good)
                kept = (now[0], at, outcome)
                results.append(outcome)
            if final:
                arrays = [pa.array(c, k) for c, k in zip(zip(*ends) if ends else ((),) * 3, kinds)]
            else:
                arrays = [batch.column(0), batch.column(width), pa.array(results, outcome_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())
        if final and kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(kept, kinds)], names=schema.fieldNames())

    return slim.mapInArrow(run, schema)


def idempotent(rows: DataFrame, key: str, definition: Fold, **given) -> DataFrame:
    """A deduplicating fold as a stage: rows without an id (null or empty) pass, each with its own outcome."""
    named = F.coalesce(column(key).cast("string"), F.lit("")) != ""
    ts, seq, ok, out = (given.get(n, d) for n, d in (("ts", "ts"), ("seq", "seq"), ("ok", "ok"), ("out", "outcome")))
    passed = rows.where(~named).select(column(key), column(seq), F.when(column(ok) if ok else F.lit(True), "ok").otherwise("fail").alias(out))
    return fold(rows.where(named), key, definition, **given).unionByName(passed)


def quarantined(rows: DataFrame, key: str, threshold: int, quarantine_us: int, as_of: str, limit: int = 100, **given) -> DataFrame:
    """(key, quarantined_at) of the keys whose quarantine holds at as_of, newest first, by the poison fold's own state."""
    state = fold(rows, key, poison_until(threshold, quarantine_us), out="until", final=True, **given)
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    active = state.where(F.col("until") > now).select(column(key), F.timestamp_micros(F.col("until") - quarantine_us).cast("timestamp_ntz").alias("quarantined_at"))
    return active.orderBy(F.desc("quarantined_at"), column(key)).limit(limit)


def batches_by_size(rows: DataFrame, size: int, key: str | None = None, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Closed form for batches by size only."""
    from .routing import before_each, numbered

    if key is None:
        return numbered(rows, order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("bigint")).drop("__n")
    counted = before_each(rows, key, order, F.lit(1), "sum", "__n")
    return counted.withColumn("batch", F.floor(F.coalesce("__n", F.lit(0)) / size).cast("bigint")).drop("__n")
