"""The queryable stores as functions from DataFrame to DataFrame. `as_of` is the clock, always given.

Reads end in TakeOrderedAndProject; counts and statistics are one aggregation; changes give the whole next state of a
table, or the rows that change, for an append log with a latest-row view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sampled
from ..functions.text import error_type
from ..model import SAGA_STATUSES
from .filters import DlqFilter, MonitorFilter, SagaFilter, ScheduleFilter, decode_cursor, effective_limit, encode_cursor

MONITOR_KEY = ("started_at", "event_id", "subscription_id")


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def before(as_of: str, interval: str) -> Column:
    return at(as_of) - F.expr(f"INTERVAL {interval}")


# Monitor


def monitor_rows(entries: DataFrame, f: MonitorFilter) -> DataFrame:
    """The filtered entries past the cursor, in keyset order, one more than a page."""
    rows = entries.where(f.predicate())
    if f.cursor:
        s, e, u = decode_cursor(f.cursor)
        here = F.struct(*[F.col(c) for c in MONITOR_KEY])
        there = F.struct(F.lit(s).cast("timestamp_ntz").alias("started_at"), F.lit(e).alias("event_id"), F.lit(u).alias("subscription_id"))
        rows = rows.where(here < there if f.descending else here > there)
    order = [F.col(c).desc() if f.descending else F.col(c).asc() for c in MONITOR_KEY]
    return rows.orderBy(*order).limit(effective_limit(f.limit) + 1)


def monitor_list(entries: DataFrame, f: MonitorFilter) -> DataFrame:
    order = [F.col(c).desc() if f.descending else F.col(c).asc() for c in MONITOR_KEY]
    return monitor_rows(entries, f).orderBy(*order).limit(effective_limit(f.limit))


def monitor_page(entries: DataFrame, f: MonitorFilter) -> tuple[list, bool, str | None]:
    """(rows, has more, next cursor): a page, so at most 1001 rows come to the driver."""
    rows, size = monitor_rows(entries, f).collect(), effective_limit(f.limit)
    more, rows = len(rows) > size, rows[:size]
    return rows, more, encode_cursor(rows[-1]["started_at"], rows[-1]["event_id"], rows[-1]["subscription_id"]) if more else None


def monitor_get(entries: DataFrame, event_id: str, subscription_id: str) -> DataFrame:
    return entries.where((F.col("event_id") == event_id) & (F.col("subscription_id") == subscription_id))


def monitor_by_event_id(entries: DataFrame, event_id: str) -> DataFrame:
    return entries.where(F.col("event_id") == event_id).orderBy("started_at", "subscription_id")


def monitor_record(log: DataFrame, key: tuple[str, ...] = ("event_id", "subscription_id"), version: str = "seq") -> DataFrame:
    """The latest state of an append log: the first record's start, names and metadata stay, the last one's status,
    error, retries and duration count. Worker-pool rows share the empty subscription."""
    keyed = log.withColumn("subscription_id", F.when(F.col("delivery_mode") == "worker_pool", F.lit("")).otherwise(F.col("subscription_id")))
    late = {"status", "error", "retry_count", "completed_at", "duration_ms"}
    rest = [c for c in keyed.columns if c not in key and c != version]
    firsts = F.min_by(F.struct(*[c for c in rest if c not in late]), version).alias("f")
    lasts = F.max_by(F.struct(*[c for c in rest if c in late]), version).alias("l")
    return keyed.groupBy(*key).agg(firsts, lasts).select(*key, "f.*", "l.*")


def monitor_update_status(entries: DataFrame, event_id: str, subscription_id: str, status: str, error: str | None, duration_ms: int, as_of: str) -> DataFrame:
    """error is cleared by a success."""
    hit = (F.col("event_id") == event_id) & (F.col("subscription_id") == subscription_id)
    new = {"status": F.lit(status), "error": F.lit(error).cast("string"), "duration_ms": F.lit(duration_ms).cast("bigint")}
    if "completed_at" in entries.columns:
        new["completed_at"] = at(as_of)
    return entries.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def monitor_sampled(entries: DataFrame, rate: float) -> DataFrame:
    return entries if rate >= 1 else entries.where(sampled(F.col("event_id"), rate))


def delete_older_than(rows: DataFrame, column: str, as_of: str, interval: str) -> DataFrame:
    """What stays after rows with column before as_of - interval go; rows without a value stay."""
    return rows.where(~F.coalesce(F.col(column) < before(as_of, interval), F.lit(False)))


# Dead letters


def dlq_list(rows: DataFrame, f: DlqFilter) -> DataFrame:
    out = rows.where(f.predicate()).orderBy(F.desc("created_at"), F.desc("id"))
    out = out.offset(f.offset) if f.offset else out
    return out.limit(f.limit) if f.limit else out


def dlq_store(failed: DataFrame, dlq_id: Column, error: Column, source: Column, as_of: str) -> DataFrame:
    return failed.select(
        dlq_id.alias("id"), "event_name", F.col("id").alias("original_id"), "payload", error.alias("error"), "retry_count",
        source.alias("source"), at(as_of).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("retried_at"),
    )


def dlq_result(stored: Column) -> Column:
    """ack once the dead letter is stored, else nack: the message comes again."""
    return F.when(F.coalesce(stored, F.lit(False)), "ack").otherwise("nack")


def dlq_stats_from_counts(rows: DataFrame) -> DataFrame:
    """Statistics of a store that can only count: all rows, and those left without the retried."""
    from .filters import DlqFilter

    left = F.count_if(DlqFilter(exclude_retried=True).predicate())
    return rows.agg(F.count("*").alias("total"), left.alias("pending"), (F.count("*") - left).alias("retried"))


def dlq_stats(rows: DataFrame) -> DataFrame:
    retried = F.count("retried_at")
    return rows.agg(
        F.count("*").alias("total"), retried.alias("retried"), (F.count("*") - retried).alias("pending"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )


def dlq_by_event(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_name").agg(F.count("*").alias("n"))


def dlq_by_error_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy(error_type(F.col("error")).alias("error_type")).agg(F.count("*").alias("n"))


def dlq_replay(rows: DataFrame, f: DlqFilter, metadata: str | None = None) -> DataFrame:
    """The messages that a replay publishes: their own id and payload, source dlq-replay, and what they came from."""
    own = F.create_map(
        F.lit("dlq_replay"), F.lit("true"), F.lit("dlq_message_id"), F.col("id"), F.lit("dlq_original_error"), F.col("error")
    )
    merged = F.map_concat(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")), own) if metadata else own
    return dlq_list(rows, f).select(F.col("original_id").alias("id"), "event_name", F.lit("dlq-replay").alias("source"), "payload", merged.alias("metadata"), F.col("id").alias("dlq_id"))


def dlq_mark_retried(rows: DataFrame, hit: Column, as_of: str) -> DataFrame:
    return rows.withColumn("retried_at", F.when(hit, at(as_of)).otherwise(F.col("retried_at")))


def dlq_increment_retry(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.withColumn("retry_count", F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count")))


def dlq_delete(rows: DataFrame, f: DlqFilter) -> DataFrame:
    return rows.where(~F.coalesce(f.predicate(), F.lit(False)))


def keep_last(rows: DataFrame, n: int, order: str = "created_at", key: str = "id") -> DataFrame:
    """A capped collection: the last n rows by order."""
    return rows.orderBy(F.desc(order), F.desc(key)).limit(n)


# Outbox


def outbox_pending(rows: DataFrame, limit: int = 100) -> DataFrame:
    return rows.where("status = 'pending'").orderBy("created_at", "id").limit(limit)


def outbox_insert(rows: DataFrame, messages: DataFrame, as_of: str) -> DataFrame:
    """The new pending rows of messages (event_name, id, ts): ids go on from the greatest, in (ts, id) order."""
    from .routing import numbered

    base = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))  # one row
    new = numbered(messages.select("event_name", F.col("id").alias("event_id"), "ts"), ("ts", "event_id"), "n").join(F.broadcast(base))
    return new.select(
        (F.col("base") + F.col("n")).alias("id"), "event_name", "event_id", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"),
        at(as_of).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.lit(None).cast("timestamp_ntz").alias("published_at"),
    )


def outbox_claim(rows: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The oldest pending rows in their next state: processing, claimed now."""
    return outbox_pending(rows, limit).withColumns({"status": F.lit("processing"), "claimed_at": at(as_of)})


def outbox_after_claim(rows: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The whole table after a claim: `limit` claimed ids are broadcast."""
    claimed = F.broadcast(outbox_pending(rows, limit).select("id", F.lit(True).alias("claimed_now")))
    joined = rows.join(claimed, "id", "left")
    new = {"status": F.lit("processing"), "claimed_at": at(as_of)}
    return joined.withColumns({c: F.when(F.col("claimed_now"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("claimed_now")


def outbox_take(rows: DataFrame, me: str, limit: int = 100) -> DataFrame:
    """What a relay reads: its own unfinished rows first, then new ones, each oldest first."""
    own = (F.col("status") == "processing") & (F.col("consumer") == me)
    ranked = rows.where(own | (F.col("status") == "pending")).withColumn("turn", F.when(own, 0).otherwise(1))
    return ranked.orderBy("turn", "created_at", "id").limit(limit)


def outbox_relay_step(rows: DataFrame, publish_ok: Column, as_of: str, limit: int = 100) -> DataFrame:
    """The rows of a relay step in their next state: published, or failed with one retry more."""
    step = outbox_pending(rows, limit).withColumn("ok", publish_ok)
    return step.select(
        "id", "event_id",
        F.when(F.col("ok"), "published").otherwise("failed").alias("status"),
        F.when(F.col("ok"), F.col("retry_count")).otherwise(F.col("retry_count") + 1).alias("retry_count"),
        F.when(F.col("ok"), at(as_of)).alias("published_at"),
        F.when(~F.col("ok"), F.lit("publish failed")).alias("last_error"),
    )


def outbox_recover_stuck(rows: DataFrame, as_of: str, interval: str = "'5' MINUTE") -> DataFrame:
    stuck = (F.col("status") == "processing") & (F.col("claimed_at") < before(as_of, interval))
    return rows.withColumns({"claimed_at": F.when(stuck, F.lit(None)).otherwise(F.col("claimed_at")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def outbox_retry_failed(rows: DataFrame, max_retries: int) -> DataFrame:
    again = (F.col("status") == "failed") & (F.col("retry_count") < max_retries)
    return rows.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def outbox_cleanup(rows: DataFrame, as_of: str, interval: str) -> DataFrame:
    gone = (F.col("status") == "published") & (F.col("published_at") < before(as_of, interval))
    return rows.where(~F.coalesce(gone, F.lit(False)))


def outbox_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


# Scheduled messages


def sched_due(rows: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The messages of a tick as published: source scheduler, and what they were."""
    due = rows.where(F.col("scheduled_at") <= at(as_of)).orderBy("scheduled_at", "id").limit(limit)
    stamp = F.date_format("scheduled_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return due.select("id", "event_name", F.lit("scheduler").alias("source"), F.col("id").alias("scheduled_message_id"), stamp.alias("scheduled_at_text"), "scheduled_at")


def sched_list(rows: DataFrame, f: ScheduleFilter) -> DataFrame:
    out = rows.where(f.predicate()).orderBy("scheduled_at", "id")
    return out.limit(f.limit) if f.limit else out


def sched_after_tick(rows: DataFrame, as_of: str, publish_ok: Column, limit: int = 100) -> DataFrame:
    """What is left after a tick: the due batch without the published ones."""
    done = rows.where(F.col("scheduled_at") <= at(as_of)).orderBy("scheduled_at", "id").limit(limit).where(publish_ok).select("id")
    return rows.join(done, "id", "left_anti")


def sched_add(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with new messages; one that is there already, by id, stays as it is."""
    return rows.unionByName(new.select(*rows.columns).dropDuplicates(["id"]).join(rows.select("id"), "id", "left_anti"))


def sched_get(rows: DataFrame, message_id: str) -> DataFrame:
    return rows.where(F.col("id") == message_id)


def sched_cancel(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def sched_counts(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.groupBy("event_name").agg(F.count("*").alias("n"), F.count_if(F.col("scheduled_at") <= at(as_of)).alias("due"))


# Sagas


def saga_execute(steps: DataFrame) -> DataFrame:
    """One row per saga of its steps in order: it runs to the first step that fails, then compensates the completed ones
    in reverse. Closed form: two aggregates over the steps, no loop."""
    failed = F.min(F.when(~F.col("exec_ok"), F.col("step_no")))
    per = steps.groupBy("saga_id").agg(
        failed.alias("failed_step"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("step_no", "step_name", "compensate_ok"))).alias("steps"),
    )
    before_it = F.filter("steps", lambda s: F.col("failed_step").isNull() | (s["step_no"] < F.col("failed_step")))
    per = per.withColumn("done", before_it)
    broken = F.exists("done", lambda s: ~s["compensate_ok"])
    status = F.when(F.col("failed_step").isNull(), "completed").when(broken, "failed").otherwise("compensated")
    back = F.when(F.col("failed_step").isNotNull(), F.reverse(F.transform("done", lambda s: s["step_name"]))).otherwise(F.array())
    return per.select(
        "saga_id", status.alias("status"), F.size("done").alias("current_step"),
        F.array_join(F.transform("done", lambda s: s["step_name"]), ",").alias("completed_steps"),
        F.array_join(back, ",").alias("compensation_order"),
    )


def saga_resume(sagas: DataFrame) -> DataFrame:
    """Failed and compensated sagas start again from step 0."""
    again = F.col("status").isin("failed", "compensated")
    return sagas.withColumn("current_step", F.when(again, 0).otherwise(F.col("current_step"))).withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def saga_rerun(sagas: DataFrame, steps: DataFrame) -> DataFrame:
    """Failed and compensated sagas run again from step 0 over `steps` (with the outcomes of now); the others stay. sagas: as
    saga_execute gives them."""
    again = sagas.where(F.col("status").isin("failed", "compensated")).select("saga_id")
    rerun = saga_execute(steps.join(again, "saga_id", "left_semi"))
    return sagas.where(~F.col("status").isin("failed", "compensated")).unionByName(rerun.select(*sagas.columns))


def saga_list(sagas: DataFrame, f: SagaFilter) -> DataFrame:
    out = sagas.where(f.predicate()).orderBy(F.desc("started_at"), F.desc("id"))
    return out.limit(f.limit) if f.limit else out


def saga_counts(sagas: DataFrame) -> DataFrame:
    """A row for every status of the domain, with 0 where there is none."""
    spark = sagas.sparkSession
    domain = spark.createDataFrame([(s,) for s in SAGA_STATUSES], "status string")
    found = sagas.groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def saga_counts_by(sagas: DataFrame, *by: str) -> DataFrame:
    """Sagas by name, or by name and status."""
    return sagas.groupBy(*by).agg(F.count("*").alias("n"))


def saga_delete(sagas: DataFrame, ids: DataFrame) -> DataFrame:
    """What stays without the sagas of these ids."""
    return sagas.join(ids.select("id"), "id", "left_anti")


def saga_stats(sagas: DataFrame) -> DataFrame:
    active = F.col("status").isin("pending", "running", "compensating")
    return sagas.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in SAGA_STATUSES],
        F.min(F.when(active, F.col("started_at"))).alias("oldest_active"),
    )


def saga_cleanup(sagas: DataFrame, as_of: str, interval: str) -> DataFrame:
    done = F.col("status").isin("completed") & (F.col("started_at") < before(as_of, interval))
    return sagas.where(~F.coalesce(done, F.lit(False)))


# Schemas and checkpoints


def schema_set_history(attempts: DataFrame) -> DataFrame:
    """Every valid attempt (version 1 or more) with whether it is accepted: no lower than any valid one before. The
    running maximum of accepted versions is that of all valid ones, so no fold is needed."""
    from .routing import before_each

    valid = before_each(attempts.where("version >= 1 and name <> ''"), "name", ("ts", "seq"), F.col("version"), "max", "highest")
    return valid.withColumn("accepted", F.col("version") >= F.coalesce("highest", F.lit(0))).drop("highest")


def schema_latest(attempts: DataFrame) -> DataFrame:
    return attempts.where("version >= 1").groupBy("name").agg(F.max("version").alias("version"))


def checkpoint_latest(positions: DataFrame) -> DataFrame:
    """The last saved position of each subscriber, by arrival; it may lie before an earlier one."""
    return positions.groupBy("subscriber_id").agg(F.max_by("position", "arrival").alias("position"))


def checkpoint_resume(subscribers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where a subscriber starts: at its checkpoint, or with the latest message where it has none."""
    got = subscribers.join(checkpoints, "subscriber_id", "left")
    return got.select("subscriber_id", F.when(F.col("position").isNull(), "latest").otherwise("timestamp").alias("start_from"), "position")


def schema_changes(attempts: DataFrame) -> DataFrame:
    """What a watcher sees: every accepted set with the version before it (null for the first), which is the highest."""
    from .routing import before_each

    accepted = schema_set_history(attempts).where("accepted")
    return before_each(accepted, "name", ("ts", "seq"), F.col("version"), "max", "previous")


def schema_list(schemas: DataFrame) -> DataFrame:
    return schemas.orderBy("name")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in gone: deletes of schemas, checkpoints and marks."""
    return rows.join(gone.select(key), key, "left_anti")


def keys_of(rows: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a store, in order: names, versions, subscribers."""
    return rows.select(key).distinct().orderBy(key)


def checkpoint_info(positions: DataFrame) -> DataFrame:
    """Of each subscriber how often it saved, its first and last arrival, and the furthest position."""
    return positions.groupBy("subscriber_id").agg(
        F.count("*").alias("saves"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"), F.max("position").alias("furthest")
    )


# Marks of processed messages


def mark_processed(marks: DataFrame, new: DataFrame) -> DataFrame:
    """(message_id, processed_at, expires_at): the last mark of each message, each with its own time to live."""
    both = marks.unionByName(new.select(*marks.columns))
    return both.groupBy("message_id").agg(F.max_by(F.struct("processed_at", "expires_at"), "processed_at").alias("m")).select("message_id", "m.*")


def duplicates(messages: DataFrame, marks: DataFrame, as_of: str) -> DataFrame:
    """The messages with a mark that holds at as_of, its last moment included."""
    return messages.join(marks.where(F.col("expires_at") >= at(as_of)).select("message_id"), "message_id", "left_semi")


def expire(rows: DataFrame, as_of: str, column: str = "expires_at") -> DataFrame:
    """What stays after rows that expired before as_of go."""
    return rows.where(~F.coalesce(F.col(column) < at(as_of), F.lit(False)))
