"""Who gets which message: fan-out, worker pools, partitioners, start positions, lag and classification."""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import crc32_text, fnv1a32
from ..session import free_name



def route_broadcast(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Every broadcast subscriber gets every message: an array of the subscribers is exploded onto each message."""
    subs = subscribers.where("mode = 'broadcast'").agg(F.array_sort(F.collect_list("subscription_id")).alias("__subs"))
    joined = messages.join(subs)  # one row, which Spark broadcasts if it is small
    return joined.withColumn("subscription_id", F.explode("__subs")).drop("__subs")


def route_by_topic(messages: DataFrame, subscriptions: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(id, event_name, subscription_id, worker_group): each message goes to the subscriptions of its own topic (event_name):
    to every broadcast one, and to one worker of each group, in turn by the topic's own count of messages. subscriptions:
    event_name, subscription_id, mode, worker_group and optionally available; a worker that isn't available is passed over for
    the next in the group's order, and a group without any gets no row (see drops)."""
    has = subscriptions if "available" in subscriptions.columns else subscriptions.withColumn("available", F.lit(True))
    wide = messages.select("id", "event_name", *[c for c in order if c not in ("id", "event_name")])
    everyone = has.where("mode = 'broadcast' and available").select("event_name", "subscription_id")
    all_of = wide.join(everyone, "event_name").select("id", "event_name", "subscription_id", F.lit("").alias("worker_group"))
    groups = has.where("mode = 'worker_pool'").groupBy("event_name", "worker_group").agg(
        F.array_sort(F.collect_list(F.struct("subscription_id", "available"))).alias("workers")
    )
    topics = groups.groupBy("event_name").agg(F.array_sort(F.collect_list(F.struct("worker_group", "workers"))).alias("groups"))
    # Numbers over all messages in topic order; a topic's own count starts at its least number.
    ranked = numbered(wide, ("event_name", *order), "n")
    firsts = ranked.groupBy("event_name").agg(F.min("n").alias("first"))
    out = ranked.join(firsts.join(topics, "event_name"), "event_name").select(
        "id", "event_name", (F.col("n") - F.col("first")).alias("m"), "groups", F.posexplode("groups").alias("g", "group")
    )
    at = ((F.col("m") * F.size("groups") + F.col("g") + 1) % F.size("group.workers")).cast("int")
    turned = F.concat(F.slice("group.workers", at + 1, F.size("group.workers")), F.slice("group.workers", F.lit(1), at))
    first = F.get(F.filter(turned, lambda w: w["available"]), F.lit(0))
    one_of = out.select("id", "event_name", first["subscription_id"].alias("subscription_id"), F.col("group.worker_group").alias("worker_group"))
    return all_of.unionByName(one_of.where("subscription_id is not null"))


def drops(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages with the reason why they reach nobody: no_subscribers, or unavailable where no subscription can take any;
    null for those that are delivered."""
    has = subscriptions if "available" in subscriptions.columns else subscriptions.withColumn("available", F.lit(True))
    topics = has.groupBy("event_name").agg(F.max("available").alias("takes"))
    joined = messages.join(topics, "event_name", "left")
    return joined.withColumn("dropped_reason", F.when(F.col("takes").isNull(), "no_subscribers").when(~F.col("takes"), "unavailable")).drop("takes")


def counters(messages: DataFrame) -> DataFrame:
    """Messages by topic and outcome, of what drops gives."""
    return messages.groupBy("event_name", F.coalesce("dropped_reason", F.lit("delivered")).alias("reason")).agg(F.count("*").alias("n"))


#: Rows of a sample for each range that rows are dealt in.
_SAMPLED = 50


def _dealt(rows: DataFrame, *order: str) -> tuple[DataFrame, str]:
    """rows with a column of their range in an order, of as many ranges as there are shuffle partitions, and its name. The bounds
    are taken from a sample beforehand and are literals: every use of the frame sees the same ranges, whatever columns it needs.
    (repartitionByRange takes a sample of its own, and so other ranges, in every use that Spark doesn't plan alike.)"""
    part = free_name("range", rows.columns)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    fraction = ranges * _SAMPLED / max(1, keys.count())
    sample = (keys.sample(fraction, 77) if fraction < 1 else keys).orderBy(*keys.columns).collect()  # about `ranges` * _SAMPLED rows
    bounds = [tuple(sample[i * len(sample) // ranges]) for i in range(1, ranges)] if sample else []
    if not bounds:
        return rows.withColumn(part, F.lit(0)), part
    kinds = [f.dataType for f in keys.schema.fields]
    table = F.sort_array(F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, keys.columns)]) for b in bounds]))
    key = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    # The number of bounds up to the key, by binary search.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))
    return rows.withColumn(part, found), part


def numbered(messages: DataFrame, order: tuple[str, ...] = ("ts", "id"), name: str = "n") -> DataFrame:
    """messages with a number from 1 in their order, without sorting all rows in one task: rows are dealt by range, and
    each range's offset comes from a table of counts, a row per range."""
    dealt, part = _dealt(messages, *order)
    rank, count, offset = (free_name(n, [*messages.columns, part, name]) for n in ("rank", "count", "offset"))
    local = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    counts = dealt.groupBy(part).agg(F.count("*").alias(count))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(offset))
    return local.join(F.broadcast(offsets), part).withColumn(name, F.col(offset) + F.col(rank)).drop(part, rank, offset)


def before_each(rows: DataFrame, key: str, order: tuple[str, ...], value: Column, how: str, name: str) -> DataFrame:
    """rows with the maximum or the sum (how: max, sum) of value over the key's earlier rows, null for the first. A hot key
    is spread over ranges; what a range must know of the ones before is a row per range and key."""
    aggregate = {"max": F.max, "sum": F.sum}[how]
    dealt, part = _dealt(rows, key, *order)
    own, end, carry, k, p = (free_name(n, [*rows.columns, part, name]) for n in ("own", "end", "carry", "of_key", "of_range"))
    within = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn(own, aggregate(value).over(within))
    ends = dealt.groupBy(F.col(part).alias(p), F.col(key).alias(k)).agg(aggregate(value).alias(end))
    carried = ends.withColumn(carry, aggregate(end).over(Window.partitionBy(k).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))).drop(end)
    joined = local.join(carried, (F.col(part) == F.col(p)) & F.col(key).eqNullSafe(F.col(k)))
    both = F.greatest(own, carry) if how == "max" else F.when(F.col(own).isNotNull() | F.col(carry).isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return joined.withColumn(name, both).select(*rows.columns, name)


def route_worker_pool(messages: DataFrame, subscribers: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Each group gets every message once, its workers in turn: of G groups by name, group g's worker of message m
    (from 0) is number (m * G + g) mod its size, g from 1 and workers by id."""
    groups = subscribers.where("mode = 'worker_pool'").groupBy("worker_group").agg(F.array_sort(F.collect_list("subscription_id")).alias("workers"))
    table = groups.agg(F.array_sort(F.collect_list(F.struct("worker_group", "workers"))).alias("__groups"))
    joined = numbered(messages, order, "__n").join(table)  # one row, which Spark broadcasts if it is small
    out = joined.select("*", F.posexplode("__groups").alias("__g", "__group"))
    at = ((F.col("__n") - 1) * F.size("__groups") + F.col("__g") + 1) % F.size("__group.workers")
    return out.withColumn("worker_group", F.col("__group.worker_group")).withColumn("subscription_id", F.get(F.col("__group.workers"), at.cast("int"))).drop("__n", "__groups", "__g", "__group")


def route_mixed(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    return route_broadcast(messages, subscribers).withColumn("worker_group", F.lit("")).unionByName(route_worker_pool(messages, subscribers))


def start_from(messages: DataFrame, position: str, as_of: str | None = None) -> DataFrame:
    """beginning: all; latest: after as_of; else from that timestamp on, itself included."""
    if position == "beginning":
        return messages
    if position == "latest":
        return messages.where(F.col("ts") > F.lit(as_of).cast("timestamp_ntz"))
    return messages.where(F.col("ts") >= F.lit(position).cast("timestamp_ntz"))


def max_age(messages: DataFrame, as_of: str, interval: str) -> DataFrame:
    return messages.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}"))


def latest_only(messages: DataFrame, key: str = "event_name") -> DataFrame:
    """The most recent message of each topic, ties to the greatest id."""
    rest = [c for c in messages.columns if c != key]
    return messages.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("r")).select(key, "r.*")


def retention(messages: DataFrame, as_of: str, interval: str | None = None, max_len: int | None = None) -> DataFrame:
    """A trimmed stream: at most max_len last messages of each topic, none older than interval."""
    out = max_age(messages, as_of, interval) if interval else messages
    if max_len is None:
        return out
    w = Window.partitionBy("event_name").orderBy(F.desc("ts"), F.desc("id"))
    return out.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_len).drop("__rn")


def hash_partition(key: Column, n: int) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", 0).otherwise(fnv1a32(key) % n).cast("int") if n > 0 else F.lit(0)


def round_robin(messages: DataFrame, n: int, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    return numbered(messages, order, "__n").withColumn("partition", (F.col("__n") % n).cast("int")).drop("__n")


def ring(n: int, replicas: int = 100) -> list[tuple[int, int]]:
    """(hash, owner) ascending; of equal hashes the later point's owner stays."""
    points = {crc32(f"{i}-{j}".encode()): i for i in range(n) for j in range(replicas)}
    return sorted(points.items())


def consistent_partition(key: Column, n: int, replicas: int = 100) -> Column:
    """The owner of the first ring point at or after the key's hash, or of the first of all. The hash's upper bits pick a
    stretch of the ring (n * replicas points as a literal), which holds few points; the first fitting one of them is taken."""
    if n <= 0:
        return F.lit(0)
    points = ring(n, replicas)
    bits = min(16, max(1, len(points).bit_length()))
    starts = [bisect_left(points, (b << (32 - bits), -1)) for b in range((1 << bits) + 1)]
    most = max(b - a for a, b in zip(starts, starts[1:])) + 1
    # After the last point the first owner comes again, at a hash beyond all.
    packed = F.array(*[F.lit((h << 24) | o) for h, o in [*points, (1 << 32, points[0][1])]])
    h = crc32_text(key)
    at = F.get(F.array(*map(F.lit, starts)), F.shiftright(h, 32 - bits).cast("int"))
    found = F.filter(F.slice(packed, at + 1, most), lambda p: F.shiftright(p, 24) >= h)
    return F.get(found, F.lit(0)).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")


def consistent_partition_of(key: str, n: int, replicas: int = 100) -> int:
    points = ring(n, replicas)
    at = bisect_left(points, (crc32(key.encode()), -1))
    return points[at % len(points)][1]


def classify(error: Column) -> Column:
    """ack, nack, reject or defer of a handler's error text; null and `ack` are acks, unknown errors defer."""
    return F.when(error.isNull() | (error == "ack"), "ack").when(error == "nack", "nack").when(error == "reject", "reject").otherwise("defer")


def retry_policy(result: Column, retry_count: Column, max_retries: Column) -> Column:
    """done, retry or dead_letter; 0 retries are no limit."""
    spent = (max_retries > 0) & (retry_count >= max_retries)
    return F.when(result == "ack", "done").when(result == "reject", "dead_letter").when(spent, "dead_letter").otherwise("retry")


def pending_replay(delivered: DataFrame, acked: DataFrame) -> DataFrame:
    """Delivered but unacknowledged messages with how often they were delivered."""
    left = delivered.join(acked.select("id"), "id", "left_anti")
    return left.groupBy("id").agg(F.count("*").alias("retry_count"), F.max("ts").alias("last_ts"))


def redelivery(pending: DataFrame, ack_wait_ms: int, max_deliver: int) -> DataFrame:
    """What becomes of unacknowledged messages (id, idle_ms, deliveries): they wait for their acknowledgement, are delivered
    again, or are given up after max_deliver deliveries (0: never)."""
    spent = (F.lit(max_deliver) > 0) & (F.col("deliveries") >= max_deliver)
    action = F.when(F.col("idle_ms") < ack_wait_ms, "wait").when(spent, "give_up").otherwise("redeliver")
    return pending.withColumn("action", action)


def orphans(pending: DataFrame, me: str, min_idle_ms: int) -> DataFrame:
    return pending.where((F.col("idle_ms") >= min_idle_ms) & (F.col("consumer") != me))


def consumer_lag(messages: DataFrame, positions: DataFrame, unacked: DataFrame | None = None) -> DataFrame:
    """Per (topic, group): messages after the group's position, the oldest of them, and with unacked (event_name,
    consumer_group, id) how many the group holds unacknowledged. A topic without groups has its length under a null group.
    A topic's messages are counted by position first: only distinct positions of a topic are compared with its groups."""
    at = messages.groupBy("event_name", "ts").agg(F.count("*").alias("n"))
    joined = at.join(positions, "event_name", "left")
    behind = F.coalesce(F.col("ts") > F.col("position"), F.lit(True))
    out = joined.groupBy("event_name", "consumer_group").agg(
        F.coalesce(F.sum(F.when(behind, F.col("n"))), F.lit(0)).alias("lag"), F.min(F.when(behind, F.col("ts"))).alias("oldest_pending")
    )
    if unacked is None:
        return out
    held = unacked.groupBy("event_name", F.col("consumer_group").alias("held_by")).agg(F.count("*").alias("pending"))
    both = out.join(held.withColumnRenamed("event_name", "held_of"), (F.col("event_name") == F.col("held_of")) & F.col("consumer_group").eqNullSafe(F.col("held_by")), "left")
    return both.select(*out.columns, F.coalesce("pending", F.lit(0)).alias("pending"))
