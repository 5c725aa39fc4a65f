"""The handling of a delivery, in the order of a subscription: monitor, poison, idempotency, handler, classification.

One fold per message id runs the stages together, because each stage sees only what the ones before let through. Skipped
rows count as completed for the monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import Fold, dedup_ttl, fold, poison
from .stores import monitor_record


def chained(poisoned: Fold | None, dedup: Fold | None) -> Fold:
    def step(state, t, ok):
        p, d = state
        result = None
        if poisoned is not None:
            p2, result = poisoned.step(p, t, ok)
            if result == "skip":
                return (p2, d), "skip"
        if dedup is not None:
            d2, seen = dedup.step(d, t, ok)
            if seen == "duplicate":  # acknowledged without a handler, so the poison count is cleared as by a success
                p3 = poisoned.step(p, t, True)[0] if poisoned is not None else p
                return (p3, d2), "duplicate"
            d = d2
        if poisoned is not None:
            p = p2
        return (p, d), "ok" if ok else "fail"

    return Fold((poisoned.init if poisoned else (), dedup.init if dedup else ()), step)


def handle(deliveries: DataFrame, key: str = "message_id", threshold: int = 5, quarantine_us: int = 3_600_000_000, ttl_us: int = 86_400_000_000) -> DataFrame:
    """(key, seq, outcome, monitor_status)."""
    out = fold(deliveries, key, chained(poison(threshold, quarantine_us), dedup_ttl(ttl_us)))
    return out.withColumn("monitor_status", F.when(F.col("outcome") == "fail", "retrying").otherwise("completed"))


def monitored(deliveries: DataFrame, handled: DataFrame, key: str = "message_id") -> DataFrame:
    """The monitor's records of a handled stream: each delivery is first recorded as pending and then updated to completed,
    retrying or failed by its outcome; the latest state of each stays. handled: what `handle` gives."""
    pending = deliveries.select(
        F.col(key).alias("event_id"), F.col("seq").cast("string").alias("subscription_id"), F.lit("broadcast").alias("delivery_mode"), "event_name",
        F.col("ts").alias("started_at"), F.lit("pending").alias("status"), F.lit(0).alias("step"),
    )
    done = handled.select(
        F.col(key).alias("event_id"), F.col("seq").cast("string").alias("subscription_id"), F.lit("broadcast").alias("delivery_mode"),
        F.lit(None).cast("string").alias("event_name"), F.lit(None).cast("timestamp_ntz").alias("started_at"), F.col("monitor_status").alias("status"), F.lit(1).alias("step"),
    )
    return monitor_record(pending.unionByName(done), version="step")


def gated(messages: DataFrame, schemas: DataFrame, stores: dict[str, bool]) -> DataFrame:
    """Which stages run for each message: the topic's loaded schema's flags, else those with a configured store."""
    joined = messages.join(schemas.withColumnRenamed("name", "event_name"), "event_name", "left")
    loaded = F.col("version").isNotNull()
    return joined.select(
        *messages.columns,
        *[F.when(loaded, F.col(f"enable_{s}")).otherwise(F.lit(stores.get(s, False))).alias(f"run_{s}") for s in ("monitor", "idempotency", "poison")],
    )
