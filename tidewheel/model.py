"""Schemas of the stores, and the domains of their enumerations."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "messages": "id string, source string, payload binary, metadata map<string,string>, ts timestamp, retry_count int",
    "monitor_entries": "event_id string, subscription_id string, event_name string, bus_id string, delivery_mode string, metadata map<string,string>, status string, error string, retry_count int, started_at timestamp, completed_at timestamp, duration_ms bigint, trace_id string, span_id string",
    "event_dlq": "id string, event_name string, original_id string, payload binary, metadata map<string,string>, error string, retry_count int, source string, created_at timestamp, retried_at timestamp",
    "event_outbox": "id bigint, event_name string, event_id string, payload binary, metadata map<string,string>, created_at timestamp, published_at timestamp, status string, retry_count int, last_error string, claimed_at timestamp",
    "scheduled_messages": "id string, event_name string, payload binary, metadata map<string,string>, scheduled_at timestamp, created_at timestamp, status string, claimed_at timestamp",
    "sagas": "id string, name string, status string, current_step int, completed_steps array<string>, data string, error string, started_at timestamp, completed_at timestamp, last_updated_at timestamp",
    "event_schemas": "name string, version int, description string, sub_timeout_ms bigint, max_retries int, retry_backoff_ms bigint, enable_monitor boolean, enable_idempotency boolean, enable_poison boolean, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "event_idempotency": "message_id string, processed_at timestamp, expires_at timestamp",
    "poison_failures": "message_id string, failure_count int, first_failed_at timestamp, last_failed_at timestamp, expires_at timestamp",
    "poison_quarantine": "message_id string, quarantined_at timestamp, expires_at timestamp, reason string",
    "checkpoints": "id string, position timestamp, updated_at timestamp",
}

STORES = tuple(_DDL)


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])

DELIVERY_MODES = ("broadcast", "worker_pool")
MONITOR_STATUSES = ("pending", "completed", "failed", "retrying")
OUTBOX_STATUSES = ("pending", "processing", "published", "failed")
SAGA_STATUSES = ("pending", "running", "completed", "failed", "compensating", "compensated")
RESULTS = ("ack", "nack", "reject", "defer")
HEALTH_RANK = ("healthy", "degraded", "unhealthy")
