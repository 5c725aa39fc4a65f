"""Queries over the stores, each beside the SQL that DuckDB answers it with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derive import view, with_views
from ..operators import stores as S
from ..operators.filters import DlqFilter, MonitorFilter, SagaFilter, ScheduleFilter, delete_age, encode_cursor, monitor_filter_from_query

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "1998-06-01 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, views: tuple[str, ...], sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return add


_ENTRY = "event_id, subscription_id, event_name, bus_id, delivery_mode, status, error, retry_count, started_at, duration_ms"
_LISTED = MonitorFilter(event_name="error", bus_id="bus-1", status=("failed", "retrying"), has_error=True, start_time="2024-01-05 00:00:00", end_time="2024-01-25 00:00:00", min_retries=1)
_LISTED_SQL = (
    "event_name = 'error' AND bus_id = 'bus-1' AND status IN ('failed', 'retrying') AND coalesce(error, '') <> '' AND "
    "started_at >= TIMESTAMP '2024-01-05' AND started_at < TIMESTAMP '2024-01-25' AND retry_count >= 1"
)


@query(
    "monitor_list",
    ("monitor_entries",),
    f"""
SELECT {_ENTRY} FROM monitor_entries WHERE {_LISTED_SQL} ORDER BY started_at, event_id, subscription_id LIMIT 100
""",
)
def _(m):
    return S.monitor_list(m, _LISTED)


@query(
    "monitor_list_desc",
    ("monitor_entries",),
    f"""
SELECT {_ENTRY} FROM monitor_entries WHERE delivery_mode = 'broadcast' AND duration_ms >= 20
  ORDER BY started_at DESC, event_id DESC, subscription_id DESC LIMIT 50
""",
)
def _(m):
    return S.monitor_list(m, MonitorFilter(delivery_mode="broadcast", min_duration_ms=20, limit=50, descending=True))


def _page2(m):
    import datetime

    cursor = encode_cursor(datetime.datetime(2024, 1, 10, 12), "evt-5000", "sub-1")
    return S.monitor_list(m, MonitorFilter(cursor=cursor, limit=25))


QUERIES["monitor_page2"] = lambda spark, d: _page2(view(spark, d, "monitor_entries"))
ORACLE_SQL["monitor_page2"] = with_views(
    f"SELECT {_ENTRY} FROM monitor_entries WHERE (started_at, event_id, subscription_id) > (TIMESTAMP '2024-01-10 12:00:00', 'evt-5000', 'sub-1') ORDER BY started_at, event_id, subscription_id LIMIT 25",
    "monitor_entries",
)


@query(
    "monitor_count",
    ("monitor_entries",),
    """
SELECT count(*) AS n FROM monitor_entries WHERE coalesce(error, '') = '' AND started_at < TIMESTAMP '2024-01-20'
""",
)
def _(m):
    return m.where(MonitorFilter(has_error=False, end_time="2024-01-20 00:00:00").predicate()).agg(F.count("*").alias("n"))


@query("monitor_get", ("monitor_entries",), f"SELECT {_ENTRY} FROM monitor_entries WHERE event_id = 'evt-42' AND subscription_id = ''")
def _(m):
    return S.monitor_get(m, "evt-42", "")


@query("monitor_by_event_id", ("monitor_entries",), f"SELECT {_ENTRY} FROM monitor_entries WHERE event_id = 'evt-7' ORDER BY started_at")
def _(m):
    return S.monitor_by_event_id(m, "evt-7")


_UPSERT = """SELECT event_id, subscription_id, arg_min(event_name, seq) AS event_name, arg_min(started_at, seq) AS started_at,
 arg_max(status, seq) AS status, arg_max(coalesce(error, ''), seq) AS error, arg_max(retry_count, seq) AS retry_count FROM
 (SELECT message_id AS event_id, CASE WHEN seq % 3 = 0 THEN '' ELSE 'sub-1' END AS subscription_id, event_name, ts AS started_at,
  CASE WHEN ok THEN 'completed' ELSE 'retrying' END AS status, CASE WHEN ok THEN NULL
  ELSE 'boom' END AS error, CAST(seq % 4 AS INT) AS retry_count, seq FROM deliveries)
 GROUP BY event_id, subscription_id"""


@query("monitor_upsert_latest", ("deliveries",), _UPSERT)
def _(d):
    log = d.selectExpr(
        "message_id as event_id", "'sub-1' as subscription_id", "event_name", "ts as started_at",
        "case when ok then 'completed' else 'retrying' end as status", "case when ok then null else 'boom' end as error",
        "cast(seq % 4 as int) as retry_count", "case when seq % 3 = 0 then 'worker_pool' else 'broadcast' end as delivery_mode", "seq",
    )
    return S.monitor_record(log).select("event_id", "subscription_id", "event_name", "started_at", "status", F.coalesce("error", F.lit("")).alias("error"), "retry_count")


@query("monitor_update_status", ("monitor_entries",), f"""SELECT event_id, subscription_id, CASE WHEN event_id = 'evt-42' AND subscription_id = '' THEN 'completed' ELSE status END AS status,
 CASE WHEN event_id = 'evt-42' AND subscription_id = '' THEN NULL ELSE error END AS error, CASE WHEN event_id = 'evt-42' AND subscription_id = '' THEN 100 ELSE duration_ms END AS duration_ms FROM monitor_entries""")
def _(m):
    return S.monitor_update_status(m, "evt-42", "", "completed", None, 100, EVENTS_AS_OF).select("event_id", "subscription_id", "status", "error", "duration_ms")


@query(
    "monitor_sampled",
    ("monitor_entries",),
    """
SELECT event_id, subscription_id FROM monitor_entries
  WHERE list_reduce([0] || list_transform(string_split(event_id, ''), lambda c: unicode(c)), lambda h, c: (h * 31 + c) % 1000) < 250
""",
)
def _(m):
    return S.monitor_sampled(m, 0.25).select("event_id", "subscription_id")


@query(
    "monitor_retention",
    ("monitor_entries",),
    """
SELECT event_id, subscription_id, started_at FROM monitor_entries WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL '10' DAY
""",
)
def _(m):
    return S.delete_older_than(m, "started_at", EVENTS_AS_OF, "'10' DAY").select("event_id", "subscription_id", "started_at")


_DLQ = "id, event_name, original_id, payload, error, retry_count, source, created_at, retried_at"
_DLQ_FILTER = DlqFilter(event_name="order.created", start_time="2024-01-03 00:00:00", end_time="2024-01-28 00:00:00", max_retries=4, source="svc-0", exclude_retried=True, limit=40, offset=5)


@query("dlq_list", ("event_dlq",), f"""SELECT {_DLQ} FROM event_dlq WHERE event_name = 'order.created' AND source = 'svc-0' AND created_at >= TIMESTAMP '2024-01-03' AND created_at <= TIMESTAMP '2024-01-28'
 AND retry_count <= 4 AND retried_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 5""")
def _(q):
    return S.dlq_list(q, _DLQ_FILTER)


@query("dlq_count", ("event_dlq",), "SELECT count(*) AS n FROM event_dlq WHERE event_name = 'order.updated' AND retry_count <= 3")
def _(q):
    return q.where(DlqFilter(event_name="order.updated", max_retries=3).predicate()).agg(F.count("*").alias("n"))


@query("dlq_get_by_original", ("event_dlq",), f"SELECT {_DLQ} FROM event_dlq WHERE original_id IN ('evt-3', 'evt-8', 'evt-13')")
def _(q):
    return q.where(F.col("original_id").isin("evt-3", "evt-8", "evt-13"))


@query("dlq_error_search", ("event_dlq",), "SELECT id, error FROM event_dlq WHERE contains(lower(error), 'validation')")
def _(q):
    return q.where(DlqFilter(error="VALIDATION").predicate()).select("id", "error")


@query(
    "dlq_stats",
    ("event_dlq",),
    """
SELECT count(*) AS total, count(retried_at) AS retried, count(*) - count(retried_at) AS pending, min(created_at) AS oldest,
  max(created_at) AS newest FROM event_dlq
""",
)
def _(q):
    return S.dlq_stats(q)


@query("dlq_by_event", ("event_dlq",), "SELECT event_name, count(*) AS n FROM event_dlq GROUP BY 1")
def _(q):
    return S.dlq_by_event(q)


@query(
    "dlq_by_error_type",
    ("event_dlq",),
    """
SELECT CASE WHEN instr(error, ':') > 1 THEN split_part(error, ':', 1) ELSE error END AS error_type, count(*) AS n FROM event_dlq
  GROUP BY 1
""",
)
def _(q):
    return S.dlq_by_error_type(q)


@query("dlq_replay", ("event_dlq",), """SELECT original_id AS id, event_name, 'dlq-replay' AS source, payload, 'true' AS dlq_replay, id AS dlq_message_id, error AS dlq_original_error
 FROM event_dlq WHERE retried_at IS NULL AND event_name = 'order.created'""")
def _(q):
    out = S.dlq_replay(q, DlqFilter(event_name="order.created", exclude_retried=True))
    return out.select("id", "event_name", "source", "payload", *[F.col("metadata")[k].alias(k) for k in ("dlq_replay", "dlq_message_id", "dlq_original_error")])


@query(
    "dlq_mark_retried",
    ("event_dlq",),
    """
SELECT id, CASE WHEN event_name = 'order.created' AND retried_at IS NULL THEN TIMESTAMP '2024-01-31'
  ELSE retried_at END AS retried_at FROM event_dlq
""",
)
def _(q):
    hit = DlqFilter(event_name="order.created", exclude_retried=True).predicate()
    return S.dlq_mark_retried(q, hit, EVENTS_AS_OF).select("id", "retried_at")


@query("dlq_increment_retry", ("event_dlq",), "SELECT id, retry_count + CASE WHEN source = 'svc-1' THEN 1 ELSE 0 END AS retry_count FROM event_dlq")
def _(q):
    return S.dlq_increment_retry(q, F.col("source") == "svc-1").select("id", "retry_count")


@query(
    "dlq_delete_by_filter",
    ("event_dlq",),
    """
SELECT id, created_at FROM event_dlq WHERE NOT (source = 'svc-2' AND created_at <= TIMESTAMP '2024-01-15')
""",
)
def _(q):
    return S.dlq_delete(q, DlqFilter(source="svc-2", end_time="2024-01-15 00:00:00")).select("id", "created_at")


@query("dlq_retention", ("event_dlq",), "SELECT id, created_at FROM event_dlq WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL '14' DAY")
def _(q):
    return S.delete_older_than(q, "created_at", EVENTS_AS_OF, "'14' DAY").select("id", "created_at")


@query("dlq_capped", ("event_dlq",), "SELECT id, created_at FROM event_dlq ORDER BY created_at DESC, id DESC LIMIT 200")
def _(q):
    return S.keep_last(q, 200).select("id", "created_at")


@query(
    "outbox_pending",
    ("event_outbox",),
    """
SELECT id, event_id, status, created_at FROM event_outbox WHERE status = 'pending' ORDER BY created_at, id LIMIT 100
""",
)
def _(o):
    return S.outbox_pending(o).select("id", "event_id", "status", "created_at")


@query("outbox_relay_step", ("event_outbox",), """SELECT id, event_id, CASE WHEN id % 7 <> 0 THEN 'published' ELSE 'failed' END AS status, retry_count + CASE WHEN id % 7 <> 0 THEN 0 ELSE 1 END AS retry_count,
 CASE WHEN id % 7 <> 0 THEN TIMESTAMP '1998-06-01' END AS published_at, CASE WHEN id % 7 = 0 THEN 'publish failed' END AS last_error
 FROM (SELECT * FROM event_outbox WHERE status = 'pending' ORDER BY created_at, id LIMIT 100)""")
def _(o):
    return S.outbox_relay_step(o, F.col("id") % 7 != 0, ORDERS_AS_OF)


_STUCK = "status = 'processing' AND claimed_at < TIMESTAMP '1998-06-01' - INTERVAL '5' MINUTE"


@query(
    "outbox_recover_stuck",
    ("event_outbox",),
    f"""
SELECT id, CASE WHEN {_STUCK} THEN 'pending' ELSE status END AS status, CASE WHEN {_STUCK} THEN NULL
  ELSE claimed_at END AS claimed_at FROM event_outbox
""",
)
def _(o):
    return S.outbox_recover_stuck(o, ORDERS_AS_OF).select("id", "status", "claimed_at")


@query(
    "outbox_retry_failed",
    ("event_outbox",),
    """
SELECT id, CASE WHEN status = 'failed' AND retry_count < 2 THEN 'pending' ELSE status END AS status FROM event_outbox
""",
)
def _(o):
    return S.outbox_retry_failed(o, 2).select("id", "status")


@query(
    "outbox_cleanup",
    ("event_outbox",),
    """
SELECT id, status, published_at FROM event_outbox WHERE NOT (status = 'published'
  AND coalesce(published_at < TIMESTAMP '1998-06-01' - INTERVAL '30' DAY, false))
""",
)
def _(o):
    return S.outbox_cleanup(o, ORDERS_AS_OF, "'30' DAY").select("id", "status", "published_at")


@query("outbox_counts", ("event_outbox",), "SELECT status, count(*) AS n FROM event_outbox GROUP BY 1")
def _(o):
    return S.outbox_counts(o)


_DUE = "SELECT * FROM scheduled_messages WHERE scheduled_at <= TIMESTAMP '1998-06-01' ORDER BY scheduled_at, id LIMIT 100"


@query(
    "sched_due",
    ("scheduled_messages",),
    f"""
SELECT id, event_name, 'scheduler' AS source, id AS scheduled_message_id, strftime(scheduled_at, '%Y-%m-%dT%H:%M:%SZ') AS scheduled_at_text, scheduled_at
  FROM ({_DUE})
""",
)
def _(s):
    return S.sched_due(s, ORDERS_AS_OF)


@query("sched_list", ("scheduled_messages",), """SELECT id, event_name, scheduled_at FROM scheduled_messages WHERE event_name = 'order.o' AND scheduled_at >= TIMESTAMP '1998-07-01' AND scheduled_at <= TIMESTAMP '1998-09-01'
 ORDER BY scheduled_at, id LIMIT 60""")
def _(s):
    return S.sched_list(s, ScheduleFilter("order.o", "1998-07-01 00:00:00", "1998-09-01 00:00:00", 60)).select("id", "event_name", "scheduled_at")


@query(
    "sched_after_tick",
    ("scheduled_messages",),
    f"""
SELECT id, scheduled_at FROM scheduled_messages WHERE id NOT IN (SELECT id FROM ({_DUE}) WHERE NOT ends_with(id, '7'))
""",
)
def _(s):
    return S.sched_after_tick(s, ORDERS_AS_OF, ~F.col("id").endswith("7")).select("id", "scheduled_at")


@query(
    "sched_cancel",
    ("scheduled_messages", "event_outbox"),
    """
SELECT id, scheduled_at FROM scheduled_messages WHERE id NOT IN (SELECT concat('sch-', CAST(id AS STRING)) FROM event_outbox
  WHERE status = 'failed')
""",
)
def _(s, o):
    return S.sched_cancel(s, o.where("status = 'failed'").select(F.concat(F.lit("sch-"), F.col("id").cast("string")).alias("id"))).select("id", "scheduled_at")


@query(
    "sched_counts",
    ("scheduled_messages",),
    """
SELECT event_name, count(*) AS n, count(*) FILTER (WHERE scheduled_at <= TIMESTAMP '1998-06-01') AS due FROM scheduled_messages
  GROUP BY 1
""",
)
def _(s):
    return S.sched_counts(s, ORDERS_AS_OF)


def _saga_sql(steps: str = "saga_steps", first: str = "f", done: str = "d", out: str = "sagas") -> str:
    """Table expressions of the execution of sagas over a table of steps."""
    inside = "failed_step IS NULL OR step_no < failed_step"
    return f"""{first} AS (SELECT saga_id, min(CASE WHEN NOT exec_ok THEN step_no END) AS failed_step FROM {steps} GROUP BY 1),
{done} AS (
  SELECT {first}.saga_id, failed_step, list(step_name ORDER BY step_no) FILTER (WHERE {inside}) AS done,
         bool_or(NOT compensate_ok) FILTER (WHERE {inside}) AS broken
  FROM {first} JOIN {steps} s ON {first}.saga_id = s.saga_id GROUP BY 1, 2),
{out} AS (
  SELECT saga_id, CASE WHEN failed_step IS NULL THEN 'completed' WHEN broken THEN 'failed' ELSE 'compensated' END AS status,
         len(done)::INT AS current_step, array_to_string(done, ',') AS completed_steps,
         CASE WHEN failed_step IS NULL THEN '' ELSE array_to_string(list_reverse(done), ',') END AS compensation_order
  FROM {done})"""


_SAGA_SQL = f"WITH {_saga_sql()}"


@query("saga_execute", ("saga_steps",), f"{_SAGA_SQL} SELECT * FROM sagas")
def _(s):
    return S.saga_execute(s)


def _sagas(steps):
    made = S.saga_execute(steps)
    days = F.expr("cast(substring(saga_id, 6) as bigint) % 90")
    return made.select(F.col("saga_id").alias("id"), F.lit("order").alias("name"), "status", "current_step", (F.lit("1998-06-01").cast("timestamp_ntz") - F.make_dt_interval(days.cast("int"))).alias("started_at"))


_SAGAS = _SAGA_SQL + ", st AS (SELECT saga_id AS id, 'order' AS name, status, current_step, TIMESTAMP '1998-06-01' - to_days(CAST(CAST(substring(saga_id, 6) AS BIGINT) % 90 AS INT)) AS started_at FROM sagas)"


@query(
    "saga_list",
    ("saga_steps",),
    f"""
{_SAGAS} SELECT id, status, started_at FROM st WHERE name = 'order' AND status IN ('failed', 'compensated')
  ORDER BY started_at DESC, id DESC LIMIT 50
""",
)
def _(s):
    return S.saga_list(_sagas(s), SagaFilter("order", ("failed", "compensated"), 50)).select("id", "status", "started_at")


@query(
    "saga_counts",
    ("saga_steps",),
    f"""
{_SAGAS} SELECT u.status, count(id) AS n
  FROM (SELECT unnest(['pending', 'running', 'completed', 'failed', 'compensating', 'compensated']) AS status) u LEFT
  JOIN st ON u.status = st.status GROUP BY 1
""",
)
def _(s):
    return S.saga_counts(_sagas(s))


@query("saga_stats", ("saga_steps",), f"""{_SAGAS} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in S.SAGA_STATUSES)},
 min(started_at) FILTER (WHERE status IN ('pending', 'running', 'compensating')) AS oldest_active FROM st""")
def _(s):
    return S.saga_stats(_sagas(s))


@query(
    "saga_cleanup",
    ("saga_steps",),
    f"""
{_SAGAS} SELECT id, status FROM st WHERE NOT (status = 'completed' AND started_at < TIMESTAMP '1998-06-01' - INTERVAL '30' DAY)
""",
)
def _(s):
    return S.saga_cleanup(_sagas(s), ORDERS_AS_OF, "'30' DAY").select("id", "status")


@query(
    "saga_resume",
    ("saga_steps",),
    f"""
{_SAGAS} SELECT id, CASE WHEN status IN ('failed', 'compensated') THEN 'pending' ELSE status END AS status, CASE
  WHEN status IN ('failed', 'compensated') THEN 0 ELSE current_step END AS current_step FROM st
""",
)
def _(s):
    return S.saga_resume(_sagas(s)).select("id", "status", "current_step")


@query("schema_set_history", ("schema_sets",), """SELECT name, seq, version, version >= coalesce(max(version) OVER (PARTITION BY name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted
 FROM schema_sets WHERE version >= 1 AND name <> ''""")
def _(s):
    return S.schema_set_history(s).select("name", "seq", "version", "accepted")


@query("schema_latest", ("schema_sets",), "SELECT name, max(version) AS version FROM schema_sets WHERE version >= 1 GROUP BY 1")
def _(s):
    return S.schema_latest(s)


@query("checkpoint_latest", ("positions",), "SELECT subscriber_id, arg_max(position, arrival) AS position FROM positions GROUP BY 1")
def _(p):
    return S.checkpoint_latest(p)


@query("checkpoint_resume", ("positions",), """WITH c AS (SELECT subscriber_id, arg_max(position, arrival) AS position FROM positions WHERE CAST(subscriber_id AS INT) % 3 <> 0 GROUP BY 1)
 SELECT s.subscriber_id, CASE WHEN position IS NULL THEN 'latest' ELSE 'timestamp' END AS start_from, position FROM (SELECT DISTINCT subscriber_id FROM positions) s LEFT JOIN c ON s.subscriber_id = c.subscriber_id""")
def _(p):
    saved = S.checkpoint_latest(p.where("cast(subscriber_id as int) % 3 <> 0"))
    return S.checkpoint_resume(p.select("subscriber_id").distinct(), saved)


# Inserts, claims and the other changes of state


@query("outbox_insert", ("event_outbox", "messages"), """SELECT (SELECT max(id) FROM event_outbox) + row_number() OVER (ORDER BY ts, id) AS id, event_name, id AS event_id, 'pending' AS status,
 0 AS retry_count, TIMESTAMP '1998-06-01' AS created_at FROM messages WHERE event_name = 'purchase'""")
def _(o, m):
    new = S.outbox_insert(o, m.where("event_name = 'purchase'"), ORDERS_AS_OF)
    return new.select("id", "event_name", "event_id", "status", "retry_count", "created_at")


_CLAIMED = "SELECT id FROM event_outbox WHERE status = 'pending' ORDER BY created_at, id LIMIT 100"


@query(
    "outbox_claim",
    ("event_outbox",),
    f"""
SELECT id, event_id, 'processing' AS status, TIMESTAMP '1998-06-01' AS claimed_at FROM event_outbox WHERE id IN ({_CLAIMED})
""",
)
def _(o):
    return S.outbox_claim(o, ORDERS_AS_OF).select("id", "event_id", "status", "claimed_at")


@query("outbox_after_claim", ("event_outbox",), f"""SELECT id, CASE WHEN id IN ({_CLAIMED}) THEN 'processing' ELSE status END AS status,
 CASE WHEN id IN ({_CLAIMED}) THEN TIMESTAMP '1998-06-01' ELSE claimed_at END AS claimed_at FROM event_outbox""")
def _(o):
    return S.outbox_after_claim(o, ORDERS_AS_OF).select("id", "status", "claimed_at")


@query("outbox_take", ("event_outbox",), """SELECT id, status, created_at FROM event_outbox WHERE status = 'pending' OR (status = 'processing' AND id % 3 = 1)
 ORDER BY CASE status WHEN 'processing' THEN 0 ELSE 1 END, created_at, id LIMIT 80""")
def _(o):
    claimed = o.withColumn("consumer", F.concat(F.lit("relay-"), (F.col("id") % 3).cast("string")))
    return S.outbox_take(claimed, "relay-1", 80).select("id", "status", "created_at")


@query("dlq_store", ("messages",), """SELECT concat('dlq-', id) AS id, event_name, id AS original_id, error, retry_count, 'svc-x' AS source, TIMESTAMP '2024-01-31' AS created_at,
 CASE WHEN seq % 5 = 0 THEN 'nack' ELSE 'ack' END AS result FROM (SELECT *, concat('boom: ', id) AS error FROM messages WHERE event_name = 'error')""")
def _(m):
    failed = m.where("event_name = 'error'")
    rows = S.dlq_store(failed, F.concat(F.lit("dlq-"), F.col("id")), F.concat(F.lit("boom: "), F.col("id")), F.lit("svc-x"), EVENTS_AS_OF)
    stored = F.substring("original_id", 5, 20).cast("bigint") % 5 != 0
    return rows.select("id", "event_name", "original_id", "error", "retry_count", "source", "created_at", S.dlq_result(stored).alias("result"))


@query(
    "dlq_stats_from_counts",
    ("event_dlq",),
    """
SELECT count(*) AS total, count(*) - count(retried_at) AS pending, count(retried_at) AS retried FROM event_dlq
""",
)
def _(q):
    return S.dlq_stats_from_counts(q)


@query("dlq_error_pattern", ("event_dlq",), "SELECT id, error FROM event_dlq WHERE regexp_matches(error, '^(?i)TIMEOUT.*[0-4]$')")
def _(q):
    return q.where(DlqFilter(error="^TIMEOUT.*[0-4]$", error_is_pattern=True).predicate()).select("id", "error")


@query("sched_add", ("scheduled_messages",), """SELECT id, event_name, scheduled_at FROM scheduled_messages UNION ALL
 SELECT concat('new-', id) AS id, event_name, scheduled_at + INTERVAL '1' DAY AS scheduled_at FROM scheduled_messages WHERE ends_with(id, '3')""")
def _(s):
    again = s.where(F.col("id").endswith("3"))
    new = again.withColumn("id", F.concat(F.lit("new-"), F.col("id"))).withColumn("scheduled_at", F.expr("scheduled_at + INTERVAL '1' DAY"))
    return S.sched_add(s, new.unionByName(again)).select("id", "event_name", "scheduled_at")


@query("sched_get", ("scheduled_messages",), "SELECT id, event_name, scheduled_at FROM scheduled_messages WHERE id = 'sch-7'")
def _(s):
    return S.sched_get(s, "sch-7").select("id", "event_name", "scheduled_at")


@query("saga_reexecute", ("saga_steps",), f"""{_SAGA_SQL}, now_steps AS (SELECT saga_id, step_no, step_name, exec_ok OR step_no % 2 = 1 AS exec_ok, compensate_ok FROM saga_steps), {_saga_sql("now_steps", "f2", "d2", "again")}
SELECT * FROM sagas WHERE status = 'completed' UNION ALL SELECT a.* FROM again a JOIN sagas s ON a.saga_id = s.saga_id WHERE s.status <> 'completed'""")
def _(s):
    return S.saga_rerun(S.saga_execute(s), s.withColumn("exec_ok", F.expr("exec_ok or step_no % 2 = 1")))


@query(
    "saga_counts_by_name",
    ("saga_steps",),
    f"""
{_SAGAS} SELECT name, status, count(*) AS n FROM (SELECT status, concat('saga', CAST(substring(id, 6) AS BIGINT) % 3) AS name
  FROM st) GROUP BY 1, 2
""",
)
def _(s):
    named = _sagas(s).withColumn("name", F.concat(F.lit("saga"), (F.substring("id", 6, 20).cast("bigint") % 3).cast("string")))
    return S.saga_counts_by(named, "name", "status")


@query("saga_delete", ("saga_steps",), f"{_SAGAS} SELECT id, status FROM st WHERE status <> 'failed'")
def _(s):
    sagas = _sagas(s)
    return S.saga_delete(sagas, sagas.where("status = 'failed'")).select("id", "status")


@query("saga_delete_older", ("saga_steps",), f"{_SAGAS} SELECT id, started_at FROM st WHERE started_at >= TIMESTAMP '1998-06-01' - INTERVAL '45' DAY")
def _(s):
    return S.delete_older_than(_sagas(s), "started_at", ORDERS_AS_OF, "'45' DAY").select("id", "started_at")


_ACCEPTED = """SELECT name, seq, ts, version FROM (SELECT *, version >= coalesce(max(version) OVER (PARTITION BY name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted
 FROM schema_sets WHERE version >= 1 AND name <> '') WHERE accepted"""


@query(
    "schema_changes",
    ("schema_sets",),
    f"""
SELECT name, seq, version, lag(version) OVER (PARTITION BY name ORDER BY ts, seq) AS previous FROM ({_ACCEPTED})
""",
)
def _(s):
    return S.schema_changes(s).select("name", "seq", "version", "previous")


@query(
    "schema_list",
    ("schema_sets",),
    """
SELECT name, max(version) AS version FROM schema_sets WHERE version >= 1 AND name <> 'click' GROUP BY 1 ORDER BY 1
""",
)
def _(s):
    gone = s.where("name = 'click'").select("name").distinct()
    return S.schema_list(S.without(S.schema_latest(s), gone, "name"))


@query("known_names", ("messages",), "SELECT DISTINCT event_name FROM messages ORDER BY 1")
def _(m):
    return S.keys_of(m, "event_name")


@query(
    "checkpoint_info",
    ("positions",),
    """
SELECT subscriber_id, count(*) AS saves, min(arrival) AS first_arrival, max(arrival) AS last_arrival, max(position) AS furthest
  FROM positions GROUP BY 1
""",
)
def _(p):
    return S.checkpoint_info(p)


@query(
    "checkpoint_delete",
    ("positions",),
    """
SELECT subscriber_id, arg_max(position, arrival) AS position FROM positions WHERE CAST(subscriber_id AS INT) % 4 <> 2 GROUP BY 1
""",
)
def _(p):
    return S.without(S.checkpoint_latest(p), p.where("cast(subscriber_id as int) % 4 = 2").select("subscriber_id").distinct(), "subscriber_id")


_MARKS = """SELECT message_id, max(ts) AS processed_at, max(ts) + CASE WHEN starts_with(message_id, '1') THEN INTERVAL '2' DAY ELSE INTERVAL '8' DAY END AS expires_at FROM deliveries WHERE ok GROUP BY 1"""


def _marks(d):
    made = d.where("ok").select("message_id", F.col("ts").alias("processed_at"), F.expr("ts + CASE WHEN startswith(message_id, '1') THEN INTERVAL '2' DAY ELSE INTERVAL '8' DAY END").alias("expires_at"))
    return S.mark_processed(made.where("false"), made)


@query("marks_by_own_ttl", ("deliveries",), _MARKS)
def _(d):
    return _marks(d)


@query(
    "marks_duplicates",
    ("deliveries",),
    f"""
SELECT seq, message_id FROM deliveries WHERE message_id IN (SELECT message_id FROM ({_MARKS})
  WHERE expires_at >= TIMESTAMP '2024-01-30')
""",
)
def _(d):
    return S.duplicates(d, _marks(d), "2024-01-30 00:00:00").select("seq", "message_id")


@query("marks_expire", ("deliveries",), f"SELECT message_id, expires_at FROM ({_MARKS}) WHERE expires_at >= TIMESTAMP '2024-01-30'")
def _(d):
    return S.expire(_marks(d), "2024-01-30 00:00:00").select("message_id", "expires_at")


@query(
    "monitor_stage",
    ("deliveries",),
    """
SELECT message_id AS event_id, CAST(seq AS STRING) AS subscription_id, event_name, ts AS started_at, CASE
  WHEN ok THEN 'completed' ELSE 'retrying' END AS status FROM deliveries
""",
)
def _(d):
    from ..operators.pipeline import monitored

    handled = d.select("message_id", "seq", F.when(F.col("ok"), "completed").otherwise("retrying").alias("monitor_status"))
    return monitored(d, handled).select("event_id", "subscription_id", "event_name", "started_at", "status")


@query("monitor_http_query", ("monitor_entries",), f"""SELECT {_ENTRY} FROM monitor_entries WHERE event_name = 'error' AND status IN ('failed', 'retrying') AND coalesce(error, '') <> ''
 AND started_at >= TIMESTAMP '2024-01-08' AND duration_ms >= 15 ORDER BY started_at DESC, event_id DESC, subscription_id DESC LIMIT 100""")
def _(m):
    asked = {"event_name": "error", "status": "failed,retrying", "has_error": "true", "start_time": "2024-01-08T00:00:00Z", "min_duration": "15ms", "limit": "many", "order": "desc"}
    return S.monitor_list(m, monitor_filter_from_query(asked))


@query(
    "monitor_guarded_delete",
    ("monitor_entries",),
    """
SELECT event_id, subscription_id FROM monitor_entries WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL '90' HOUR
""",
)
def _(m):
    hours = int(delete_age("90h").total_seconds() // 3600)
    return S.delete_older_than(m, "started_at", EVENTS_AS_OF, f"'{hours}' HOUR").select("event_id", "subscription_id")


def _upserted(spark, sf_dir):
    from ..session import shared_path
    from ..sources.tables import latest, write_changes

    path = shared_path(spark, "upsert")
    rows = view(spark, sf_dir, "deliveries").select("message_id", "seq", "ok", F.expr("seq % 11 = 0").alias("deleted"))
    for batch in range(2):
        write_changes(rows.where(F.col("seq") % 2 == batch), path, batch)
    write_changes(rows.where("seq % 2 = 1"), path, 1)  # a repeated batch
    return latest(spark, path, rows.schema, ("message_id",), "seq").select("message_id", "seq", "ok")


QUERIES["store_upsert"] = _upserted
ORACLE_SQL["store_upsert"] = with_views(
    """SELECT message_id, r.seq AS seq, r.ok AS ok FROM (SELECT message_id, arg_max({'seq': seq, 'ok': ok, 'gone': seq % 11 = 0}, (seq % 2, seq)) AS r FROM deliveries GROUP BY 1) WHERE NOT r.gone""", "deliveries"
)
