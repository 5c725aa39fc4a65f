"""Queries on the ordered folds, with recursive SQL over (key, row number)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derive import VIEWS, view
from ..operators import fold as O
from ..operators.filters import MonitorFilter
from ..operators.pipeline import handle
from ..session import shared_path
from ..streaming import stateful

HOUR = 3_600_000_000
DAY = 24 * HOUR
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _simple(key: str, first: str, nxt: str, names: str) -> str:
    """A step that sees the last state (p_ columns) beside the row; the first row sees the initial one."""
    return f"""WITH RECURSIVE deliveries AS ({VIEWS["deliveries"]}),
e AS (SELECT {key} AS k, epoch_us(ts) AS t, seq, ok, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq) AS rn FROM deliveries),
r AS (SELECT k, rn, seq, {nxt} FROM (SELECT e.*, {first} FROM e WHERE rn = 1)
 UNION ALL SELECT k, rn, seq, {nxt} FROM (SELECT e.*, {names} FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1))
SELECT k AS {key}, seq, o AS outcome FROM r"""


def add(name: str, key: str, definition: O.Fold, sql: str | None, by_session: bool = False):
    QUERIES[name] = lambda spark, d: O.fold(view(spark, d, "deliveries"), key, definition, by_session=by_session)
    if sql:
        ORACLE_SQL[name] = sql


def _dedup_sql(dup: str, claim: bool) -> str:
    mark = f"CASE WHEN {dup} THEN p_q WHEN {'true' if claim else 'ok'} THEN t + {2 * DAY} ELSE p_q END AS q"
    return _simple("message_id", "-1::BIGINT AS p_q", f"{mark}, CASE WHEN {dup} THEN 'duplicate' WHEN ok THEN 'ok' ELSE 'fail' END AS o", "r.q AS p_q")


add("fold_idempotency", "message_id", O.dedup_ttl(2 * DAY), _dedup_sql("t <= p_q", False), by_session=True)
add("fold_idempotency_exclusive", "message_id", O.dedup_ttl(2 * DAY, inclusive=False), _dedup_sql("t < p_q", False))
add("fold_idempotency_claim", "message_id", O.dedup_ttl(2 * DAY, claim_on_check=True), _dedup_sql("t <= p_q", True))
add(
    "fold_poison", "message_id", O.poison(2, 2 * DAY),
    _simple(
        "message_id", "0 AS p_f, -1::BIGINT AS p_q",
        f"CASE WHEN t <= p_q THEN p_f WHEN ok THEN 0 ELSE p_f + 1 END AS f, CASE WHEN t > p_q AND NOT ok AND p_f + 1 >= 2 THEN t + {2 * DAY} ELSE p_q END AS q, CASE WHEN t <= p_q THEN 'skip' WHEN ok THEN 'ok' ELSE 'fail' END AS o",
        "r.f AS p_f, r.q AS p_q",
    ),
)
_REJ = f"(p_m = 1 AND t - p_s <= {DAY})"
_MODE = "CASE WHEN p_m = 1 THEN 2 ELSE p_m END"
add(
    "fold_breaker", "subscriber", O.circuit_breaker(2, 2, DAY),
    _simple(
        "subscriber", "0 AS p_m, 0 AS p_f, 0 AS p_g, 0::BIGINT AS p_s",
        f"""CASE WHEN {_REJ} THEN 1 WHEN ok AND {_MODE} = 2 THEN CASE WHEN CASE WHEN p_m = 1 THEN 0 ELSE p_g END + 1 >= 2 THEN 0 ELSE 2 END WHEN ok THEN 0
 WHEN {_MODE} = 2 OR p_f + 1 >= 2 THEN 1 ELSE 0 END AS m,
 CASE WHEN {_REJ} THEN p_f WHEN ok AND {_MODE} = 2 AND CASE WHEN p_m = 1 THEN 0 ELSE p_g END + 1 < 2 THEN p_f WHEN ok THEN 0 ELSE p_f + 1 END AS f,
 CASE WHEN {_REJ} THEN p_g WHEN ok AND {_MODE} = 2 AND CASE WHEN p_m = 1 THEN 0 ELSE p_g END + 1 < 2 THEN CASE
  WHEN p_m = 1 THEN 0 ELSE p_g END + 1 ELSE 0 END AS g,
 CASE WHEN {_REJ} OR ok THEN p_s ELSE t END AS s, CASE WHEN {_REJ} THEN 'rejected' WHEN ok THEN 'ok' ELSE 'fail' END AS o""",
        "r.m AS p_m, r.f AS p_f, r.g AS p_g, r.s AS p_s",
    ),
)
add(
    "fold_fixed_window", "subscriber", O.fixed_window(3, DAY),
    _simple(
        "subscriber", "NULL::BIGINT AS p_s, 0 AS p_n",
        f"CASE WHEN p_s IS NULL OR t >= p_s + {DAY} THEN t ELSE p_s END AS s, CASE WHEN p_s IS NULL OR t >= p_s + {DAY} THEN 1 ELSE p_n + 1 END AS n, CASE WHEN p_s IS NULL OR t >= p_s + {DAY} OR p_n + 1 <= 3 THEN 'allow' ELSE 'deny' END AS o",
        "r.s AS p_s, r.n AS p_n",
    ),
)
add(
    "limiter_remaining", "subscriber", O.fixed_window_remaining(3, DAY),
    _simple(
        "subscriber", "NULL::BIGINT AS p_s, 0 AS p_n",
        f"CASE WHEN p_s IS NULL OR t >= p_s + {DAY} THEN t ELSE p_s END AS s, CASE WHEN p_s IS NULL OR t >= p_s + {DAY} THEN 1 ELSE p_n + 1 END AS n, greatest(0, 3 - CASE WHEN p_s IS NULL OR t >= p_s + {DAY} THEN 1 ELSE p_n + 1 END)::BIGINT AS o",
        "r.s AS p_s, r.n AS p_n",
    ),
)
_KEPT = f"list_filter(p_l, lambda x: x > t - {DAY})"
add(
    "fold_sliding_window", "subscriber", O.sliding_window(3, DAY),
    _simple(
        "subscriber", "[]::BIGINT[] AS p_l",
        f"CASE WHEN len({_KEPT}) >= 3 THEN {_KEPT} ELSE list_append({_KEPT}, t) END AS l, CASE WHEN len({_KEPT}) >= 3 THEN 'deny' ELSE 'allow' END AS o",
        "r.l AS p_l",
    ),
    by_session=True,
)
_UNIT = 10 * HOUR
_LEVEL = f"CASE WHEN p_t IS NULL THEN {3 * _UNIT} ELSE least({3 * _UNIT}, p_v + t - p_t) END"
add(
    "fold_token_bucket", "subscriber", O.token_bucket(3, _UNIT),
    _simple(
        "subscriber", "0::BIGINT AS p_v, NULL::BIGINT AS p_t",
        f"{_LEVEL} - CASE WHEN {_LEVEL} >= {_UNIT} THEN {_UNIT} ELSE 0 END AS v, t AS lt, CASE WHEN {_LEVEL} >= {_UNIT} THEN 'allow' ELSE 'deny' END AS o",
        "r.v AS p_v, r.lt AS p_t",
    ),
)
_TICKS = f"(CASE WHEN p_a IS NULL THEN 0 ELSE (t - p_a) // {DAY} END)"
_B, _N, _A = f"(p_b + CASE WHEN {_TICKS} > 0 AND p_n > 0 THEN 1 ELSE 0 END)", f"(CASE WHEN {_TICKS} > 0 THEN 0 ELSE p_n END)", f"(coalesce(p_a, t) + {_TICKS} * {DAY})"
add(
    "batch_size_or_timeout", "subscriber", O.micro_batches(5, DAY),
    _simple(
        "subscriber", "0::BIGINT AS p_b, 0 AS p_n, NULL::BIGINT AS p_a",
        f"CASE WHEN {_N} + 1 >= 5 THEN {_B} + 1 ELSE {_B} END AS b, CASE WHEN {_N} + 1 >= 5 THEN 0 ELSE {_N} + 1 END AS n, CASE WHEN {_N} + 1 >= 5 THEN t ELSE {_A} END AS a, {_B} AS o",
        "r.b AS p_b, r.n AS p_n, r.a AS p_a",
    ),
)
QUERIES["batch_by_size"] = lambda spark, d: O.batches_by_size(view(spark, d, "deliveries"), 100).select("seq", "batch")
ORACLE_SQL["batch_by_size"] = f"WITH deliveries AS ({VIEWS['deliveries']}) SELECT seq, (row_number() OVER (ORDER BY ts, seq) - 1) // 100 AS batch FROM deliveries"

QUERIES["batch_by_size_keyed"] = lambda spark, d: O.batches_by_size(view(spark, d, "deliveries"), 7, "subscriber").select("seq", "batch")
ORACLE_SQL["batch_by_size_keyed"] = f"SELECT seq, (row_number() OVER (PARTITION BY subscriber ORDER BY ts, seq) - 1) // 7 AS batch FROM ({VIEWS['deliveries']})"

_BLOCK = "(t <= p_q)"
_DUP = "(t <= p_d)"
ORACLE_SQL["handle_pipeline"] = _simple(
    "message_id", "0 AS p_f, -1::BIGINT AS p_q, -1::BIGINT AS p_d",
    f"""CASE WHEN {_BLOCK} THEN p_f WHEN {_DUP} OR ok THEN 0 ELSE p_f + 1 END AS f, CASE WHEN NOT {_BLOCK} AND NOT {_DUP} AND NOT ok AND p_f + 1 >= 2 THEN t + {2 * DAY} ELSE p_q END AS q,
 CASE WHEN NOT {_BLOCK} AND NOT {_DUP} AND ok THEN t + {DAY} ELSE p_d END AS d, CASE WHEN {_BLOCK} THEN 'skip' WHEN {_DUP} THEN 'duplicate' WHEN ok THEN 'ok' ELSE 'fail' END AS o""",
    "r.f AS p_f, r.q AS p_q, r.d AS p_d",
).replace("o AS outcome FROM r", "o AS outcome, CASE WHEN o = 'fail' THEN 'retrying' ELSE 'completed' END AS monitor_status FROM r")
QUERIES["handle_pipeline"] = lambda spark, d: handle(view(spark, d, "deliveries"), threshold=2, quarantine_us=2 * DAY, ttl_us=DAY)

_POISON = _simple(
    "message_id", "0 AS p_f, -1::BIGINT AS p_q",
    f"""CASE WHEN {{release}} THEN 0 WHEN t <= p_q THEN p_f WHEN ok THEN 0 ELSE p_f + 1 END AS f,
 CASE WHEN {{release}} THEN -1 WHEN t > p_q AND NOT ok AND p_f + 1 >= 2 THEN t + {2 * DAY} ELSE p_q END AS q,
 CASE WHEN {{release}} THEN 'released' WHEN t <= p_q THEN 'skip' WHEN ok THEN 'ok' ELSE 'fail' END AS o""",
    "r.f AS p_f, r.q AS p_q",
)
QUERIES["quarantined"] = lambda spark, d: O.quarantined(view(spark, d, "deliveries"), "message_id", 2, 2 * DAY, "2024-01-29 00:00:00")
ORACLE_SQL["quarantined"] = _POISON.replace("{release}", "false").replace(
    "SELECT k AS message_id, seq, o AS outcome FROM r",
    f"""SELECT message_id, make_timestamp(q - {2 * DAY}) AS quarantined_at FROM (SELECT k AS message_id, arg_max(q, rn) AS q FROM r GROUP BY 1)
WHERE q > epoch_us(TIMESTAMP '2024-01-29') ORDER BY q DESC, message_id LIMIT 100""",
)
QUERIES["poison_release"] = lambda spark, d: O.fold(
    view(spark, d, "deliveries").withColumn("freed", F.expr("seq % 13 = 0")), "message_id", O.poison(2, 2 * DAY), release="freed"
)
ORACLE_SQL["poison_release"] = _POISON.replace("{release}", "seq % 13 = 0")
QUERIES["fold_poison_exclusive"] = lambda spark, d: O.fold(view(spark, d, "deliveries"), "message_id", O.poison(2, 2 * DAY, inclusive=False))
ORACLE_SQL["fold_poison_exclusive"] = _POISON.replace("{release}", "false").replace("t <= p_q", "t < p_q").replace("t > p_q", "t >= p_q")


def _some_without_id(rows):
    return rows.withColumn("message_id", F.expr("CASE WHEN seq % 10 = 0 THEN '' ELSE message_id END"))


QUERIES["idempotency_without_id"] = lambda spark, d: O.idempotent(_some_without_id(view(spark, d, "deliveries")), "message_id", O.dedup_ttl(2 * DAY))
ORACLE_SQL["idempotency_without_id"] = (
    _dedup_sql("t <= p_q", False).replace(f"deliveries AS ({VIEWS['deliveries']})", f"deliveries AS (SELECT * FROM ({VIEWS['deliveries']}) WHERE seq % 10 <> 0)")
    + f" UNION ALL SELECT '' AS message_id, seq, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS outcome FROM ({VIEWS['deliveries']}) WHERE seq % 10 = 0"
)
_SLIDE = f"CASE WHEN len({_KEPT}) >= 3 THEN {_KEPT} ELSE list_append({_KEPT}, t) END"
add(
    "limiter_remaining_sliding", "subscriber", O.sliding_window_remaining(3, DAY),
    _simple("subscriber", "[]::BIGINT[] AS p_l", f"{_SLIDE} AS l, greatest(0, 3 - len({_SLIDE}))::BIGINT AS o", "r.l AS p_l"),
)
add(
    "limiter_delay_sliding", "subscriber", O.sliding_window_delay(3, DAY),
    _simple("subscriber", "[]::BIGINT[] AS p_l", f"{_SLIDE} AS l, CASE WHEN len({_KEPT}) >= 3 THEN {DAY // 3} ELSE 0 END::BIGINT AS o", "r.l AS p_l"),
)
_AFTER = f"({_LEVEL} - CASE WHEN {_LEVEL} >= {_UNIT} THEN {_UNIT} ELSE 0 END)"
add(
    "limiter_delay_bucket", "subscriber", O.token_bucket_delay(3, _UNIT),
    _simple("subscriber", "0::BIGINT AS p_v, NULL::BIGINT AS p_t", f"{_AFTER} AS v, t AS lt, greatest(0, {_UNIT} - {_AFTER})::BIGINT AS o", "r.v AS p_v, r.lt AS p_t"),
)


def _deliveries_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = stateful.stream_table(spark, f"{sf_dir}/events.parque[t]", schema)
    return rows.selectExpr("concat(cast(user_id as string), '-', event_type) as message_id", "cast(user_id as string) as subscriber", "event_id as seq", "ts", "event_id % 2 <> 0 as ok", "event_type")


def _streamed(key, definition):
    def run(spark, sf_dir):
        return stateful.run_to_table(stateful.fold_stream(_deliveries_stream(spark, sf_dir), key, definition), "folded")

    return run


for _name, _batch, _key, _def in (
    ("stream_dedup", "fold_idempotency", "message_id", O.dedup_ttl(2 * DAY)),
    ("stream_poison", "fold_poison", "message_id", O.poison(2, 2 * DAY)),
    ("stream_breaker", "fold_breaker", "subscriber", O.circuit_breaker(2, 2, DAY)),
):
    QUERIES[_name] = _streamed(_key, _def)
    ORACLE_SQL[_name] = ORACLE_SQL[_batch]

QUERIES["stream_dedup_expiring"] = lambda spark, d: stateful.run_to_table(
    stateful.fold_stream(_deliveries_stream(spark, d), "message_id", O.dedup_ttl(2 * DAY), delay="1 hour"), "folded"
)
ORACLE_SQL["stream_dedup_expiring"] = ORACLE_SQL["fold_idempotency"]


def _tail(spark, sf_dir):
    entries = _deliveries_stream(spark, sf_dir).withColumnsRenamed({"ts": "started_at", "event_type": "event_name"})
    found = stateful.tail(entries, MonitorFilter(event_name="error").predicate(), "2024-01-25 00:00:00")
    return stateful.run_to_table(found.select("seq", F.col("started_at").alias("ts")), "tail")


QUERIES["stream_tail"] = _tail
ORACLE_SQL["stream_tail"] = f"SELECT seq, ts FROM ({VIEWS['deliveries']}) WHERE ts >= TIMESTAMP '2024-01-25' AND event_name = 'error'"
QUERIES["stream_first_seen"] = lambda spark, d: stateful.run_to_table(
    stateful.first_seen_stream(_deliveries_stream(spark, d), "message_id", "40 days").select("message_id"), "seen"
)
ORACLE_SQL["stream_first_seen"] = f"SELECT DISTINCT message_id FROM ({VIEWS['deliveries']})"


def _relayed(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    rows = stateful.stream_table(spark, f"{sf_dir}/orders.parque[t]", schema)
    pending = rows.selectExpr("o_orderkey as id", "case o_orderstatus when 'O' then 'pending' else 'other' end as status", "cast(o_orderkey % 4 as int) as retry_count")
    path = shared_path(spark, "relay")
    query = stateful.relay(pending, lambda batch: batch.withColumn("ok", F.col("id") % 7 != 0), path, f"{path}-checkpoint")
    return stateful.finish(query, spark, path, "id bigint, status string, retry_count int")


QUERIES["stream_relay"] = _relayed
ORACLE_SQL["stream_relay"] = f"""SELECT id, CASE WHEN id % 7 <> 0 THEN 'published' ELSE 'failed' END AS status, retry_count + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS retry_count
 FROM ({VIEWS["event_outbox"]}) WHERE status = 'pending'"""


def _once(spark, sf_dir):
    path = shared_path(spark, "once")
    rows = _deliveries_stream(spark, sf_dir).select("message_id", "seq", "ts", F.lit(True).alias("ok"))
    query = stateful.once(rows, lambda batch: batch, "message_id", ("ts", "seq"), f"{path}/out", f"{path}/marks", f"{path}/checkpoint")
    return stateful.finish(query, spark, f"{path}/out", "message_id string, seq bigint")


QUERIES["stream_once"] = _once
ORACLE_SQL["stream_once"] = f"SELECT message_id, arg_min(seq, (ts, seq)) AS seq FROM ({VIEWS['deliveries']}) GROUP BY 1"
