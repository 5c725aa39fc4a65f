"""Queries on routing, partitioning, payloads and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derive import view, with_views
from ..functions import text as X
from ..functions.json_schema import (
    FieldMapper, JsonSchema, decode_envelope, decode_raw, decode_wire, encode_envelope, encode_wire, upcast_to_latest, validate_and_upcast, versioned_decode, versioned_encode,
)
from ..functions.wire import MSGPACK, PROTO, CodecRegistry
from ..operators import routing as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, views: tuple[str, ...], sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return add


_POOL = """g AS (SELECT worker_group, list(subscription_id ORDER BY subscription_id) AS workers, row_number() OVER (ORDER BY worker_group) AS g, count(*) OVER () AS gs
  FROM subscribers WHERE mode = 'worker_pool' GROUP BY worker_group),
m AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS n FROM messages),
p AS (SELECT id, worker_group, workers[CAST((n * gs + g) % len(workers) AS INT) + 1] AS subscription_id FROM m CROSS JOIN g)"""


@query("route_broadcast", ("messages", "subscribers"), "SELECT id, subscription_id FROM messages CROSS JOIN subscribers WHERE mode = 'broadcast'")
def _(m, s):
    return R.route_broadcast(m, s).select("id", "subscription_id")


@query("route_worker_pool", ("messages", "subscribers"), f"WITH {_POOL} SELECT * FROM p")
def _(m, s):
    return R.route_worker_pool(m, s).select("id", "worker_group", "subscription_id")


@query(
    "route_mixed",
    ("messages", "subscribers"),
    f"""
WITH {_POOL} SELECT id, worker_group, subscription_id FROM p UNION ALL SELECT id, '' AS worker_group, subscription_id
  FROM messages CROSS JOIN subscribers WHERE mode = 'broadcast'
""",
)
def _(m, s):
    return R.route_mixed(m, s).select("id", "worker_group", "subscription_id")


@query("start_from_timestamp", ("messages",), "SELECT id, ts FROM messages WHERE ts >= TIMESTAMP '2024-01-20'")
def _(m):
    return R.start_from(m, "2024-01-20 00:00:00").select("id", "ts")


@query("start_from_latest", ("messages",), "SELECT id, ts FROM messages WHERE ts > TIMESTAMP '2024-01-29'")
def _(m):
    return R.start_from(m, "latest", "2024-01-29 00:00:00").select("id", "ts")


@query("max_age", ("messages",), "SELECT id, ts FROM messages WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '3' DAY")
def _(m):
    return R.max_age(m, "2024-01-31 00:00:00", "'3' DAY").select("id", "ts")


@query("latest_only", ("messages",), "SELECT event_name, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM messages GROUP BY 1")
def _(m):
    return R.latest_only(m.select("event_name", "id", "ts"))


@query(
    "retention",
    ("messages",),
    """
SELECT event_name, id FROM (SELECT *, row_number() OVER (PARTITION BY event_name ORDER BY ts DESC, id DESC) AS rn FROM messages
  WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '20' DAY) WHERE rn <= 300
""",
)
def _(m):
    return R.retention(m, "2024-01-31 00:00:00", "'20' DAY", 300).select("event_name", "id")


@query(
    "part_fnv",
    ("messages",),
    """
SELECT id, CAST(list_reduce([2166136261::HUGEINT] || list_transform(string_split(id, ''), lambda c: unicode(c)::HUGEINT), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) % 16 AS INT) AS partition
  FROM messages
""",
)
def _(m):
    return m.select("id", R.hash_partition(F.col("id"), 16).alias("partition"))


@query("part_round_robin", ("messages",), "SELECT id, CAST(row_number() OVER (ORDER BY ts, id) % 8 AS INT) AS partition FROM messages")
def _(m):
    return R.round_robin(m, 8).select("id", "partition")


@query("part_consistent", ("messages",), None)
def _(m):
    return m.select("id", R.consistent_partition(F.col("id"), 8).alias("partition"))


@query(
    "classify_results",
    ("deliveries",),
    """
SELECT seq, CASE WHEN seq % 5 = 0 THEN 'ack' WHEN seq % 5 = 1 THEN 'nack' WHEN seq % 5 = 2 THEN 'reject'
  WHEN seq % 5 = 3 THEN 'defer' ELSE 'defer' END AS result FROM deliveries
""",
)
def _(d):
    error = F.when(F.col("seq") % 5 == 0, F.lit(None)).when(F.col("seq") % 5 == 1, "nack").when(F.col("seq") % 5 == 2, "reject").when(F.col("seq") % 5 == 3, "defer").otherwise("disk full")
    return d.select("seq", R.classify(error).alias("result"))


@query("retry_policy", ("messages",), """SELECT id, CASE WHEN r = 'ack' THEN 'done' WHEN r = 'reject' THEN 'dead_letter' WHEN retry_count >= 3 THEN 'dead_letter' ELSE 'retry' END AS action
 FROM (SELECT *, CASE seq % 4 WHEN 0 THEN 'ack' WHEN 1 THEN 'nack' WHEN 2 THEN 'reject' ELSE 'defer' END AS r FROM messages)""")
def _(m):
    result = F.element_at(F.array(*map(F.lit, ("ack", "nack", "reject", "defer"))), (F.col("seq") % 4 + 1).cast("int"))
    return m.select("id", R.retry_policy(result, F.col("retry_count"), F.lit(3)).alias("action"))


@query(
    "pending_replay",
    ("messages",),
    """
SELECT id, count(*) AS retry_count FROM (SELECT id, seq FROM messages UNION ALL SELECT id, seq FROM messages WHERE seq % 2 = 0)
  WHERE seq % 3 <> 0 GROUP BY 1
""",
)
def _(m):
    delivered = m.unionByName(m.where("seq % 2 = 0"))
    return R.pending_replay(delivered, m.where("seq % 3 = 0")).select("id", "retry_count")


@query("orphan_claim", ("messages",), "SELECT id FROM messages WHERE (1706659200000 - epoch_ms(ts)) >= 864000000 AND user_id % 4 <> 1")
def _(m):
    idle = F.lit(1706659200000) - F.unix_millis(F.col("ts").cast("timestamp"))
    pending = m.select("id", idle.alias("idle_ms"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("consumer"))
    return R.orphans(pending, "c1", 864_000_000).select("id")


@query("redelivery", ("messages",), """SELECT id, CASE WHEN 1706659200000 - epoch_ms(ts) < 864000000 THEN 'wait' WHEN retry_count >= 4 THEN 'give_up' ELSE 'redeliver' END AS action FROM messages""")
def _(m):
    idle = F.lit(1706659200000) - F.unix_millis(F.col("ts").cast("timestamp"))
    return R.redelivery(m.select("id", idle.alias("idle_ms"), F.col("retry_count").alias("deliveries")), 864_000_000, 4).select("id", "action")


@query("new_ids", ("messages",), "SELECT seq, CASE WHEN seq % 3 = 0 THEN 36 ELSE length(id) END AS size FROM messages")
def _(m):
    from ..sources.transport import new_id

    given = F.when(F.col("seq") % 6 == 0, "").when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("id"))
    return m.select("seq", F.length(new_id(given)).alias("size"))


@query("consumer_lag", ("messages",), """WITH pos AS (SELECT event_name, unnest(['g1', 'g2']) AS consumer_group FROM (SELECT DISTINCT event_name FROM messages)),
 q AS (SELECT *, CASE WHEN consumer_group = 'g1' THEN TIMESTAMP '2024-01-15' END AS position FROM pos)
 SELECT m.event_name, consumer_group, count(*) FILTER (WHERE position IS NULL OR ts > position) AS lag,
  min(ts) FILTER (WHERE position IS NULL OR ts > position) AS oldest_pending
 FROM messages m JOIN q ON m.event_name = q.event_name GROUP BY 1, 2""")
def _(m):
    groups = m.select("event_name").distinct().withColumn("consumer_group", F.explode(F.array(F.lit("g1"), F.lit("g2"))))
    return R.consumer_lag(m, groups.withColumn("position", F.when(F.col("consumer_group") == "g1", F.lit("2024-01-15").cast("timestamp_ntz"))))


_SUBSCRIPTIONS = """VALUES ('view', 'b1', 'broadcast', '', true), ('view', 'w1', 'worker_pool', 'A', true), ('view', 'w2', 'worker_pool', 'A', false), ('view', 'w3', 'worker_pool', 'A', true),
 ('view', 'v1', 'worker_pool', 'B', true), ('click', 'b2', 'broadcast', '', true), ('click', 'w1', 'worker_pool', 'A', true), ('click', 'w3', 'worker_pool', 'A', true), ('error', 'w9', 'worker_pool', 'C', false)"""
_SUBS_SQL = f"s AS (SELECT * FROM ({_SUBSCRIPTIONS}) AS t(event_name, subscription_id, mode, worker_group, available))"


def _subscriptions(m):
    return m.sparkSession.sql(f"SELECT * FROM ({_SUBSCRIPTIONS}) AS t(event_name, subscription_id, mode, worker_group, available)")


@query("route_by_topic", ("messages",), f"""WITH {_SUBS_SQL},
g AS (SELECT event_name, worker_group, list(subscription_id ORDER BY subscription_id) AS ws, list(available ORDER BY subscription_id) AS av,
  row_number() OVER (PARTITION BY event_name ORDER BY worker_group) AS g, count(*) OVER (PARTITION BY event_name) AS gs FROM s
  WHERE mode = 'worker_pool' GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY event_name ORDER BY ts, id) - 1 AS n FROM messages),
o AS (SELECT id, m.event_name, worker_group, ws, av, CAST((n * gs + g) % len(ws) AS INT) AS k FROM m JOIN g ON m.event_name = g.event_name),
c AS (SELECT id, event_name, worker_group, list_filter(list_transform(range(len(ws)), lambda i: CASE
  WHEN av[(k + i) % len(ws) + 1] THEN ws[(k + i) % len(ws) + 1] END), lambda x: x IS NOT NULL) AS ok FROM o)
SELECT id, event_name, ok[1] AS subscription_id, worker_group FROM c WHERE len(ok) > 0
UNION ALL SELECT id, m.event_name, subscription_id, '' AS worker_group FROM messages m JOIN s ON m.event_name = s.event_name WHERE mode = 'broadcast' AND available""")
def _(m):
    return R.route_by_topic(m, _subscriptions(m))


@query(
    "drops",
    ("messages",),
    """
SELECT id, CASE WHEN event_name IN ('view', 'click') THEN NULL WHEN event_name = 'error' THEN 'unavailable'
  ELSE 'no_subscribers' END AS dropped_reason FROM messages
""",
)
def _(m):
    return R.drops(m, _subscriptions(m)).select("id", "dropped_reason")


@query(
    "dropped_by_reason",
    ("messages",),
    """
SELECT event_name, CASE WHEN event_name IN ('view', 'click') THEN 'delivered' WHEN event_name = 'error' THEN 'unavailable'
  ELSE 'no_subscribers' END AS reason, count(*) AS n FROM messages GROUP BY 1, 2
""",
)
def _(m):
    return R.counters(R.drops(m, _subscriptions(m)))


@query("consumer_lag_pending", ("messages",), """WITH p(event_name, consumer_group, position) AS (VALUES ('view', 'g1', TIMESTAMP '2024-01-10'), ('view', 'g2', TIMESTAMP '2024-01-20'), ('click', 'g1', NULL::TIMESTAMP)),
j AS (SELECT m.event_name, m.ts, consumer_group, position FROM messages m LEFT JOIN p ON m.event_name = p.event_name),
l AS (SELECT event_name, consumer_group, count(*) FILTER (WHERE position IS NULL OR ts > position)::BIGINT AS lag,
  min(ts) FILTER (WHERE position IS NULL OR ts > position) AS oldest_pending FROM j GROUP BY 1, 2),
u AS (SELECT event_name, 'g1' AS consumer_group, count(*) AS pending FROM messages WHERE seq % 7 = 0 GROUP BY 1)
SELECT l.event_name, l.consumer_group, lag, oldest_pending, coalesce(pending, 0) AS pending FROM l LEFT JOIN u ON l.event_name = u.event_name AND l.consumer_group = u.consumer_group""")
def _(m):
    rows = [("view", "g1", "2024-01-10"), ("view", "g2", "2024-01-20"), ("click", "g1", None)]
    positions = m.sparkSession.createDataFrame(rows, "event_name string, consumer_group string, position string").withColumn("position", F.col("position").cast("timestamp_ntz"))
    return R.consumer_lag(m, positions, m.where("seq % 7 = 0").select("event_name", F.lit("g1").alias("consumer_group"), "id"))


@query("health_rollup", ("messages",), """SELECT source, CASE max(CASE WHEN retry_count = 5 THEN 2 WHEN retry_count >= 3 THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status
 FROM (SELECT event_name AS source, retry_count FROM messages WHERE event_name <> 'signup' OR retry_count < 4) GROUP BY 1""")
def _(m):
    rows = m.where("event_name <> 'signup' or retry_count < 4")
    status = F.when(F.col("retry_count") == 5, "unhealthy").when(F.col("retry_count") >= 3, "degraded").otherwise("healthy")
    return rows.groupBy(F.col("event_name").alias("source")).agg(X.worst_status(status).alias("status"))


@query(
    "full_name",
    ("messages",),
    """
SELECT seq, CASE seq % 3 WHEN 0 THEN 'bus-1' ELSE '' END AS bus, CASE seq % 3 WHEN 2 THEN '' ELSE CASE seq % 3
  WHEN 0 THEN event_name ELSE 'x' END END AS topic, seq % 3 = 0 AS valid FROM messages
""",
)
def _(m):
    name = F.when(F.col("seq") % 3 == 0, F.concat("source", F.lit("://"), "event_name")).when(F.col("seq") % 3 == 1, F.lit("://x")).otherwise(F.lit("plain"))
    return m.select("seq", X.full_name(name).alias("f")).select("seq", "f.*")


@query("sanitize", ("messages",), "SELECT id, regexp_replace(payload, '[^a-zA-Z0-9]', '_', 'g') AS safe FROM messages")
def _(m):
    return m.select("id", X.sanitize(F.col("payload")).alias("safe"))


@query(
    "backoff",
    ("messages",),
    """
SELECT id, least(100.0 * pow(2, retry_count), 1000.0) AS delay, least(100.0 * pow(2, retry_count), 1000.0) * 0.7 AS low
  FROM messages
""",
)
def _(m):
    return m.select("id", X.backoff_ms(F.col("retry_count"), 100, 1000).alias("b")).select("id", "b.delay", "b.low")


_STEPS = [FieldMapper(1, 2, defaults={"email": '"unknown@example.com"'}), FieldMapper(2, 3, renames={"name": "fullName"})]


@query("json_upcast", ("envelopes",), """SELECT event_id, CASE version WHEN 3 THEN payload WHEN 1 THEN concat('{"email":"unknown@example.com","fullName":"', json_extract_string(payload, '$.name'), '"}')
 ELSE concat('{"email":"u@x.io","fullName":"', coalesce(json_extract_string(payload, '$.name'), json_extract_string(payload, '$.fullName')), '"}') END AS payload FROM envelopes""")
def _(e):
    out, _ = upcast_to_latest(F.col("payload"), F.col("version"), _STEPS)
    return e.select("event_id", out.alias("payload"))


_SCHEMA = JsonSchema(2, "user", ("name", "email"), {"name": "string", "email": "string", "age": "number"})


@query(
    "json_validate",
    ("envelopes",),
    """
SELECT event_id, CASE WHEN version = 2 THEN NULL WHEN version = 1 THEN 'missing required field: email'
  ELSE 'missing required field: name' END AS error FROM envelopes
""",
)
def _(e):
    return e.select("event_id", _SCHEMA.error(F.col("payload")).alias("error"))


@query("envelope_decode", ("envelopes",), """SELECT event_id, version, 'user' AS topic, CASE version WHEN 1 THEN payload WHEN 2 THEN concat('{"email":"u@x.io","name":"', json_extract_string(payload, '$.name'), '"}')
 ELSE concat('{"email":"u@x.io","fullName":"', json_extract_string(payload, '$.fullName'), '"}') END AS payload FROM envelopes""")
def _(e):
    packed = e.select("event_id", encode_envelope(F.col("version"), F.lit("user"), F.col("payload")).alias("data"))
    return packed.select("event_id", decode_envelope(F.col("data")).alias("d")).select("event_id", "d.version", "d.topic", "d.payload")


@query("wire_roundtrip", ("messages",), "SELECT id, source, payload, retry_count FROM messages")
def _(m):
    data = encode_wire(F.col("id"), F.col("source"), F.col("payload").cast("binary"), F.col("retry_count"))
    return m.select(decode_wire(data).alias("d")).select("d.id", "d.source", F.col("d.payload").cast("string").alias("payload"), "d.retry_count")


@query("wire_decode_errors", ("messages",), "SELECT seq, seq % 10 <> 0 AS good FROM messages")
def _(m):
    from ..sources.transport import decoded

    wire = encode_wire(F.col("id"), F.col("source"), F.col("payload").cast("binary"), F.col("retry_count"))
    data = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("{not json "), F.col("seq").cast("string"))).otherwise(wire)
    good, bad = decoded(m.select("event_name", "ts", data.alias("data")))
    ids = good.select(F.substring("id", 5, 20).cast("bigint").alias("seq"), F.lit(True).alias("good"))
    return ids.unionByName(bad.where("metadata['X-Decode-Error'] is not null").select(F.substring("data", 11, 20).cast("bigint").alias("seq"), F.lit(False).alias("good")))


def _typed(m):
    kind = F.element_at(F.array(*map(F.lit, ("application/json", "", "text/plain"))), (F.col("seq") % 3 + 1).cast("int"))
    empty = F.create_map().cast("map<string,string>")
    return m.withColumn("metadata", F.when(kind == "", empty).otherwise(F.create_map(F.lit("Content-Type"), kind)))


@query("content_type_route", ("messages",), "SELECT seq, CASE WHEN seq % 3 = 2 THEN 'dead_letter' ELSE 'decode' END AS route FROM messages")
def _(m):
    from ..sources.transport import split_by_content

    good, bad = split_by_content(_typed(m), F.col("metadata"))
    return good.select("seq", F.lit("decode").alias("route")).unionByName(bad.select("seq", F.lit("dead_letter").alias("route")))


@query(
    "content_type_set",
    ("messages",),
    """
SELECT seq, 'application/msgpack' AS kind, CASE WHEN seq % 3 = 1 THEN 1 ELSE 2 END AS entries FROM messages
""",
)
def _(m):
    from ..functions.wire import with_content_type

    own = F.when(F.col("seq") % 3 != 1, F.create_map(F.lit("trace"), F.col("id"))).otherwise(F.create_map(F.lit("Content-Type"), F.lit("text/plain")))
    found = m.select("seq", with_content_type(own, "application/msgpack").alias("d"))
    return found.select("seq", F.col("d")["Content-Type"].alias("kind"), F.size("d").alias("entries"))


def _through(codec):
    def run(m):
        sent = _typed(m).select("id", "source", "payload", "metadata", "retry_count")
        got = codec.decode(codec.encode(sent, "data").select("data"), "data", "m").select("m.*")
        return got.select("id", "source", F.col("payload").cast("string").alias("payload"), F.coalesce(F.col("metadata")["Content-Type"], F.lit("")).alias("kind"), "retry_count")

    return run


_THROUGH = "SELECT id, source, payload, CASE seq % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN '' ELSE 'text/plain' END AS kind, retry_count FROM messages"
query("wire_msgpack", ("messages",), _THROUGH)(_through(MSGPACK))
query("wire_proto", ("messages",), _THROUGH)(_through(PROTO))


@query("codec_dispatch", ("messages",), "SELECT id, CASE seq % 4 WHEN 3 THEN 'unknown content type' ELSE '' END AS dead_reason FROM messages")
def _(m):
    registry = CodecRegistry()
    parts = []
    for n, codec in enumerate((registry.must_get(None), registry.must_get("application/msgpack"), registry.must_get("application/x-protobuf"), registry.must_get("text/plain"))):
        kind = codec.content_type if n < 3 else "text/plain"
        own = m.where(F.col("seq") % 4 == n).withColumn("metadata", F.create_map(F.lit("Content-Type"), F.lit(kind)))
        parts.append(codec.encode(own.select("id", "source", "payload", "metadata", "retry_count"), "data").select("id", "metadata", "data"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    good, bad = registry.decode(rows)
    return good.select("m.id", F.lit("").alias("dead_reason")).unionByName(bad.select("id", "dead_reason"))


@query("kafka_dead_letters", ("messages",), """SELECT CASE WHEN seq % 10 = 0 THEN concat('evt.', event_name, '.dlt') ELSE concat('evt.', event_name) END AS topic, id, seq % 10 <> 0 AS good FROM messages""")
def _(m):
    from ..sources.transport import from_kafka, kafka_frame

    sent = kafka_frame(m.select("id", "event_name", "source", "payload", "retry_count", "ts"))
    broken = F.substring(F.col("key").cast("string"), 5, 20).cast("bigint") % 10 == 0
    read = sent.select("topic", F.when(broken, F.concat(F.lit("!"), F.col("key").cast("string")).cast("binary")).otherwise(F.col("value")).alias("value"), F.lit("2024-01-31").cast("timestamp").alias("timestamp"))
    good, dead = from_kafka(read)
    alive = good.select(F.concat(F.lit("evt."), F.col("event_name")).alias("topic"), "id", F.lit(True).alias("good"))
    return alive.unionByName(dead.where("size(headers) = 3").select("topic", F.substring(F.col("value").cast("string"), 2, 20).alias("id"), F.lit(False).alias("good")))


_LATEST = JsonSchema(3, "user", ("fullName", "email"), {"fullName": "string", "email": "string"})


@query("versioned_decode", ("envelopes",), """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN payload WHEN version = 1 THEN concat('{"email":"unknown@example.com","fullName":"', json_extract_string(payload, '$.name'), '"}')

  ELSE concat('{"email":"u@x.io","fullName":"', coalesce(json_extract_string(payload, '$.name'), json_extract_string(payload, '$.fullName')), '"}') END AS payload,
 CASE WHEN event_id % 5 <> 0 THEN 3 END AS version, CAST(NULL AS VARCHAR) AS error FROM envelopes""")
def _(e):
    data = F.when(F.col("event_id") % 5 == 0, F.col("payload")).otherwise(encode_envelope(F.col("version"), F.lit("user"), F.col("payload")))
    return e.select("event_id", versioned_decode(data, _STEPS, _LATEST).alias("d")).select("event_id", "d.payload", "d.version", "d.error")


@query("schema_gating", ("messages",), """SELECT id, CASE event_name WHEN 'view' THEN true WHEN 'click' THEN false ELSE true END AS run_monitor, CASE event_name WHEN 'view' THEN false WHEN 'click' THEN true ELSE false END AS run_poison FROM messages""")
def _(m):
    from ..operators.pipeline import gated

    schemas = m.sparkSession.createDataFrame([("view", 1, True, True, False), ("click", 2, False, False, True)], "name string, version int, enable_monitor boolean, enable_idempotency boolean, enable_poison boolean")
    return gated(m.select("id", "event_name"), schemas, {"monitor": True}).select("id", "run_monitor", "run_poison")


@query("outbox_routing", ("messages",), "SELECT id, CASE WHEN seq % 4 = 0 THEN 'outbox' ELSE 'transport' END AS target FROM messages")
def _(m):
    from ..sources.transport import outbox_split

    inside, outside = outbox_split(m, F.col("seq") % 4 == 0)
    return inside.select("id", F.lit("outbox").alias("target")).unionByName(outside.select("id", F.lit("transport").alias("target")))


@query("versioned_encode", ("envelopes",), """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 END AS version, CASE version WHEN 2 THEN concat('{"email":"u@x.io","name":"', json_extract_string(payload, '$.name'), '"}') ELSE payload END AS payload
 FROM envelopes WHERE version <> 3""")
def _(e):
    rows = e.where("version <> 3")
    data = F.when(F.col("event_id") % 2 == 0, versioned_encode(F.col("payload"), F.lit("user"), _SCHEMA)).otherwise(versioned_encode(F.col("payload"), F.lit("user"), None))
    raw = rows.select("event_id", F.col("version").alias("v"), decode_raw(data).alias("d"))
    # Spark keeps an envelope's keys in order; what is no envelope stays as it was written.
    sorted_ = F.when(F.col("v") == 2, F.to_json(F.try_parse_json("d.payload"))).otherwise(F.col("d.payload"))
    return raw.select("event_id", "d.version", sorted_.alias("payload"))


@query("validate_and_upcast", ("envelopes",), """SELECT event_id, CASE WHEN version = 3 THEN NULL WHEN event_id % 5 = 0 THEN NULL WHEN version = 1 THEN concat('{"email":"unknown@example.com","fullName":"', json_extract_string(payload, '$.name'), '"}')
 ELSE concat('{"email":"u@x.io","fullName":"', json_extract_string(payload, '$.name'), '"}') END AS payload,
 CASE WHEN version = 3 THEN 'unknown version' WHEN event_id % 5 = 0 THEN 'invalid json' END AS error FROM envelopes""")
def _(e):
    schemas = [JsonSchema(1, "user", ("name",), {"name": "string"}), JsonSchema(2, "user", ("name", "email"), {"name": "string", "email": "string"})]
    payload = F.when((F.col("event_id") % 5 == 0) & (F.col("version") < 3), F.lit("{broken")).otherwise(F.col("payload"))
    return e.select("event_id", validate_and_upcast(payload, F.col("version"), schemas, _STEPS).alias("d")).select("event_id", "d.payload", "d.error")


@query("rfc3339", ("messages",), "SELECT id, CASE WHEN seq % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM messages")
def _(m):
    text = F.when(F.col("seq") % 5 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return m.select("id", X.rfc3339(text).cast("timestamp_ntz").alias("at"))


_RING = ", ".join(f"({h}, {o})" for h, o in R.ring(8))
ORACLE_SQL["part_consistent"] = with_views(
    f"""WITH ring(h, owner) AS (VALUES {_RING}),
c AS (SELECT id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(id, ''), lambda ch: unicode(ch)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384)
  ELSE x // 2 END)), 4294967295) AS h FROM messages),
l AS (SELECT id, (SELECT min(ring.h) FROM ring WHERE ring.h >= c.h) AS h FROM c)
SELECT id, CAST(owner AS INT) AS partition FROM l JOIN ring ON ring.h = coalesce(l.h, (SELECT min(h) FROM ring))""",
    "messages",
)
