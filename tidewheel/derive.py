"""Store-shaped views of the driver's tables. The SQL is read by Spark and, for the oracles, by DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import table

VIEWS: dict[str, str] = {
    "messages": """
SELECT concat('evt-', CAST(event_id AS STRING)) AS id, event_type AS event_name, 'bus-1' AS source, props AS payload,
       ts, CAST(event_id % 6 AS INT) AS retry_count, user_id, event_id AS seq
FROM events""",
    "monitor_entries": """
SELECT concat('evt-', CAST(event_id AS STRING)) AS event_id,
       CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('sub-', CAST(user_id % 3 AS STRING)) END AS subscription_id,
       event_type AS event_name, concat('bus-', CAST(user_id % 2 AS STRING)) AS bus_id,
       CASE WHEN event_id % 2 = 0 THEN 'worker_pool' ELSE 'broadcast' END AS delivery_mode,
       CASE WHEN event_id % 10 = 0 THEN 'pending' WHEN event_type <> 'error' THEN 'completed'
            WHEN event_id % 4 = 1 THEN 'failed' ELSE 'retrying' END AS status,
       CASE WHEN event_id % 10 <> 0 AND event_type = 'error' THEN concat('timeout: user ', CAST(user_id AS STRING)) END AS error,
       CAST(event_id % 4 AS INT) AS retry_count, ts AS started_at,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS duration_ms
FROM events""",
    "event_dlq": """
SELECT concat('dlq-', CAST(event_id AS STRING)) AS id, concat('order.', CASE WHEN user_id % 2 = 0 THEN 'created' ELSE 'updated' END) AS event_name,
       concat('evt-', CAST(event_id AS STRING)) AS original_id, props AS payload,
       CASE event_id % 3 WHEN 0 THEN concat('timeout: upstream ', CAST(user_id AS STRING))
                         WHEN 1 THEN 'Validation failed: missing field' ELSE 'boom' END AS error,
       CAST(event_id % 6 AS INT) AS retry_count, concat('svc-', CAST(user_id % 3 AS STRING)) AS source, ts AS created_at,
       CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL '1' HOUR END AS retried_at
FROM events WHERE event_type = 'error'""",
    "deliveries": """
SELECT concat(CAST(user_id AS STRING), '-', event_type) AS message_id, CAST(user_id AS STRING) AS subscriber, event_type AS event_name,
       event_id AS seq, ts, event_id % 2 <> 0 AS ok
FROM events""",
    "event_outbox": """
SELECT o_orderkey AS id, 'order.placed' AS event_name, concat('ord-', CAST(o_orderkey AS STRING)) AS event_id,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing'
            ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'published' END END AS status,
       CAST(o_orderkey % 4 AS INT) AS retry_count, o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL '2' MINUTE END AS claimed_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '3' MINUTE END AS published_at
FROM orders""",
    "scheduled_messages": """
SELECT concat('sch-', CAST(o_orderkey AS STRING)) AS id, concat('order.', lower(o_orderstatus)) AS event_name,
       o_orderdate AS created_at, o_orderdate + INTERVAL '30' DAY AS scheduled_at
FROM orders""",
    "saga_steps": """
SELECT concat('saga-', CAST(l_orderkey AS STRING)) AS saga_id, CAST(step_no AS INT) AS step_no, concat('step-', CAST(step_no AS STRING)) AS step_name,
       NOT (l_returnflag = 'R' AND step_no >= 3) AS exec_ok, l_partkey % 10 <> 0 AS compensate_ok
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag,
        l_extendedprice, l_shipdate) AS step_no FROM lineitem) t""",
    "subscribers": """
SELECT * FROM (VALUES ('b1','broadcast',''),('b2','broadcast',''),('a1','worker_pool','A'),('a2','worker_pool','A'),
       ('a3','worker_pool','A'),('c1','worker_pool','B'),('c2','worker_pool','B')) AS t(subscription_id, mode, worker_group)""",
    "envelopes": """
SELECT event_id, CAST(event_id % 3 + 1 AS INT) AS version,
       CASE event_id % 3 WHEN 0 THEN concat('{"name":"u', CAST(user_id AS STRING), '"}')
         WHEN 1 THEN concat('{"name":"u', CAST(user_id AS STRING), '","email":"u@x.io"}')
         ELSE concat('{"fullName":"u', CAST(user_id AS STRING), '","email":"u@x.io"}') END AS payload
FROM events""",
    "schema_sets": """
SELECT event_type AS name, event_id AS seq, ts, CAST(floor(value) % 7 AS INT) AS version FROM events""",
    "positions": """
SELECT CAST(user_id AS STRING) AS subscriber_id, ts AS position, event_id AS arrival FROM events""",
}

_TABLE = re.compile(r"\bFROM\s+(events|orders|lineitem)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    names = set(_TABLE.findall(sql))
    return spark.sql(_TABLE.sub(r"FROM {\1}", sql), **{n: table(spark, sf_dir, n) for n in names})


def with_views(sql: str, *names: str) -> str:
    """DuckDB text with the views as common table expressions before it."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[len('WITH RECURSIVE') :]}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {head}, {sql.lstrip()[len('WITH') :]}"
    return f"WITH {head} {sql}"
