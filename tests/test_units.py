import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel import model
from tidewheel.functions import text as X
from tidewheel.functions.hashing import fnv1a32, sample_bucket
from tidewheel.functions.json_schema import FieldMapper, JsonSchema, upcast_to_latest
from tidewheel.operators import filters, fold
from tidewheel.operators.stores import monitor_page
from tidewheel.session import shared_path
from tidewheel.sources import transport
from tidewheel.streaming import stateful

US = 1_000_000


def outcomes(definition, rows):
    state, out = definition.init, []
    for t, ok in rows:
        state, o = definition.step(state, t, ok)
        out.append(o)
    return out


def test_dedup_edges():
    assert outcomes(fold.dedup_ttl(10), [(0, True), (10, True), (11, True)]) == ["ok", "duplicate", "ok"]
    assert outcomes(fold.dedup_ttl(10, inclusive=False), [(0, True), (10, True)]) == ["ok", "ok"]
    assert outcomes(fold.dedup_ttl(10), [(0, False), (1, True), (2, True)]) == ["fail", "ok", "duplicate"]
    assert outcomes(fold.dedup_ttl(10, claim_on_check=True), [(0, False), (1, True)]) == ["fail", "duplicate"]


def test_poison_and_breaker():
    f = fold.poison(2, 10)
    assert outcomes(f, [(0, False), (1, False), (11, True), (12, False), (13, True)]) == ["fail", "fail", "skip", "fail", "skip"]
    b = fold.circuit_breaker(2, 2, 10)
    assert outcomes(b, [(0, False), (1, False), (11, True), (12, True), (13, True), (14, False)]) == ["fail", "fail", "rejected", "ok", "ok", "fail"]


def test_limiters():
    assert outcomes(fold.fixed_window(1, 10), [(0, True), (5, True), (10, True)]) == ["allow", "deny", "allow"]
    assert outcomes(fold.sliding_window(1, 10), [(0, True), (5, True), (10, True)]) == ["allow", "deny", "allow"]
    assert outcomes(fold.token_bucket(2, 10), [(0, True), (0, True), (9, True), (10, True)]) == ["allow", "allow", "deny", "allow"]
    assert outcomes(fold.micro_batches(2, 10), [(0, True), (1, True), (2, True), (12, True)]) == [0, 0, 1, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=40))
def test_sessions_reset(rows):
    """A pause beyond the gap leaves a state that is as good as new."""
    rows = sorted(rows)
    for f in (fold.dedup_ttl(5), fold.sliding_window(2, 5), fold.token_bucket(2, 3), fold.fixed_window(2, 5)):
        if f.init == (None, 0) :
            continue  # first-hit windows end by time, not by pause
        parts, last = [], None
        for r in rows:
            if last is None or r[0] - last > f.gap_us:
                parts.append([])
            parts[-1].append(r)
            last = r[0]
        assert [o for p in parts for o in outcomes(f, p)] == outcomes(f, rows)


def plain_fold(definition, rows):
    """(key, seq, outcome) by a plain loop over rows of (key, seq, t, ok)."""
    states, out = {}, []
    for key, seq, t, ok in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        outcome = None
        if t is not None:
            states[key], outcome = definition.step(states.get(key, definition.init), t, int(ok or 0))
        out.append((key, seq, outcome))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind, keys", [("bigint", [None, 2**53 + 1, 2**53, 1]), ("string", [None, "", "a", "A"]), ("double", [None, 0.5])])
def test_fold_keys_keep_their_value(spark, kind, keys):
    """Null, large, empty and repeated keys; null times and outcomes; batch, split and streaming forms agree."""
    base, rows = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), []
    for i in range(120):
        t = None if i % 17 == 0 else 5 * 3600 * (i * 31 % 97)
        rows.append((keys[i % len(keys)], i, t, None if i % 13 == 0 else i % 3 > 0))
    frame = [(k, i, None if t is None else base + datetime.timedelta(seconds=t), ok, "x") for k, i, t, ok in rows]
    df = spark.createDataFrame(frame, f"k0 {kind}, seq bigint, ts timestamp, ok boolean, session string").repartition(3)
    us = int(base.timestamp()) * US
    for definition in (fold.dedup_ttl(20 * 3600 * US), fold.poison(2, 30 * 3600 * US)):
        want = plain_fold(definition, [(k, i, None if t is None else us + t * US, ok) for k, i, t, ok in rows])
        assert sorted(map(tuple, fold.fold(df, "k0", definition).collect()), key=repr) == want
        assert sorted(map(tuple, fold.fold(df, "k0", definition, by_session=True).collect()), key=repr) == want
        last = {k: o for k, i, t, ok in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])) for kk, s, o in want if s == i and kk == k}
        assert dict((r["k0"], r["outcome"]) for r in fold.fold(df, "k0", definition, final=True).collect()) == last
        path = shared_path(spark, "keys")
        df.coalesce(1).write.parquet(path)
        stream = stateful.fold_stream(stateful.stream_table(spark, path, df.schema), "k0", definition)
        assert sorted(map(tuple, stateful.run_to_table(stream, "keys").collect()), key=repr) == want


def test_split_gap_spans(spark):
    """Sessions over many spans, on both sides of every border, against a loop."""
    times = [i * 3 for i in range(400)] + [1300 + i * 11 for i in range(200)] + [5000 + i * 700 for i in range(20)]
    rows = [(k, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=t + k * 5)) for k in range(2) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k bigint, seq bigint, ts timestamp")
    got = {(r["k"], r["seq"]): r["session"] for r in fold.split_gap(df, "k", "ts", "seq", 10).collect()}
    assert len(got) == len(rows)
    for k in range(2):
        start = last = None
        for i, t in enumerate(times):
            start = t if last is None or t - last > 10 else start
            last = t
            assert got[k, i] - got[k, 0] == start


def test_stream_state_expires_and_late_rows_go(spark):
    """Two micro-batches: the second drops what lies before the watermark, and expired keys start anew."""
    path, hour = shared_path(spark, "late"), datetime.timedelta(hours=1)
    base = datetime.datetime(2024, 1, 1)
    kind = "k string, seq bigint, ts timestamp, ok boolean"
    parts = [[("a", 1, base, True), ("b", 2, base + 90 * hour, True)], [("a", 3, base + hour, True), ("a", 4, base + 91 * hour, True), ("b", 5, base + 91 * hour, True)]]
    out = shared_path(spark, "late-out")
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
        stream = stateful.fold_stream(stateful.stream_table(spark, path, spark.read.parquet(path).schema), "k", fold.dedup_ttl(10 * 3600 * US), delay="1 hour")
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
    got = {r["seq"]: r["outcome"] for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == {1: "ok", 2: "ok", 4: "ok", 5: "duplicate"}


def test_stream_state_of_a_key_outlives_an_earlier_row(spark):
    """A row that comes out of order doesn't bring the end of its key's state forward; keys of one bucket end each by itself."""
    path, hour, base = shared_path(spark, "early"), datetime.timedelta(hours=1), datetime.datetime(2024, 1, 1)
    out = shared_path(spark, "early-out")
    parts = [
        [("a", 1, 10), ("c", 2, 8)], [("a", 3, 6), ("b", 4, 22)], [("a", 5, 19), ("c", 6, 19)], [("a", 7, 21), ("b", 8, 60)], [("b", 9, 61), ("a", 10, 58)],
    ]
    for part in parts:
        rows = [(k, seq, base + h * hour, True) for k, seq, h in part]
        spark.createDataFrame(rows, "k string, seq bigint, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(path)
        stream = stateful.fold_stream(stateful.stream_table(spark, path, spark.read.parquet(path).schema), "k", fold.dedup_ttl(10 * 3600 * US), delay="5 hours", buckets=1)
        query = stream.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out)
        query.awaitTermination()
    got = {r["seq"]: r["outcome"] for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == {1: "ok", 2: "ok", 3: "duplicate", 4: "ok", 5: "duplicate", 6: "ok", 7: "ok", 8: "ok", 9: "duplicate", 10: "ok"}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


@pytest.mark.parametrize("definition", [fold.dedup_ttl(20 * 3600 * US), fold.poison(2, 30 * 3600 * US)])
def test_stream_states_are_few(spark, definition):
    """5,000 keys have at most BUCKETS values in the state store, and each its own state from one micro-batch to the next."""
    path, out = shared_path(spark, "many"), shared_path(spark, "many-out")
    rows = spark.range(15000).selectExpr("concat('k', id % 5000) as k", "id as seq", "timestamp_seconds(1704067200 + id * 7) as ts", "id % 3 > 0 as ok")
    for part in ("seq < 7500", "seq >= 7500"):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
        stream = stateful.fold_stream(stateful.stream_table(spark, path, rows.schema), "k", definition)
        query = stream.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out)
        query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= stateful.BUCKETS
    got = spark.read.schema(stream.schema).parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.fold(rows, "k", definition).collect()))


def test_stream_keys_of_every_type(spark):
    """Keys of one bucket keep their type and value, and numbers of rows stay exact beside null ones."""
    big = 2**53 + 1
    rows = spark.sql(f"""SELECT named_struct('a', i % 3, 'b', IF(i % 3 = 0, NULL, 'x"y')) AS s, array(CAST(i % 2 AS DOUBLE), NULL) AS l, unhex(concat('FF0', i % 4)) AS b,
 CASE i % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN 0.1D WHEN 2 THEN 0D END AS d, timestamp_micros(1704067200123456 + i % 3) AS t, date'2024-01-01' + CAST(i % 3 AS INT) AS y,
 CAST(i % 3 AS DECIMAL(20, 7)) AS n, i % 2 = 0 AS o, IF(i = 5, NULL, {big} + i) AS seq, timestamp_seconds(1704067200 + i) AS ts, i % 3 > 0 AS ok FROM (SELECT explode(sequence(0L, 59L)) AS i)""")
    path = shared_path(spark, "kinds")
    rows.coalesce(1).write.parquet(path)
    definition = fold.poison(2, 7 * US)
    for key in ("s", "l", "b", "d", "t", "y", "n", "o"):
        stream = stateful.fold_stream(stateful.stream_table(spark, path, rows.schema), key, definition, buckets=1)
        got = stateful.run_to_table(stream, "kinds")
        want = fold.fold(rows, key, definition)
        assert got.schema[key].dataType == want.schema[key].dataType
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect()), key


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    texts = ["", "a", "evt-1", "schlüssel", "鍵"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a32(F.col("t")).alias("h"), sample_bucket(F.col("t")).alias("b")).collect():
        assert r["h"] == fnv(r["t"])
        want = 0
        for c in r["t"]:
            want = (want * 31 + ord(c)) % 1000
        assert r["b"] == want


def test_json_schema(spark):
    schema = JsonSchema(1, "order", ("order_id",), {"order_id": "string", "total": "number", "confirmed": "boolean", "items": "array", "metadata": "object", "odd": "strange"})
    cases = {
        '{"order_id":"1","total":1.5,"confirmed":true,"items":[1],"metadata":{},"odd":3}': True,
        '{"order_id":null}': False, '{"total":1}': False, '{"order_id":"1","total":"x"}': False, "not json": False, "[1]": False, '{"order_id":"1","items":{}}': False,
    }
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", schema.valid(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == cases


def test_upcast_chain(spark):
    steps = [FieldMapper(1, 2, defaults={"email": '"unknown@example.com"'}), FieldMapper(2, 3, renames={"name": "fullName"}, removals=("gone",))]
    df = spark.createDataFrame([('{"name":"John","n":1.50,"gone":1}', 1), ('{"fullName":"x"}', 3), ("{}", 9)], "p string, v int")
    out, error = upcast_to_latest(F.col("p"), F.col("v"), steps)
    rows = df.select(out.alias("o"), error.alias("e")).collect()
    assert rows[0]["o"] == '{"email":"unknown@example.com","fullName":"John","n":1.5}' and rows[0]["e"] is None
    assert rows[1]["o"] == '{"fullName":"x"}' and rows[2]["e"] == "unknown version"


def test_pages_walk_all(spark):
    base = datetime.datetime(2024, 1, 1)
    m = spark.createDataFrame([(f"e{i}", "s", base + datetime.timedelta(seconds=i // 2)) for i in range(5)], "event_id string, subscription_id string, started_at timestamp_ntz")
    for descending in (False, True):
        seen, cursor = [], None
        while True:
            rows, more, cursor = monitor_page(m, filters.MonitorFilter(limit=2, cursor=cursor, descending=descending))
            seen += [r["event_id"] for r in rows]
            if not more:
                break
        assert seen == sorted((f"e{i}" for i in range(5)), reverse=descending)


def test_query_string_and_guard():
    f = filters.monitor_filter_from_query({"status": "failed,retrying", "has_error": "true", "min_duration": "1s", "limit": "x", "order": "desc"})
    assert f.status == ("failed", "retrying") and f.has_error and f.min_duration_ms == 1000 and f.limit == 0 and f.descending
    assert filters.effective_limit(0) == 100 and filters.effective_limit(5000) == 1000
    assert X.parse_duration("1h30m") == 5400 * US
    for bad, force in (("1h", False), ("0s", True), ("x", False)):
        with pytest.raises(ValueError):
            filters.delete_age(bad, force)
    assert filters.delete_age("1h", True) == datetime.timedelta(hours=1)


def test_transport_roundtrip(spark, tmp_path):
    rows = [("m1", "a", "src", bytearray(b"\x00\xff"), datetime.datetime(2024, 1, 1), 0), ("", "a", "src", bytearray(b"x"), datetime.datetime(2024, 1, 2), 2)]
    df = spark.createDataFrame(rows, "id string, event_name string, source string, payload binary, ts timestamp_ntz, retry_count int")
    transport.publish(df, str(tmp_path / "t"))
    good, bad = transport.subscribe(spark, str(tmp_path / "t"), "a", "2024-01-02 00:00:00")
    got = good.collect()
    assert len(got) == 1 and bytes(got[0]["payload"]) == b"x" and got[0]["retry_count"] == 2 and len(got[0]["id"]) == 36
    assert bad.count() == 0


def test_store_schemas_hold_their_rows(spark):
    """Every store's schema takes an empty table through a write and a read."""
    for name in model.STORES:
        kind, path = model.schema(name), shared_path(spark, name)
        spark.createDataFrame([], kind).write.parquet(path)
        assert spark.read.parquet(path).schema.fieldNames() == kind.fieldNames()


def test_upserts_from_a_stream(spark):
    from tidewheel.sources import tables

    path, kind = shared_path(spark, "upserts"), model.schema("event_idempotency")
    at = lambda n: datetime.datetime(2024, 1, n)
    for rows in ([("a", at(1), at(2)), ("b", at(1), at(3)), (None, at(1), at(1))], [("a", at(5), at(6)), ("c", at(4), None)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = stateful.stream_table(spark, f"{path}/in", kind, max_files=1)
        tables.upsert_stream(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    got = tables.compact(spark, f"{path}/log", kind, ("message_id",), "processed_at", f"{path}/table")
    assert {r["message_id"]: r["expires_at"] for r in got.collect()} == {"a": at(6), "b": at(3), "c": None, None: at(1)}


def test_before_each_over_hot_keys(spark):
    from tidewheel.operators.routing import before_each, numbered

    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, i, i % 11 if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, v bigint").repartition(5)
    seen, want = {}, {"max": {}, "sum": {}}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        past = [x for x in seen.setdefault(k, []) if x is not None]
        want["max"][i], want["sum"][i] = max(past, default=None), sum(past) if past else None
        seen[k].append(v)
    for how in ("max", "sum"):
        got = before_each(df, "k", ("ts", "id"), F.col("v"), how, "before").collect()
        assert {r["id"]: r["before"] for r in got} == want[how]
    order = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert {r["id"]: r["n"] for r in numbered(df).collect()} == {i: n + 1 for n, i in enumerate(order)}


def test_numbers_beyond_a_sample(spark):
    """Ranges are the same in every use of the frame, also where rows are too many to be seen whole and uses differ in columns."""
    from tidewheel.operators.routing import before_each, numbered
    from tidewheel.operators.stores import outbox_insert

    n = 20_000
    df = spark.range(n, numPartitions=3).selectExpr("concat('e', id) AS id", "id * 7919 % 20011 AS ts", "'x' AS event_name", "'p' AS payload", "encode('k', 'utf-8') AS key")
    place = {f"e{i}": k + 1 for k, i in enumerate(sorted(range(n), key=lambda i: i * 7919 % 20011))}
    assert {r["id"]: r["n"] for r in numbered(df).collect()} == place
    assert {r["id"]: r["n"] for r in numbered(df).select("id", "n").collect()} == place
    summed = before_each(df, "key", ("ts",), F.lit(1), "sum", "before").collect()
    assert {r["id"]: (r["before"] or 0) + 1 for r in summed} == place
    new = outbox_insert(spark.createDataFrame([(5,)], "id bigint"), df, "2024-01-01 00:00:00")
    assert {r["event_id"]: r["id"] - 5 for r in new.collect()} == place


def test_binary_wire_forms():
    from tidewheel.functions import wire

    cases = [("", "", b"", None, 0), ("id", "sé", b"\x00\xff" * 300, {"a": "1", "b" * 40: "c" * 70_000}, 2**31 - 1), ("x" * 31, "y" * 300, b"z" * 70_000, {str(i): "" for i in range(20)}, -5)]
    for m in cases:
        for encode, decode in ((wire.msgpack_encode, wire.msgpack_decode), (wire.proto_encode, wire.proto_decode)):
            assert decode(encode(m)) == m
            if len(encode(m)) > 1:
                with pytest.raises(Exception):
                    decode(encode(m)[:-1] + b"\xc1" * 9)
    # Fixed bytes of both formats.
    assert wire.msgpack_encode(("a", "b", b"c", None, 300)) == b"\x84\xa2id\xa1a\xa6source\xa1b\xa7payload\xc4\x01c\xabretry_count\xcd\x01\x2c"
    assert wire.proto_encode(("a", "b", b"c", {"k": "v"}, 300)) == b"\x0a\x01a\x12\x01b\x1a\x06\x0a\x01k\x12\x01v\x20\xac\x02\x2a\x01c"


def test_registries():
    from tidewheel.functions import wire
    from tidewheel.functions.json_schema import SchemaRegistry

    registry = SchemaRegistry()
    registry.register(JsonSchema(1, "user"))
    registry.register(JsonSchema(2, "user"), FieldMapper(1, 2))
    assert registry.names() == ["user"] and registry.versions("user") == [1, 2] and registry.latest("user").version == 2 and registry.latest("x") is None
    for bad in (JsonSchema(2, "user"), JsonSchema(0, "user"), JsonSchema(1)):
        with pytest.raises(ValueError):
            registry.register(bad)
    codecs = wire.CodecRegistry()
    assert codecs.must_get(None) is wire.JSON and codecs.must_get("text/plain") is wire.JSON and codecs.get("text/plain") is None
    codecs.register(wire.Codec("text/plain", wire.JSON.encode, wire.JSON.decode))
    assert codecs.get("text/plain").content_type == "text/plain"


def test_property_names_with_dots(spark):
    schema = JsonSchema(1, "x", ("a.b",), {"a.b": "number", "it's": "string"})
    cases = {'{"a.b":1}': True, '{"a.b":"1"}': False, '{"a":{"b":1}}': False, '{"a.b":2,"it\'s":"x"}': True, '{"a.b":2,"it\'s":3}': False}
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", schema.valid(F.col("p")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == cases


def test_ring_lookup_equals_search(spark):
    from tidewheel.operators.routing import consistent_partition, consistent_partition_of

    keys = [f"k{i}" for i in range(500)] + ["", "é"]
    for n, replicas in ((1, 1), (3, 5), (40, 100)):
        rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", consistent_partition(F.col("k"), n, replicas).alias("p")).collect()
        assert all(r["p"] == consistent_partition_of(r["k"], n, replicas) for r in rows)


def test_stream_once_keeps_marks_between_batches(spark):
    path = shared_path(spark, "once-test")
    kind = "id string, seq bigint, ok boolean"
    for rows in ([("a", 1, True), ("a", 2, True), ("b", 3, False), ("", 4, True)], [("a", 5, True), ("b", 6, True), ("", 7, True), (None, 8, True)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = stateful.stream_table(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema)
        query = stateful.once(stream, lambda batch: batch, "id", ("seq",), f"{path}/out", f"{path}/marks", f"{path}/checkpoint")
        got = stateful.finish(query, spark, f"{path}/out", kind)
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4, 6, 7, 8]


def test_shared_folder_can_be_cleared():
    """In a process of its own, as it ends every frame of the session."""
    import subprocess
    import sys

    code = """
import os
from tidewheel.session import build_session, drop_shared, shared_path
spark = build_session("clear", **{"spark.master": "local[1]", "spark.ui.enabled": "false"})
path = shared_path(spark, "x")
spark.range(3).write.parquet(path)
assert os.path.isdir(path)
drop_shared(spark)
assert not os.path.exists(os.path.dirname(path))
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rpartition("/tests/")[0], timeout=120)
