"""Streaming forms of the folds, the tail of the monitor, deduplication windows, transactional handling and the outbox relay.

A fold's states are kept in the state store as JSON text, those of a bucket of keys together, since a call of Python for each
key costs milliseconds and a key in a call microseconds. Within a micro-batch a bucket's rows are sorted by event time, so with
rows that arrive in order the outcomes equal those of the batch form. A bucket's rows of one micro-batch are gathered to be
sorted; `max_files` of stream_table bounds a micro-batch. A micro-batch rewrites the states of each bucket that it touches: with
very many keys and small micro-batches, give more `buckets`. Their number belongs to the checkpoint.

With a watermark delay, rows later than the watermark are dropped, and the state of a key whose fold forgets after a pause
(`gap_us`) is removed once the watermark is past that pause, so the store holds the keys of the last gap and not all there
ever were. Folds without a gap keep their state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, StringType, StructType, TimestampType

from ..operators.fold import Fold
from ..session import column, shared_path

#: Buckets of keys in the state store.
BUCKETS = 4096
#: Bits for what a row lacks. So no null and no float comes into pandas.
NO_SEQ, NO_TIME, NO_KEY = 1, 2, 4
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _as_text(key: Column, kind: DataType) -> Column:
    """A key's value as text, one text a value; -0.0 is 0.0."""
    if isinstance(kind, StringType):
        return key
    if isinstance(kind, BinaryType):
        return F.hex(key)
    if isinstance(kind, TimestampType):
        return F.unix_micros(key).cast("string")
    if isinstance(kind, (FloatType, DoubleType)):
        return (key + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, (ArrayType, StructType)):
        return F.to_json(F.struct(key.alias("k")), _JSON)
    return key.cast("string")


def _from_text(text: Column, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.unhex(text)
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    if isinstance(kind, (ArrayType, StructType)):
        return F.from_json(text, StructType().add("k", kind), _JSON)["k"]
    return text.cast(kind)


def fold_stream(
    rows: DataFrame,
    key: str,
    definition: Fold,
    ts: str = "ts",
    seq: str = "seq",
    ok: str | None = "ok",
    out: str = "outcome",
    delay: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """key, seq and outcome of an unbounded frame. delay: the watermark's, such as '1 hour'; without it no row is late and
    no state expires."""
    init, step, kind, gap = definition.init, definition.step, definition.out_type, definition.gap_us
    expires = delay is not None and gap is not None
    key_kind = rows.select(column(key)).schema[0].dataType
    code = F.coalesce(column(ok).cast("int"), F.lit(0)) if ok else F.lit(1)
    slim = rows.select(_as_text(column(key), key_kind).alias("k"), column(seq).cast("bigint").alias("seq"), column(ts).cast("timestamp").alias("at"), code.alias("ok"))
    if delay is not None:
        slim = slim.withWatermark("at", delay)
    lacks = sum((F.when(F.col(name).isNull(), bit).otherwise(0) for name, bit in (("seq", NO_SEQ), ("at", NO_TIME), ("k", NO_KEY))), F.lit(0))
    slim = slim.select(
        F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce("k", F.lit("")).alias("k"), F.coalesce("seq", F.lit(-(2**63))).alias("seq"), F.coalesce(F.unix_micros("at"), F.lit(-(2**63))).alias("t"), "ok", lacks.alias("lacks"),
        *(["at"] if delay is not None else []),
    )

    def run(_: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (tuple(now), last) for k, now, last in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            pdf, new = pd.concat([f[["k", "seq", "t", "ok", "lacks"]] for f in frames], ignore_index=True), (init, None)
            times, numbers, good, lack = (pdf[c].to_numpy() for c in ("t", "seq", "ok", "lacks"))
            keys = [None if x & NO_KEY else k for k, x in zip(pdf["k"].tolist(), lack.tolist())]
            order, results = np.lexsort((numbers, times)), [None] * len(pdf)
            order = order[(lack[order] & NO_TIME) == 0]  # a row without a time changes nothing
            for i, t, g in zip(order.tolist(), times[order].tolist(), good[order].tolist()):
                now, last = known.get(keys[i], new)
                now, results[i] = step(now, t, g)
                known[keys[i]] = now, t if last is None or t > last else last
            numbers = pd.arrays.IntegerArray(numbers.copy(), (lack & NO_SEQ) > 0)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=object), "seq": numbers, "outcome": pd.Series(results, dtype=object)})
        if expires:
            mark = state.getCurrentWatermarkMs()
            ends = {k: (last + gap) // 1000 + 1 for k, (_, last) in known.items()}
            known = {k: v for k, v in known.items() if ends[k] >= mark}
        if known:
            state.update((json.dumps([(k, *v) for k, v in known.items()]),))
            if expires:
                state.setTimeoutTimestamp(max(min(ends[k] for k in known), mark + 1))
        elif state.exists:
            state.remove()

    timeout = GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout
    folded = slim.groupBy("bucket").applyInPandasWithState(run, f"k string, seq bigint, outcome {kind}", "state string", "append", timeout)
    return folded.select(_from_text(F.col("k"), key_kind).alias(key), F.col("seq").alias(seq), F.col("outcome").alias(out))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs what a stream has now into a Parquet table in the shared folder, and reads it."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_table(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """New files of a table as a stream: a change stream of its inserts, whose resume token is the checkpoint."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def first_seen_stream(rows: DataFrame, key: str, delay: str, ts: str = "ts") -> DataFrame:
    """The native window of deduplication: one row of a key within the watermark's delay."""
    return rows.withColumn(ts, column(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tail(entries: DataFrame, predicate: Column, since: str) -> DataFrame:
    """New entries from a time on that match a filter: an incremental scan, without state."""
    return entries.where(F.col("started_at") >= F.lit(since).cast("timestamp_ntz")).where(predicate)


def once(rows: DataFrame, handler: Callable[[DataFrame], DataFrame], key: str, order: tuple[str, ...], out_path: str, marks_path: str, checkpoint: str):
    """Transactional handling: of each micro-batch the first row of every id without a mark is handled, and results and
    marks are written under the batch's number, so a repeated batch replaces its own rows and sees only earlier marks. Rows
    without an id are handled each; rows for which the handler gives no `ok` leave no mark and may come again."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.where(F.coalesce(column(key).cast("string"), F.lit("")) != "")
        firsts = named.groupBy(column(key)).agg(F.min_by(F.struct(*[column(c) for c in named.columns if c != key]), F.struct(*map(column, order))).alias("r")).select(column(key), "r.*")
        kind = f"`{key}` {batch.schema[key].dataType.simpleString()}, batch bigint"
        marks = spark.read.schema(kind).parquet(marks_path).where(F.col("batch") < number) if number else None
        fresh = firsts.join(marks, key, "left_anti") if marks is not None else firsts
        passed = batch.where(F.coalesce(column(key).cast("string"), F.lit("")) == "")
        done = handler(fresh.select(*map(column, batch.columns)).unionByName(passed))
        done.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        kept = spark.read.schema(done.schema).parquet(f"{out_path}/batch={number}").where("ok")
        kept.where(F.coalesce(column(key).cast("string"), F.lit("")) != "").select(key).write.mode("overwrite").parquet(f"{marks_path}/batch={number}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relay(pending: DataFrame, publish: Callable[[DataFrame], DataFrame], status_path: str, checkpoint: str):
    """An outbox relay: every micro-batch of pending rows is published, and its status rows are written under the batch's
    number, so that a repeated batch replaces its own rows. publish gives the rows with a boolean `ok`."""

    def step(batch: DataFrame, number: int) -> None:
        done = publish(batch)
        rows = done.select(
            "id", F.when(F.col("ok"), "published").otherwise("failed").alias("status"),
            F.when(F.col("ok"), F.col("retry_count")).otherwise(F.col("retry_count") + 1).alias("retry_count"),
        )
        rows.write.mode("overwrite").parquet(f"{status_path}/batch={number}")

    return pending.where("status = 'pending'").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query, spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that a batch-numbered writer has put under path."""
    query.awaitTermination()
    kind = StructType.fromDDL(schema)
    return spark.read.schema(kind).parquet(path).select(*kind.fieldNames())
