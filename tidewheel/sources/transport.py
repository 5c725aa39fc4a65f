"""Transports. Folders of Parquet, one partition folder per topic, are read and written here; for Kafka, the frames that
Spark's connector writes and reads are made and opened (the connector itself is not part of this environment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_schema import content_route, decode_wire, encode_wire
from ..functions.wire import JSON, Codec
from ..operators.routing import max_age, start_from

#: The prefix of a topic's name on a broker, and the headers of a dead letter.
TOPIC_PREFIX = "evt."
DEAD_HEADERS = ("X-Original-Topic", "X-Error", "X-Failed-At")


def new_id(given: Column) -> Column:
    """The id, or a uuid for an empty one."""
    return F.coalesce(F.nullif(given, F.lit("")), F.uuid())


def publish(messages: DataFrame, path: str) -> None:
    """Appends messages (with event_name) in wire JSON; an empty id becomes a uuid. The transport's own time is `ts`."""
    metadata = F.col("metadata") if "metadata" in messages.columns else None
    wire = encode_wire(new_id(F.col("id")), F.col("source"), F.col("payload").cast("binary"), F.col("retry_count"), metadata)
    messages.select("event_name", "ts", wire.alias("data")).write.mode("append").partitionBy("event_name").parquet(path)


def subscribe(spark: SparkSession, path: str, event_name: str, position: str = "beginning", as_of: str | None = None, age: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, undecodable) of a topic; partition pruning and the time filter reach the scan."""
    rows = spark.read.parquet(path).where(F.col("event_name") == event_name)
    rows = start_from(rows, position, as_of)
    rows = max_age(rows, as_of, age) if age else rows
    return decoded(rows)


def decoded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = rows.withColumn("m", decode_wire(F.col("data")))
    good = got.where("m is not null").select("event_name", "ts", "m.*")
    bad = got.where("m is null").select("event_name", "ts", "data", F.create_map(F.lit("X-Decode-Error"), F.lit("invalid wire message")).alias("metadata"))
    return good, bad


def split_by_content(rows: DataFrame, metadata: Column) -> tuple[DataFrame, DataFrame]:
    """(decodable, dead letters) by content type."""
    routed = rows.withColumn("__route", content_route(metadata))
    return routed.where("__route = 'decode'").drop("__route"), routed.where("__route = 'dead_letter'").drop("__route")


def outbox_split(rows: DataFrame, in_transaction: Column) -> tuple[DataFrame, DataFrame]:
    """(to the outbox, to the transport)."""
    return rows.where(in_transaction), rows.where(~F.coalesce(in_transaction, F.lit(False)))


def kafka_frame(messages: DataFrame, codec: Codec = JSON, key: Column | None = None) -> DataFrame:
    """(topic, key, value, headers) as the connector writes them: the key is `key`, or the message's id."""
    wire = codec.encode(messages, "value")
    headers = F.array(F.struct(F.lit("Content-Type").alias("key"), F.lit(codec.content_type).cast("binary").alias("value")))
    return wire.select(
        F.concat(F.lit(TOPIC_PREFIX), "event_name").alias("topic"), (F.col("id") if key is None else key).cast("string").cast("binary").alias("key"), "value", headers.alias("headers")
    )


def from_kafka(frame: DataFrame, codec: Codec = JSON) -> tuple[DataFrame, DataFrame]:
    """(messages, dead-letter frame) of what the connector reads (topic, value, timestamp). A broker keeps each group's
    position, so there is no start position here. Undecodable values go to the topic's dead-letter topic."""
    got = codec.decode(frame.select("topic", "value", "timestamp"), "value", "m")
    name = F.substring(F.col("topic"), F.lit(len(TOPIC_PREFIX) + 1), F.length("topic"))
    good = got.where("m is not null").select(name.alias("event_name"), F.col("timestamp").alias("ts"), "m.*")
    return good, dead_letter_frame(got.where("m is null"), F.lit("invalid wire message"), F.col("timestamp"))


def dead_letter_frame(frame: DataFrame, error: Column, failed_at: Column) -> DataFrame:
    """(topic, value, headers) of dead letters: the topic's own dead-letter topic, and where, why and when it failed."""
    values = (F.col("topic"), error, F.date_format(failed_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    headers = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in zip(DEAD_HEADERS, values)])
    return frame.select(F.concat("topic", F.lit(".dlt")).alias("topic"), "value", headers.alias("headers"))


def write_kafka(frame: DataFrame, servers: str) -> None:
    """Writes a frame of kafka_frame or dead_letter_frame by Spark's connector."""
    frame.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()


def read_kafka(spark: SparkSession, servers: str, names: list[str], group: str, max_offsets: int | None = None) -> DataFrame:
    """The connector's stream of topics, for a group."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.group.id", group)
    reader = reader.option("subscribe", ",".join(TOPIC_PREFIX + n for n in names)).option("includeHeaders", "true")
    return (reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader).load()
