"""Stores as sinks: an append log in numbered batches, and the table that its latest rows are.

A change is never written in place: `write_changes` puts a batch's rows under its number, so a repeated batch (a lost driver, a
replayed micro-batch) replaces its own rows, and `latest` takes the last row of each key, one aggregation. `compact` writes that
as a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import column


def write_changes(rows: DataFrame, path: str, batch: int) -> None:
    """rows may have a boolean `deleted`; every batch has the same columns."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str):
    """Writes every micro-batch of a stream as changes."""
    return rows.writeStream.foreachBatch(lambda batch, number: write_changes(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: StructType, key: tuple[str, ...], version: str) -> DataFrame:
    """The table: of each key the row of the last batch, in it the greatest version; deleted ones are gone."""
    log = spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("batch bigint").fields])).parquet(path)
    rest = [c for c in schema.fieldNames() if c not in key]
    last = log.groupBy(*map(column, key)).agg(F.max_by(F.struct(*map(column, rest)), F.struct("batch", column(version))).alias("r")).select(*map(column, key), "r.*")
    if "deleted" in rest:
        last = last.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return last.select(*map(column, schema.fieldNames()))


def compact(spark: SparkSession, path: str, schema: StructType, key: tuple[str, ...], version: str, out: str) -> DataFrame:
    latest(spark, path, schema, key, version).write.mode("overwrite").parquet(out)
    return spark.read.schema(schema).parquet(out)
