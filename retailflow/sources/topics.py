"""Topics: append-only logs of (key, value) messages.

Two backends with one message shape. The file backend keeps a topic under
`<root>/topic=<name>/producer=<job>/batch_id=<n>/` and is what the tests run. The Kafka backend only sets
options of Spark's own source and sink; its connector is not part of a plain Spark install, so
it is not exercised here.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.session import SPENT_SHUFFLES, setting
from retailflow.sources.storage import exists, make_folder, together

BACKFILL_BATCH = -1


def write_topic(messages: DataFrame, root: str, batch_id: int, producer: str = "main", as_dealt: bool = False) -> None:
    """Appends messages (topic, key, value and optionally seq and arrived) as batch `batch_id` of this
    producer. Writing the same batch again replaces it, so a replayed micro-batch changes nothing;
    other producers' batches stay. With `as_dealt` the messages are written from where they are: by as few tasks as their data need,
    so that no text is shuffled."""
    seq = F.col("seq") if "seq" in messages.columns else F.monotonically_increasing_id()
    key = F.col("key") if "key" in messages.columns else F.lit(None).cast("string")
    arrived = F.col("arrived") if "arrived" in messages.columns else F.current_timestamp()
    # One file per topic and micro-batch rather than one per task; a large topic is split again.
    rows = (messages if as_dealt else together(messages, "topic")).select(
        "topic", key.alias("key"), "value", seq.cast("bigint").alias("seq"), arrived.alias("arrived"),
        F.lit(producer).alias("producer"), F.lit(batch_id).cast("bigint").alias("batch_id"),
    )
    with setting(messages.sparkSession, SPENT_SHUFFLES, "true"):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "producer", "batch_id").parquet(root)


def read_batch(spark: SparkSession, root: str, topics: list[str], batch_id: int, producer: str) -> DataFrame:
    """What a producer wrote as a batch into some topics: seq and value."""
    paths = [f"{root}/topic={t}/producer={producer}/batch_id={batch_id}" for t in topics]
    paths = [p for p in paths if exists(spark, p)]
    rows = spark.read.schema("seq bigint, value string")
    return rows.parquet(*paths) if paths else spark.createDataFrame([], "seq bigint, value string")


def read_topic(
    spark: SparkSession, root: str, topic: str, from_batch: int | None = None, until_batch: int | None = None
) -> DataFrame:
    """A topic as a table; `from_batch` (inclusive) and `until_batch` (exclusive) replay a range.
    The range is a partition filter: other batches are not read."""
    path = f"{root}/topic={topic}"
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.TOPIC_MESSAGE)
    rows = spark.read.schema(schemas.TOPIC_MESSAGE).parquet(path)
    if from_batch is not None:
        rows = rows.filter(F.col("batch_id") >= from_batch)
    if until_batch is not None:
        rows = rows.filter(F.col("batch_id") < until_batch)
    return rows


def stream_topic(spark: SparkSession, root: str, topic: str, files_per_trigger: int | None = None) -> DataFrame:
    """A topic as a stream, which may not have a message yet. Consumers keep their position in
    their own checkpoint; several consumers of one topic do not disturb each other."""
    make_folder(spark, f"{root}/topic={topic}")
    reader = spark.readStream.schema(schemas.TOPIC_MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root}/topic={topic}")


def kafka_options(
    servers: str,
    topics: list[str],
    group: str | None = None,
    offsets: dict[str, dict[int, int]] | None = None,
    until: dict[str, dict[int, int]] | None = None,
) -> dict[str, str]:
    """Options of the Kafka source: default or named group, start at the end or at given offsets
    per topic and partition, and for a bounded replay an end as well."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "failOnDataLoss": "true"}
    if group:
        options["kafka.group.id"] = group
    options["startingOffsets"] = json.dumps(offsets) if offsets else "latest"
    if until:
        options["endingOffsets"] = json.dumps(until)
    return options


def _from_kafka(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("offset").alias("seq"),
        F.col("timestamp").alias("arrived"),
        "topic",
        "partition",
    )


def stream_kafka(spark: SparkSession, servers: str, topics: list[str], **start) -> DataFrame:
    return _from_kafka(spark.readStream.format("kafka").options(**kafka_options(servers, topics, **start)).load())


def replay_kafka(spark: SparkSession, servers: str, topics: list[str], offsets: dict, until: dict) -> DataFrame:
    options = kafka_options(servers, topics, offsets=offsets, until=until)
    return _from_kafka(spark.read.format("kafka").options(**options).load())


def write_kafka(messages: DataFrame, servers: str) -> None:
    """Sends (topic, key, value) rows of a micro-batch, keyed, so that versions of one row stay
    in order."""
    columns = [c for c in ("topic", "key", "value") if c in messages.columns]
    messages.select(*columns).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
