"""Topics as DataFrames of (seq, key, value): JSON text keyed by order id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tillspark import schemas

# Where each consumer group starts without a checkpoint. The
# order group declares nothing and so has the consumer's own default.
GROUP_START = {
    "inventory-service": "earliest",
    "notification-service": "earliest",
    "payment-service": "earliest",
    "order-service": "latest",
}


# Rows of a topic grow when they are parsed, so its files can be read in small parts.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20)}


def placed_at(rows: DataFrame, topic: str, partition: Column | None = None, time: Column | None = None) -> DataFrame:
    """Topic rows with `at`: their place in one order over all partitions and topics.

    By publishing time, where rows carry one, then topic, partition and
    sequence; the sequence alone orders one partition only.
    """
    return rows.withColumn("at", F.struct(
        (F.lit(None) if time is None else time).cast("timestamp").alias("time"), F.lit(topic).alias("topic"),
        (F.lit(0) if partition is None else partition).cast("int").alias("partition"), F.col("seq").cast("long").alias("seq"),
    ))


def read_topic(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    streaming: bool = True,
    start: str = "earliest",
    max_files: int | None = None,
    servers: str | None = None,
    max_offsets: int | None = None,
) -> DataFrame:
    """A topic as rows (seq, key, value, at).

    `fmt="kafka"` takes `location` as the topic name and needs the
    connector; `start` counts only until the job has a checkpoint. Other
    formats take a folder, always read from its beginning (see `subscribe`).
    `max_files` or `max_offsets` bound a micro-batch.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        if streaming and max_offsets:
            reader = reader.option("maxOffsetsPerTrigger", max_offsets)
        rows = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", location)
            .option("startingOffsets", start)
            .load()
            .withColumn("seq", F.col("offset"))
        )
        return placed_at(rows, location, F.col("partition"), F.col("timestamp")).select(
            "seq", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "at"
        )
    if start != "earliest":
        raise ValueError("a folder topic is always read from its beginning")
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.schema(schemas.PUBLISHED_TOPIC).format(fmt).load(location)
    return placed_at(rows, location.rstrip("/").rsplit("/", 1)[-1], time=F.col("published")).drop("published")


def subscribe(
    spark: SparkSession, location: str, group: str, checkpoint: str, max_files: int | None = None
) -> DataFrame:
    """A folder topic as its consumer group reads it.

    A group that starts at the latest row sees only what is published after
    its first start. That place is written beside its checkpoint, so later
    starts go on from the checkpoint and not from a newer end.
    """
    rows = read_topic(spark, location, max_files=max_files)
    if GROUP_START[group] == "earliest":
        return rows
    folder = f"{checkpoint}/first-start"
    try:
        last = spark.read.schema("seq long").parquet(folder).first()["seq"]
    except AnalysisException:  # the first start
        here = read_topic(spark, location, streaming=False).agg(F.max("seq").alias("seq"))
        here.coalesce(1).write.parquet(folder)
        last = spark.read.schema("seq long").parquet(folder).first()["seq"]
    return rows if last is None else rows.filter(F.col("seq") > last)


def topic_rows(events: DataFrame, seq: Column) -> DataFrame:
    """Events (key, value) as topic rows in the order of `seq`."""
    return events.select(seq.cast("long").alias("seq"), "key", "value")


def write_topic(
    rows: DataFrame, location: str, checkpoint: str | None = None, fmt: str = "parquet",
    servers: str | None = None,
) -> StreamingQuery | None:
    """Publish rows: a batch append, or a streaming append with a checkpoint."""
    if fmt == "kafka":
        rows = rows.select("key", "value")
        target = {"kafka.bootstrap.servers": servers, "topic": location}
    else:
        rows = rows.drop("at")
        target = {"path": location, **SMALL_GROUPS}
    if rows.isStreaming:
        writer = rows.writeStream.format(fmt).option("checkpointLocation", checkpoint)
        return writer.options(**target).trigger(availableNow=True).start()
    rows.write.format(fmt).mode("append").options(**target).save()
    return None
