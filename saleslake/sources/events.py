"""The transaction event stream and the decoding of its messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslake import schemas
from saleslake.functions.money import exact_money

# Producers and operators rely on these names.
TOPIC = "transactions.raw"
CONSUMER_GROUP = "transaction-window-aggregator"  # a prefix: each query has a group of its own
BROKERS = "localhost:9092"


def read_topic(
    spark: SparkSession,
    brokers: str = BROKERS,
    topic: str = TOPIC,
    group: str = CONSUMER_GROUP,
    starting: str = "latest",
) -> DataFrame:
    """The topic as a streaming frame with `key` and `value`. Needs the Kafka connector on the class path.

    `starting` only matters for a new query; a restarted one goes on where its checkpoint ended.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("groupIdPrefix", group)
        .load()
    )


def decode(messages: DataFrame) -> DataFrame:
    """Messages (column `value`, JSON as text or bytes) with their parsed fields and a `valid` flag.

    A message that is no JSON, or has no readable time or exact amount, is marked instead of failing the query.
    """
    parsed = F.from_json(F.col("value").cast("string"), schemas.STREAM_EVENT)
    # Unpacking through a generator parses each message once; as plain columns the parser would run
    # again in every filter on one of its fields.
    fields = messages.select("*", F.inline(F.array(parsed)))
    decoded = fields.withColumns(
        {"event_time": F.try_to_timestamp(F.col("event_time")), "amount": exact_money(F.col("amount"))}
    )
    return decoded.withColumn("valid", F.col("event_time").isNotNull() & F.col("amount").isNotNull())


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("valid").select("transaction_id", "customer_id", "amount", "event_time")


def rejected(decoded: DataFrame) -> DataFrame:
    """The messages that could not be decoded, as they came."""
    return decoded.where("NOT valid").select(F.col("value").cast("string").alias("value"))
