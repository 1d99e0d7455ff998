"""Messages: publication of candles and errors, topics, retries and dead letters. Frames have Kafka's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import backoff_seconds
from tickloom.functions.timeframe import minutes

# Topics of completion events by processing context.
COMPLETION_TOPICS = {"training": "completed.preprocess-data.training", "inference": "completed.preprocess-data.inference", "backfill": "completed.preprocess-data.backfill"}
DEFAULT_TOPIC = "completed.preprocess-data"


def candle_messages(candles: DataFrame, per_message: int = 1000) -> DataFrame:
    """Per symbol, timeframe and chunk of `per_message` periods of that timeframe: a JSON list of candles; lists are
    bounded."""
    periods = F.unix_timestamp("timestamp") / (60 * minutes(F.col("timeframe")) * per_message)
    rows = candles.withColumn("chunk", F.floor(periods)).groupBy("symbol", "timeframe", "chunk").agg(F.array_sort(F.collect_list(F.struct("timestamp", "open_price", "high_price", "low_price", "close_price", "volume"))).alias("candles"))
    return rows.select(F.col("symbol").alias("key"), F.to_json(F.struct("symbol", "timeframe", F.size("candles").alias("n_candles"), "candles")).alias("value"))


def error_messages(rejected: DataFrame, reason: str) -> DataFrame:
    return rejected.select(F.col("symbol").alias("key"), F.to_json(F.struct(F.lit(reason).alias("reason"), F.struct(*rejected.columns).alias("row"))).alias("value"))


def completion_topic(context: Column) -> Column:
    pairs = [F.lit(x) for k, v in COMPLETION_TOPICS.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[context], F.lit(DEFAULT_TOPIC))


def decoded(messages: DataFrame, schema: str) -> DataFrame:
    """`value` parsed; what is no object of the schema has `parse_error`."""
    parsed = F.from_json(F.col("value").cast("string"), schema)
    looks = F.col("value").cast("string").rlike(r"^\s*\{")
    return messages.withColumn("data", F.when(looks, parsed)).withColumn("parse_error", F.coalesce(~looks, F.lit(True)) | F.col("data").isNull())


def routed(failed: DataFrame, max_attempts: int, retry_topic: str, dead_topic: str) -> DataFrame:
    """failed (key, value, topic, attempt, error): the next attempt's topic, number and delay, or the dead-letter topic."""
    again = F.col("attempt") < max_attempts
    return failed.select(
        "key", "value", F.when(again, F.lit(retry_topic)).otherwise(F.lit(dead_topic)).alias("target"), (F.col("attempt") + 1).alias("next_attempt"),
        F.when(again, backoff_seconds(F.col("attempt") + 1)).alias("delay_seconds"),
        F.array(F.struct(F.lit("original_topic").alias("key"), F.col("topic").alias("value")), F.struct(F.lit("attempt").alias("key"), (F.col("attempt") + 1).cast("string").alias("value")), F.struct(F.lit("error").alias("key"), F.col("error").alias("value"))).alias("headers"),
    )


#: A handler takes the valid messages of its topic: key, attempt and the fields of its schema as `data`.
Handler = Callable[[DataFrame], None]


def dispatched(batch: DataFrame, handlers: dict[str, tuple[str, Handler]], max_attempts: int, retry_topic: str, dead_topic: str) -> DataFrame:
    """Messages (key, value, topic, attempt) to the handlers of their topics, topic: (schema, handler). What does not parse
    and what has no handler is `routed` to retries and dead letters, which are returned.

    Each message is parsed by the schema of its topic in one pass, whose result is written down once for all handlers; a
    handler that fails fails the batch, so handlers have to bear repetition.
    """
    known = F.col("topic").isin(*handlers)
    rows = batch.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), "no handler"))
    for k, (topic, (schema, _)) in enumerate(handlers.items()):
        parsed = decoded(batch.where(F.col("topic") == topic), schema)
        rows = rows.where(F.coalesce(F.col("topic") != topic, F.lit(True))).unionByName(
            parsed.select("key", "value", "topic", "attempt", F.when(F.col("parse_error"), "not an object of the schema").alias("error"), F.when(~F.col("parse_error"), F.col("data")).alias(f"_data_{k}")),
            allowMissingColumns=True,
        )
    held = rows.persist()
    try:
        for k, (topic, (_, handle)) in enumerate(handlers.items()):
            handle(held.where((F.col("topic") == topic) & F.col("error").isNull()).select("key", "attempt", F.col(f"_data_{k}").alias("data")))
        failed = held.where(F.col("error").isNotNull()).select("key", "value", "topic", "attempt", "error")
        return routed(failed, max_attempts, retry_topic, dead_topic)
    finally:
        held.unpersist()


def kafka_stream(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """A request stream; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true").load()
