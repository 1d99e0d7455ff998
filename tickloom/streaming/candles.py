"""Streaming resampling and indicators. State lives in the checkpoint, so a restart loses no open candle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tickloom.functions.timeframe import MINUTES, period_start
from tickloom.operators import incremental
from tickloom.operators.resample import ohlcv
from tickloom.sources import candles as cs
from tickloom.sources import feature_store as fs
from tickloom.sources.versioned import finished
from tickloom.streaming.features import updates


def closed_candles(ticks: DataFrame, timeframe: str, late: str = "10 minutes") -> DataFrame:
    """Candles of a tick or candle stream (or batch), emitted in append mode once the watermark has passed their period.

    Windows need fixed lengths, so months are grouped by their start, which is then the watermark's column: a month comes
    out once rows of a later month are at least 32 days after its start, so late rows of the month before still count.
    """
    if timeframe == "1M":
        months = ticks.withColumn("_month", period_start(F.col("timestamp"), "1M"))
        months = months.withWatermark("_month", "32 days") if ticks.isStreaming else months
        out = months.groupBy("symbol", "_month").agg(*ohlcv())
        return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_month").alias("timestamp"), "open_price", "high_price", "low_price", "close_price", "volume", "source_rows")
    marked = ticks.withWatermark("timestamp", late) if ticks.isStreaming else ticks
    offset = {"1w": "4 days"}.get(timeframe, "0 seconds")
    size = f"{MINUTES[timeframe]} minutes"
    out = marked.groupBy("symbol", F.window("timestamp", size, size, offset).alias("w")).agg(*ohlcv())
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("timestamp"), "open_price", "high_price", "low_price", "close_price", "volume", "source_rows")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All input there is, then stop; the same checkpoint goes on where it stopped, also under a continuous trigger."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rsi_updates(candles: DataFrame, length: int = 14) -> DataFrame:
    """Incremental RSI of each candle, by `features.updates`."""
    return updates(candles, [("rsi", {"length": length})]).select("symbol", "timestamp", F.col(f"rsi_{length}").alias("rsi"))


def upsert_each_batch(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch of candles is upserted into the table at `path`. Offsets are committed after a batch is in the table,
    and a batch that comes again changes nothing, so each takes effect once."""
    write = lambda batch, number: cs.save(batch.sparkSession, batch, path, number)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resampled_each_batch(stream: DataFrame, folder: str, timeframes: list[str], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A stream of ticks as candles of several timeframes (`incremental.candles`), with late rows apart in `folder`/late:
    each row goes, for each timeframe, either into one candle or to the late rows.

    Without `interval` the query takes what there is and ends; with it, it goes on at that pace. Both may follow each
    other on one checkpoint.
    """
    step = lambda batch, number: incremental.run(batch.sparkSession, batch, folder, timeframes, batch=number)
    pace = {"availableNow": True} if interval is None else {"processingTime": interval}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**pace).start()


def catch_up(stream: Callable[[], DataFrame], folder: str, timeframes: list[str], checkpoint: str, interval: str = "10 seconds") -> StreamingQuery:
    """From the backlog to live: runs over what there is until one finds nothing new, then goes on at `interval` on the same
    checkpoint. `stream` makes the source anew for each query. Returns the live query."""
    while True:
        query = resampled_each_batch(stream(), folder, timeframes, checkpoint)
        query.awaitTermination()
        if not any(p.numInputRows for p in query.recentProgress):
            return resampled_each_batch(stream(), folder, timeframes, checkpoint, interval)


def online_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch of a feature stream is pushed to the online table: the newest row of each symbol stays.

    Each batch writes the whole table (one row for each symbol) as `path`/v{batch}, from the one before it, so a batch
    that runs again after a failure gives the same table. `online_table` reads the newest.
    """

    def push(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = fs.online(batch)
        held = finished(spark, path)
        before = [v for v in held if v < number]
        if before:
            rows = fs.push_online(spark.read.parquet(f"{path}/v{max(before)}"), batch)
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest online table that `online_updates` wrote; an error if there is none."""
    held = finished(spark, path)
    if not held:
        raise ValueError(f"no online table at {path}")
    return spark.read.parquet(f"{path}/v{held[-1]}")


def tick_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), *[F.col("value").alias(c) for c in ("open_price", "high_price", "low_price", "close_price")], F.lit(1).cast("long").alias("volume"))
