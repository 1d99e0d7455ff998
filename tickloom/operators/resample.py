"""OHLCV resampling. First and last are chosen by time, so the order of the input does not matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timeframe import MINUTES, period_start


def ohlcv(extra: bool = True) -> list:
    out = [
        F.min_by("open_price", "timestamp").alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", "timestamp").alias("close_price"),
        F.sum("volume").alias("volume"),
    ]
    return out + [F.count(F.lit(1)).alias("source_rows")] if extra else out


def resample(candles: DataFrame, timeframe: str) -> DataFrame:
    """One timeframe, by symbol: partial aggregates before the shuffle, so a hot symbol costs few rows."""
    return (
        candles.withColumn("period", period_start(F.col("timestamp"), timeframe))
        .groupBy("symbol", "period")
        .agg(*ohlcv())
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("period").alias("timestamp"), "open_price", "high_price", "low_price", "close_price", "volume", "source_rows")
    )


def roll_up(candles: DataFrame, timeframes: list[str]) -> DataFrame:
    """Several timeframes from one scan: each is rolled from the longest shorter one whose periods nest in its own.

    The aggregates are decomposable, so only the finest reads the input; row counts are summed.
    """
    base = candles if "source_rows" in candles.columns else candles.withColumn("source_rows", F.lit(1))
    made: dict[str, DataFrame] = {}
    out = None
    for tf in sorted(timeframes, key=MINUTES.get):
        finer = [t for t in made if MINUTES[tf] % MINUTES[t] == 0 and not (tf == "1M" and t == "1w")]
        source = made[max(finer, key=MINUTES.get)] if finer else base
        grouped = source.withColumn("period", period_start(F.col("timestamp"), tf)).groupBy("symbol", "period").agg(*ohlcv(False), F.sum("source_rows").alias("source_rows"))
        made[tf] = grouped.withColumnRenamed("period", "timestamp")
        rows = made[tf].withColumn("timeframe", F.lit(tf))
        out = rows if out is None else out.unionByName(rows)
    return out.select("symbol", "timeframe", "timestamp", "open_price", "high_price", "low_price", "close_price", "volume", "source_rows")


def complete_only(candles: DataFrame) -> DataFrame:
    """Without the last candle of each symbol and timeframe, which may still be open."""
    last = candles.groupBy("symbol", "timeframe").agg(F.max("timestamp").alias("last_open"))
    return candles.join(last, ["symbol", "timeframe"]).where(F.col("timestamp") < F.col("last_open")).drop("last_open")


def distinct_rows(candles: DataFrame) -> DataFrame:
    """Optional deduplication before resampling: one row per symbol and time, the highest volume wins."""
    best = F.max(F.struct("volume", "close_price", "open_price", "high_price", "low_price")).alias("best")
    return candles.groupBy("symbol", "timestamp").agg(best).select("symbol", "timestamp", "best.*")


def stats(resampled: DataFrame) -> DataFrame:
    """Candles, source rows and time span of each symbol and timeframe."""
    return resampled.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("candles"), F.sum("source_rows").alias("source_rows"), F.min("timestamp").alias("first_candle"), F.max("timestamp").alias("last_candle"))
