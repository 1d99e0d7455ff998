"""Incremental resampling: what is open is kept, so each row is read once.

State is one table: an accumulator for each open candle (first and last price with their times, high, low, sums), and for
each symbol the time of the last row that was taken. A run takes rows after that time only (strictly, so the row at the
mark is not counted twice), merges them with the open candles, and closes all but the newest period of each symbol and
timeframe. Accumulators merge in any order, so candles from many runs equal those of one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.timeframe import period_start
from tickloom.sources import candles as cs
from tickloom.sources import versioned

STATE = "symbol string, timeframe string, period timestamp, first_at timestamp, open_price double, high_price double, low_price double, last_at timestamp, close_price double, volume long, source_rows long"
CANDLE = ["symbol", "timeframe", "timestamp", "open_price", "high_price", "low_price", "close_price", "volume", "source_rows"]
#: The timeframe under which the state table keeps a symbol's mark.
MARK = "mark"


def accumulators(rows: DataFrame, timeframes: list[str]) -> DataFrame:
    """Rows (symbol, timestamp, prices, volume) as accumulators of every timeframe's periods."""
    periods = F.explode(F.array(*[F.struct(F.lit(tf).alias("timeframe"), period_start(F.col("timestamp"), tf).alias("period")) for tf in timeframes]))
    ones = rows.withColumn("_p", periods).select("symbol", "_p.*", F.col("timestamp").alias("first_at"), "open_price", "high_price", "low_price", F.col("timestamp").alias("last_at"), "close_price", F.col("volume").cast("long").alias("volume"), F.lit(1).cast("long").alias("source_rows"))
    return merged(ones)


def merged(parts: DataFrame) -> DataFrame:
    """Accumulators of the same candle as one; partial aggregates come first, so an open candle costs few rows."""
    return parts.groupBy("symbol", "timeframe", "period").agg(
        F.min("first_at").alias("first_at"), F.min_by("open_price", "first_at").alias("open_price"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"),
        F.max("last_at").alias("last_at"), F.max_by("close_price", "last_at").alias("close_price"), F.sum("volume").alias("volume"), F.sum("source_rows").alias("source_rows"),
    )


@dataclass
class Step:
    candles: DataFrame  # accumulators with `is_open`
    marks: DataFrame  # state rows of the marks
    late: DataFrame  # rows, by timeframe, of periods that were closed before


def as_candles(accumulated: DataFrame) -> DataFrame:
    return accumulated.withColumnRenamed("period", "timestamp").select(*CANDLE)


def advance(state: DataFrame, rows: DataFrame, timeframes: list[str], start: str | None = None, by_mark: bool = True) -> Step:
    """One run. state: STATE, maybe empty. With `by_mark`, rows may hold what was taken before: those up to the mark of
    their symbol are left out, and for a symbol without a mark those before `start`. Without, all rows are new (a batch of a
    stream), and those of a closed period come out as late, for each timeframe in which they are. Null symbols or times
    are left out."""
    rows = rows.where(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull())
    marks = state.where(F.col("timeframe") == MARK).select("symbol", F.col("last_at").alias("_mark"))
    opened = state.where(F.col("timeframe") != MARK)
    if by_mark:
        first = F.lit(True) if start is None else F.col("timestamp") >= F.lit(start).cast("timestamp")
        rows = rows.join(marks, "symbol", "left").where(F.when(F.col("_mark").isNull(), first).otherwise(F.col("timestamp") > F.col("_mark"))).drop("_mark")
    fresh = accumulators(rows, timeframes)
    bounds = opened.groupBy("symbol", "timeframe").agg(F.max("period").alias("_open"))
    joined = fresh.join(bounds, ["symbol", "timeframe"], "left")
    behind = F.coalesce(F.col("period") < F.col("_open"), F.lit(False))
    late = rows.withColumn("timeframe", F.explode(F.array(*[F.lit(tf) for tf in timeframes]))).join(bounds, ["symbol", "timeframe"])
    late = late.where(_period(timeframes) < F.col("_open")).drop("_open")
    together = merged(opened.unionByName(joined.where(~behind).drop("_open")))
    newest = together.groupBy("symbol", "timeframe").agg(F.max("period").alias("_newest"))
    dated = together.join(newest, ["symbol", "timeframe"])
    flagged = dated.withColumn("is_open", F.col("period") == F.col("_newest")).drop("_newest")
    seen = rows.groupBy("symbol").agg(F.max("timestamp").alias("_mark")).unionByName(marks).groupBy("symbol").agg(F.max("_mark").alias("last_at"))
    marked = seen.select("symbol", F.lit(MARK).alias("timeframe"), "last_at")
    return Step(flagged, marked, late)


def _period(timeframes: list[str]):
    out = F.lit(None).cast("timestamp")
    for tf in timeframes:
        out = F.when(F.col("timeframe") == tf, period_start(F.col("timestamp"), tf)).otherwise(out)
    return out


def held_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of the last run that was committed."""
    found = versioned.read(spark, f"{folder}/state")
    return spark.createDataFrame([], STATE) if found is None else found.drop("part")


def run(spark: SparkSession, rows: DataFrame, folder: str, timeframes: list[str], start: str | None = None, reset: bool = False, batch: int | None = None) -> None:
    """One run over stored state: closed candles are upserted into `folder`/candles, late rows of a stream's batch are kept
    in `folder`/late, then the state is committed. A run that fails before that is repeated from the same state and gives
    the same candles. `reset` (a backfill) starts without state. With `batch`, rows are a stream's batch, and a batch that
    is in already changes nothing.
    """
    if batch is not None and (known := versioned.last_batch(spark, f"{folder}/state")) is not None and batch <= known:
        return
    state = spark.createDataFrame([], STATE) if reset else held_state(spark, folder)
    step = advance(state, rows, timeframes, start, by_mark=batch is None)
    work = f"{folder}/work-{uuid.uuid4().hex}"  # computed once, and not read from what is being replaced
    step.candles.write.parquet(f"{work}/candles")
    step.marks.write.parquet(f"{work}/marks")
    made = spark.read.parquet(f"{work}/candles")
    cs.save(spark, as_candles(made.where(~F.col("is_open"))), f"{folder}/candles")
    if batch is not None:
        versioned.commit(spark, f"{folder}/late", step.late.withColumn("part", F.lit(batch)), ["part"], ["symbol", "timestamp"])
    kept = made.where("is_open").drop("is_open").unionByName(spark.read.parquet(f"{work}/marks"), allowMissingColumns=True)
    versioned.commit(spark, f"{folder}/state", kept.withColumn("part", F.lit(0)), ["part"], ["symbol", "timeframe"], batch)
    versioned.remove(spark, work)


def candles(spark: SparkSession, folder: str) -> DataFrame:
    """All candles so far with `is_open`, from the table of closed ones and the state."""
    opened = as_candles(held_state(spark, folder).where(F.col("timeframe") != MARK)).drop("source_rows").withColumn("is_open", F.lit(True))
    closed = versioned.read(spark, f"{folder}/candles")
    if closed is None:
        return opened
    return closed.select(*[c for c in CANDLE if c != "source_rows"], F.lit(False).alias("is_open")).unionByName(opened)
