"""The offline store behind a router of contexts, and an online table of feature views.

The offline store is a versioned table by symbol and day. A run in the context "incremental" adds the rows that it lacks;
one in the context "backfill" replaces, for each symbol, all between the batch's first and last time, days without a row
in the batch included. The online table holds the newest values of each view and symbol in one version: older ones are
deleted after a commit, so a reader of an older version has to read again. Batches that come again change nothing.

Times are cast to timestamps (UTC in a session of this package). A batch with a null time is skipped whole. Symbols are
not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources import feature_store as fs
from tickloom.sources import versioned

OFFLINE = ["symbol", "date"]
ONLINE = ["view", "bucket"]
CONTEXTS = ("incremental", "backfill")


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("symbol", F.col("symbol").cast("string")).withColumn("date", F.date_format("event_timestamp", "yyyy-MM-dd"))


def _days(rows: DataFrame) -> DataFrame:
    return rows.select(*OFFLINE).distinct()


def offline(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame | None:
    rows = versioned.read(spark, path, only)
    return None if rows is None else _dated(rows.drop("date"))


def route(spark: SparkSession, features: DataFrame, path: str, context: str, order: str, batch: int | None = None) -> bool:
    """Store a batch by its context; False where it is empty, holds a null time, or is in already.

    Of several rows of a symbol and time in the batch the first by `order` is stored.
    """
    if context not in CONTEXTS:
        raise ValueError(f"context {context!r} is none of {', '.join(CONTEXTS)}")
    rows = _dated(fs.first_of_batch(fs.storable(features.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))), order))
    if not rows.take(1):
        return False
    if context == "incremental":
        held = offline(spark, path, _days(rows))
        if held is not None:
            rows = held.unionByName(rows.join(held.select(*fs.ROW), fs.ROW, "left_anti"), allowMissingColumns=True)
        return versioned.commit(spark, path, rows, OFFLINE, ["event_timestamp"], batch)
    listed = versioned.manifest(spark, path)
    touched = None
    if listed is not None:
        bounds = rows.groupBy("symbol").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
        touched = listed.join(bounds, "symbol").where(F.col("date").between(F.col("_from"), F.col("_to"))).select(*OFFLINE)
        held = offline(spark, path, touched)
        if held is not None:
            rows = fs.replaced(held, rows)
    return versioned.commit(spark, path, rows, OFFLINE, ["event_timestamp"], batch, replaced=touched)


def online(spark: SparkSession, path: str) -> DataFrame | None:
    """(view, symbol, event_timestamp, values): the newest values of each view and symbol, by name."""
    rows = versioned.read(spark, path)
    return None if rows is None else rows.select("view", "symbol", "event_timestamp", "values")


def viewed(features: DataFrame, views: DataFrame) -> DataFrame:
    """The newest row of each symbol, in the columns of each of its views; views without any of their columns are left out.

    views: view, symbol, columns (names). Feature columns are numbers.
    """
    names = [c for c in features.columns if c not in (*fs.ROW, "date")]
    if not names:
        raise ValueError("no feature columns")
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{c}`").cast("double") for c in names]))
    # One row for each symbol is left before views are joined.
    newest = fs.online(features.select(F.col("symbol").cast("string").alias("symbol"), F.col("event_timestamp").cast("timestamp").alias("event_timestamp"), values.alias("values")).where("event_timestamp IS NOT NULL"))
    chosen = F.map_filter("values", lambda name, _: F.array_contains("columns", name))
    return newest.join(views.select("view", "symbol", "columns"), "symbol").select("view", "symbol", "event_timestamp", chosen.alias("values")).where(F.size("values") > 0)


def merge_online(spark: SparkSession, rows: DataFrame, path: str, batch: int | None = None, buckets: int = 16) -> bool:
    """Put newer values in the place of older ones; only the buckets with a row in `rows` are read and written."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int"))
    if not placed.take(1):
        return False
    held = versioned.read(spark, path, placed.select(*ONLINE).distinct())
    both = placed.withColumn("_new", F.lit(1))
    if held is not None:
        both = both.unionByName(held.withColumn("_new", F.lit(0)))
    best = F.max_by(F.struct("event_timestamp", "values"), F.struct("event_timestamp", "_new"))
    merged = both.groupBy("view", "symbol", "bucket").agg(best.alias("_row")).select("view", "symbol", "bucket", "_row.*")
    done = versioned.commit(spark, path, merged, ONLINE, ["symbol"], batch)
    versioned.expire(spark, path, ONLINE)
    return done


def materialise(spark: SparkSession, store: str, views: DataFrame, path: str, start, end, batch: int | None = None) -> bool:
    """All views of what the offline store holds from `start` to `end`, both included; only the days between are read."""
    listed, first, last = versioned.manifest(spark, store), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if listed is None:
        return False
    rows = offline(spark, store, listed.where(F.col("date").between(F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd"))))
    if rows is None:
        return False
    return merge_online(spark, viewed(rows.where(F.col("event_timestamp").between(first, last)), views), path, batch)


def push(spark: SparkSession, features: DataFrame, views: DataFrame, role: str, symbol: str, path: str, batch: int | None = None) -> bool:
    """Live features of one symbol into its views of a role; an error where there is none, no change where no column fits."""
    tagged = fs.views_of(views, role, symbol)
    return merge_online(spark, viewed(features.where(F.col("symbol") == symbol), tagged), path, batch)


def push_each_batch(spark: SparkSession, views: DataFrame, role: str, symbol: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that is delivered again changes nothing."""

    def run(rows: DataFrame, number: int) -> None:
        push(spark, rows, views, role, symbol, path, number)

    return run
