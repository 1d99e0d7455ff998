"""The offline feature store (by symbol and day), its online table, and configuration records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = ["symbol", "event_timestamp"]


def checked(features: DataFrame) -> DataFrame:
    if "event_timestamp" not in features.columns:
        raise ValueError("features need a column event_timestamp")
    return features


def dated(features: DataFrame) -> DataFrame:
    ts = F.col("event_timestamp")
    return features.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")})


def write(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file for each symbol and day; only the days that `features` holds are replaced."""
    rows = dated(checked(features)).repartition("symbol", "year", "month", "day").sortWithinPartitions("symbol", "event_timestamp")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year", "month", "day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("year", "month", "day")


def load(spark: SparkSession, path: str, days: list[tuple[str, str]]) -> DataFrame:
    """The rows of the given (symbol, yyyy-mm-dd) partitions, in order of time; no other partition is listed or read."""
    if not days:
        return read(spark, path).limit(0)
    wanted = [f"{path}/symbol={s}/year={d[:4]}/month={d[5:7]}/day={d[8:10]}" for s, d in sorted(set(days))]
    rows = spark.read.option("basePath", path).parquet(*wanted)
    return rows.drop("year", "month", "day").orderBy("event_timestamp", "symbol")


def manifest(features: DataFrame) -> DataFrame:
    """Per symbol and day: first and last time, and rows."""
    return features.groupBy("symbol", F.to_date("event_timestamp").alias("date")).agg(F.min("event_timestamp").alias("min_ts"), F.max("event_timestamp").alias("max_ts"), F.count(F.lit(1)).alias("n_rows"))


def overlapping(parts: DataFrame, start: str, end: str) -> DataFrame:
    return parts.where(~((F.col("max_ts") < F.lit(start).cast("timestamp")) | (F.col("min_ts") > F.lit(end).cast("timestamp"))))


def first_of_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row for each symbol and time, the first by `order`."""
    best = Window.partitionBy(*ROW).orderBy(order)
    return batch.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def new_rows(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The rows of a batch that the store does not hold yet: existing rows win."""
    return first_of_batch(checked(batch), order).join(existing.select(*ROW), ROW, "left_anti")


def append(spark: SparkSession, batch: DataFrame, path: str, order: str) -> int:
    """Incremental store: writes and counts the new rows."""
    try:
        existing = read(spark, path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = first_of_batch(checked(batch), order)
    else:
        fresh = new_rows(existing, batch, order)
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        dated(fresh).repartition("symbol", "year", "month", "day").write.mode("append").partitionBy("symbol", "year", "month", "day").parquet(path)
    fresh.unpersist()
    return n


def replaced(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch: its rows replace those of the same symbol between its first and last time."""
    bounds = batch.groupBy("symbol").agg(F.min("event_timestamp").alias("_from"), F.max("event_timestamp").alias("_to"))
    kept = existing.join(bounds, "symbol", "left").where(F.col("_from").isNull() | (F.col("event_timestamp") < F.col("_from")) | (F.col("event_timestamp") > F.col("_to"))).drop("_from", "_to")
    return kept.unionByName(batch, allowMissingColumns=True)


def storable(batch: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A batch with a null time is skipped whole; a backfill keeps its window, both ends included."""
    rows = checked(batch).where(~F.lit(bool(batch.where(F.col("event_timestamp").isNull()).take(1))))
    return rows if start is None else rows.where(F.col("event_timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def online(features: DataFrame) -> DataFrame:
    """The newest row of each symbol."""
    rest = [c for c in features.columns if c != "symbol"]
    return features.groupBy("symbol").agg(F.max_by(F.struct(*rest), "event_timestamp").alias("_row")).select("symbol", "_row.*")


def online_projection(features: DataFrame, schema: list[str]) -> DataFrame | None:
    """The view's columns that there are, in order of name; None if there is none beside the key."""
    kept = sorted({c for c in schema if c in features.columns} - {*ROW})
    if not kept:
        return None
    return features.select(*sorted([*ROW, *kept])).withColumn("symbol", F.col("symbol").cast("string"))


def push_online(table: DataFrame, features: DataFrame) -> DataFrame:
    return online(table.unionByName(features, allowMissingColumns=True))


def views_of(views: DataFrame, role: str, symbol: str) -> DataFrame:
    """The feature views of a role and symbol; it is an error if there are none.

    views: view, feature_role, symbol, one row for each view.
    """
    found = views.where((F.col("feature_role") == role) & (F.col("symbol") == symbol))
    if not found.take(1):
        raise ValueError(f"no feature view of role {role} and symbol {symbol}: store offline features first")
    return found


def upsert_config(configs: DataFrame, new: DataFrame) -> DataFrame:
    """Configuration versions by hash; the new record wins."""
    both = configs.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    rest = [c for c in configs.columns if c != "hash"]
    return both.groupBy("hash").agg(F.max_by(F.struct(*rest), F.struct("_rank", "created_at")).alias("_row")).select("hash", "_row.*")


def find_config(configs: DataFrame, version: str) -> DataFrame:
    """The newest record of that version or hash."""
    return configs.where((F.col("semver") == version) | (F.col("hash") == version)).orderBy(F.desc("created_at")).limit(1)


def latest_by_prefix(configs: DataFrame, prefix: str) -> DataFrame:
    return configs.where(F.col("semver").startswith(prefix)).orderBy(F.desc("created_at")).limit(1)
