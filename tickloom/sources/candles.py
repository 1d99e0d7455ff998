"""Candle sources, the keyed candle table, and its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.quality import clean, required
from tickloom.sources import versioned

CSV_SCHEMA = "Time timestamp, Open double, High double, Low double, Close double, Volume long, X int"
KEY = ["symbol", "timeframe", "timestamp"]
COLUMNS = ["open_price", "high_price", "low_price", "close_price", "volume"]


def read_csv(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Tab-separated candles with a header; other columns are dropped. Symbol and timeframe come from the file name.

    Files are named SYMBOL_TIMEFRAME.csv; many files are one read.
    """
    rows = spark.read.csv(path, schema=CSV_SCHEMA, sep="\t", header=True, timestampFormat="yyyy-MM-dd HH:mm:ss").withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1))
    named = rows.select(F.regexp_extract("_file", "^(.*)_[^_]*$", 1).alias("symbol"), F.regexp_extract("_file", "_([^_]*)$", 1).alias("timeframe"), F.col("Time").alias("timestamp"), F.col("Open").alias("open_price"), F.col("High").alias("high_price"), F.col("Low").alias("low_price"), F.col("Close").alias("close_price"), F.coalesce("Volume", F.lit(0)).alias("volume"))
    return named if limit is None else named.orderBy("timestamp").limit(limit)


# Names of a candle's columns in a feature frame.
FRAME_NAMES = {"open_price": "Open", "high_price": "High", "low_price": "Low", "close_price": "Close", "volume": "Volume", "timestamp": "event_timestamp"}


def feature_frame(candles: DataFrame) -> DataFrame:
    """Candles under the names that features expect, with their time as the key."""
    return candles.withColumnsRenamed(FRAME_NAMES)


def time_key(frame: DataFrame, key: str = "event_timestamp", text: str = "Time") -> DataFrame:
    """A frame with a time-valued key: the key as it is, or parsed from the text column; an error if there is neither."""
    if dict(frame.dtypes).get(key) in ("timestamp", "timestamp_ntz"):
        return frame
    source = key if key in frame.columns else text
    if source not in frame.columns:
        raise ValueError(f"no time key: neither {key} nor {text} is a column")
    return frame.withColumn(key, F.to_timestamp(F.col(source))).drop(*({text} - {key}))


def flag_base(candles: DataFrame, base: str) -> DataFrame:
    return candles.withColumn("is_base", F.col("timeframe") == base)


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new rows by key, the new one wins; of several new ones the last by `created_at` if there is such a
    column, then the greatest by prices and volume."""
    missing = {*KEY, *COLUMNS} - {*new.columns}
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    made = F.col("created_at").cast("timestamp") if "created_at" in new.columns else F.lit(None).cast("timestamp")
    volume = F.coalesce(F.col("volume").try_cast("long"), F.lit(0)).alias("volume")
    both = existing.select(*KEY, *COLUMNS, F.lit(0).alias("_rank"), F.lit(None).cast("timestamp").alias("_made")).unionByName(new.select(*KEY, *COLUMNS[:-1], volume, F.lit(1).alias("_rank"), made.alias("_made")))
    best = F.max_by(F.struct(*COLUMNS), F.struct("_rank", "_made", *COLUMNS)).alias("_best")
    return both.groupBy(*KEY).agg(best).select(*KEY, "_best.*")


def convert_csv(spark: SparkSession, path: str | list[str], out: str) -> None:
    """CSV candles to Parquet, in a folder for each symbol and timeframe; only those that were read are replaced."""
    rows = read_csv(spark, path).repartition("symbol", "timeframe").sortWithinPartitions("timestamp")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe").parquet(out)


def save(spark: SparkSession, new: DataFrame, path: str, batch: int | None = None) -> bool:
    """Upsert into the table at `path`: the touched dates are read, merged and committed at once, so a failure leaves the
    table as it was. False, and no change, if `batch` is in already. Rows without a key are left out."""
    dated = required(new, *KEY).withColumn("date", F.to_date("timestamp"))
    old = versioned.read(spark, path, dated.select("timeframe", "date").distinct())
    if old is None:
        old = spark.createDataFrame([], T.StructType([dated.schema[c] for c in KEY] + [T.StructField(c, T.DoubleType()) for c in COLUMNS[:-1]] + [T.StructField("volume", T.LongType())]))
    rows = upsert(old, dated).withColumn("date", F.to_date("timestamp"))
    return versioned.commit(spark, path, rows, ["timeframe", "date"], ["symbol", "timestamp"], batch)


def latest_timestamp(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol", "timeframe").agg(F.max("timestamp").alias("latest"))


def in_range(candles: DataFrame, symbols: list[str], start: str, end: str, timeframe: str | None = None) -> DataFrame:
    """Rows of the symbols with start <= timestamp <= end, in order; the conditions reach the scan. No symbols: no rows."""
    rows = candles.where(F.col("symbol").isin(symbols) & F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return (rows if timeframe is None else rows.where(F.col("timeframe") == timeframe)).orderBy("symbol", "timestamp")


def page_days(candles: DataFrame, limit: int, offset: int) -> DataFrame:
    """(symbol, day, start): the days that hold a page of the order by symbol and time, with the number of rows before
    each. The index is one count for each symbol and day."""
    days = candles.groupBy("symbol", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    symbols = days.groupBy("symbol").agg(F.sum("n").alias("_all"))
    ahead = symbols.select("symbol", (F.sum("_all").over(Window.orderBy("symbol")) - F.col("_all")).alias("_ahead"))  # one row a symbol
    inside = F.sum("n").over(Window.partitionBy("symbol").orderBy("day")) - F.col("n")
    starts = days.withColumn("_inside", inside).join(ahead, "symbol").withColumn("start", F.col("_ahead") + F.col("_inside"))
    return starts.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select("symbol", "day", "start")


def page(candles: DataFrame, limit: int, offset: int) -> DataFrame:
    """`limit` rows from `offset` on, by symbol and time. A deep page costs what the first one does: an index of counts
    finds its days, and only their rows are ordered. There are at most `limit` such days, as a day has a row."""
    wanted = page_days(candles, limit, offset)
    rows = candles.withColumn("day", F.to_date("timestamp")).join(F.broadcast(wanted), ["symbol", "day"])
    here = F.row_number().over(Window.partitionBy("symbol", "day").orderBy("timestamp"))
    place = F.col("start") + here - 1
    return rows.withColumn("_place", place).where((F.col("_place") >= offset) & (F.col("_place") < offset + limit)).drop("day", "start", "_place").orderBy("symbol", "timestamp")


def latest(candles: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key, by one aggregate."""
    keys = keys or ("symbol",)
    rest = [c for c in candles.columns if c not in keys]
    return candles.groupBy(*keys).agg(F.max_by(F.struct(*rest), "timestamp").alias("_row")).select(*keys, "_row.*")


def availability_of(candles: DataFrame, symbol: str, timeframe: str) -> DataFrame:
    """One row: count and bounds; count 0 and null bounds where there is nothing."""
    return candles.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)).agg(F.count(F.lit(1)).alias("record_count"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def timeframes_of(candles: DataFrame, symbol: str) -> DataFrame:
    return candles.where(F.col("symbol") == symbol).select("timeframe").distinct()


def ingest(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows of a batch, and one summary row for each symbol: last close, last volume, batch size."""
    good = clean(new)
    summary = good.groupBy("symbol").agg(F.max_by("close_price", "timestamp").alias("last_close"), F.max_by("volume", "timestamp").alias("last_volume"), F.count(F.lit(1)).alias("batch_size"))
    return good, summary
