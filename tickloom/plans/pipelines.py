"""Composite pipelines: requests to stored features, and data set assembly."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.registry import FEATURES, compute
from tickloom.functions.timeframe import MINUTES, minutes
from tickloom.operators import coverage, dataset
from tickloom.operators.quality import clean
from tickloom.operators.resample import complete_only, roll_up
from tickloom.sources import feature_store as fs


def request_errors() -> Column:
    """Rules of a request (symbol, base, targets, features, start_ts, end_ts), as the list of those it breaks."""
    longer = F.forall("targets", lambda t: minutes(t) > minutes(F.col("base")))
    rules = {
        "symbol is empty": F.trim(F.coalesce("symbol", F.lit(""))) == "",
        "no feature is enabled": F.size(F.coalesce("features", F.array().cast("array<string>"))) < 1,
        "end is not after start": ~F.coalesce(F.col("end_ts") > F.col("start_ts"), F.lit(False)),
        "no target timeframe": F.size(F.coalesce("targets", F.array().cast("array<string>"))) < 1,
        "a target is not longer than the base": ~F.coalesce(longer, F.lit(True)),
        "a feature is not known": ~F.coalesce(F.forall("features", lambda f: f.isin(*FEATURES)), F.lit(True)),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def checked_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests with their symbol trimmed and upper-cased, and the others with their errors."""
    rows = requests.withColumn("errors", request_errors())
    good = rows.where(F.size("errors") == 0).drop("errors").withColumn("symbol", F.upper(F.trim("symbol")))
    return good, rows.where(F.size("errors") > 0)


def expanded(definitions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Enabled features, with each enabled parameter set (or none), for every data set.

    definitions: feature, enabled, parameter_sets (array of struct enabled, parameters). Both are configuration.
    """
    sets = F.filter("parameter_sets", lambda p: p["enabled"])
    rows = definitions.where("enabled").select("feature", F.explode_outer(sets).alias("p")).select("feature", F.col("p.parameters").alias("parameters"))
    return rows.join(F.broadcast(datasets.withColumn("_all", F.lit(1))), F.lit(1) == F.col("_all")).drop("_all")


def context_columns(frame: DataFrame, primary: list[str], derived: list[str], optional: list[str]) -> DataFrame:
    """The context columns of a frame in order; a missing primary one is an error that names all missing ones."""
    missing = [c for c in primary if c not in frame.columns]
    if missing:
        raise ValueError(f"missing context columns: {', '.join(missing)}")
    return frame.select(*primary, *[c for c in [*derived, *optional] if c in frame.columns and c not in primary])


def features(candles: DataFrame, definitions: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Candles that pass the checks, with all features in one plan."""
    return compute(clean(candles), definitions)


def preprocess(base: DataFrame, existing: DataFrame, timeframe: str, definitions: list[tuple[str, dict[str, Any]]], columns: list[str], start: str, end: str, warm_up_candles: int = 500) -> DataFrame:
    """Rows of the window that the store lacks, with their features.

    Reads `warm_up_candles` periods before the window, resamples, computes, trims to the window, and leaves out the
    (symbol, time) that `existing` holds with all of `columns`. An incomplete last candle is not stored.
    """
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    read = base.where((F.col("timestamp") >= first - F.expr(f"interval {warm_up_candles * MINUTES[timeframe]} minutes")) & (F.col("timestamp") <= last))
    made = features(complete_only(roll_up(clean(read), [timeframe])), definitions).where(F.col("timestamp") >= first)
    held = existing.dropna(subset=columns).select("symbol", F.col("event_timestamp").alias("timestamp"))
    return made.join(held, ["symbol", "timestamp"], "left_anti").withColumnRenamed("timestamp", "event_timestamp")


def store(spark: SparkSession, frames: dict[str, DataFrame], path: str, order: str, window: tuple[str, str] | None = None, online: DataFrame | None = None) -> tuple[dict[str, int], DataFrame | None]:
    """Computed features by timeframe go into the offline store, each timeframe into a folder of its own under `path`.

    A backfill gives its `window`, outside of which nothing is stored; rows that are there already stay. With an
    `online` table, the stored rows are materialised: the newest row of each symbol is given back. Returns the number of
    new rows by timeframe, and the online table.
    """
    stored = {}
    for timeframe, frame in frames.items():
        rows = fs.storable(frame, *(window or (None, None)))
        stored[timeframe] = fs.append(spark, rows, f"{path}/timeframe={timeframe}", order)
        online = fs.push_online(online, rows) if online is not None else None
    return stored, online


def request_totals(runs: DataFrame) -> DataFrame:
    """Totals of a log of requests (columns: those of features by timeframe, elapsed_ms): requests, features, mean time
    and features of a request; zeros for an empty log. The two key columns of a frame are no features."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    made = F.coalesce(F.sum(F.aggregate(F.map_values("columns"), F.lit(0).cast("long"), lambda s, x: s + x - 2)), F.lit(0))
    return runs.agg(F.count(F.lit(1)).alias("requests"), made.alias("features"), (F.coalesce(F.sum("elapsed_ms"), F.lit(0)) / n).alias("mean_ms"), (made / n).alias("features_per_request"))


def coverage_report(base: DataFrame, stored: DataFrame, columns: list[str], timeframe: str, start: str, end: str) -> DataFrame:
    """Coverage of every stored column over the part of the window for which there are candles."""
    available = coverage.availability(base)
    wanted = available.select("symbol", "timeframe").distinct().withColumns({"start_ts": F.lit(start).cast("timestamp"), "end_ts": F.lit(end).cast("timestamp")})
    clipped = coverage.constrained(wanted, available).where("overlaps").select("symbol", F.col("adjusted_start").alias("start_ts"), F.col("adjusted_end").alias("end_ts"))
    series = coverage.on_grid(coverage.expected(clipped, timeframe), stored.withColumnRenamed("event_timestamp", "timestamp"), columns)
    return coverage.buckets(coverage.coverage(coverage.without_warm_up(series)))


def assembled(base: DataFrame, higher: dict[str, DataFrame], keys: list[str], ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Base rows with the closed candles' indicators of every higher timeframe, split in time order."""
    out = base
    for timeframe, frame in higher.items():
        out = dataset.merge_higher(out, frame, MINUTES[timeframe], keys)
    return dataset.split(out, keys, *ratios)


def selected(frame: DataFrame, columns: list[str], least_variance: float = 0.01, most_correlation: float = 0.9) -> list[str]:
    """Columns that vary and don't repeat an earlier one."""
    flat = set(dataset.low_variance(frame, columns, least_variance))
    varied = [c for c in columns if c not in flat]
    return [c for c in varied if c not in set(dataset.correlated(frame, varied, most_correlation))]
