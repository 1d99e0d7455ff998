"""Which features exist, and where the gaps are. Long format: (symbol, timeframe, feature, timestamp, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.timeframe import MINUTES, grid, minutes

SERIES = ["symbol", "timeframe", "feature"]


def expected(requests: DataFrame, timeframe: str) -> DataFrame:
    """requests (symbol, start_ts, end_ts) to one row per expected period start."""
    return requests.select("symbol", F.lit(timeframe).alias("timeframe"), F.explode(grid(F.col("start_ts"), F.col("end_ts"), timeframe)).alias("timestamp"))


def on_grid(expected_rows: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Expected timestamps with the features that exist there, in long format; missing values are null."""
    wide = expected_rows.join(features.select("symbol", "timestamp", *names), ["symbol", "timestamp"], "left")
    return wide.unpivot(["symbol", "timeframe", "timestamp"], names, "feature", "value")


def missing_periods(series: DataFrame, timeframe: str) -> DataFrame:
    """Runs of null values: a new one starts where the step to the null before exceeds 1.5 intervals."""
    order = Window.partitionBy(*SERIES).orderBy("timestamp")
    step = F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(order))
    nulls = series.where(F.col("value").isNull()).withColumn("_break", F.coalesce(step > 1.5 * 60 * MINUTES[timeframe], F.lit(True)).cast("int"))
    runs = nulls.withColumn("_run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*SERIES, "_run").agg(F.min("timestamp").alias("gap_start"), F.max("timestamp").alias("gap_end"), F.count(F.lit(1)).alias("n_missing")).drop("_run")


def without_warm_up(series: DataFrame, share: float = 0.05) -> DataFrame:
    """Leading nulls go if they are fewer than `share` of the series' rows."""
    first = F.min(F.when(F.col("value").isNotNull(), F.col("timestamp")))
    heads = series.groupBy(*SERIES).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    marked = series.join(heads, SERIES).withColumn("_lead", F.coalesce(F.col("timestamp") < F.col("_first"), F.lit(False)))
    leads = marked.groupBy(*SERIES).agg(F.count_if("_lead").alias("_leads"))
    kept = marked.join(leads, SERIES).where(~(F.col("_lead") & (F.col("_leads") < share * F.col("_n"))))
    return kept.select(series.columns)


def coverage(series: DataFrame) -> DataFrame:
    """Per feature: expected and present rows, first and last present time, percentage, completeness."""
    present = F.when(F.col("value").isNotNull(), F.col("timestamp"))
    out = series.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_expected"), F.count("value").alias("n_present"), F.min(present).alias("first_present"), F.max(present).alias("last_present"))
    return out.withColumn("coverage_pct", F.col("n_present") * 100.0 / F.col("n_expected")).withColumn("fully_covered", F.col("n_present") == F.col("n_expected"))


def best_column(by_column: DataFrame) -> DataFrame:
    """(symbol, timeframe, feature, column_index, coverage_pct, fully_covered): full first, then percentage, then place."""
    order = Window.partitionBy(*SERIES).orderBy(F.desc("fully_covered"), F.desc("coverage_pct"), "column_index")
    return by_column.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def buckets(analysis: DataFrame, full_pct: float = 100.0) -> DataFrame:
    pct = F.col("coverage_pct")
    return analysis.withColumns({
        "is_full": pct >= full_pct, "is_partial": (pct > 0) & (pct < full_pct), "is_missing": pct <= 0,
        "needs_computation": pct < full_pct, "needs_warm_up": (pct > 0) & (pct < full_pct),
    })


def overall(analysis: DataFrame, *keys: str) -> DataFrame:
    """Mean coverage and counts; 0 where nothing was asked for."""
    out = buckets(analysis).groupBy(*keys).agg(F.coalesce(F.avg("coverage_pct"), F.lit(0.0)).alias("mean_pct"), F.count_if("is_full").alias("n_full"), F.count_if("is_partial").alias("n_partial"), F.count_if("is_missing").alias("n_missing"))
    return out.withColumn("summary", F.format_string("%d full, %d partial, %d missing", "n_full", "n_partial", "n_missing"))


def availability(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("record_count"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def constrained(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Requests clipped to what is available; no row of candles leaves the bounds null and the request unavailable."""
    joined = requests.join(available, ["symbol", "timeframe"], "left")
    start, end = F.greatest("start_ts", "earliest"), F.least("end_ts", "latest")
    overlaps = F.coalesce((F.col("earliest") <= F.col("end_ts")) & (F.col("latest") >= F.col("start_ts")), F.lit(False))
    return joined.withColumns({"overlaps": overlaps, "adjusted_start": F.when(overlaps, start), "adjusted_end": F.when(overlaps, end), "is_constrained": overlaps & ((F.col("earliest") > F.col("start_ts")) | (F.col("latest") < F.col("end_ts")))})


def stale(available: DataFrame, base: str) -> DataFrame:
    """Target timeframes against the base one: missing, or behind by a period or more."""
    first = available.where(F.col("timeframe") == base).select("symbol", F.col("latest").alias("base_latest"))
    targets = available.where(F.col("timeframe") != base)
    lag = (F.unix_timestamp("base_latest") - F.unix_timestamp("latest")) / 60
    return targets.join(first, "symbol").withColumn("lag_minutes", lag).withColumn("needs_resampling", F.col("lag_minutes") >= minutes(F.col("timeframe")))


def warm_up(analysis: DataFrame, available: DataFrame, timeframe: str, candles: int) -> DataFrame:
    """The window before the newest common feature time that must be read again; null unless every partial feature has
    rows and enough candles lie before it; never before the earliest candle."""
    partial = buckets(analysis).where("is_partial").groupBy("symbol").agg(F.min("last_present").alias("upto"), F.bool_and(F.col("n_present") > 0).alias("all_have_rows"))
    joined = partial.join(available.where(F.col("timeframe") == timeframe), "symbol")
    start = F.col("upto") - F.expr(f"interval {candles * MINUTES[timeframe]} minutes")
    ok = F.col("all_have_rows") & (F.col("record_count") >= candles)
    return joined.select("symbol", F.when(ok, F.greatest(start, F.col("earliest"))).alias("warm_up_start"), F.when(ok, F.col("upto")).alias("warm_up_end"))


def catch_up(features: DataFrame, reference: str, timeframe: str) -> DataFrame:
    """Features (symbol, feature, timestamp): caught up if the newest is less than a period behind the reference time."""
    out = features.groupBy("symbol", "feature").agg(F.max("timestamp").alias("last_ts"))
    behind = F.unix_timestamp(F.lit(reference).cast("timestamp")) - F.unix_timestamp("last_ts")
    return out.withColumn("caught_up", behind < 60 * MINUTES[timeframe])


def without_data(requested: DataFrame, analysis: DataFrame) -> DataFrame:
    """An analysis row for every requested (symbol, timeframe, feature); those without data have no rows and 0 per cent."""
    rows = requested.join(analysis, SERIES, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_expected", "n_present")}
    return rows.withColumns(zero | {"coverage_pct": F.coalesce("coverage_pct", F.lit(0.0)), "fully_covered": F.coalesce("fully_covered", F.lit(False))})


def needed_features(analysis: DataFrame) -> DataFrame:
    """The features that any timeframe of a symbol needs."""
    return buckets(analysis).where("needs_computation").select("symbol", "feature").distinct()


def to_compute(definitions: DataFrame, analysis: DataFrame, force: bool = False, skip_existing: bool = True) -> DataFrame:
    """definitions (position, feature): those to compute, in order; all if forced or if existing ones aren't skipped."""
    if force or not skip_existing:
        return definitions.orderBy("position")
    needs = buckets(analysis).groupBy("feature").agg(F.bool_or("needs_computation").alias("needs"))
    return definitions.join(needs, "feature", "left").where(F.coalesce("needs", F.lit(True))).drop("needs").orderBy("position")


def inactive(state: DataFrame, active: DataFrame) -> DataFrame:
    """The symbols that hold state but are not active, each once."""
    return state.select("symbol").distinct().join(active.select("symbol"), "symbol", "left_anti")
