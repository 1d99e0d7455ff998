"""Technical indicators over candles (symbol, timestamp, ...), as Spark plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.ordered import numbered, smoothed
from tickloom.operators.pieces import windowed

KEYS = ["symbol"]


@dataclass(frozen=True)
class Trailing:
    """A column over the current row and at most `before` rows in front of it."""

    before: int
    column: Callable[[WindowSpec], Column]


def trailing_columns(candles: DataFrame, index: str | None = None, **columns: Trailing) -> DataFrame:
    """candles with all `columns`, by symbol and time, from one pass over chunks that overlap."""
    reach = max(c.before for c in columns.values())
    return windowed(candles, KEYS, "timestamp", reach, lambda w: {name: c.column(w) for name, c in columns.items()}, index)


def last_rows(n: int, column: Callable[[WindowSpec], Column]) -> Trailing:
    """`column` over the last n rows once there are n; null before."""

    def full(w: WindowSpec) -> Column:
        own = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(F.lit(1)).over(own) >= n, column(own))

    return Trailing(n - 1, full)


def wilder(df: DataFrame, values: dict[str, str], length: int, first: int = 1) -> DataFrame:
    """Wilder's averages, out: value: the mean of the first `length` rows, from row `first` on, then smoothing by 1/length.

    df has row_no from 0; rows before the seed, and series too short for one, get null.
    """
    seed_at = first + length - 1
    head = df.where((F.col("row_no") >= first) & (F.col("row_no") <= seed_at))
    seeds = head.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(f"_seed_{o}") for o, v in values.items()]).where(F.col("_n") == length).drop("_n")
    rows = df.join(seeds, KEYS, "left").withColumn("_i", F.col("row_no") - seed_at)
    rows = rows.withColumns({f"_x_{o}": F.when(F.col("_i") == 0, F.col(f"_seed_{o}")).otherwise(F.coalesce(v, F.lit(0.0))) for o, v in values.items()})
    out = smoothed(rows, KEYS, "_i", {o: f"_x_{o}" for o in values}, (length - 1) / length)
    return out.drop("_i", *[f"_x_{o}" for o in values], *[f"_seed_{o}" for o in values])


def rsi(candles: DataFrame, length: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength index; null for the first `length` candles; 100 where there are no losses."""
    step = Trailing(1, lambda w: F.col("close_price") - F.lag("close_price").over(w))
    df = trailing_columns(numbered(candles, KEYS, "timestamp"), "row_no", _step=step)
    df = df.withColumn("_gain", F.greatest("_step", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_step"), F.lit(0.0)))
    df = wilder(df, {"_up": "_gain", "_down": "_loss"}, length)
    value = F.when(F.col("_down") <= 1e-12 * F.greatest(F.col("_up"), F.lit(1e-300)), F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))
    return df.withColumn(out, F.when(F.col("_up").isNotNull(), value)).drop("_step", "_gain", "_loss", "_up", "_down", "row_no")


def ema(df: DataFrame, value: str, length: int, out: str) -> DataFrame:
    """Exponential average with factor 2 / (length + 1), from the first value on; df has row_no."""
    return smoothed(df, KEYS, "row_no", {out: value}, 1 - 2 / (length + 1))


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = numbered(candles, KEYS, "timestamp")
    df = ema(ema(df, "close_price", fast, "_fast"), "close_price", slow, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    return ema(df, "macd", signal, "macd_signal").withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow", "row_no")


def bollinger(candles: DataFrame, length: int = 20, width: float = 2.0) -> DataFrame:
    bands = {"bb_middle": 0.0, "bb_upper": width, "bb_lower": -width}
    band = lambda far: last_rows(length, lambda w: F.avg("close_price").over(w) + far * F.stddev_pop("close_price").over(w))
    return trailing_columns(candles, **{name: band(far) for name, far in bands.items()})


def atr(candles: DataFrame, length: int = 14, out: str = "atr") -> DataFrame:
    """Average true range with Wilder smoothing; the first candle's range is its high less its low."""

    def reach(w: WindowSpec) -> Column:
        before = F.lag("close_price").over(w)
        return F.greatest(F.col("high_price") - F.col("low_price"), F.abs(F.col("high_price") - before), F.abs(F.col("low_price") - before))

    df = trailing_columns(numbered(candles, KEYS, "timestamp"), "row_no", _tr=Trailing(1, reach))
    return wilder(df, {out: "_tr"}, length, first=0).drop("_tr", "row_no")


def with_atr(candles: DataFrame, length: int = 14, column: str = "atr") -> DataFrame:
    """candles with average true ranges in `column`: as they are, unless the column is absent or null in every row."""
    if column in candles.columns and candles.where(F.col(column).isNotNull()).limit(1).count():
        return candles
    return atr(candles.drop(column), length, column)


def normalised_distance(candles: DataFrame, indicator: str, length: int = 14, out: str = "distance") -> DataFrame:
    """(indicator - close) in units of the average true range; null where that is 0 or not known yet."""
    ranged = atr(candles, length, "_atr")
    return ranged.withColumn(out, F.when(F.col("_atr") > 0, (F.col(indicator) - F.col("close_price")) / F.col("_atr"))).drop("_atr")


def log_change(column: str, n: int) -> Trailing:
    return Trailing(n, lambda w: F.log(F.col(column) / F.lag(column, n).over(w)))


def is_rolling_high(column: str, n: int) -> Trailing:
    return _or_false(last_rows(n, lambda w: F.max(column).over(w) == F.col(column)))


def above_mean(column: str, n: int) -> Trailing:
    return _or_false(last_rows(n, lambda w: F.col(column) > F.avg(column).over(w)))


def _or_false(flag: Trailing) -> Trailing:
    return Trailing(flag.before, lambda w: F.coalesce(flag.column(w), F.lit(False)))


def relative_volume(n: int) -> Trailing:
    return last_rows(n, lambda w: F.col("volume") / F.avg("volume").over(w))


def place_of_maximum(column: str, n: int) -> Trailing:
    """The place of the window's maximum from its start, as a share of its length."""

    def place(w: WindowSpec) -> Column:
        held = F.collect_list(column).over(w)
        return (F.array_position(held, F.array_max(held)) - 1) / F.lit(float(n))

    return last_rows(n, place)


def rolling_percentile(column: str, n: int) -> Trailing:
    """The share of the window's values below the current one."""
    return last_rows(n, lambda w: F.size(F.filter(F.collect_list(column).over(w), lambda x: x < F.col(column))) / F.lit(float(n)))
