"""Data sets for training: higher timeframes without look-ahead, ordered splits, column filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import asof, numbered
from tickloom.operators.pieces import windowed

# Columns of a candle, under both namings.
NOT_CARRIED = {"Open", "High", "Low", "Close", "Close_Time", "Volume", "open_price", "high_price", "low_price", "close_price", "volume", "source_rows", "timeframe"}


def detected_step(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent step between consecutive times in seconds, the least of equally frequent ones."""
    step = lambda w: {"step_seconds": F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(w))}
    counts = windowed(frame.select(*keys, "timestamp"), keys, "timestamp", 1, step).where(F.col("step_seconds").isNotNull()).groupBy(*keys, "step_seconds").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("step_seconds", F.struct((-F.col("n")).alias("n"), "step_seconds")).alias("step_seconds"))


def merge_higher(base: DataFrame, higher: DataFrame, minutes: int, keys: list[str]) -> DataFrame:
    """Base rows with the indicators of the last higher candle that had closed: open time + length <= base time."""
    carried = [c for c in higher.columns if c not in NOT_CARRIED and c not in (*keys, "timestamp")]
    closed = higher.select(*keys, (F.col("timestamp") + F.expr(f"interval {minutes} minutes")).alias("_closed"), *[F.col(c).alias(f"HTF-{minutes}_{c}") for c in carried])
    return asof(base, closed, keys, "timestamp", "_closed").drop("_closed")


def split(frame: DataFrame, keys: list[str], train: float = 0.8, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Chronological split by ratio, half to even; adds `split`."""
    ratios = (train, validation, test)
    if any(not 0 <= r <= 1 for r in ratios) or abs(sum(ratios) - 1) > 1e-10:
        raise ValueError("ratios must lie in [0, 1] and sum to 1")
    sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(frame, keys, "timestamp", "_i").join(sizes, keys)
    first, second = F.bround(F.lit(train) * F.col("_n")), F.bround(F.lit(validation) * F.col("_n"))
    return ranked.withColumn("split", F.when(F.col("_i") < first, "train").when(F.col("_i") < first + second, "validation").otherwise("test")).drop("_n", "_i")


def variances(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, variance): population variances in one pass."""
    row = frame.agg(*[F.var_pop(c).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "variance")


def low_variance(frame: DataFrame, columns: list[str], least: float = 0.01) -> list[str]:
    row = frame.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is None or row[c] <= least]


def correlations(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row with the correlation of each pair of columns, named a_b: all pairs in one pass over the rows."""
    return frame.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])


def correlated(frame: DataFrame, columns: list[str], most: float = 0.9) -> list[str]:
    """Columns whose correlation with an earlier one exceeds `most` in size: all pairs in one pass over the rows."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    if not pairs:
        return []
    row = correlations(frame, pairs).first()
    return [b for b in columns if any(abs(row[f"{a}_{b}"] or 0) > most for a, x in pairs if x == b)]
