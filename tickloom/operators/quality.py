"""Candle checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open_price", "high_price", "low_price", "close_price")


def consistent() -> Column:
    """Open and close within low and high, volume not negative."""
    inside = [(F.col(p) >= F.col("low_price")) & (F.col(p) <= F.col("high_price")) for p in ("open_price", "close_price")]
    ok = (F.col("high_price") >= F.col("low_price")) & inside[0] & inside[1] & (F.col("volume") >= 0)
    return F.coalesce(ok, F.lit(False))


def valid() -> Column:
    """Consistent, and every price above zero; nulls fail."""
    above = (F.col("open_price") > 0) & (F.col("high_price") > 0) & (F.col("low_price") > 0) & (F.col("close_price") > 0)
    return consistent() & F.coalesce(above, F.lit(False))


def clean(candles: DataFrame) -> DataFrame:
    return candles.where(valid())


def rejected(candles: DataFrame) -> DataFrame:
    """The rows that `clean` leaves out, with the rules that they break."""
    rules = {
        "missing": F.greatest(*[F.col(p).isNull() for p in (*PRICES, "volume")]),
        "not_positive": F.least(*[F.col(p) for p in PRICES]) <= 0,
        "high_below_low": F.col("high_price") < F.col("low_price"),
        "open_outside": (F.col("open_price") < F.col("low_price")) | (F.col("open_price") > F.col("high_price")),
        "close_outside": (F.col("close_price") < F.col("low_price")) | (F.col("close_price") > F.col("high_price")),
        "negative_volume": F.col("volume") < 0,
    }
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return candles.where(~valid()).withColumn("errors", errors)


def required(candles: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the named columns."""
    return candles.dropna(subset=list(columns))
