"""Timeframes: lengths, period starts, expected grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes of each timeframe; a month counts 30 days, a tick none.
MINUTES = {"tick": 0, "1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080, "1M": 43200}
# Provider names of timeframes.
PROVIDER_TIMEFRAMES = {"1m": "1min", "5m": "5min", "15m": "15min", "30m": "30min", "1h": "1h", "4h": "4h", "1d": "1day", "1w": "1week"}


def minutes(timeframe: Column) -> Column:
    pairs = [F.lit(x) for k, v in MINUTES.items() for x in (k, v)]
    return F.create_map(*pairs)[timeframe]


def seconds(timeframe: Column) -> Column:
    return minutes(timeframe) * 60


def interval(timeframe: Column) -> Column:
    """The step of a timeframe as an interval string; null for ticks."""
    m = minutes(timeframe)
    return F.when(m > 0, F.concat(m.cast("string"), F.lit(" minutes")))


def period_start(ts: Column, timeframe: str) -> Column:
    """The start of the period that holds `ts`, in UTC; weeks start on Monday; other timeframes leave it unchanged."""
    if timeframe in ("1d", "1w", "1M"):
        return F.date_trunc({"1d": "day", "1w": "week", "1M": "month"}[timeframe], ts)
    step = MINUTES.get(timeframe, 0) * 60
    if not step:
        return ts
    return F.timestamp_seconds(F.unix_timestamp(ts) - F.pmod(F.unix_timestamp(ts), F.lit(step)))


def period_start_by(ts: Column, timeframe: Column) -> Column:
    """`period_start` for a timeframe column."""
    out = ts
    for name in MINUTES:
        out = F.when(timeframe == name, period_start(ts, name)).otherwise(out)
    return out


def provider_timeframe(timeframe: Column) -> Column:
    """The provider's name of a timeframe; one without such a name keeps its own."""
    pairs = [F.lit(x) for k, v in PROVIDER_TIMEFRAMES.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[timeframe], timeframe)


def grid(start: Column, end: Column, timeframe: str) -> Column:
    """Expected period starts between two times, both included."""
    if timeframe == "1M":
        return F.sequence(period_start(start, "1M"), end, F.expr("interval 1 month"))
    return F.sequence(period_start(start, timeframe), end, F.expr(f"interval {MINUTES[timeframe]} minutes"))
