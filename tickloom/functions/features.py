"""The features: for each one its typed parameters, its plan over a table, and its step for one candle of a stream.

A step gives what the plan gives for the same candles in order of time. Smoothed features reach back 40 times the length
over which they fade to 1/e; what lies before is below double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import indicators
from tickloom.functions.registry import feature

OBSERVED, REWARD = "observation_space", "reward_engineering"


@dataclass(frozen=True)
class Nothing:
    """No parameters."""


@dataclass(frozen=True)
class Length:
    length: int = 14

    def __post_init__(self) -> None:
        if self.length < 1:
            raise ValueError("length is at least 1")


@dataclass(frozen=True)
class Bands:
    length: int = 20
    width: float = 2.0

    def __post_init__(self) -> None:
        if self.length < 1 or self.width < 0:
            raise ValueError("length is at least 1, width at least 0")


@dataclass(frozen=True)
class Averages:
    fast: int = 12
    slow: int = 26
    signal: int = 9

    def __post_init__(self) -> None:
        if not (0 < self.fast < self.slow and self.signal > 0):
            raise ValueError("lengths are at least 1, and fast is below slow")


def _averaged(k: int, length: int, held: float, value: float) -> float:
    """Wilder's average after value number k, from 0: up to the first `length` it grows to their mean."""
    return held + value / length if k < length else (held * (length - 1) + value) / length


def _rsi_step(p: Length, state: tuple, candle: Any) -> tuple[tuple, tuple]:
    n, last, up, down = state
    if n:
        change = candle.close_price - last
        up, down = _averaged(n - 1, p.length, up, max(change, 0.0)), _averaged(n - 1, p.length, down, max(-change, 0.0))
    value = 100.0 if down <= 1e-12 * max(up, 1e-300) else 100 - 100 / (1 + up / down)
    return (n + 1, candle.close_price, up, down), (value if n >= p.length else None,)


@feature(
    "rsi", parameters=Length, columns=lambda p: [f"rsi_{p.length}"], role=OBSERVED, reach=lambda p: 41 * p.length + 1,
    state="n long, last double, up double, down double", start=(0, 0.0, 0.0, 0.0), step=_rsi_step,
)
def _rsi(df: DataFrame, p: Length) -> DataFrame:
    return indicators.rsi(df, p.length, f"rsi_{p.length}")


@feature("close", parameters=Nothing, columns=lambda p: ["close_value"], role=REWARD, reach=lambda p: 0, step=lambda p, state, candle: ((), (candle.close_price,)))
def _close(df: DataFrame, p: Nothing) -> DataFrame:
    return df.withColumn("close_value", F.col("close_price"))


def _macd_step(p: Averages, state: tuple, candle: Any) -> tuple[tuple, tuple]:
    n, fast, slow, signal = state
    follow = lambda held, value, length: value if n == 0 else held + (value - held) * 2 / (length + 1)
    fast, slow = follow(fast, candle.close_price, p.fast), follow(slow, candle.close_price, p.slow)
    signal = follow(signal, fast - slow, p.signal)
    return (n + 1, fast, slow, signal), (fast - slow, signal, fast - slow - signal)


@feature(
    "macd", parameters=Averages, columns=lambda p: ["macd", "macd_signal", "macd_histogram"], role=OBSERVED, reach=lambda p: 20 * (p.slow + p.signal + 2),
    state="n long, fast double, slow double, signal double", start=(0, 0.0, 0.0, 0.0), step=_macd_step,
)
def _macd(df: DataFrame, p: Averages) -> DataFrame:
    return indicators.macd(df, p.fast, p.slow, p.signal)


def _bands_step(p: Bands, state: tuple, candle: Any) -> tuple[tuple, tuple]:
    held = [*state[0], candle.close_price][-p.length :]
    if len(held) < p.length:
        return (held,), (None, None, None)
    middle, far = float(np.mean(held)), p.width * float(np.std(held))
    return (held,), (middle, middle + far, middle - far)


@feature(
    "bollinger", parameters=Bands, columns=lambda p: ["bb_middle", "bb_upper", "bb_lower"], role=OBSERVED, reach=lambda p: p.length - 1,
    state="held array<double>", start=([],), step=_bands_step,
)
def _bollinger(df: DataFrame, p: Bands) -> DataFrame:
    return indicators.bollinger(df, p.length, p.width)


def _atr_step(p: Length, state: tuple, candle: Any) -> tuple[tuple, tuple]:
    n, last, mean = state
    last = last if n else candle.low_price
    reach = max(candle.high_price - candle.low_price, abs(candle.high_price - last), abs(candle.low_price - last))
    mean = _averaged(n, p.length, mean, reach)
    return (n + 1, candle.close_price, mean), (mean if n >= p.length - 1 else None,)


@feature(
    "atr", parameters=Length, columns=lambda p: [f"atr_{p.length}"], role=OBSERVED, reach=lambda p: 41 * p.length + 1,
    state="n long, last double, mean double", start=(0, 0.0, 0.0), step=_atr_step,
)
def _atr(df: DataFrame, p: Length) -> DataFrame:
    return indicators.atr(df, p.length, f"atr_{p.length}")
