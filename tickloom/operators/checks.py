"""The registered backtest checks, and the validation run over them.

A check is a function of (trades, equity, parameters) that gives strategy_id, passed, score, threshold and explanation,
one row for each strategy. `validated` runs any number of them, for all strategies, as one plan.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.registry import CHECKS, check
from tickloom.operators import backtest as bt

ID = bt.ID


def _result(frame: DataFrame, passed: Column, score: Column, threshold: float, explanation: Column) -> DataFrame:
    return frame.select(*ID, F.coalesce(passed, F.lit(False)).alias("passed"), score.cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"), explanation.alias("explanation"))


def _bounded(frame: DataFrame, name: str, score: str, threshold: float, at_least: bool) -> DataFrame:
    """A check of one number against one bound, with its text."""
    passed = F.col(score) >= threshold if at_least else F.col(score) <= threshold
    bound = f"{name} is %.2f, the {'least' if at_least else 'most'} allowed is {threshold:.2f}: %s"
    return _result(frame, passed, F.col(score), threshold, F.format_string(bound, F.col(score).cast("double"), F.when(passed, "met").otherwise("not met")))


@check("daily_loss")
def daily_loss(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The worst day's loss, in per cent of the account's size; the text names the first three days that break the limit."""
    limit = p.get("limit_pct", 5.0)
    days = bt.daily_loss(trades, p.get("account", 100_000.0), limit, p.get("tz", "UTC"))
    worst = days.groupBy(*ID).agg(F.max("loss_pct").alias("worst"), F.count_if("violates").alias("n"))
    named = F.format_string("%s: %.2f%%", F.date_format("day", "yyyy-MM-dd"), F.col("loss_pct"))
    first = bt.first_violations(days).groupBy(*ID).agg(F.array_sort(F.collect_list(named)).alias("named"))
    text = F.when(F.col("n") == 0, F.format_string(f"no day lost more than {limit:.2f}%%; the worst lost %.2f%%", F.col("worst")))
    text = text.otherwise(F.concat(F.format_string(f"%d days lost more than {limit:.2f}%%, first ", F.col("n")), F.array_join("named", ", ")))
    return _result(worst.join(first, ID, "left"), F.col("n") == 0, F.col("worst"), limit, text)


@check("max_drawdown")
def max_drawdown(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    depth = bt.max_drawdown(equity).withColumn("depth", -F.col("max_drawdown_pct"))
    return _bounded(depth, "greatest drawdown in per cent", "depth", p.get("limit_pct", 10.0), False)


@check("profit_target")
def profit_target(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    target = p.get("target_pct", 10.0)
    return _bounded(bt.profit_target(equity, p.get("account", 100_000.0), target), "best gain in per cent", "max_pct", target, True)


@check("trading_days")
def trading_days(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    least = p.get("least", 4)
    days = bt.trading_days(trades, p.get("tz", "UTC"))
    short = F.lit(least) - F.col("trading_days")
    text = F.when(short <= 0, F.format_string(f"%d trading days, {least} are needed", "trading_days")).otherwise(F.format_string(f"%d trading days, %d fewer than the {least} needed", F.col("trading_days"), short))
    period = F.format_string("; %s to %s, %d calendar days, %.1f%% of them traded", F.date_format("first_day", "yyyy-MM-dd"), F.date_format("last_day", "yyyy-MM-dd"), F.col("span_days"), 100 * F.col("frequency"))
    return _result(days, F.col("trading_days") >= least, F.col("trading_days"), least, F.concat(text, period))


@check("position_size")
def position_size(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    rows = bt.position_size(trades, p["limit"]).withColumn("largest", F.greatest("max_single", "max_net"))
    return _bounded(rows, "largest position", "largest", p["limit"], False)


@check("stop_loss")
def stop_loss(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    least = p.get("least_pct", 100.0)
    return _bounded(bt.stop_loss(trades, least), "share of trades with a stop in per cent", "compliance_pct", least, True)


@check("profit_factor")
def profit_factor(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    return _bounded(bt.profit_factor(trades), "profit factor", "profit_factor", p.get("least", 1.5), True)


@check("win_rate")
def win_rate(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Per cent of closed trades that win; fewer than `min_trades` closed trades don't pass."""
    rows = bt.win_rate(trades, p.get("min_trades", 1)).withColumn("rate_pct", 100 * F.col("win_rate"))
    out = _bounded(rows, "share of winning trades in per cent", "rate_pct", p.get("least_pct", 50.0), True)
    return out.join(rows.select(*ID, "enough"), ID).withColumn("passed", F.col("passed") & F.col("enough")).drop("enough")


@check("losing_streak")
def losing_streak(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The longest run of losing trades, and, with `drawdown_pct`, how deep it goes."""
    most, depth = p.get("most", 5), p.get("drawdown_pct")
    rows = bt.longest_streaks(trades, p.get("account", 100_000.0))
    passed = F.col("max_losses") <= most if depth is None else (F.col("max_losses") <= most) & (F.col("streak_drawdown_pct") <= depth)
    text = F.format_string(f"%d losing trades in a row, {most} are allowed; the run fell %.2f%%", F.col("max_losses"), F.col("streak_drawdown_pct"))
    return _result(rows, passed, F.col("max_losses"), most, text)


@check("sharpe")
def sharpe(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    return _bounded(bt.sharpe(equity, p.get("periods", 252)), "Sharpe ratio", "sharpe", p.get("least", 1.0), True)


@check("calmar")
def calmar(trades: DataFrame, equity: DataFrame, p: dict[str, Any]) -> DataFrame:
    return _bounded(bt.calmar(equity, p.get("periods", 252), p.get("years", 3)), "Calmar ratio", "calmar", p.get("least", 1.0), True)


def validated(trades: DataFrame, equity: DataFrame, wanted: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """One row for each strategy and check: passed, score, threshold, explanation, the check's parameters as JSON, and
    whether the strategy passed all. A strategy without rows for a check does not pass it."""
    if unknown := [name for name, _ in wanted if name not in CHECKS]:
        raise KeyError(f"no check named {', '.join(unknown)}")
    if not wanted:
        raise ValueError("a validation needs a check")
    out = None
    for name, p in wanted:
        rows = CHECKS[name](trades, equity, p).select(F.lit(name).alias("check"), F.lit(json.dumps(p, sort_keys=True)).alias("config"), *ID, "passed", "score", "threshold", "explanation")
        out = rows if out is None else out.unionByName(rows)
    passed = out.groupBy(*ID).agg((F.count_if("passed") == len(wanted)).alias("all_passed"))
    return out.join(passed, ID)
