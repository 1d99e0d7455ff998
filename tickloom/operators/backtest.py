"""Backtest checks over trades and equity curves of many strategies in one job.

trades: strategy_id, symbol, entry_ts, exit_ts, entry_price, size, direction, profit, stop_loss (exit_ts null: open).
equity: strategy_id, ts, equity, one row for each strategy and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import numbered, running_max, running_sum
from tickloom.operators.pieces import running, windowed

ID = ["strategy_id"]


def trade_columns(trades: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp("exit_ts") - F.unix_timestamp("entry_ts")
    return trades.withColumns({"is_open": F.col("exit_ts").isNull(), "is_winning": F.col("profit") > 0, "duration_s": seconds, "trade_return": trade_return(), "risk_reward": risk_reward()})


def trade_return() -> Column:
    value = F.col("size") * F.col("entry_price")
    return F.when(value > 0, F.col("profit") / value).otherwise(F.col("profit"))


def risk_reward() -> Column:
    """The price's move over the distance of the stop, null for open trades and those without such a distance. The move
    counts upwards, for short trades too."""
    risk, move = F.abs(F.col("entry_price") - F.col("stop_loss")), F.col("profit") * F.col("direction") / F.col("size")
    return F.when(F.col("exit_ts").isNotNull() & (risk > 0) & (F.col("size") != 0), move / risk)


def closed(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("exit_ts").isNotNull())


def daily_loss(trades: DataFrame, account: float, limit_pct: float = 5.0, tz: str = "UTC") -> DataFrame:
    """Profit by exit date in the account's time zone, the balance after it, the day's loss in per cent of the account's
    size, and whether it broke the limit."""
    day = F.to_date(F.from_utc_timestamp("exit_ts", tz)).alias("day")
    days = closed(trades).groupBy(*ID, day).agg(F.sum("profit").alias("day_profit"), F.count(F.lit(1)).alias("n_trades"))
    sums = F.sum("day_profit").over(Window.partitionBy(*ID).orderBy("day"))
    days = days.withColumn("balance", F.lit(account) + sums)
    loss = F.when(F.col("day_profit") < 0, -F.col("day_profit")).otherwise(0.0)
    return days.withColumn("loss_pct", 100 * loss / account).withColumn("violates", loss > account * limit_pct / 100)


def first_violations(days: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy(*ID).orderBy("day")
    return days.where("violates").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def drawdowns(equity: DataFrame) -> DataFrame:
    """equity with its running maximum, the drawdown in per cent (not above 0) and whether the row is a new high."""
    top = running_max(equity, ID, "ts", "equity", "peak", "_earlier")
    new_high = F.coalesce(F.col("equity") > F.col("_earlier"), F.lit(True))
    return top.withColumns({"drawdown_pct": 100 * (F.col("equity") - F.col("peak")) / F.col("peak"), "new_high": new_high}).drop("_earlier")


def max_drawdown(equity: DataFrame) -> DataFrame:
    """The deepest drawdown in per cent: its size, trough, the last high before it and the first recovery after it; and
    the greatest fall below a high in money, which may be another one."""
    rows = drawdowns(equity)
    deepest = rows.groupBy(*ID).agg(F.min(F.struct("drawdown_pct", "ts", "equity", "peak")).alias("low"))
    joined = rows.join(deepest, ID)
    return joined.groupBy(*ID).agg(
        F.first("low.drawdown_pct").alias("max_drawdown_pct"),
        F.max(F.col("peak") - F.col("equity")).alias("amount"),
        F.max(F.when(F.col("new_high") & (F.col("ts") <= F.col("low.ts")), F.col("ts"))).alias("peak_ts"),
        F.first("low.ts").alias("trough_ts"),
        F.min(F.when((F.col("ts") > F.col("low.ts")) & (F.col("equity") >= F.col("low.peak")), F.col("ts"))).alias("recovered_ts"),
    )


def profit_target(equity: DataFrame, account: float, target_pct: float = 10.0) -> DataFrame:
    gain = 100 * (F.col("equity") - account) / account
    rows = equity.withColumn("gain_pct", gain)
    reached = rows.groupBy(*ID).agg(F.max("gain_pct").alias("max_pct"), F.min(F.when(F.col("gain_pct") >= target_pct, F.col("ts"))).alias("reached_ts"), F.max_by("gain_pct", "ts").alias("final_pct"))
    after = rows.join(reached.select(*ID, "reached_ts"), ID).where(F.col("ts") >= F.col("reached_ts")).groupBy(*ID).agg(F.min("gain_pct").alias("low_after_pct"))
    return reached.join(after, ID, "left").withColumn("maintained", F.coalesce(F.col("low_after_pct") >= target_pct, F.lit(False)))


def trading_days(trades: DataFrame, tz: str = "UTC") -> DataFrame:
    days = trades.select(*ID, F.explode(F.array("entry_ts", "exit_ts")).alias("ts")).where(F.col("ts").isNotNull()).select(*ID, F.to_date(F.from_utc_timestamp("ts", tz)).alias("day"))
    out = days.groupBy(*ID).agg(F.countDistinct("day").alias("trading_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"))
    return out.withColumn("frequency", F.col("trading_days") / F.col("span_days"))


def net_positions(trades: DataFrame) -> DataFrame:
    """Net size of each strategy and symbol at the end of every time at which a trade opens or closes."""
    signed = F.col("size") * F.col("direction")
    changes = trades.select(*ID, "symbol", F.explode(F.array(F.struct(F.col("entry_ts").alias("ts"), signed.alias("change")), F.struct(F.col("exit_ts").alias("ts"), (-signed).alias("change")))).alias("x")).select(*ID, "symbol", "x.*").where(F.col("ts").isNotNull())
    sums = changes.groupBy(*ID, "symbol", "ts").agg(F.sum("change").alias("change"))
    return running_sum(sums, [*ID, "symbol"], "ts", "change", "position")


def position_size(trades: DataFrame, limit: float) -> DataFrame:
    single = trades.groupBy(*ID).agg(F.max("size").alias("max_single"), F.count_if(F.col("size") > limit).alias("n_over"))
    joint = net_positions(trades).groupBy(*ID).agg(F.max(F.abs("position")).alias("max_net"))
    return single.join(joint, ID, "left").withColumn("within", (F.col("max_single") <= limit) & (F.col("max_net") <= limit))


def stop_loss(trades: DataFrame, least_pct: float = 100.0) -> DataFrame:
    out = trades.groupBy(*ID).agg(F.count(F.lit(1)).alias("n_trades"), F.count("stop_loss").alias("n_with_stop"))
    return out.withColumn("compliance_pct", F.when(F.col("n_trades") > 0, 100.0 * F.col("n_with_stop") / F.col("n_trades")).otherwise(100.0)).withColumn("passed", F.col("compliance_pct") >= least_pct)


def profit_factor(trades: DataFrame) -> DataFrame:
    wins, losses = F.sum(F.when(F.col("profit") > 0, F.col("profit")).otherwise(0.0)), F.sum(F.when(F.col("profit") < 0, -F.col("profit")).otherwise(0.0))
    out = closed(trades).groupBy(*ID).agg(wins.alias("gross_profit"), losses.alias("gross_loss"))
    factor = F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(F.col("gross_profit") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("profit_factor", factor)


def win_rate(trades: DataFrame, min_trades: int = 1) -> DataFrame:
    out = closed(trades).groupBy(*ID).agg(F.count(F.lit(1)).alias("n_closed"), F.count_if(F.col("profit") > 0).alias("n_wins"), F.sum("profit").alias("net_profit"))
    return out.withColumn("win_rate", F.col("n_wins") / F.col("n_closed")).withColumn("enough", F.col("n_closed") >= min_trades)


#: What orders trades that close at the same time.
TIES = ("entry_ts", "profit", "size")


def _with_runs(trades: DataFrame, **sums: Column) -> DataFrame:
    """Closed trades with the number of those that don't lose up to each, which is equal in a run of losses, and with
    other running sums: by (strategy, day), carried over days by one row for each."""
    return running(closed(trades), ID, "exit_ts", {"_run": F.when(F.col("profit") < 0, 0).otherwise(1), **sums}, *TIES)


def losing_streaks(trades: DataFrame) -> DataFrame:
    """Runs of losing closed trades by exit time: length and summed loss. Ties in time are ordered by entry and profit.

    A run is the trades between two that don't lose, so its number is a running count of the latter; runs over several
    days are put together by their number.
    """
    losing = _with_runs(trades).where("profit < 0")
    return losing.groupBy(*ID, "_run").agg(F.count(F.lit(1)).alias("losses"), F.sum("profit").alias("lost"), F.min("exit_ts").alias("from_ts"), F.max("exit_ts").alias("to_ts"))


def longest_streaks(trades: DataFrame, account: float) -> DataFrame:
    """The length of the longest run of losing trades (the first of several), and the greatest fall in it of the balance
    after its first trade, in per cent, with that balance and the least one of the run; 0 and 0 where no trade loses.
    Nothing closed: no row."""
    rows = _with_runs(trades, _gain=F.col("profit")).withColumn("_balance", F.lit(account) + F.col("_gain"))
    losing = rows.where("profit < 0").groupBy(*ID, "_run").agg(F.count(F.lit(1)).alias("losses"), F.max("_balance").alias("_first"), F.min("_balance").alias("_last"))
    depth = F.when(F.col("_first") > 0, 100 * (F.col("_first") - F.col("_last")) / F.col("_first")).alias("depth")
    longest = losing.groupBy(*ID).agg(F.max_by(F.struct("losses", depth, "_first", "_last"), F.struct("losses", -F.col("_run"))).alias("_top"))
    out = closed(trades).select(*ID).distinct().join(longest, ID, "left")
    return out.select(*ID, F.coalesce("_top.losses", F.lit(0)).alias("max_losses"), F.coalesce("_top.depth", F.lit(0.0)).alias("streak_drawdown_pct"), F.col("_top._first").alias("start_balance"), F.col("_top._last").alias("least_balance"))


def max_consecutive_losses(trades: DataFrame) -> DataFrame:
    longest = losing_streaks(trades).groupBy(*ID).agg(F.max("losses").alias("max_losses"))
    return closed(trades).select(*ID).distinct().join(longest, ID, "left").select(*ID, F.coalesce("max_losses", F.lit(0)).alias("max_losses"))


def returns(equity: DataFrame) -> DataFrame:
    """Percent change from row to row; the first row of a curve goes."""
    changed = windowed(equity, ID, "ts", 1, lambda w: {"r": F.col("equity") / F.lag("equity").over(w) - 1})
    return changed.where(F.col("r").isNotNull())


def sharpe(equity: DataFrame, periods: int = 252) -> DataFrame:
    out = returns(equity).groupBy(*ID).agg(F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("sharpe", F.when(F.col("sd_r") > 0, F.col("mean_r") / F.col("sd_r") * F.sqrt(F.lit(float(periods)))).otherwise(0.0))


def calmar(equity: DataFrame, periods: int = 252, years: int = 3) -> DataFrame:
    """Annualised compound return over the greatest drawdown of the compounded last `years` years of returns."""
    rows = numbered(returns(equity), ID, "ts", "_i")
    sizes = rows.groupBy(*ID).agg(F.count(F.lit(1)).alias("_n"))
    tail = rows.join(sizes, ID).where(F.col("_i") >= F.col("_n") - periods * years)
    grown = running(tail, ID, "ts", {"_log": F.log1p("r")}).withColumn("_w", F.exp("_log"))
    path = running_max(grown, ID, "ts", "_w", "_top")
    out = path.groupBy(*ID).agg(F.exp(F.sum(F.log1p("r"))).alias("growth"), F.count(F.lit(1)).alias("n"), F.max(1 - F.col("_w") / F.col("_top")).alias("max_dd"))
    yearly = F.pow("growth", F.lit(float(periods)) / F.col("n")) - 1
    return out.withColumn("annual_return", yearly).withColumn("calmar", F.when(F.col("max_dd") > 0, F.col("annual_return") / F.col("max_dd")).otherwise(0.0))


def suite(checks: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """name to (result, passed, score): one row for each strategy and check, and `all_passed` for the strategy."""
    out = None
    for name, (frame, passed, score) in checks.items():
        rows = frame.select(*ID, F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), score.cast("double").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    verdict = out.groupBy(*ID).agg(F.bool_and("passed").alias("all_passed"))
    return out.join(verdict, ID)
