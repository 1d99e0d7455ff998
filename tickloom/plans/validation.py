"""Registered queries of the validation suite, stored features, and request logs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.operators import checks
from tickloom.operators import coverage as cov
from tickloom.plans import pipelines as pl
from tickloom.plans.more import analysis
from tickloom.plans.queries import candles, curve, equity, query, r, trades
from tickloom.session import shared_folder, table
from tickloom.sources import feature_store as fs
from tickloom.streaming import candles as st

SUITE = [
    ("daily_loss", {"account": 100_000.0, "limit_pct": 5.0}),
    ("trading_days", {"least": 10}),
    ("stop_loss", {"least_pct": 90.0}),
    ("profit_factor", {"least": 1.0}),
    ("win_rate", {"least_pct": 45.0, "min_trades": 20}),
    ("losing_streak", {"account": 10_000_000.0, "most": 12, "drawdown_pct": 5.0}),
    ("sharpe", {"least": 1.0}),
    ("max_drawdown", {"limit_pct": 30.0}),
]

SUITE_SQL = """x AS (SELECT strategy_id, exit_ts::DATE AS day, sum(profit) AS p FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1, 2),
 dl AS (SELECT strategy_id, count(*) FILTER (p < -5000) = 0 AS passed, max(greatest(-p, 0)) / 1000 AS score FROM x GROUP BY 1),
 dy AS (SELECT strategy_id, count(DISTINCT day) AS n FROM (SELECT strategy_id, entry_ts::DATE AS day FROM tr UNION ALL SELECT strategy_id, exit_ts::DATE FROM tr WHERE exit_ts IS NOT NULL) GROUP BY 1),
 sl AS (SELECT strategy_id, 100.0 * count(stop_loss) / count(*) AS s FROM tr GROUP BY 1),
 pf AS (SELECT strategy_id, sum(greatest(profit, 0)) / sum(greatest(-profit, 0)) AS f, 100.0 * count(*) FILTER (profit > 0) / count(*) AS w, count(*) AS n FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1),
 ru AS (SELECT *, sum(CASE WHEN profit < 0 THEN 0 ELSE 1 END) OVER o AS run, 10000000 + sum(profit) OVER o AS b FROM tr WHERE exit_ts IS NOT NULL WINDOW o AS (PARTITION BY strategy_id ORDER BY exit_ts, entry_ts, profit, size ROWS UNBOUNDED PRECEDING)),
 ls AS (SELECT strategy_id, run, count(*) AS k, 100 * (max(b) - min(b)) / max(b) AS depth FROM ru WHERE profit < 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY k DESC, run) = 1),
 sh AS (SELECT strategy_id, avg(r) / stddev_samp(r) * sqrt(252.0) AS s FROM r GROUP BY 1),
 md AS (SELECT strategy_id, max(100 * (top - equity) / top) AS d FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts) AS top FROM e) GROUP BY 1),
 al AS (SELECT strategy_id, 'daily_loss' AS "check", passed, score::DOUBLE AS score, 5.0::DOUBLE AS threshold, '{"account": 100000.0, "limit_pct": 5.0}' AS config FROM dl
 UNION ALL SELECT strategy_id, 'trading_days', n >= 10, n, 10, '{"least": 10}' FROM dy UNION ALL SELECT strategy_id, 'stop_loss', s >= 90, s, 90, '{"least_pct": 90.0}' FROM sl
 UNION ALL SELECT strategy_id, 'profit_factor', f >= 1, f, 1, '{"least": 1.0}' FROM pf UNION ALL SELECT strategy_id, 'win_rate', w >= 45 AND n >= 20, w, 45, '{"least_pct": 45.0, "min_trades": 20}' FROM pf
 UNION ALL SELECT strategy_id, 'losing_streak', k <= 12 AND depth <= 5, k, 12, '{"account": 10000000.0, "drawdown_pct": 5.0, "most": 12}' FROM ls
 UNION ALL SELECT strategy_id, 'sharpe', s >= 1, s, 1, '{"least": 1.0}' FROM sh UNION ALL SELECT strategy_id, 'max_drawdown', d <= 30, d, 30, '{"limit_pct": 30.0}' FROM md)
 SELECT strategy_id, "check", passed, round(score, 6) AS score, threshold, config, bool_and(passed) OVER (PARTITION BY strategy_id) AS all_passed FROM al"""


@query(SUITE_SQL)
def a32_e5_validation(spark, sf_dir):
    # Every check reads the trades, so their join runs once and what the suite uses of it is kept.
    path = f"{shared_folder(spark)}/trades-{uuid.uuid4().hex}"
    trades(spark, sf_dir).select("strategy_id", "entry_ts", "exit_ts", "size", "profit", "stop_loss").write.parquet(path)
    rows = spark.read.parquet(path)
    found = checks.validated(rows, curve(rows), SUITE)
    return found.select("strategy_id", "check", "passed", r("score").alias("score"), "threshold", "config", "all_passed")


@query("""x AS (SELECT strategy_id, count(DISTINCT day) AS n, min(day) AS a, max(day) AS b FROM (SELECT strategy_id, entry_ts::DATE AS day FROM tr UNION ALL SELECT strategy_id, exit_ts::DATE FROM tr WHERE exit_ts IS NOT NULL) GROUP BY 1)
 SELECT strategy_id, n || ' trading days, ' || CASE WHEN n >= 2000 THEN '2000 are needed' ELSE (2000 - n) || ' fewer than the 2000 needed' END || '; ' || a || ' to ' || b || ', ' || (b - a + 1) || ' calendar days, ' || printf('%.1f', 100 * n / (b - a + 1)::DOUBLE) || '% of them traded' AS explanation FROM x""")
def x20_explanations(spark, sf_dir):
    return checks.trading_days(trades(spark, sf_dir), equity(spark, sf_dir), {"least": 2000}).select("strategy_id", "explanation")


@query("x AS (SELECT symbol, arg_max(close_price, timestamp) AS last FROM c GROUP BY 1) SELECT symbol FROM x WHERE last <= (SELECT avg(last) FROM x)")
def u3_inactive(spark, sf_dir):
    rows = candles(spark, sf_dir)
    last = rows.groupBy("symbol").agg(F.max_by("close_price", "timestamp").alias("last"))
    return cov.inactive(rows, last.join(last.agg(F.avg("last").alias("mean")), F.col("last") > F.col("mean")))


@query("SELECT 'view_' || min(event_id) AS view, event_type AS symbol, 'reward' AS feature_role FROM events WHERE event_id % 2 = 1 GROUP BY event_type QUALIFY row_number() OVER (ORDER BY event_type) = 1")
def f14_views(spark, sf_dir):
    role = F.when(F.col("event_id") % 2 == 0, "observation").otherwise("reward").alias("feature_role")
    views = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), role).agg(F.concat(F.lit("view_"), F.min("event_id").cast("string")).alias("view"))
    least = views.agg(F.min("symbol")).first()[0]
    return fs.views_of(views, "reward", least).select("view", "symbol", "feature_role")


@query("SELECT count(*) AS requests, sum(event_id % 7 + event_id % 5)::BIGINT AS features, round(avg(event_id % 11), 6) AS mean_ms, round(sum(event_id % 7 + event_id % 5) / count(*), 6) AS features_per_request FROM events")
def a19_request_totals(spark, sf_dir):
    made = F.create_map(F.lit("1h"), F.col("event_id") % 7 + 2, F.lit("4h"), F.col("event_id") % 5 + 2)
    found = pl.request_totals(table(spark, sf_dir, "events").select(made.alias("columns"), (F.col("event_id") % 11).alias("elapsed_ms")))
    return found.select("requests", "features", r("mean_ms").alias("mean_ms"), r("features_per_request").alias("features_per_request"))


@query("""x AS (SELECT '1h' AS timeframe, symbol, timestamp, close_price FROM c WHERE timestamp BETWEEN '2024-01-03' AND '2024-01-20' UNION ALL SELECT '4h', symbol, timestamp, close_price FROM q WHERE timestamp BETWEEN '2024-01-03' AND '2024-01-20'),
 y AS (SELECT symbol, max(timestamp) AS newest FROM x GROUP BY 1)
 SELECT timeframe, symbol, count(*) AS n_rows, round(sum(close_price), 4) AS total, any_value(newest) AS online_at FROM x JOIN y USING (symbol) GROUP BY 1, 2""")
def p5_store(spark, sf_dir):
    """Two backfills of overlapping windows, each into both stores; then both stores are read back."""
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    frames = {tf: candles(spark, sf_dir, tf).select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price") for tf in ("1h", "4h")}
    online = frames["1h"].limit(0)
    for window in (("2024-01-03", "2024-01-12"), ("2024-01-10", "2024-01-20")):
        _, online = pl.store(spark, frames, folder, "close_price", window, online)
    newest = online.select("symbol", F.col("event_timestamp").alias("online_at"))
    stored = [fs.read(spark, f"{folder}/timeframe={tf}").select(F.lit(tf).alias("timeframe"), "symbol", "close_price") for tf in frames]
    counted = stored[0].unionByName(stored[1]).groupBy("timeframe", "symbol").agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum("close_price"), 4).alias("total"))
    return counted.join(newest, "symbol").select("timeframe", "symbol", "n_rows", "total", "online_at")


@query("SELECT event_type AS symbol, max(ts) AS event_timestamp, arg_max(value, ts) AS close_price FROM events GROUP BY 1")
def r14_online_updates(spark, sf_dir):
    """Ticks arrive in four batches, each of which is pushed to the online table."""
    folder = f"{shared_folder(spark)}/online-{uuid.uuid4().hex}"
    # A stream reads a folder, in the order of its files; four files are four batches.
    table(spark, sf_dir, "events").repartitionByRange(4, "ts").write.parquet(f"{folder}/events")
    stream = st.tick_stream(spark, f"{folder}/events").select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    st.online_updates(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return st.online_table(spark, f"{folder}/table").select("symbol", "event_timestamp", "close_price")


@query("""x AS (SELECT *, sum(CASE WHEN profit < 0 THEN 0 ELSE 1 END) OVER o AS run, 10000000 + sum(profit) OVER o AS b FROM tr WHERE exit_ts IS NOT NULL WINDOW o AS (PARTITION BY strategy_id ORDER BY exit_ts, entry_ts, profit, size ROWS UNBOUNDED PRECEDING))
 SELECT strategy_id, count(*) AS max_losses, round(max(b), 2) AS start_balance, round(min(b), 2) AS least_balance FROM x WHERE profit < 0 GROUP BY strategy_id, run QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY count(*) DESC, run) = 1""")
def a29_streak_balances(spark, sf_dir):
    found = bt.longest_streaks(trades(spark, sf_dir), 10_000_000.0)
    return found.select("strategy_id", "max_losses", r("start_balance", 2).alias("start_balance"), r("least_balance", 2).alias("least_balance"))


@query("""x AS (SELECT unnest([1, 2, 3, 4]) AS k, unnest(['open_price', 'close_price', 'volume', 'low_price']) AS name, unnest([var_pop(open_price), var_pop(close_price), var_pop(volume), var_pop(low_price)]) AS v FROM c),
 p AS (SELECT unnest([2, 3, 3, 4, 4, 4]) AS k, unnest([1, 1, 2, 1, 2, 3]) AS before, unnest([corr(open_price, close_price), corr(open_price, volume), corr(close_price, volume), corr(open_price, low_price), corr(close_price, low_price), corr(volume, low_price)]) AS r FROM c)
 SELECT name FROM x WHERE v > 0.01 AND NOT EXISTS (SELECT 1 FROM p JOIN x b ON b.k = p.before WHERE p.k = x.k AND b.v > 0.01 AND abs(p.r) > 0.4)""")
def p8_selected(spark, sf_dir):
    kept = pl.selected(candles(spark, sf_dir), ["open_price", "close_price", "volume", "low_price"], 0.01, 0.4)
    return spark.createDataFrame([(name,) for name in kept], "name string")


@query("""x AS (SELECT symbol, count(*) AS n, count(*) FILTER (volume > 2) AS k, max(timestamp) FILTER (volume > 2) AS upto, min(timestamp) AS earliest FROM c GROUP BY 1)
 SELECT symbol, CASE WHEN k > 0 AND n >= 30 THEN greatest(upto - INTERVAL 30 HOUR, earliest) END AS warm_up_start, CASE WHEN k > 0 AND n >= 30 THEN upto END AS warm_up_end FROM x WHERE k < n AND k > 0""")
def a15_warm_up(spark, sf_dir):
    last = candles(spark, sf_dir).where("volume > 2").groupBy("symbol", "timeframe").agg(F.max("timestamp").alias("last_present"))
    found = analysis(spark, sf_dir).where("timeframe = '1h'").join(last, ["symbol", "timeframe"], "left")
    return cov.warm_up(found, cov.availability(candles(spark, sf_dir)), "1h", 30)
