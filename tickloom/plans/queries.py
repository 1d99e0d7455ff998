"""Registered queries over the given tables, each with the SQL that must give the same rows.

ticks: events by type; candles: ticks resampled; trades: line items with their orders; equity: running daily profit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import indicators as ind
from tickloom.functions import scalar
from tickloom.functions.registry import compute
from tickloom.functions.timeframe import interval, minutes, period_start, provider_timeframe
from tickloom.operators import backtest as bt
from tickloom.operators import coverage as cov
from tickloom.operators import dataset as ds
from tickloom.operators import ordered, quality, stats
from tickloom.operators import resample as rs
from tickloom.plans import pipelines as pl
from tickloom.session import cut, table
from tickloom.sources import candles as cs
from tickloom.sources import feature_store as fs
from tickloom.sources import messages as ms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Views that the SQL below starts from.
WITH = """
t AS (SELECT event_id, event_type AS symbol, ts AS timestamp, value AS v, user_id FROM events),
c AS (SELECT symbol, date_trunc('hour', timestamp) AS timestamp, arg_min(v, timestamp) AS open_price, max(v) AS high_price, min(v) AS low_price,
             arg_max(v, timestamp) AS close_price, count(*)::BIGINT AS volume FROM t WHERE v > 0 GROUP BY 1, 2),
d AS (SELECT symbol, date_trunc('day', timestamp) AS timestamp, arg_min(v, timestamp) AS open_price, max(v) AS high_price, min(v) AS low_price,
             arg_max(v, timestamp) AS close_price, count(*)::BIGINT AS volume FROM t WHERE v > 0 GROUP BY 1, 2),
q AS (SELECT symbol, to_timestamp(floor(epoch(timestamp) / 14400) * 14400)::TIMESTAMP AS timestamp, arg_min(v, timestamp) AS open_price, max(v) AS high_price,
             min(v) AS low_price, arg_max(v, timestamp) AS close_price, count(*)::BIGINT AS volume FROM t WHERE v > 0 GROUP BY 1, 2),
tr AS (SELECT o_orderpriority AS strategy_id, l_returnflag AS symbol, least(l_shipdate, o_orderdate) AS entry_ts,
              CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN NULL ELSE greatest(l_shipdate, o_orderdate) END AS exit_ts,
              l_extendedprice / l_quantity AS entry_price, l_quantity AS size, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END AS direction,
              l_extendedprice * (l_discount - l_tax) AS profit, CASE WHEN l_linenumber = 1 THEN NULL ELSE 0.9 * l_extendedprice / l_quantity END AS stop_loss
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT strategy_id, ts, 1000000 + sum(p) OVER (PARTITION BY strategy_id ORDER BY ts) AS equity
      FROM (SELECT strategy_id, date_trunc('day', exit_ts)::TIMESTAMP AS ts, sum(profit) AS p FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1, 2)),
r AS (SELECT * FROM (SELECT strategy_id, ts, equity / lag(equity) OVER (PARTITION BY strategy_id ORDER BY ts) - 1 AS r FROM e) WHERE r IS NOT NULL)
"""


def query(sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: plain(function(spark, sf_dir))
        if sql is not None:
            ORACLES[function.__name__] = f"WITH {WITH.strip()},\n{sql}" if sql.lstrip().startswith("x AS") else f"WITH {WITH.strip()}\n{sql}"
        return function

    return add


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as in the tables."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)})


def r(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    prices = [F.col("value").alias(c) for c in quality.PRICES]
    return rows.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), *prices, F.lit(1).cast("long").alias("volume"))


def candles(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    return rs.resample(quality.clean(ticks(spark, sf_dir)), tf)


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.roll_up(quality.clean(ticks(spark, sf_dir)), ["1h", "4h", "1d"])


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What a line item alone decides is worked out before the join, so that fewer and narrower columns are shuffled.
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("_ship"), F.coalesce((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), F.lit(False)).alias("_open"),
        price.alias("entry_price"), F.col("l_quantity").alias("size"), F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1).alias("direction"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("profit"), F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(0.9 * price).alias("stop_loss"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("strategy_id"), F.col("o_orderdate").cast("timestamp").alias("_ordered"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "strategy_id", "symbol", F.least("_ship", "_ordered").alias("entry_ts"), F.when(F.col("_open"), F.lit(None)).otherwise(F.greatest("_ship", "_ordered")).alias("exit_ts"),
        "entry_price", "size", "direction", "profit", "stop_loss",
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(trades(spark, sf_dir))


def curve(trades: DataFrame) -> DataFrame:
    """The equity after each day of a strategy. Most queries read it several times, so it is checkpointed: the join that
    trades come from runs once."""
    days = bt.closed(trades).groupBy("strategy_id", F.date_trunc("day", "exit_ts").alias("ts")).agg(F.sum("profit").alias("p"))
    return cut(days.select("strategy_id", "ts", (F.lit(1_000_000) + F.sum("p").over(Window.partitionBy("strategy_id").orderBy("ts"))).alias("equity")))


def return_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.numbered(bt.returns(equity(spark, sf_dir)), ["strategy_id"], "ts", "i").select("strategy_id", "ts", "i", "r")


OHLCV_SQL = "open_price, high_price, low_price, close_price, volume"

# Candles


@query("SELECT symbol, '1h' AS timeframe, timestamp, open_price, high_price, low_price, close_price, volume, volume AS source_rows FROM c")
def a1_resample_1h(spark, sf_dir):
    return candles(spark, sf_dir)


@query("SELECT symbol, '4h' AS timeframe, timestamp, open_price, high_price, low_price, close_price, volume, volume AS source_rows FROM q")
def x1_resample_4h(spark, sf_dir):
    return candles(spark, sf_dir, "4h")


@query("""SELECT symbol, tf AS timeframe, p AS timestamp, arg_min(v, timestamp) AS open_price, max(v) AS high_price, min(v) AS low_price, arg_max(v, timestamp) AS close_price,
 count(*)::BIGINT AS volume, count(*)::BIGINT AS source_rows FROM (
 SELECT *, '5m' AS tf, to_timestamp(floor(epoch(timestamp) / 300) * 300)::TIMESTAMP AS p FROM t WHERE v > 0 UNION ALL
 SELECT *, '15m', to_timestamp(floor(epoch(timestamp) / 900) * 900)::TIMESTAMP FROM t WHERE v > 0 UNION ALL
 SELECT *, '1h', date_trunc('hour', timestamp) FROM t WHERE v > 0 UNION ALL SELECT *, '1d', date_trunc('day', timestamp) FROM t WHERE v > 0 UNION ALL
 SELECT *, '1w', date_trunc('week', timestamp) FROM t WHERE v > 0 UNION ALL SELECT *, '1M', date_trunc('month', timestamp) FROM t WHERE v > 0) GROUP BY 1, 2, 3""")
def a2_many_timeframes(spark, sf_dir):
    return rs.roll_up(quality.clean(ticks(spark, sf_dir)), ["5m", "15m", "1h", "1d", "1w", "1M"])


@query("SELECT symbol, '1h' AS timeframe, timestamp, close_price FROM c QUALIFY timestamp < max(timestamp) OVER (PARTITION BY symbol)")
def a3_complete_candles(spark, sf_dir):
    return rs.complete_only(candles(spark, sf_dir)).select("symbol", "timeframe", "timestamp", "close_price")


@query("""SELECT symbol, tf AS timeframe, count(*) AS candles, sum(volume)::BIGINT AS source_rows, min(timestamp) AS first_candle, max(timestamp) AS last_candle FROM (
 SELECT *, '1h' AS tf FROM c UNION ALL SELECT *, '4h' FROM q UNION ALL SELECT *, '1d' FROM d) GROUP BY 1, 2""")
def a4_a5_resample_stats(spark, sf_dir):
    return rs.stats(several(spark, sf_dir))


@query("SELECT tf AS timeframe, max(timestamp) AS latest FROM (SELECT *, '1h' AS tf FROM c UNION ALL SELECT *, '4h' FROM q UNION ALL SELECT *, '1d' FROM d) GROUP BY 1 UNION ALL SELECT '1w', NULL")
def a6_latest_by_timeframe(spark, sf_dir):
    wanted = spark.createDataFrame([("1h",), ("4h",), ("1d",), ("1w",)], "timeframe string")
    newest = several(spark, sf_dir).groupBy("timeframe").agg(F.max("timestamp").alias("latest"))
    return wanted.join(newest, "timeframe", "left")


def _bad(spark, sf_dir):
    shifted = F.col("high_price") - F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(0.0)
    return ticks(spark, sf_dir).withColumn("high_price", shifted)


@query("SELECT event_id, symbol, timestamp, v AS close_price FROM t WHERE v > 0 AND event_id % 7 <> 0")
def f1_valid_candles(spark, sf_dir):
    return quality.clean(_bad(spark, sf_dir)).select("event_id", "symbol", "timestamp", "close_price")


@query("SELECT event_id, event_id % 7 <> 0 AS ok FROM t")
def f2_consistent_candles(spark, sf_dir):
    return _bad(spark, sf_dir).select("event_id", quality.consistent().alias("ok"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN least(v, v - b) <= 0 THEN 'not_positive' END, CASE WHEN b > 0 THEN 'high_below_low' END,
 CASE WHEN b > 0 THEN 'open_outside' END, CASE WHEN b > 0 THEN 'close_outside' END], lambda s: s IS NOT NULL), ',') AS errors
 FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END AS b FROM t) WHERE b > 0 OR v <= 0""")
def s28_rejected_candles(spark, sf_dir):
    return quality.rejected(_bad(spark, sf_dir)).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT count(*) AS n FROM t WHERE v IS NOT NULL AND symbol IS NOT NULL")
def f3_required_fields(spark, sf_dir):
    return quality.required(ticks(spark, sf_dir), "symbol", "close_price").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, tf AS timeframe, max(timestamp) AS latest FROM (SELECT *, '1h' AS tf FROM c UNION ALL SELECT *, '4h' FROM q UNION ALL SELECT *, '1d' FROM d) GROUP BY 1, 2")
def s5_latest_timestamp(spark, sf_dir):
    return cs.latest_timestamp(several(spark, sf_dir))


@query("SELECT symbol, timestamp, close_price FROM c WHERE symbol IN (SELECT DISTINCT symbol FROM c ORDER BY 1 LIMIT 2) AND timestamp BETWEEN '2024-01-05' AND '2024-01-12'")
def s6_s8_range_scan(spark, sf_dir):
    rows = candles(spark, sf_dir)
    symbols = [x["symbol"] for x in rows.select("symbol").distinct().orderBy("symbol").limit(2).collect()]
    return cs.in_range(rows, symbols, "2024-01-05", "2024-01-12", "1h").select("symbol", "timestamp", "close_price")


@query("SELECT symbol, timestamp, close_price FROM c ORDER BY symbol, timestamp LIMIT 50 OFFSET 100")
def s7_t2_page(spark, sf_dir):
    return cs.page(candles(spark, sf_dir), 50, 100).select("symbol", "timestamp", "close_price")


@query("SELECT symbol, timestamp, close_price, volume FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1")
def s9_j1_latest_candle(spark, sf_dir):
    return cs.latest(candles(spark, sf_dir)).select("symbol", "timestamp", "close_price", "volume")


@query("SELECT count(*) AS record_count, min(timestamp) AS earliest, max(timestamp) AS latest FROM c WHERE symbol = 'click'")
def s10_availability_of(spark, sf_dir):
    return cs.availability_of(candles(spark, sf_dir), "click", "1h")


@query("SELECT DISTINCT tf AS timeframe FROM (SELECT '1h' AS tf FROM c WHERE symbol = 'click' UNION ALL SELECT '4h' FROM q WHERE symbol = 'click' UNION ALL SELECT '1d' FROM d WHERE symbol = 'click')")
def s11_timeframes(spark, sf_dir):
    return cs.timeframes_of(several(spark, sf_dir), "click")


@query("""SELECT symbol, tf AS timeframe, count(*) AS record_count, min(timestamp) AS earliest, max(timestamp) AS latest, date_diff('day', min(timestamp), max(timestamp)) AS span_days
 FROM (SELECT *, '1h' AS tf FROM c UNION ALL SELECT *, '4h' FROM q UNION ALL SELECT *, '1d' FROM d) GROUP BY 1, 2""")
def s12_x14_availability(spark, sf_dir):
    return cov.availability(several(spark, sf_dir)).withColumn("span_days", F.datediff("latest", "earliest").cast("long"))


@query("""SELECT symbol, '1h' AS timeframe, timestamp, CASE WHEN extract('day' FROM timestamp) % 2 = 0 THEN close_price + 1 ELSE close_price END AS close_price, volume FROM c""")
def s4_upsert(spark, sf_dir):
    old = candles(spark, sf_dir).drop("source_rows")
    new = old.where(F.dayofmonth("timestamp") % 2 == 0).withColumn("close_price", F.col("close_price") + 1)
    return cs.upsert(old, new).select("symbol", "timeframe", "timestamp", "close_price", "volume")


@query("SELECT symbol, arg_max(v, timestamp) AS last_close, 1::BIGINT AS last_volume, count(*) AS batch_size FROM t WHERE v > 0 GROUP BY 1")
def s3_p9_ingest_summary(spark, sf_dir):
    return cs.ingest(ticks(spark, sf_dir))[1]


@query("SELECT symbol, timestamp, v AS close_price FROM t QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY v DESC) = 1")
def r7_distinct_rows(spark, sf_dir):
    return rs.distinct_rows(ticks(spark, sf_dir)).select("symbol", "timestamp", "close_price")


# Scalar functions


@query("""SELECT event_id, to_timestamp(floor(epoch(timestamp) / 900) * 900)::TIMESTAMP AS p15, to_timestamp(floor(epoch(timestamp) / 1800) * 1800)::TIMESTAMP AS p30,
 date_trunc('week', timestamp)::TIMESTAMP AS p1w, date_trunc('month', timestamp)::TIMESTAMP AS p1m FROM t""")
def x1_period_starts(spark, sf_dir):
    ts = F.col("timestamp")
    return ticks(spark, sf_dir).select("event_id", period_start(ts, "15m").alias("p15"), period_start(ts, "30m").alias("p30"), period_start(ts, "1w").alias("p1w"), period_start(ts, "1M").alias("p1m"))


@query("""SELECT event_id, tf, m, CASE WHEN m > 0 THEN m || ' minutes' END AS step, tf AS provider FROM (
 SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tick' WHEN 1 THEN '1h' WHEN 2 THEN '1M' ELSE '4h' END AS tf, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 43200 ELSE 240 END AS m FROM t)""")
def x2_x5_timeframe_maps(spark, sf_dir):
    k = F.col("event_id") % 4
    tf = F.when(k == 0, "tick").when(k == 1, "1h").when(k == 2, "1M").otherwise("4h")
    return ticks(spark, sf_dir).select("event_id", tf.alias("tf")).select("event_id", "tf", minutes(F.col("tf")).alias("m"), interval(F.col("tf")).alias("step"), provider_timeframe(F.col("tf")).alias("provider"))


@query("""SELECT p_partkey, upper(replace(replace(s, '-', ''), '/', '')) AS compact, CASE WHEN regexp_matches(upper(s), '^[A-Z0-9]{6,}$') THEN upper(s)[1:3] || '/' || upper(s)[4:] ELSE upper(s) END AS paired
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'usd-' || p_partkey ELSE 'eurusd' || p_partkey END AS s FROM part)""")
def x4_symbols(spark, sf_dir):
    key = F.col("p_partkey")
    s = F.when(key % 2 == 0, F.concat(F.lit("usd-"), key.cast("string"))).otherwise(F.concat(F.lit("eurusd"), key.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", scalar.compact_symbol(F.col("s")).alias("compact"), scalar.paired_symbol(F.col("s")).alias("paired"))


@query("""SELECT event_id, sha256(j)[1:10] AS config_hash, md5(j) AS parameter_md5 FROM (
 SELECT event_id, '{"kind": "' || event_type || '", "user": "' || user_id || '", "weight": "1"}' AS j FROM events)""")
def x6_x7_hashes(spark, sf_dir):
    parameters = F.create_map(F.lit("weight"), F.lit("1"), F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", scalar.config_hash(parameters).alias("config_hash"), scalar.parameter_hash(parameters).alias("parameter_md5"))


@query("SELECT event_id, CASE WHEN event_id % 12 <= 0 THEN 0.0 ELSE least(pow(2.0, event_id % 12 - 1), 300.0) END AS wait FROM events")
def x15_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.backoff_seconds(F.col("event_id") % 12).alias("wait"))


@query("SELECT c_custkey, CAST(CASE WHEN s <= 100000 THEN 10.0 ELSE 8.0 END AS DOUBLE) AS target, round(CAST(s AS DOUBLE) / 100000 * 10, 6) AS lots, greatest(5, least(10, trunc(s / 20000)::INT)) AS open_trades FROM (SELECT c_custkey, c_acctbal * 30 AS s FROM customer)")
def x19_account_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", scalar.account_rules(F.col("c_acctbal") * 30).alias("a"))
    return rows.select("c_custkey", F.col("a.profit_target_pct").alias("target"), r("a.max_lots").alias("lots"), F.col("a.max_open_trades").alias("open_trades"))


@query("""SELECT user_id, datediff('day', min(ts)::DATE, max(ts)::DATE) AS days, datediff('day', min(ts)::DATE, max(ts)::DATE) > 7 AS chunked, datediff('day', min(ts)::DATE, max(ts)::DATE) > 30 AS backfill FROM events GROUP BY 1""")
def x13_request_days(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"))
    return spans.withColumns({"chunked": F.col("days") > 7, "backfill": F.col("days") > 30})


# Indicators

SERIES = "x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i, close_price - lag(close_price) OVER (PARTITION BY symbol ORDER BY timestamp) AS s, lag(close_price) OVER (PARTITION BY symbol ORDER BY timestamp) AS b FROM c)"


def _wilder(source: str, value: str, first: int, n: int, name: str) -> str:
    """SQL for Wilder's average: the seed, then a fold over the list of later values."""
    return f"""{name}_s AS (SELECT symbol, avg({value}) AS seed FROM {source} WHERE i BETWEEN {first} AND {first + n - 1} GROUP BY 1 HAVING count(*) = {n}),
 {name} AS (SELECT symbol, i, CASE WHEN i = {first + n - 1} THEN seed ELSE list_reduce(list_prepend(seed, list({value}) FILTER (i > {first + n - 1}) OVER w), lambda a, y: (a * {n - 1} + y) / {n}) END AS {name}
 FROM {source} JOIN {name}_s USING (symbol) WHERE i >= {first + n - 1} WINDOW w AS (PARTITION BY symbol ORDER BY i))"""


@query(f"""{SERIES}, g AS (SELECT symbol, i, timestamp, greatest(s, 0) AS up, greatest(-s, 0) AS down FROM x), {_wilder('g', 'up', 1, 14, 'u')}, {_wilder('g', 'down', 1, 14, 'w')}
 SELECT g.symbol, g.timestamp, round(CASE WHEN w.w <= 1e-12 * greatest(u.u, 1e-300) THEN 100.0 ELSE 100 - 100 / (1 + u.u / w.w) END, 6) AS rsi FROM g LEFT JOIN u USING (symbol, i) LEFT JOIN w USING (symbol, i)""".replace("w.w <= 1e-12", "w.w <= 1e-12"))
def w1_rsi(spark, sf_dir):
    return ind.rsi(candles(spark, sf_dir)).select("symbol", "timestamp", r("rsi").alias("rsi"))


def _ema(source: str, value: str, n: int) -> str:
    return f"list_reduce(list({value}) OVER w, lambda a, y: a * {1 - 2 / (n + 1)!r} + y * {2 / (n + 1)!r})"


@query(f"""{SERIES}, m AS (SELECT symbol, timestamp, i, {_ema('x', 'close_price', 12)} - {_ema('x', 'close_price', 26)} AS macd FROM x WINDOW w AS (PARTITION BY symbol ORDER BY i))
 SELECT symbol, timestamp, round(macd, 6) AS macd, round({_ema('m', 'macd', 9)}, 6) AS macd_signal FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i)""")
def w2_macd(spark, sf_dir):
    return ind.macd(candles(spark, sf_dir)).select("symbol", "timestamp", r("macd").alias("macd"), r("macd_signal").alias("macd_signal"))


@query("""SELECT symbol, timestamp, CASE WHEN count(*) OVER w >= 20 THEN round(avg(close_price) OVER w, 6) END AS middle, CASE WHEN count(*) OVER w >= 20 THEN round(avg(close_price) OVER w + 2 * stddev_pop(close_price) OVER w, 6) END AS upper
 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS 19 PRECEDING)""")
def w3_bollinger(spark, sf_dir):
    return ind.bollinger(candles(spark, sf_dir)).select("symbol", "timestamp", r("bb_middle").alias("middle"), r("bb_upper").alias("upper"))


@query(f"""{SERIES}, g AS (SELECT symbol, i, timestamp, greatest(high_price - low_price, coalesce(abs(high_price - b), 0), coalesce(abs(low_price - b), 0)) AS tr FROM x), {_wilder('g', 'tr', 0, 14, 'a')}
 SELECT g.symbol, g.timestamp, round(a.a, 6) AS atr FROM g LEFT JOIN a USING (symbol, i)""")
def w4_atr(spark, sf_dir):
    return ind.atr(candles(spark, sf_dir)).select("symbol", "timestamp", r("atr").alias("atr"))


@query("""SELECT symbol, timestamp, round(ln(close_price / lag(close_price, 3) OVER o), 6) AS roc3, count(*) OVER w >= 10 AND max(close_price) OVER w = close_price AS high10, count(*) OVER w >= 10 AND close_price > avg(close_price) OVER w AS above10,
 CASE WHEN count(*) OVER w >= 10 THEN round(volume / avg(volume) OVER w, 6) END AS rvol, CASE WHEN count(*) OVER w >= 10 THEN (list_position(list(close_price) OVER w, max(close_price) OVER w) - 1) / 10.0 END AS place,
 CASE WHEN count(*) OVER w >= 10 THEN len(list_filter(list(close_price) OVER w, lambda z: z < close_price)) / 10.0 END AS pct
 FROM c WINDOW o AS (PARTITION BY symbol ORDER BY timestamp), w AS (PARTITION BY symbol ORDER BY timestamp ROWS 9 PRECEDING)""")
def w5_w10_variations(spark, sf_dir):
    made = ind.trailing_columns(
        candles(spark, sf_dir), roc3=ind.log_change("close_price", 3), high10=ind.is_rolling_high("close_price", 10), above10=ind.above_mean("close_price", 10),
        rvol=ind.relative_volume(10), place=ind.place_of_maximum("close_price", 10), pct=ind.rolling_percentile("close_price", 10),
    )
    return made.select("symbol", "timestamp", r("roc3").alias("roc3"), "high10", "above10", r("rvol").alias("rvol"), "place", "pct")


@query("SELECT symbol, close_price AS close_value FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1")
def w19_e8_latest_feature(spark, sf_dir):
    return cs.latest(compute(candles(spark, sf_dir), [("close", {})])).select("symbol", "close_value")


# Joins over time


@query("""SELECT c.symbol, c.timestamp, c.close_price, round(h.hv, 6) AS "HTF-240_range" FROM c ASOF LEFT JOIN (SELECT symbol, timestamp + INTERVAL 4 HOUR AS ct, high_price - low_price AS hv FROM q) h ON c.symbol = h.symbol AND c.timestamp >= h.ct""")
def j3_higher_timeframe(spark, sf_dir):
    higher = candles(spark, sf_dir, "4h").withColumn("range", F.col("high_price") - F.col("low_price"))
    return ds.merge_higher(candles(spark, sf_dir), higher, 240, ["symbol"]).select("symbol", "timestamp", "close_price", r("`HTF-240_range`").alias("HTF-240_range"))


@query("""SELECT t.event_id, t.symbol, CASE WHEN epoch(t.timestamp) - epoch(c.timestamp) <= 5400 THEN c.close_price END AS close_price FROM t ASOF LEFT JOIN c ON t.symbol = c.symbol AND t.timestamp >= c.timestamp""")
def j2_point_in_time(spark, sf_dir):
    features = candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("feature_ts"), F.col("close_price").alias("feature_close"))
    return ordered.asof(ticks(spark, sf_dir).select("event_id", "symbol", "timestamp"), features, ["symbol"], "timestamp", "feature_ts", 5400).select("event_id", "symbol", F.col("feature_close").alias("close_price"))


@query("SELECT c.symbol, c.timestamp, c.close_price, d.close_price AS day_open_close FROM c LEFT JOIN d USING (symbol, timestamp)")
def j4_context_join(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "timestamp", "close_price").join(candles(spark, sf_dir, "1d").select("symbol", "timestamp", F.col("close_price").alias("day_open_close")), ["symbol", "timestamp"], "left")


@query("SELECT symbol, timestamp, q.volume AS v4, d.volume AS v24 FROM q FULL JOIN d USING (symbol, timestamp)")
def j5_combine_frames(spark, sf_dir):
    frame = lambda tf, name: candles(spark, sf_dir, tf).select("symbol", "timestamp", F.col("volume").alias(name))
    return ordered.side_by_side([frame("4h", "v4"), frame("1d", "v24")], ["symbol", "timestamp"])


@query("SELECT symbol, timestamp, close_price FROM c WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.symbol = c.symbol AND q.timestamp = c.timestamp)")
def j10_s16_new_rows(spark, sf_dir):
    feature = lambda tf: candles(spark, sf_dir, tf).withColumnRenamed("timestamp", "event_timestamp")
    return fs.new_rows(feature("4h"), feature("1h"), "close_price").select("symbol", F.col("event_timestamp").alias("timestamp"), "close_price")


@query("""SELECT symbol, timestamp, volume FROM c WHERE timestamp < '2024-01-10' OR timestamp > (SELECT max(timestamp) FROM q q2 WHERE q2.symbol = c.symbol) UNION ALL SELECT symbol, timestamp, volume FROM q
 WHERE timestamp >= '2024-01-10' UNION ALL SELECT symbol, timestamp, volume FROM c WHERE timestamp >= '2024-01-10' AND timestamp < (SELECT min(timestamp) FROM q q2 WHERE q2.symbol = c.symbol AND q2.timestamp >= '2024-01-10')""")
def s17_replace_interval(spark, sf_dir):
    feature = lambda tf: candles(spark, sf_dir, tf).select("symbol", F.col("timestamp").alias("event_timestamp"), "volume")
    return fs.replaced(feature("1h"), feature("4h").where(F.col("event_timestamp") >= F.lit("2024-01-10").cast("timestamp"))).withColumnRenamed("event_timestamp", "timestamp")


@query("SELECT symbol, timestamp::DATE AS date, min(timestamp) AS min_ts, max(timestamp) AS max_ts, count(*) AS n_rows FROM c GROUP BY 1, 2 HAVING NOT (max(timestamp) < '2024-01-05' OR min(timestamp) > '2024-01-09')")
def s14_s18_manifest(spark, sf_dir):
    return fs.overlapping(fs.manifest(candles(spark, sf_dir).withColumnRenamed("timestamp", "event_timestamp")), "2024-01-05", "2024-01-09")


@query("SELECT symbol, timestamp AS event_timestamp, volume FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1")
def s20_s22_online(spark, sf_dir):
    return fs.online(candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("event_timestamp"), "volume"))


@query("SELECT symbol, timestamp AS event_timestamp, close_price, volume FROM c")
def f13_online_projection(spark, sf_dir):
    return fs.online_projection(candles(spark, sf_dir).withColumnRenamed("timestamp", "event_timestamp"), ["volume", "close_price", "rsi_14"])


# Coverage

GRID = """x AS (SELECT s.symbol, g.g AS timestamp, c.close_price AS value FROM (SELECT DISTINCT symbol FROM c) s,
 (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS g FROM c) g LEFT JOIN c ON c.symbol = s.symbol AND c.timestamp = g.g)"""


def series(spark, sf_dir):
    """Hourly closes of every symbol on the grid from the first candle of the table to the last."""
    rows = candles(spark, sf_dir)
    bounds = rows.agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))
    requests = rows.select("symbol").distinct().join(F.broadcast(bounds))  # one row
    return cov.on_grid(cov.expected(requests, "1h"), rows, ["close_price"])


@query(f"{GRID} SELECT symbol, timestamp, value FROM x")
def j7_x3_grid(spark, sf_dir):
    return series(spark, sf_dir).select("symbol", "timestamp", "value")


@query(f"""{GRID} SELECT symbol, count(*) AS n_expected, count(value) AS n_present, min(timestamp) FILTER (value IS NOT NULL) AS first_present, max(timestamp) FILTER (value IS NOT NULL) AS last_present, round(count(value) * 100.0 / count(*), 6) AS coverage_pct, count(value) = count(*) AS fully_covered FROM x GROUP BY 1""")
def a7_coverage(spark, sf_dir):
    return cov.coverage(series(spark, sf_dir)).select("symbol", "n_expected", "n_present", "first_present", "last_present", r("coverage_pct").alias("coverage_pct"), "fully_covered")


@query(f"""{GRID}, n AS (SELECT symbol, timestamp, CASE WHEN epoch(timestamp) - epoch(lag(timestamp) OVER w) <= 5400 THEN 0 ELSE 1 END AS b FROM x WHERE value IS NULL WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
 m AS (SELECT symbol, timestamp, sum(b) OVER (PARTITION BY symbol ORDER BY timestamp) AS run FROM n) SELECT symbol, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) AS n_missing FROM m GROUP BY symbol, run""")
def a9_missing_periods(spark, sf_dir):
    return cov.missing_periods(series(spark, sf_dir), "1h").select("symbol", "gap_start", "gap_end", "n_missing")


@query(f"""{GRID}, h AS (SELECT symbol, min(timestamp) FILTER (value IS NOT NULL) AS f, count(*) AS n FROM x GROUP BY 1), l AS (SELECT symbol, count(*) FILTER (timestamp < f) AS k FROM x JOIN h USING (symbol) GROUP BY 1)
 SELECT symbol, count(*) AS n FROM x JOIN h USING (symbol) JOIN l USING (symbol) WHERE NOT (coalesce(timestamp < f, false) AND k < 0.05 * h.n) GROUP BY 1""")
def a10_warm_up_nulls(spark, sf_dir):
    return cov.without_warm_up(series(spark, sf_dir)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{GRID}, k AS (SELECT symbol, count(value) * 100.0 / count(*) AS p FROM x GROUP BY 1) SELECT round(avg(p), 6) AS mean_pct, count(*) FILTER (p >= 100) AS n_full, count(*) FILTER (p > 0 AND p < 100) AS n_partial, count(*) FILTER (p <= 0) AS n_missing FROM k""")
def a11_a12_overall(spark, sf_dir):
    return cov.overall(cov.coverage(series(spark, sf_dir))).select(r("mean_pct").alias("mean_pct"), "n_full", "n_partial", "n_missing")


@query(f"""{GRID}, k AS (SELECT symbol, count(value) * 100.0 / count(*) AS p FROM x GROUP BY 1) SELECT symbol, p >= 99 AS is_full, p > 0 AND p < 99 AS is_partial, p < 99 AS needs_computation FROM k""")
def a13_near_full(spark, sf_dir):
    return cov.buckets(cov.coverage(series(spark, sf_dir)), 99.0).select("symbol", "is_full", "is_partial", "needs_computation")


@query("""SELECT symbol, greatest(TIMESTAMP '2023-12-01', min(timestamp)) AS adjusted_start, least(TIMESTAMP '2024-01-15', max(timestamp)) AS adjusted_end, true AS is_constrained FROM c GROUP BY 1""")
def a14_j9_constrained(spark, sf_dir):
    rows = candles(spark, sf_dir)
    requests = rows.select("symbol", "timeframe").distinct().withColumns({"start_ts": F.lit("2023-12-01").cast("timestamp"), "end_ts": F.lit("2024-01-15").cast("timestamp")})
    return cov.constrained(requests, cov.availability(rows)).select("symbol", "adjusted_start", "adjusted_end", "is_constrained")


@query("""SELECT symbol, tf AS timeframe, (epoch(b) - epoch(l)) / 60 AS lag_minutes, (epoch(b) - epoch(l)) / 60 >= m AS needs_resampling FROM (
 SELECT symbol, '4h' AS tf, 240 AS m, max(timestamp) AS l FROM q GROUP BY 1 UNION ALL SELECT symbol, '1d', 1440, max(timestamp) FROM d GROUP BY 1) JOIN (SELECT symbol, max(timestamp) AS b FROM c GROUP BY 1) USING (symbol)""")
def j11_stale_targets(spark, sf_dir):
    return cov.stale(cov.availability(several(spark, sf_dir)), "1h").select("symbol", "timeframe", "lag_minutes", "needs_resampling")


@query("SELECT symbol, max(timestamp) AS last_ts, epoch(TIMESTAMP '2024-01-30 23:30') - epoch(max(timestamp)) < 3600 AS caught_up FROM c GROUP BY 1")
def a16_catch_up(spark, sf_dir):
    rows = candles(spark, sf_dir).select("symbol", F.lit("close").alias("feature"), "timestamp")
    return cov.catch_up(rows, "2024-01-30 23:30:00", "1h").select("symbol", "last_ts", "caught_up")


@query("""SELECT symbol, tf AS timeframe, count(*) AS n FROM (SELECT symbol, '1h' AS tf FROM c UNION ALL SELECT symbol, '4h' FROM q UNION ALL SELECT symbol, '1d' FROM d) GROUP BY GROUPING SETS ((symbol), (tf))""")
def a18_grouping_sets(spark, sf_dir):
    rows = several(spark, sf_dir)
    return rows.groupingSets([["symbol"], ["timeframe"]], "symbol", "timeframe").agg(F.count(F.lit(1)).alias("n"))


# Data sets


@query("""SELECT symbol, arg_min(s, (-n, s)) AS step_seconds FROM (SELECT symbol, s, count(*) AS n FROM (SELECT symbol, (epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp)))::BIGINT AS s FROM c) WHERE s IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def a35_w15_step(spark, sf_dir):
    return ds.detected_step(candles(spark, sf_dir), ["symbol"])


@query("""SELECT symbol, timestamp, CASE WHEN i < round_even(0.7 * n, 0) THEN 'train' WHEN i < round_even(0.7 * n, 0) + round_even(0.2 * n, 0) THEN 'validation' ELSE 'test' END AS split
 FROM (SELECT symbol, timestamp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM c)""")
def t5_split(spark, sf_dir):
    return ds.split(candles(spark, sf_dir), ["symbol"], 0.7, 0.2, 0.1).select("symbol", "timestamp", "split")


@query("SELECT * FROM (SELECT unnest(['open_price', 'close_price', 'volume']) AS \"column\", unnest([round(var_pop(open_price), 4), round(var_pop(close_price), 4), round(var_pop(volume), 4)]) AS variance FROM c)")
def a33_variances(spark, sf_dir):
    return ds.variances(candles(spark, sf_dir), ["open_price", "close_price", "volume"]).select("column", r("variance", 4).alias("variance"))


@query("SELECT round(corr(open_price, close_price), 6) AS open_close, round(corr(high_price, low_price), 6) AS high_low FROM c")
def a34_correlations(spark, sf_dir):
    found = ds.correlations(candles(spark, sf_dir), [("open_price", "close_price"), ("high_price", "low_price")])
    return found.select(r("open_price_close_price").alias("open_close"), r("high_price_low_price").alias("high_low"))


# Backtests


@query("""SELECT count(*) AS n, count(*) FILTER (exit_ts IS NULL) AS n_open, count(*) FILTER (profit > 0) AS n_win, sum((epoch(exit_ts) - epoch(entry_ts))::BIGINT)::BIGINT AS seconds, round(sum(profit / (size * entry_price)), 4) AS sum_return,
 round(avg(profit * direction / size / abs(entry_price - stop_loss)) FILTER (exit_ts IS NOT NULL AND abs(entry_price - stop_loss) > 0), 6) AS mean_ratio FROM tr""")
def w20_a44_trade_columns(spark, sf_dir):
    return bt.trade_columns(trades(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_open").alias("n_open"), F.count_if("is_winning").alias("n_win"), F.sum("duration_s").alias("seconds"), r(F.sum("trade_return"), 4).alias("sum_return"), r(F.avg("risk_reward")).alias("mean_ratio"))


@query("""SELECT strategy_id, day, round(p, 4) AS day_profit, round(b, 4) AS balance, round(CASE WHEN p < 0 THEN -p / 10000 ELSE 0.0 END, 9) AS loss_pct, p < -50000 AS violates FROM (
 SELECT strategy_id, day, p, 1000000 + sum(p) OVER (PARTITION BY strategy_id ORDER BY day) AS b FROM (SELECT strategy_id, exit_ts::DATE AS day, sum(profit) AS p FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1, 2))""")
def a20_w18_daily_loss(spark, sf_dir):
    return bt.daily_loss(trades(spark, sf_dir), 1_000_000).select("strategy_id", "day", r("day_profit", 4).alias("day_profit"), r("balance", 4).alias("balance"), r("loss_pct", 9).alias("loss_pct"), "violates")


@query("""SELECT strategy_id, round(min(100 * (equity - p) / p), 6) AS max_drawdown_pct FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts) AS p FROM e) GROUP BY 1""")
def a21_w13_drawdown(spark, sf_dir):
    return bt.drawdowns(equity(spark, sf_dir)).groupBy("strategy_id").agg(r(F.min("drawdown_pct")).alias("max_drawdown_pct"))


@query("""x AS (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts) AS p FROM e), y AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY strategy_id ORDER BY ts), true) AS h, 100 * (equity - p) / p AS dd FROM x),
 z AS (SELECT strategy_id, arg_min(ts, dd) AS tt, min(dd) AS dd, arg_min(p, dd) AS tp, max(p - equity) AS am FROM y GROUP BY 1)
 SELECT y.strategy_id, round(any_value(z.dd), 6) AS max_drawdown_pct, round(any_value(am), 4) AS amount, max(ts) FILTER (h AND ts <= tt) AS peak_ts, any_value(tt) AS trough_ts, min(ts) FILTER (ts > tt AND equity >= tp) AS recovered_ts FROM y JOIN z USING (strategy_id) GROUP BY 1""")
def a22_w14_drawdown_detail(spark, sf_dir):
    return bt.max_drawdown(equity(spark, sf_dir)).select("strategy_id", r("max_drawdown_pct").alias("max_drawdown_pct"), r("amount", 4).alias("amount"), "peak_ts", "trough_ts", "recovered_ts")


@query("""x AS (SELECT *, 100 * (equity - 1000000) / 1000000 AS g FROM e), y AS (SELECT strategy_id, max(g) AS m, min(ts) FILTER (g >= 10) AS t0, arg_max(g, ts) AS f FROM x GROUP BY 1),
 z AS (SELECT strategy_id, min(g) AS l FROM x JOIN y USING (strategy_id) WHERE ts >= t0 GROUP BY 1)
 SELECT strategy_id, round(m, 6) AS max_pct, t0 AS reached_ts, round(f, 6) AS final_pct, round(l, 6) AS low_after_pct, coalesce(l >= 10, false) AS maintained FROM y LEFT JOIN z USING (strategy_id)""")
def a23_profit_target(spark, sf_dir):
    return bt.profit_target(equity(spark, sf_dir), 1_000_000).select("strategy_id", r("max_pct").alias("max_pct"), "reached_ts", r("final_pct").alias("final_pct"), r("low_after_pct").alias("low_after_pct"), "maintained")


@query("""SELECT strategy_id, count(DISTINCT day) AS trading_days, (max(day) - min(day) + 1)::INT AS span_days FROM (SELECT strategy_id, entry_ts::DATE AS day FROM tr UNION ALL SELECT strategy_id, exit_ts::DATE FROM tr WHERE exit_ts IS NOT NULL) GROUP BY 1""")
def a24_trading_days(spark, sf_dir):
    return bt.trading_days(trades(spark, sf_dir)).select("strategy_id", "trading_days", "span_days")


@query("""x AS (SELECT strategy_id, symbol, entry_ts AS ts, size * direction AS ch FROM tr UNION ALL SELECT strategy_id, symbol, exit_ts, -size * direction FROM tr WHERE exit_ts IS NOT NULL),
 y AS (SELECT strategy_id, symbol, ts, sum(ch) AS ch FROM x GROUP BY 1, 2, 3), z AS (SELECT strategy_id, max(abs(p)) AS m FROM (SELECT strategy_id, sum(ch) OVER (PARTITION BY strategy_id, symbol ORDER BY ts) AS p FROM y) GROUP BY 1)
 SELECT strategy_id, max(size) AS max_single, count(*) FILTER (size > 40) AS n_over, round(any_value(m), 4) AS max_net FROM tr JOIN z USING (strategy_id) GROUP BY 1""")
def a25_w17_position_size(spark, sf_dir):
    return bt.position_size(trades(spark, sf_dir), 40).select("strategy_id", "max_single", "n_over", r("max_net", 4).alias("max_net"))


@query("SELECT strategy_id, count(*) AS n_trades, count(stop_loss) AS n_with_stop, round(100.0 * count(stop_loss) / count(*), 6) AS compliance_pct FROM tr GROUP BY 1")
def a26_stop_loss(spark, sf_dir):
    return bt.stop_loss(trades(spark, sf_dir)).select("strategy_id", "n_trades", "n_with_stop", r("compliance_pct").alias("compliance_pct"))


@query("SELECT strategy_id, round(sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END), 6) AS profit_factor FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1")
def a27_profit_factor(spark, sf_dir):
    return bt.profit_factor(trades(spark, sf_dir)).select("strategy_id", r("profit_factor").alias("profit_factor"))


@query("SELECT strategy_id, count(*) AS n_closed, count(*) FILTER (profit > 0) AS n_wins, round(count(*) FILTER (profit > 0) / count(*), 6) AS win_rate, round(sum(profit), 4) AS net_profit FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1")
def a28_win_rate(spark, sf_dir):
    return bt.win_rate(trades(spark, sf_dir)).select("strategy_id", "n_closed", "n_wins", r("win_rate").alias("win_rate"), r("net_profit", 4).alias("net_profit"))


@query("""x AS (SELECT *, sum(CASE WHEN profit < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy_id ORDER BY exit_ts, entry_ts, profit, size ROWS UNBOUNDED PRECEDING) AS run FROM tr WHERE exit_ts IS NOT NULL)
 SELECT strategy_id, max(n) AS max_losses FROM (SELECT strategy_id, run, count(*) FILTER (profit < 0) AS n FROM x GROUP BY 1, 2) GROUP BY 1""")
def a29_w16_losing_streaks(spark, sf_dir):
    return bt.max_consecutive_losses(trades(spark, sf_dir))


@query("SELECT strategy_id, round(avg(r) / stddev_samp(r) * sqrt(252.0), 6) AS sharpe, count(*) AS n FROM r GROUP BY 1")
def a30_w11_sharpe(spark, sf_dir):
    return bt.sharpe(equity(spark, sf_dir)).select("strategy_id", r("sharpe").alias("sharpe"), "n")


@query("""x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY ts DESC) <= 756), y AS (SELECT strategy_id, ts, r, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy_id ORDER BY ts)) AS w FROM x),
 z AS (SELECT *, max(w) OVER (PARTITION BY strategy_id ORDER BY ts) AS top FROM y)
 SELECT strategy_id, round(pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1, 6) AS annual_return, round(max(1 - w / top), 6) AS max_dd FROM z GROUP BY 1""")
def a31_w12_calmar(spark, sf_dir):
    return bt.calmar(equity(spark, sf_dir)).select("strategy_id", r("annual_return").alias("annual_return"), r("max_dd").alias("max_dd"))


@query("""x AS (SELECT strategy_id, 'stop_loss' AS "check", count(stop_loss) = count(*) AS passed FROM tr GROUP BY 1 UNION ALL
 SELECT strategy_id, 'profit_factor', sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END) >= 1.0 FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1 UNION ALL
 SELECT strategy_id, 'win_rate', count(*) FILTER (profit > 0) / count(*) >= 0.5 FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1)
 SELECT strategy_id, "check", passed, bool_and(passed) OVER (PARTITION BY strategy_id) AS all_passed FROM x""")
def a32_p7_suite(spark, sf_dir):
    rows = trades(spark, sf_dir)
    checks = {
        "stop_loss": (bt.stop_loss(rows), F.col("passed"), F.col("compliance_pct")),
        "profit_factor": (bt.profit_factor(rows), F.col("profit_factor") >= 1.0, F.col("profit_factor")),
        "win_rate": (bt.win_rate(rows), F.col("win_rate") >= 0.5, F.col("win_rate")),
    }
    return bt.suite(checks).select("strategy_id", "check", "passed", "all_passed")


# Statistics

#: The normal distribution function, for SQL: half the mass outside of (-z, z), for z of 0 or more.
TAIL = """(0.5 * exp(-{z} * {z} / 2) * (1 / (1 + 0.3275911 * {z} / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * {z} / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * {z} / sqrt(2)))
 * (1.421413741 + (1 / (1 + 0.3275911 * {z} / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * {z} / sqrt(2))) * 1.061405429)))))"""


@query(f"""x AS (SELECT strategy_id, count(*) AS n, count(*) - 1.0::DOUBLE AS df, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t FROM r GROUP BY 1),
 y AS (SELECT *, 48 * (df - 0.5) ** 2 AS b, (df - 0.5) * ln(1 + t * t / df) AS y, 1.959963984540054 + 2.3722711 / df + 2.8224983 / df ** 2 + 2.5558497 / df ** 3 AS c FROM x),
 z AS (SELECT *, (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * sqrt(y) AS z, (abs(t) - c * (1 - 1 / (4 * df))) / sqrt(1 + c * c / (2 * df)) AS w FROM y),
 v AS (SELECT *, 2 * {TAIL.format(z="z")} AS p, abs(w) AS u FROM z)
 SELECT strategy_id, n, round(t, 6) AS t, round(p, 5) AS p, round(CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END, 5) AS p_one_tailed, round(CASE WHEN w < 0 THEN {TAIL.format(z="u")} ELSE 1 - {TAIL.format(z="u")} END, 5) AS power FROM v""")
def a36_t_statistic(spark, sf_dir):
    return stats.t_statistic(return_series(spark, sf_dir)).select("strategy_id", "n", r("t").alias("t"), *[r(c, 5).alias(c) for c in ("p", "p_one_tailed", "power")])


@query("""x AS (SELECT strategy_id, count(*) AS n, avg(r) AS m FROM r GROUP BY 1), y AS (SELECT r.strategy_id, any_value(n) AS n, avg((r - m) ** 2) AS m2, avg((r - m) ** 3) AS m3, avg((r - m) ** 4) AS m4 FROM r JOIN x USING (strategy_id) GROUP BY 1)
 SELECT strategy_id, round(m3 / m2 ** 1.5, 4) AS skew, round(m4 / m2 ** 2 - 3, 4) AS excess, round(n / 6 * (m3 ** 2 / m2 ** 3 + (m4 / m2 ** 2 - 3) ** 2 / 4), 3) AS jb,
 round(exp(-n / 12 * (m3 ** 2 / m2 ** 3 + (m4 / m2 ** 2 - 3) ** 2 / 4)), 6) AS p FROM y""")
def a39_jarque_bera(spark, sf_dir):
    found = stats.jarque_bera(return_series(spark, sf_dir))
    return found.select("strategy_id", r("skew", 4).alias("skew"), r("excess", 4).alias("excess"), r("jb", 3).alias("jb"), r("p").alias("p"))


@query(f"""x AS (SELECT *, rank() OVER (PARTITION BY strategy_id ORDER BY abs(r)) + (count(*) OVER (PARTITION BY strategy_id, abs(r)) - 1) / 2.0 AS k FROM (SELECT strategy_id, round(r, 9) AS r FROM r) WHERE r <> 0)
, ti AS (SELECT strategy_id, sum(k ** 3 - k) AS ties FROM (SELECT strategy_id, count(*)::DOUBLE AS k FROM x GROUP BY strategy_id, abs(r)) GROUP BY 1),
 y AS (SELECT strategy_id, sum(k) FILTER (r > 0) AS w_plus, count(*) AS n FROM x GROUP BY 1), v AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS s, abs(s) AS u FROM y JOIN ti USING (strategy_id))
 SELECT strategy_id, round(w_plus, 4) AS w_plus, n, round(s, 6) AS z, round(2 * {TAIL.format(z="u")}, 5) AS p FROM v""")
def a38_wilcoxon(spark, sf_dir):
    found = stats.wilcoxon(return_series(spark, sf_dir).withColumn("r", F.round("r", 9)))
    return found.select("strategy_id", r("w_plus", 4).alias("w_plus"), "n", r("z").alias("z"), r("p", 5).alias("p"))


@query(f"""x AS (SELECT strategy_id, round(r, 9) > 0 AS u, lag(round(r, 9) > 0) OVER (PARTITION BY strategy_id ORDER BY ts) AS b FROM r),
 y AS (SELECT strategy_id, count(*) FILTER (u IS DISTINCT FROM b) AS runs, count(*) FILTER (u) AS n_up, count(*) FILTER (NOT u) AS n_down, 2.0::DOUBLE * n_up * n_down AS ab, n_up + n_down AS n FROM x GROUP BY 1),
 v AS (SELECT *, (runs - ab / n - 1) / sqrt(ab * (ab - n) / (n * n * (n - 1.0::DOUBLE))) AS s, abs(s) AS z FROM y)
 SELECT strategy_id, runs, n_up, n_down, round(s, 6) AS z, round(2 * {TAIL.format(z="z")}, 5) AS p FROM v""")
def a41_runs_test(spark, sf_dir):
    found = stats.runs_test(return_series(spark, sf_dir).withColumn("r", F.round("r", 9)))
    return found.select("strategy_id", "runs", "n_up", "n_down", r("z").alias("z"), r("p", 5).alias("p"))


@query("""x AS (SELECT strategy_id, least(count(*) / 100000.0, 1.0) AS p FROM tr GROUP BY 1), y AS (SELECT *, row_number() OVER (ORDER BY p, strategy_id) AS k, count(*) OVER () AS m FROM x)
 SELECT strategy_id AS test, round(least(p * m, 1.0), 6) AS bonferroni, round(max(least(p * (m - k + 1), 1.0)) OVER (ORDER BY k), 6) AS holm, round(min(least(p * m / k, 1.0)) OVER (ORDER BY k DESC), 6) AS fdr FROM y""")
def a43_corrections(spark, sf_dir):
    tests = trades(spark, sf_dir).groupBy(F.col("strategy_id").alias("test")).agg(F.least(F.count(F.lit(1)) / 100000.0, F.lit(1.0)).alias("p"))
    out = None
    for method in ("bonferroni", "holm", "fdr"):
        one = stats.corrected(tests, method).select("test", r("p_adjusted").alias(method))
        out = one if out is None else out.join(one, "test")
    return out


# As in the reference.
SIMULATIONS = 10_000

DRAWS = """s AS (SELECT strategy_id, row_number() OVER (PARTITION BY strategy_id ORDER BY ts) - 1 AS i, r, count(*) OVER (PARTITION BY strategy_id) AS n FROM r),
 w AS (SELECT DISTINCT strategy_id, n FROM s), k AS (SELECT strategy_id, n, sim, step, ('0x' || md5('7:' || sim || ':' || (step // {block}))[1:8])::BIGINT AS key FROM w, range(100) a(sim), LATERAL (SELECT unnest(range(n)) AS step)),
 dr AS (SELECT k.strategy_id, sim, step, s.r FROM k JOIN s ON s.strategy_id = k.strategy_id AND s.i = (key % greatest(k.n - {block} + 1, 1) + step % {block}) % k.n)"""


@query(f"x AS (SELECT 1), {DRAWS.format(block=1)} SELECT strategy_id, sim, round(avg(r), 9) AS mean_r, count(*) AS n FROM dr GROUP BY 1, 2")
def a37_bootstrap_draws(spark, sf_dir):
    return stats.draws(return_series(spark, sf_dir), 100).groupBy("strategy_id", "sim").agg(r(F.avg("r"), 9).alias("mean_r"), F.count(F.lit(1)).alias("n"))


@query(f"""x AS (SELECT 1), {DRAWS.format(block=5)}, pa AS (SELECT strategy_id, sim, step, 1000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy_id, sim ORDER BY step)) AS v FROM dr)
 SELECT strategy_id, step, round(quantile_cont(v, 0.05), 4) AS lower, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.95), 4) AS upper FROM pa GROUP BY 1, 2""")
def a45_a46_bands(spark, sf_dir):
    paths = stats.simulated_paths(return_series(spark, sf_dir), 100, 1000.0, block=5)
    return stats.bands(paths).select("strategy_id", "step", r("lower", 4).alias("lower"), r("median", 4).alias("median"), r("upper", 4).alias("upper"))


PATH_ENDS = """pa AS (SELECT strategy_id, sim, step, 1000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy_id, sim ORDER BY step)) AS v FROM dr),
 tops AS (SELECT *, 1 - v / greatest(max(v) OVER (PARTITION BY strategy_id, sim ORDER BY step), 1000) AS dd FROM pa), en AS (SELECT strategy_id, sim, arg_max(v, step) AS f, max(dd) AS dd FROM tops GROUP BY 1, 2),
 own AS (SELECT strategy_id, exp(sum(ln(1 + r))) - 1 AS o FROM r GROUP BY 1)
 SELECT strategy_id, round(avg((f > 1000)::INT), 6) AS win_rate, round(avg((f <= 1000)::INT), 6) AS p_loss, round(avg(f), 4) AS mean_final, round(quantile_cont(f, 0.5), 4) AS median_final,
 round(stddev_pop(f), 4) AS sd_final, round(avg(dd), 6) AS mean_dd, round(max(dd), 6) AS worst_dd, round(100 * any_value(o), 6) AS original_return, round(100 * avg((f / 1000 - 1 < o)::INT), 4) AS percentile
 FROM en JOIN own USING (strategy_id) GROUP BY 1"""


def _outcome(paths, series):
    places = {"win_rate": 6, "p_loss": 6, "mean_final": 4, "median_final": 4, "sd_final": 4, "mean_dd": 6, "worst_dd": 6, "original_return": 6, "percentile": 4}
    return stats.outcome(paths, 1000.0, series).select("strategy_id", *[r(c, k).alias(c) for c, k in places.items()])


@query(f"x AS (SELECT 1), {DRAWS.format(block=1)}, {PATH_ENDS}")
def a47_outcome(spark, sf_dir):
    rows = return_series(spark, sf_dir)
    return _outcome(stats.simulated_paths(rows, 100, 1000.0), rows)


@query(f"""x AS (SELECT strategy_id, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM r GROUP BY 1),
 k AS (SELECT strategy_id, m, sd, sim, step, md5('7:' || sim || ':' || step) AS h FROM x, range(100) a(sim), LATERAL (SELECT unnest(range(n)) AS step)),
 dr AS (SELECT strategy_id, sim, step, m + sd * sqrt(-2 * ln((('0x' || h[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * ((('0x' || h[9:16])::BIGINT + 0.5::DOUBLE) / 4294967296)) AS r FROM k), {PATH_ENDS}""")
def a45_parametric_outcome(spark, sf_dir):
    rows = return_series(spark, sf_dir)
    return _outcome(stats.paths(stats.parametric_draws(rows, 100), 1000.0), rows)


@query()
def a37_bootstrap_mean(spark, sf_dir):
    """The mean and the ratio of mean and deviation, tested on the same 10,000 paths."""
    return stats.bootstrap_test(return_series(spark, sf_dir), SIMULATIONS)


@query()
def a42_reality_check(spark, sf_dir):
    return stats.reality_check(return_series(spark, sf_dir), SIMULATIONS)


#: The greatest scaled bootstrap mean of each simulation, and the best observed one.
OBSERVED = "ob AS (SELECT strategy_id, avg(r) AS m, avg(r) / (stddev_samp(r) + 1e-10) AS ratio, count(*) AS n FROM r GROUP BY 1), sm AS (SELECT strategy_id, sim, avg(r) AS dm, avg(r) / (stddev_pop(r) + 1e-10) AS dratio FROM dr GROUP BY 1, 2)"


@query(f"""x AS (SELECT 1), {DRAWS.format(block=1)}, {OBSERVED} SELECT strategy_id, round(any_value(m), 9) AS mean_r, avg((CASE WHEN m > 0 THEN dm - m >= m ELSE dm - m <= m END)::INT) AS p_mean, round(any_value(ratio), 6) AS ratio,
 avg((CASE WHEN ratio > 0 THEN dratio >= ratio ELSE dratio <= ratio END)::INT) AS p_ratio, round(avg(dratio), 6) AS drawn_ratio, round(stddev_pop(dm), 9) AS drawn_sd FROM sm JOIN ob USING (strategy_id) GROUP BY 1""")
def a37_bootstrap_mean_100(spark, sf_dir):
    """As a37_bootstrap_mean, over as many paths as SQL repeats in little time."""
    places = {"mean_r": 9, "p_mean": 9, "ratio": 6, "p_ratio": 9, "drawn_ratio": 6, "drawn_sd": 9}
    return stats.bootstrap_test(return_series(spark, sf_dir), 100).select("strategy_id", *[r(c, k).alias(c) for c, k in places.items()])


@query(f"""x AS (SELECT 1), {DRAWS.format(block=1)}, {OBSERVED}, tops AS (SELECT sim, max((dm - m) * sqrt(n)) AS v FROM sm JOIN ob USING (strategy_id) GROUP BY 1), best AS (SELECT max(m * sqrt(n)) AS best FROM ob)
 SELECT round(any_value(best), 9) AS best, avg((v >= best)::INT) AS p FROM tops, best""")
def a42_reality_check_100(spark, sf_dir):
    return stats.reality_check(return_series(spark, sf_dir), 100).select(r("best", 9).alias("best"), "p")


@query(f"""x AS (SELECT strategy_id, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM r GROUP BY 1), y AS (SELECT strategy_id, n, (r - m) / sd AS s, abs(s) AS z, row_number() OVER (PARTITION BY strategy_id ORDER BY r) AS i FROM r JOIN x USING (strategy_id)),
 v AS (SELECT *, greatest(least(CASE WHEN s < 0 THEN {TAIL.format(z="z")} ELSE 1 - {TAIL.format(z="z")} END, 1 - 1e-12), 1e-12) AS c FROM y),
 w AS (SELECT strategy_id, any_value(n) AS n, (-any_value(n) - sum((2 * i - 1) * ln(c) + (2 * (n - i) + 1) * ln(1 - c)) / any_value(n)) * (1 + 0.75 / any_value(n) + 2.25 / any_value(n) ** 2) AS a FROM v GROUP BY 1)
 SELECT strategy_id, n, round(a, 4) AS a2, round(CASE WHEN a >= 0.6 THEN exp(1.2937 - 5.709 * a + 0.0186 * a * a) WHEN a >= 0.34 THEN exp(0.9177 - 4.279 * a - 1.38 * a * a)
 WHEN a >= 0.2 THEN 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a) ELSE 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a) END, 5) AS p FROM w""")
def a40_anderson_darling(spark, sf_dir):
    return stats.anderson_darling(return_series(spark, sf_dir)).select("strategy_id", "n", r("a2", 4).alias("a2"), r("p", 5).alias("p"))


# Messages


@query("SELECT symbol AS key, count(*) AS messages, sum(volume)::BIGINT AS volume FROM c GROUP BY 1")
def s27_publication(spark, sf_dir):
    sent = ms.candle_messages(candles(spark, sf_dir), per_message=100_000)
    body = F.from_json("value", "candles array<struct<volume: long>>")
    rows = sent.select("key", F.explode(body["candles"]).alias("c"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("messages"), F.sum("c.volume").alias("volume"))


@query("SELECT event_id, coalesce(CASE event_id % 4 WHEN 0 THEN 'completed.preprocess-data.training' WHEN 1 THEN 'completed.preprocess-data.inference' WHEN 2 THEN 'completed.preprocess-data.backfill' END, 'completed.preprocess-data') AS topic FROM events")
def s29_topics(spark, sf_dir):
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", ms.completion_topic(F.when(k == 0, "training").when(k == 1, "inference").when(k == 2, "backfill").otherwise("other")).alias("topic"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'retry' ELSE 'dead' END AS target, event_id % 5 + 1 AS next_attempt, CASE WHEN event_id % 5 < 3 THEN pow(2.0, event_id % 5) END AS delay_seconds FROM events")
def r11_r12_retries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), F.lit("requests").alias("topic"), (F.col("event_id") % 5).alias("attempt"), F.lit("bad").alias("error"))
    return ms.routed(rows, 3, "retry", "dead").select(F.col("key").cast("long").alias("event_id"), "target", "next_attempt", "delay_seconds")


@query("SELECT event_id, event_id % 3 = 0 AS parse_error FROM events")
def x16_s30_decoding(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, F.lit("not json")).otherwise(F.col("props"))
    return ms.decoded(table(spark, sf_dir, "events").select("event_id", value.alias("value")), "k string").select("event_id", "parse_error")


# Pipelines


@query("""SELECT symbol, timestamp AS event_timestamp, close_price AS close_value FROM c WHERE timestamp >= '2024-01-10' AND timestamp <= '2024-01-20'
 AND timestamp < (SELECT max(c2.timestamp) FROM c c2 WHERE c2.symbol = c.symbol AND c2.timestamp <= '2024-01-20') AND NOT EXISTS (SELECT 1 FROM q WHERE q.symbol = c.symbol AND q.timestamp = c.timestamp)""")
def p1_preprocess(spark, sf_dir):
    stored = candles(spark, sf_dir, "4h").select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    made = pl.preprocess(ticks(spark, sf_dir), stored, "1h", [("close", {})], ["close_price"], "2024-01-10", "2024-01-20 00:59:59", 100)
    return made.select("symbol", "event_timestamp", "close_value")


@query("""x AS (SELECT s.symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp FROM (SELECT symbol, greatest(min(timestamp), TIMESTAMP '2024-01-02') AS a, least(max(timestamp), TIMESTAMP '2024-01-12') AS b FROM c GROUP BY 1) s),
 y AS (SELECT x.symbol, x.timestamp, q.close_price AS v FROM x LEFT JOIN q USING (symbol, timestamp)), h AS (SELECT symbol, min(timestamp) FILTER (v IS NOT NULL) AS f, count(*) AS n FROM y GROUP BY 1),
 l AS (SELECT symbol, count(*) FILTER (timestamp < f) AS k FROM y JOIN h USING (symbol) GROUP BY 1)
 SELECT symbol, count(*) AS n_expected, count(v) AS n_present, count(v) < count(*) AS needs_computation FROM y JOIN h USING (symbol) JOIN l USING (symbol) WHERE NOT (coalesce(timestamp < f, false) AND k < 0.05 * h.n) GROUP BY 1""")
def p2_coverage_report(spark, sf_dir):
    stored = candles(spark, sf_dir, "4h").select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    return pl.coverage_report(candles(spark, sf_dir), stored, ["close_price"], "1h", "2024-01-02", "2024-01-12").select("symbol", "n_expected", "n_present", "needs_computation")


@query("""x AS (SELECT c.symbol, c.timestamp, c.close_price, h.v4 FROM c ASOF LEFT JOIN (SELECT symbol, timestamp + INTERVAL 4 HOUR AS ct, high_price AS v4 FROM q) h ON c.symbol = h.symbol AND c.timestamp >= h.ct)
 SELECT symbol, timestamp, v4 AS "HTF-240_top", CASE WHEN i < round_even(0.8 * n, 0) THEN 'train' WHEN i < round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'validation' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM x)""")
def p6_assembled(spark, sf_dir):
    higher = candles(spark, sf_dir, "4h").select("symbol", "timestamp", F.col("high_price").alias("top"))
    return pl.assembled(candles(spark, sf_dir), {"4h": higher}, ["symbol"]).select("symbol", "timestamp", "`HTF-240_top`", "split")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN trim(o_orderpriority) = '' THEN 'symbol is empty' END, CASE WHEN o_custkey % 3 = 0 THEN 'no feature is enabled' END,
 CASE WHEN o_orderkey % 2 = 0 THEN 'end is not after start' END, CASE WHEN o_custkey % 5 = 0 THEN 'a target is not longer than the base' END], lambda s: s IS NOT NULL), '; ') AS errors
 FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_custkey % 5 = 0""")
def f12_request_errors(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("symbol"), F.lit("1h").alias("base"), F.array(F.when(F.col("o_custkey") % 5 == 0, "15m").otherwise("4h")).alias("targets"),
        F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("rsi"))).alias("features"), start.alias("start_ts"),
        F.when(F.col("o_orderkey") % 2 == 0, start).otherwise(start + F.expr("interval 1 day")).alias("end_ts"),
    )
    return pl.checked_requests(requests)[1].select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


@query("SELECT symbol, f AS feature FROM (SELECT DISTINCT symbol FROM c), (SELECT unnest(['bollinger', 'close', 'macd']) AS f) WHERE f <> 'close'")
def f10_f11_to_compute(spark, sf_dir):
    definitions = spark.createDataFrame([("bollinger", True, []), ("close", True, []), ("macd", True, [(True, {"fast": 12}), (False, {"fast": 5})]), ("rsi", False, [])], "feature string, enabled boolean, parameter_sets array<struct<enabled: boolean, parameters: map<string, int>>>")
    symbols = candles(spark, sf_dir).select("symbol").distinct()
    wanted = pl.expanded(definitions, symbols)
    done = wanted.where("feature = 'close'").select("feature", F.lit(100.0).alias("coverage_pct"))
    positions = wanted.select("symbol", "feature").withColumn("position", F.lit(0))
    return cov.to_compute(positions, done).select("symbol", "feature")


from tickloom.plans import more, stored, validation  # noqa: E402,F401  register further queries
