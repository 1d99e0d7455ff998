"""Further registered queries with their SQL: configuration, names, joins of frames, coverage decisions, the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import scalar
from tickloom.functions.timeframe import period_start_by
from tickloom.operators import backtest as bt
from tickloom.operators import coverage as cov
from tickloom.operators import ordered
from tickloom.plans import pipelines as pl
from tickloom.plans.queries import candles, query, r, several, ticks, trades
from tickloom.session import shared_folder, table
from tickloom.sources import candles as cs
from tickloom.sources import feature_store as fs


@query("""x AS (SELECT strategy_id, exit_ts::DATE AS day, sum(profit) AS p FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1, 2)
 SELECT strategy_id, day, round(-p / 1000, 9) AS loss_pct, row_number() OVER (PARTITION BY strategy_id ORDER BY day) AS n FROM x WHERE p < -5000 QUALIFY n <= 3""")
def t4_first_violations(spark, sf_dir):
    days = bt.daily_loss(trades(spark, sf_dir), 100_000)
    return bt.first_violations(days).select("strategy_id", "day", r("loss_pct", 9).alias("loss_pct"), F.col("n").cast("long").alias("n"))


# Share of candles in which a column moved, as the coverage of two columns of one feature.
BY_COLUMN = """x AS (SELECT symbol, count(*) AS n, count(*) FILTER (close_price > open_price) AS a, count(*) FILTER (high_price > low_price) AS b FROM c GROUP BY 1)"""


@query(BY_COLUMN + """ SELECT symbol, column_index, round(pct, 6) AS coverage_pct FROM (
 SELECT symbol, 0 AS column_index, 100.0 * a / n AS pct FROM x UNION ALL SELECT symbol, 1, 100.0 * b / n FROM x UNION ALL SELECT symbol, 2, 100.0 * b / n FROM x)
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pct = 100 DESC, pct DESC, column_index) = 1""")
def a8_best_column(spark, sf_dir):
    n = F.count(F.lit(1))
    up, wide = 100.0 * F.count_if(F.col("close_price") > F.col("open_price")) / n, 100.0 * F.count_if(F.col("high_price") > F.col("low_price")) / n
    shares = candles(spark, sf_dir).groupBy("symbol").agg(F.array(up, wide, wide).alias("pcts"))
    rows = shares.select("symbol", F.lit("1h").alias("timeframe"), F.lit("moved").alias("feature"), F.posexplode("pcts").alias("column_index", "coverage_pct"))
    return cov.best_column(rows.withColumn("fully_covered", F.col("coverage_pct") == 100)).select("symbol", "column_index", r("coverage_pct").alias("coverage_pct"))


ANALYSIS = "x AS (SELECT symbol, '1h' AS timeframe, 100.0 * count(*) FILTER (volume > 2) / count(*) AS pct, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT symbol, '4h', 100.0 * count(*) FILTER (volume > 2) / count(*), count(*) FROM q GROUP BY 1)"


def analysis(spark, sf_dir):
    """Coverage of each symbol's candles of more than two ticks, in two timeframes."""
    n, busy = F.count(F.lit(1)), F.count_if(F.col("volume") > 2)
    rows = several(spark, sf_dir).where("timeframe IN ('1h', '4h')").groupBy("symbol", "timeframe").agg(n.alias("n_expected"), busy.alias("n_present"), (100.0 * busy / n).alias("coverage_pct"))
    return rows.withColumns({"feature": F.lit("busy"), "fully_covered": F.col("n_present") == F.col("n_expected")})


@query(ANALYSIS + " SELECT DISTINCT symbol, 'busy' AS feature FROM x WHERE pct < 100")
def u5_needed_features(spark, sf_dir):
    return cov.needed_features(analysis(spark, sf_dir))


@query(ANALYSIS + """ SELECT symbol, '1h' AS timeframe, f AS feature, CASE WHEN f = 'busy' THEN n ELSE 0 END AS n_expected, CASE WHEN f = 'busy' THEN round(pct, 6) ELSE 0.0 END AS coverage_pct
 FROM x, (SELECT unnest(['busy', 'calm']) AS f) WHERE timeframe = '1h'""")
def a17_without_data(spark, sf_dir):
    requested = candles(spark, sf_dir).select("symbol", "timeframe", F.explode(F.array(F.lit("busy"), F.lit("calm"))).alias("feature")).distinct()
    found = cov.without_data(requested, analysis(spark, sf_dir))
    return found.select("symbol", "timeframe", "feature", "n_expected", r("coverage_pct").alias("coverage_pct"))


@query("SELECT event_id, event_type || '_v1_' || md5('{\"user\": \"' || user_id || '\"}') || '_close' AS name, CASE WHEN event_id % 2 = 0 THEN 'observation_features' ELSE 'reward_features' END AS view FROM events")
def x9_x21_names(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    name = scalar.feature_column(F.col("event_type"), F.lit("v1"), F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.lit("close"))
    role = F.when(F.col("event_id") % 2 == 0, "observation_space").otherwise("reward_engineering")
    return rows.select("event_id", name.alias("name"), scalar.view_name(role).alias("view"))


@query("SELECT symbol, timestamp, 'market_data' AS kind, volume::VARCHAR AS volume, 'x' AS meta FROM c")
def x17_x18_envelopes(spark, sf_dir):
    sent = scalar.envelope("market_data", F.col("symbol"), F.col("timestamp"), volume=F.col("volume"))
    context = F.create_map(F.lit("symbol"), F.col("e.context.symbol"), F.lit("venue"), F.lit(None).cast("string"))
    flat = scalar.flat_context(context, F.create_map(F.lit("origin"), F.lit("x")))
    rows = candles(spark, sf_dir).select(sent.alias("e")).select("e", flat.alias("flat")).where("size(flat) = 2")
    return rows.select(F.col("flat")["symbol"].alias("symbol"), F.col("e.context.timestamp").alias("timestamp"), F.col("e.kind").alias("kind"), F.col("e.data")["volume"].alias("volume"), F.col("flat")["meta_origin"].alias("meta"))


def configs(spark, sf_dir):
    """A record for each event: its type as the hash, a version, and its number as the time of its making."""
    rows = table(spark, sf_dir, "events")
    version = F.concat(F.lit("1."), (F.col("event_id") % 50).cast("string"), F.lit("."), F.col("event_id").cast("string"))
    return rows.select("event_id", F.col("event_type").alias("hash"), version.alias("semver"), F.timestamp_seconds("event_id").alias("created_at"))


@query("SELECT event_type AS hash, '1.' || (max(event_id) % 50) || '.' || max(event_id) AS semver FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def s23_upsert_config(spark, sf_dir):
    rows = configs(spark, sf_dir)
    return fs.upsert_config(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id")).select("hash", "semver")


@query("SELECT 'hash' AS by, max(event_id) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) UNION ALL SELECT 'prefix', max(event_id) FROM events WHERE event_id % 50 = 7")
def s24_s25_find_config(spark, sf_dir):
    rows = configs(spark, sf_dir)
    least = rows.agg(F.min("hash")).first()[0] or ""
    by_hash, by_prefix = fs.find_config(rows, least), fs.latest_by_prefix(rows, "1.7.")
    return by_hash.select(F.lit("hash").alias("by"), "event_id").unionByName(by_prefix.select(F.lit("prefix").alias("by"), "event_id"))


@query("SELECT symbol, timestamp AS event_timestamp, close_price, volume FROM c")
def s21_online_projection(spark, sf_dir):
    return fs.online_projection(candles(spark, sf_dir).withColumnRenamed("timestamp", "event_timestamp"), ["volume", "close_price", "absent"])


@query("SELECT symbol, max(timestamp) AS event_timestamp, arg_max(close_price, timestamp) AS close_price FROM c GROUP BY 1")
def s22_push_online(spark, sf_dir):
    rows = candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    early = F.col("event_timestamp") < F.lit("2024-01-15").cast("timestamp")
    return fs.push_online(fs.online(rows.where(early)), rows.where(~early))


@query("SELECT symbol, timestamp AS event_timestamp, close_price FROM c WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10'")
def f8_s19_storable(spark, sf_dir):
    rows = candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    return fs.storable(rows, "2024-01-03", "2024-01-10")


@query("SELECT symbol, timestamp, close_price, volume FROM c")
def f4_context_columns(spark, sf_dir):
    return pl.context_columns(candles(spark, sf_dir), ["symbol", "timestamp", "close_price"], ["volume", "spread"], ["close_price"])


@query("SELECT symbol, timestamp, c.close_price, q.volume AS volume FROM c LEFT JOIN q USING (symbol, timestamp)")
def j6_onto_first(spark, sf_dir):
    key = ["symbol", "timestamp"]
    return ordered.onto_first(candles(spark, sf_dir).select(*key, "close_price"), [candles(spark, sf_dir, "4h").select(*key, "close_price", "volume")], key)


@query("SELECT symbol, timestamp, coalesce(c.close_price, d.close_price) AS close_price, d.low_price FROM (SELECT * FROM c WHERE hour(timestamp) > 5) c FULL JOIN d USING (symbol, timestamp)")
def j8_side_by_side(spark, sf_dir):
    key = ["symbol", "timestamp"]
    hours, days = candles(spark, sf_dir).where("hour(timestamp) > 5").select(*key, "close_price"), candles(spark, sf_dir, "1d").select(*key, "close_price", "low_price")
    return ordered.side_by_side([hours, None, days], key)


@query('SELECT symbol, timestamp AS event_timestamp, open_price AS "Open", high_price AS "High", low_price AS "Low", close_price AS "Close", volume AS "Volume" FROM c')
def f9_feature_frame(spark, sf_dir):
    return cs.feature_frame(candles(spark, sf_dir)).select("symbol", "event_timestamp", "Open", "High", "Low", "Close", "Volume")


@query("SELECT event_id, date_trunc('second', ts) AS event_timestamp FROM events")
def x11_time_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"))
    return cs.time_key(cs.time_key(rows))


@query("SELECT tf AS timeframe, tf = '1h' AS is_base, count(*) AS n FROM (SELECT '1h' AS tf FROM c UNION ALL SELECT '4h' FROM q UNION ALL SELECT '1d' FROM d) GROUP BY 1, 2")
def s2_base_flag(spark, sf_dir):
    return cs.flag_base(several(spark, sf_dir), "1h").groupBy("timeframe", "is_base").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('hour', timestamp) WHEN 1 THEN date_trunc('week', timestamp)::TIMESTAMP ELSE timestamp END AS period FROM t""")
def x1_period_by_column(spark, sf_dir):
    tf = F.when(F.col("event_id") % 3 == 0, "1h").when(F.col("event_id") % 3 == 1, "1w").otherwise("tick")
    return ticks(spark, sf_dir).select("event_id", period_start_by(F.col("timestamp"), tf).alias("period"))


@query("""x AS (SELECT *, timestamp::DATE AS date FROM c) SELECT symbol, timestamp AS event_timestamp, close_price, count(*) OVER (PARTITION BY symbol, date) AS day_rows FROM x
 WHERE date <= (SELECT min(date) + 1 FROM x)""")
def s13_s15_store_round_trip(spark, sf_dir):
    """All candles are stored; the manifest, stored beside them, tells which partitions to load."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    fs.write(rows, f"{folder}/rows")
    fs.manifest(spark.read.parquet(f"{folder}/rows")).write.parquet(f"{folder}/manifest")
    held = spark.read.parquet(f"{folder}/manifest")
    first = held.agg(F.min("date").alias("first"))
    days = held.join(F.broadcast(first), F.datediff("date", "first") <= 1).select("symbol", "date", "n_rows")
    found = fs.load(spark, f"{folder}/rows", [(d["symbol"], str(d["date"])) for d in days.collect()])  # as many as partitions asked for
    named = found.withColumn("date", F.to_date("event_timestamp")).join(F.broadcast(days), ["symbol", "date"])
    return named.select("symbol", "event_timestamp", "close_price", F.col("n_rows").alias("day_rows"))
