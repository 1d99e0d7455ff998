"""Registered queries that keep state in the shared folder: incremental resampling, upserts by batch, late rows, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions import registry
from tickloom.operators import incremental
from tickloom.operators.quality import clean
from tickloom.plans.queries import SERIES, _wilder, candles, query, r, ticks
from tickloom.session import shared_folder, table
from tickloom.sources import candles as cs
from tickloom.sources import messages as ms
from tickloom.sources import router
from tickloom.sources import versioned
from tickloom.streaming import candles as st
from tickloom.streaming import features as sf

SHORT = "symbol, timestamp, open_price, high_price, low_price, close_price, volume"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT *, timestamp = max(timestamp) OVER (PARTITION BY symbol, timeframe) AS is_open FROM (
 SELECT '1h' AS timeframe, {SHORT} FROM c UNION ALL SELECT '4h', {SHORT} FROM q UNION ALL SELECT '1d', {SHORT} FROM d)""")
def r1_r4_incremental(spark, sf_dir):
    """Three runs; each is given all rows up to its time, of which those up to the mark are left out."""
    folder, rows = _folder(spark, "incremental"), clean(ticks(spark, sf_dir))
    ends = rows.agg(F.percentile_approx("timestamp", [0.3, 0.7]).alias("e"), F.max("timestamp").alias("last")).first()
    for end in (*ends.e, ends.last):
        incremental.run(spark, rows.where(F.col("timestamp") <= F.lit(end)), folder, ["1h", "4h", "1d"])
    return incremental.candles(spark, folder)


@query("""SELECT symbol, '1h' AS timeframe, timestamp, CASE WHEN extract('day' FROM timestamp) % 2 = 0 THEN close_price + 1 ELSE close_price END AS close_price, volume FROM c""")
def s4_r13_upsert_batches(spark, sf_dir):
    """Batches 0 and 1 are committed; both come again with other prices, which changes nothing."""
    folder, rows = _folder(spark, "upserts"), candles(spark, sf_dir).drop("source_rows")
    new = rows.where(F.dayofmonth("timestamp") % 2 == 0).withColumn("close_price", F.col("close_price") + 1)
    for number, batch in ((0, rows), (1, new), (0, rows), (1, rows)):
        cs.save(spark, batch, folder, number)
    return versioned.read(spark, folder).select("symbol", "timeframe", "timestamp", "close_price", "volume")


@query("""x AS (SELECT *, CASE WHEN day(timestamp) < 9 THEN 1 WHEN day(timestamp) < 16 THEN 2 WHEN day(timestamp) < 23 THEN 3 ELSE 4 END AS part FROM t WHERE v > 0), y AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN least(part + 2, 4) ELSE part END AS batch FROM x),
 b AS (SELECT symbol, batch, max(max(date_trunc('hour', timestamp))) OVER (PARTITION BY symbol ORDER BY batch) AS top FROM y GROUP BY 1, 2),
 z AS (SELECT y.*, coalesce(date_trunc('hour', timestamp) < (SELECT max(top) FROM b WHERE b.symbol = y.symbol AND b.batch < y.batch), false) AS late FROM y)
 SELECT symbol, date_trunc('hour', timestamp) AS timestamp, late, count(*)::BIGINT AS n, round(sum(v), 4) AS total FROM z GROUP BY 1, 2, 3""")
def r8_late_rows(spark, sf_dir):
    """Ticks in four batches by the day of the month, every tenth of them two batches late: what each hour's candle took, and what came late."""
    folder, rows = _folder(spark, "late"), clean(ticks(spark, sf_dir))
    day = F.dayofmonth("timestamp")
    part = F.when(day < 9, 1).when(day < 16, 2).when(day < 23, 3).otherwise(4)
    batch = F.when(F.col("event_id") % 10 == 0, F.least(part + 2, F.lit(4))).otherwise(part)
    rows.withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/rows")
    for number in range(1, 5):
        incremental.run(spark, spark.read.parquet(f"{folder}/rows").where(F.col("batch") == number), f"{folder}/out", ["1h"], batch=number)
    late = versioned.read(spark, f"{folder}/out/late").select("event_id", F.lit(True).alias("late"))
    told = spark.read.parquet(f"{folder}/rows").join(late, "event_id", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    taken = incremental.candles(spark, f"{folder}/out").select("symbol", "timestamp", "volume")
    hours = told.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("timestamp"), "late").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close_price"), 4).alias("total"))
    # A candle's volume is the number of rows that it took.
    return hours.join(taken, ["symbol", "timestamp"], "left").withColumn("n", F.when(F.col("late"), F.col("n")).otherwise(F.col("volume"))).drop("volume")


@query("SELECT symbol, timestamp, close_price FROM c ORDER BY symbol, timestamp LIMIT 40 OFFSET (SELECT count(*) - 60 FROM c)")
def s7_t2_deep_page(spark, sf_dir):
    rows = candles(spark, sf_dir)
    return cs.page(rows, 40, rows.count() - 60).select("symbol", "timestamp", "close_price")


@query(f"SELECT '1h' AS timeframe, {SHORT} FROM c UNION ALL SELECT '1d', {SHORT} FROM d")
def r10_catch_up(spark, sf_dir):
    """A folder of ticks is caught up with; then the rest of them arrive and the live query takes them from the same
    checkpoint."""
    folder, rows = _folder(spark, "live"), clean(ticks(spark, sf_dir)).drop("event_id")
    middle = rows.agg(F.percentile_approx("timestamp", 0.6)).first()[0]
    rows.where(F.col("timestamp") <= F.lit(middle)).write.parquet(f"{folder}/ticks")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{folder}/ticks")
    live = st.catch_up(source, f"{folder}/out", ["1h", "1d"], f"{folder}/checkpoint", "1 second")
    rows.where(F.col("timestamp") > F.lit(middle)).coalesce(1).write.mode("append").parquet(f"{folder}/ticks")
    live.processAllAvailable()
    live.stop()
    return incremental.candles(spark, f"{folder}/out").drop("is_open")


@query("""x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'closes' WHEN event_id % 4 = 1 THEN 'users' WHEN event_id % 4 = 2 THEN 'nobody' END AS topic, event_id % 5 = 0 AS broken, event_id % 3 AS attempt, value, user_id FROM events)
 SELECT topic, 'handled' AS outcome, NULL AS attempt, count(*) AS n, round(sum(CASE WHEN topic = 'closes' THEN value ELSE user_id END), 4) AS total FROM x WHERE topic IN ('closes', 'users') AND NOT broken GROUP BY 1
 UNION ALL SELECT NULL, CASE WHEN attempt < 2 THEN 'retry' ELSE 'dead' END, attempt + 1, count(*), NULL FROM x WHERE topic IS NULL OR topic = 'nobody' OR broken GROUP BY 2, 3""")
def s30_r11_handlers(spark, sf_dir):
    """Events as messages of three topics and none; two have handlers, which add up what they get."""
    k = F.col("event_id") % 4
    body = F.when(F.col("event_id") % 5 == 0, F.lit("broken")).otherwise(F.to_json(F.struct("value", "user_id")))
    batch = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("key"), body.alias("value"), F.when(k == 0, "closes").when(k == 1, "users").when(k == 2, "nobody").alias("topic"), (F.col("event_id") % 3).alias("attempt"),
    )
    folder = _folder(spark, "handled")

    def adding(topic: str, field: str):
        row = lambda rows: rows.agg(F.lit(topic).alias("topic"), F.lit("handled").alias("outcome"), F.lit(None).cast("long").alias("attempt"), F.count(F.lit(1)).alias("n"), F.round(F.sum(field), 4).alias("total"))
        return lambda rows: row(rows).write.parquet(f"{folder}/{topic}")

    failed = ms.dispatched(batch, {"closes": ("value double", adding("closes", "data.value")), "users": ("user_id long", adding("users", "data.user_id"))}, 2, "retry", "dead")
    counts = failed.groupBy(F.lit(None).cast("string").alias("topic"), F.col("target").alias("outcome"), F.col("next_attempt").alias("attempt")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))
    return counts.unionByName(spark.read.parquet(f"{folder}/closes")).unionByName(spark.read.parquet(f"{folder}/users").withColumn("total", F.col("total").cast("double")))


@query("""x AS (SELECT symbol, timestamp, close_price, day(timestamp) AS k, hour(timestamp) % 2 = 0 AND day(timestamp) IN (5, 6, 8) AS again FROM c), b AS (SELECT symbol, min(timestamp) AS lo, max(timestamp) AS hi FROM x WHERE again GROUP BY 1)
 SELECT x.symbol, timestamp AS event_timestamp, close_price + CASE WHEN again THEN 2 WHEN k > 15 THEN 1 ELSE 0 END AS close_price
 FROM x LEFT JOIN b USING (symbol) WHERE k <= 20 AND (again OR lo IS NULL OR NOT timestamp BETWEEN lo AND hi)""")
def s19_store_router(spark, sf_dir):
    """Two incremental batches that overlap, of which the first one's rows stay, and a backfill that replaces all in its
    interval; the last batch comes twice."""
    folder, rows = _folder(spark, "router"), candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price")
    day, price = F.dayofmonth("event_timestamp"), F.col("close_price")
    router.route(spark, rows.where(day <= 15), folder, "incremental", "close_price", 0)
    router.route(spark, rows.where(day.between(10, 20)).withColumn("close_price", price + 1), folder, "incremental", "close_price", 1)
    again = rows.where((F.hour("event_timestamp") % 2 == 0) & day.isin(5, 6, 8)).withColumn("close_price", price + 2)
    router.route(spark, again, folder, "backfill", "close_price", 2)
    router.route(spark, rows, folder, "backfill", "close_price", 2)
    return router.offline(spark, folder).select("symbol", "event_timestamp", "close_price")


@query("""SELECT 'prices' AS view, symbol, max(timestamp) AS event_timestamp, 'close_price' AS name, arg_max(close_price, timestamp) AS value FROM c
 WHERE day(timestamp) <= 20 OR symbol = (SELECT min(symbol) FROM c) GROUP BY 2
 UNION ALL SELECT 'volumes', symbol, max(timestamp), 'volume', arg_max(volume, timestamp)::DOUBLE FROM c WHERE day(timestamp) <= 20 GROUP BY 2""")
def s20_s21_views(spark, sf_dir):
    """Two views are materialised by two intervals; later rows of one symbol are pushed into its view of prices, then older
    ones, which change nothing."""
    folder, rows = _folder(spark, "views"), candles(spark, sf_dir).select("symbol", F.col("timestamp").alias("event_timestamp"), "close_price", "volume")
    day = F.dayofmonth("event_timestamp")
    router.route(spark, rows.where(day <= 20), f"{folder}/offline", "incremental", "close_price")
    symbols = rows.select("symbol").distinct()
    kinds = (("prices", "observation", ["close_price", "absent"]), ("volumes", "context", ["volume"]), ("nothing", "observation", ["absent"]))
    views = None
    for view, role, columns in kinds:
        made = symbols.select(F.lit(view).alias("view"), F.lit(role).alias("feature_role"), "symbol", F.array(*map(F.lit, columns)).alias("columns"))
        views = made if views is None else views.unionByName(made)
    ends = rows.agg(F.min("event_timestamp").alias("first"), F.max(F.when(day <= 10, F.col("event_timestamp"))).alias("middle"), F.max("event_timestamp").alias("last"), F.min("symbol").alias("symbol")).first()
    router.materialise(spark, f"{folder}/offline", views, f"{folder}/online", ends["first"], ends["middle"])
    router.materialise(spark, f"{folder}/offline", views, f"{folder}/online", ends["middle"], ends["last"])
    for part in (day > 20, day <= 3):
        router.push(spark, rows.where(part), views, "observation", ends["symbol"], f"{folder}/online")
    return router.online(spark, f"{folder}/online").select("view", "symbol", "event_timestamp", F.explode("values").alias("name", "value"))


VALUES = ("rsi_14", "close_value", "bb_upper", "atr_5")


@query(f"""{SERIES}, g AS (SELECT symbol, i, timestamp, close_price AS close_value, greatest(s, 0) AS up, greatest(-s, 0) AS down, greatest(high_price - low_price, coalesce(abs(high_price - b), 0), coalesce(abs(low_price - b), 0)) AS tr,
  CASE WHEN count(*) OVER v >= 20 THEN round(avg(close_price) OVER v + 2 * stddev_pop(close_price) OVER v, 6) END AS bb_upper FROM x WINDOW v AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)),
 {_wilder('g', 'up', 1, 14, 'u')}, {_wilder('g', 'down', 1, 14, 'w')}, {_wilder('g', 'tr', 0, 5, 'a')},
 f AS (SELECT g.symbol, g.timestamp, round(CASE WHEN w.w <= 1e-12 * greatest(u.u, 1e-300) THEN 100.0 ELSE 100 - 100 / (1 + u.u / w.w) END, 6) AS rsi_14, round(close_value, 6) AS close_value, bb_upper, round(a.a, 6) AS atr_5
  FROM g LEFT JOIN u USING (symbol, i) LEFT JOIN w USING (symbol, i) LEFT JOIN a USING (symbol, i)),
 h AS (SELECT make_timestamp((epoch_us(min(timestamp)) + epoch_us(max(timestamp))) // 2) AS middle FROM f)
 SELECT 'table' AS way, * FROM f UNION ALL SELECT 'stream', * FROM f
 UNION ALL SELECT 'late', symbol, timestamp, NULL, NULL, NULL, NULL FROM f, h WHERE timestamp <= middle AND hour(timestamp) % 7 = 0
 UNION ALL SELECT * FROM (SELECT 'latest', * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1)""")
def e1_e3_r9_one_definition(spark, sf_dir):
    """Four features of every candle over the table, of each symbol's newest candle, and in a stream that stops in the middle and goes
    on; when it goes on, some candles of the first half come again."""
    folder, rows = _folder(spark, "features"), candles(spark, sf_dir)
    wanted = [("rsi", {}), ("close", {}), ("bollinger", {"length": 20}), ("atr", {"length": 5})]
    ends = rows.agg(F.min(F.unix_micros("timestamp")).alias("first"), F.max(F.unix_micros("timestamp")).alias("last")).first()
    early = F.unix_micros("timestamp") <= ((ends["first"] or 0) + (ends["last"] or 0)) // 2
    for part in (early, ~early | (F.hour("timestamp") % 7 == 0)):
        rows.where(part).write.mode("append").parquet(f"{folder}/candles")
        made = sf.updates(spark.readStream.schema(rows.schema).parquet(f"{folder}/candles"), wanted)
        st.run_available(made, f"{folder}/out", f"{folder}/checkpoint")
    ways = [
        (F.lit("table"), registry.compute(rows, wanted)),
        (F.when(F.col("late"), "late").otherwise("stream"), spark.read.parquet(f"{folder}/out")),
        (F.lit("latest"), registry.latest(rows, wanted)),
    ]
    out = None
    for way, frame in ways:
        told = frame.select(way.alias("way"), "symbol", "timestamp", *[r(c).alias(c) for c in VALUES])
        out = told if out is None else out.unionByName(told)
    return out


@query(f"""{SERIES}, g AS (SELECT symbol, i, timestamp, close_price, avg(close_price) OVER (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING) AS line,
  greatest(high_price - low_price, coalesce(abs(high_price - b), 0), coalesce(abs(low_price - b), 0)) AS tr FROM x), {_wilder('g', 'tr', 0, 14, 'a')}
 SELECT g.symbol, g.timestamp, CASE WHEN a.a > 0 THEN round((line - close_price) / a.a, 6) END AS distance FROM g LEFT JOIN a USING (symbol, i)""")
def w7_distance(spark, sf_dir):
    """How far the mean of ten closes is from the close."""
    mean = ind.Trailing(9, lambda w: F.avg("close_price").over(w.rowsBetween(-9, 0)))
    return ind.normalised_distance(ind.trailing_columns(candles(spark, sf_dir), line=mean), "line").select("symbol", "timestamp", r("distance").alias("distance"))
